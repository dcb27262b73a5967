import hashlib
import json
import random
from array import array

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from casemart.llm import prefix_bpe
from casemart.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return prefix_bpe.PrefixBPE(PATH)


def ids_of(coder, text):
    return list(prefix_bpe._numbers(coder.encode(text)))


def test_automaton_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        strings = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 8))} | {b"a", b"b"}
        numbered = {s: n for n, s in enumerate(strings)}
        a = prefix_bpe.SuffixAutomaton(numbered)
        text = bytes(rng.choice(b"ab") for _ in range(30))
        state = length = 0
        for end, byte in enumerate(text, 1):
            while state << 8 | byte not in a.go:
                state = a.link[state]
                length = a.depth[state]
            state, length = a.go[state << 8 | byte], length + 1
            got = [n for n, size in a.ends[state] if size <= length]
            want = [numbered[s] for s in sorted(strings, key=len, reverse=True) if text[:end].endswith(s)]
            assert got == want


def test_each_token_is_its_own_encoding(coder):
    assert all(coder.encode_piece(t) == [i] for t, i in coder.ids.items())


def test_pairs_against_the_library(coder, library):
    """Two tokens fit exactly where the library's merges leave them alone."""
    rng, merge = random.Random(4), library.model.tokenize
    spelt = {i: t for t, i in library.get_vocab().items()}
    some = [rng.choice(list(coder.ids.values())) for _ in range(400)] + list(range(300))
    for _ in range(20_000):
        a, b = rng.choice(some), rng.choice(some)
        assert coder.fits(a, b) == ([t.id for t in merge(spelt[a] + spelt[b])] == [a, b])


def test_random_strings_as_the_library(coder, library):
    rng = random.Random(3)
    alphabets = ("ab", "a", "anba", "aeiou nrst", "0123 .,", "日本é🎉ß \n\t", "ABCabc'sltd ", "<|endoftext|>", " \n", "-=_ ")
    for _ in range(6_000):
        t = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 40)))
        t = t[:5] + "<|endoftext|>" * rng.randint(1, 2) + t[5:] if rng.random() < 0.1 else t
        want = library.encode(t, add_special_tokens=False).ids
        assert ids_of(coder, t) == want, t
        assert coder.decode(array("I", want)) == library.decode(want, skip_special_tokens=False) == t


def test_character_classes_as_the_library(coder, library):
    """One of each range of 61 code points, in all positions that the split pattern tells apart."""
    for point in [p for p in range(0, 0x110000, 61) if not 0xD800 <= p < 0xE000]:
        c = chr(point)
        t = f"a{c}1{c} {c}."
        assert ids_of(coder, t) == library.encode(t, add_special_tokens=False).ids, hex(point)


def test_one_piece_of_a_whole_text(coder, library):
    for t in ("a" * 100_000, "ab" * 30_000 + "b", "=" * 50_001):
        assert ids_of(coder, t) == library.encode(t, add_special_tokens=False).ids


def test_tokens_out_of_order_are_decoded_as_the_library(coder, library):
    rng = random.Random(8)
    for _ in range(2_000):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 6))]
        assert coder.decode(array("I", ids)) == library.decode(ids, skip_special_tokens=False)


def test_forgetting_changes_nothing(library):
    coder = prefix_bpe.PrefixBPE(PATH)
    coder.pieces.most, coder.pieces.longest = 3, 4
    for t in ("a long sentence of several longish words, é 日本 🎉", "again words of several", "", "again a long sentence"):
        assert ids_of(coder, t) == library.encode(t, add_special_tokens=False).ids
    assert len(coder.pieces) <= 3


def expected(rows, library):
    out = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(map(str, out))


def test_awkward_rows(messy, rows, nothing, library):
    assert sorted(str(tuple(r)) for r in prefix_bpe.digests(messy, PATH).collect()) == expected(rows, library)
    assert prefix_bpe.digests(nothing, PATH).count() == 0


def test_round_trip(unique):
    ids = prefix_bpe.encoded(unique, PATH)
    back = {r.doc_id: r.text for r in prefix_bpe.decoded(ids, PATH).collect()}
    assert back == {r.doc_id: r.text or "" for r in unique.collect()}


def test_query_on_a_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op13_prefix_bpe"](spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(str(tuple(r)) for r in got.collect()) == expected(rows, library)


def test_other_tokenizers_are_refused(tmp_path):
    with open(PATH) as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="without further rules"):
        prefix_bpe.PrefixBPE(str(tmp_path / "t.json"))
