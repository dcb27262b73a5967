import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from casemart.llm import bpe, token_files
from casemart.llm.common import scratch


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_tiktoken(messy, rows, tik):
    got = bpe.digests(messy, *bpe.public_coder()).collect()
    want = []
    for r in rows:
        ids = tik.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_round_trip_and_offsets(unique):
    ids = bpe.encoded(unique, *bpe.public_coder(), offsets=True)
    back = {r.doc_id: r.text for r in bpe.decoded(ids, *bpe.public_coder()).collect()}
    for r in unique.collect():
        assert back[r.doc_id] == (r.text or "")
    for r in ids.collect():
        assert len(r.ids) == len(r.starts) == len(r.ends)
        assert all(a < b for a, b in zip(r.starts, r.ends)) and r.starts == sorted(r.starts)


def test_forgetting_changes_nothing(tik):
    coder = bpe.ByteBPE(*bpe.public_coder())
    coder.pieces.most, coder.pieces.longest = 3, 4
    for t in ("a long sentence of several longish words, é 日本 🎉", "again words of several", "", "again a long sentence"):
        assert coder.encode(t) == tik.encode_ordinary(t)
    assert len(coder.pieces) <= 3 and len(coder.pieces.older) <= 3


def test_random_strings_as_tiktoken(tik):
    rng, coder = random.Random(3), bpe.ByteBPE(*bpe.public_coder())
    alphabets = ("ab", "anba", "aeiou nrst", "0123 .,", "日本é🎉ß \n\t", "ABCabc'sltd ")
    for _ in range(4_000):
        t = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 40)))
        assert coder.encode(t) == tik.encode_ordinary(t), t


def test_files_as_the_tokenizer(spark, unique):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    out = scratch(spark, "test-ids")
    token_files.write_ids(unique, path, out)
    got = {r.doc_id: tuple(r)[1:] for r in token_files.file_digests(spark, out).collect()}
    t, start, n = Tokenizer.from_file(path), 0, 0
    for r in sorted(unique.collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start, n = start + len(ids), n + 1
    assert len(got) == n


def test_files_of_awkward_rows(spark, messy, rows, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    for docs, n in ((messy, len(rows)), (nothing, 0)):
        out = scratch(spark, "test-ids")
        token_files.write_ids(docs, path, out)
        got = sorted(token_files.file_digests(spark, out).collect(), key=lambda r: r.start)
        assert len(got) == n
        assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
        if n:
            assert token_files.read_ids(spark, out).filter("doc_id = 5").count() == 1


def test_latin_chunks_as_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, coder = Tokenizer.from_file(path), token_files.Encoder(path)
    assert coder.chunked
    for x in ("".join(map(chr, range(33, 256))), "I'M 's it'S. 12½ªºµ×", "É́ Σίσυφος ΟΔΟΣ.", "Don't!", "A-b.c"):
        assert np.frombuffer(coder.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_special_strings_are_the_librarys(tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, coder = Tokenizer.from_file(path), token_files.Encoder(path)
    for x in ("a <|endoftext|> b", "a<|endoftext|>B", "A <|ENDOFTEXT|> b", "<|startoftext|><|endoftext|>", "<|endoftext", "É <|endoftext|>\n日本"):
        assert np.frombuffer(coder.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode("a <|endoftext|> b"), "<u4").tolist() == [320, 49407, 321]


def test_another_tokenizer_takes_no_short_cut():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, coder = Tokenizer.from_file(path), token_files.Encoder(path)
    assert not coder.chunked
    for x in ("Some Words, don't  lower them\n", "", "a <|endoftext|> b"):
        assert np.frombuffer(coder.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_a_filter_skips_row_groups(spark):
    """An id between those of the files' statistics that occurs nowhere is excluded by the Bloom filters alone."""
    out = scratch(spark, "test-ids")
    docs = spark.range(60_000).select((F.col("id") * 2).alias("doc_id"), F.lit("a b").alias("text"))
    token_files.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), out)

    def read(wanted: int) -> int:
        """Rows that the scan hands on."""
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            found = token_files.read_ids(spark, out).filter(F.col("doc_id") == wanted).select("ids")
            found.write.format("noop").mode("overwrite").save()
            plan = found._jdf.queryExecution().executedPlan()
            found.collect()
            while plan.children().size():
                plan = plan.children().head()
            return plan.metrics().apply("numOutputRows").value()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")

    assert 0 < read(40_000) <= token_files.ROW_STRIDE
    assert read(40_001) == 0
    files = [f for f in spark.read.orc(out).inputFiles()]
    reader = spark._jvm.org.apache.orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(files[0]), spark._jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getStripes().size() >= 1 and reader.getRowIndexStride() == token_files.ROW_STRIDE
