import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from casemart.llm import periodic_runs
from casemart.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, shortest=6, times=4):
    """Every lag, every stretch of matches."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        x = q
        while x < n:
            y = x
            while y < n and words[y] == words[y - q]:
                y += 1
            if y > x and y - x + q >= max(shortest, times * q):
                found[x - q, y] = min(q, found.get((x - q, y), n))
            x = max(y, x + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text, loop=True):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if loop and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    collapsed = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(collapsed))


def test_random_words_against_brute_force():
    rng, many = random.Random(1), 0
    for _ in range(4_000):
        letters = [b"a", b"b", b"c"][: rng.randint(1, 3)]
        words = [rng.choice(letters) for _ in range(rng.randint(0, 70))]
        root = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(words))
        words = words[:at] + (root * 8)[: rng.randint(0, 60)] + words[at:]
        got = periodic_runs.find_runs(words)
        assert got == brute(words), words
        many += len(got)
    assert many > 3_000


@pytest.mark.parametrize(("shortest", "times"), [(6, 5), (20, 4), (9, 7)])
def test_other_lengths(shortest, times):
    rng = random.Random(shortest)
    for _ in range(500):
        root = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(1, 6))]
        words = [b"a"] * rng.randint(0, 9) + (root * 12)[: rng.randint(0, 70)] + [b"b"] * rng.randint(0, 12)
        assert periodic_runs.find_runs(words, shortest, times) == brute(words, shortest, times)
    with pytest.raises(ValueError, match="four periods"):
        periodic_runs.find_runs([], 6, 3)


def test_few_steps_where_one_word_fills_a_text():
    assert periodic_runs.find_runs([b"x"] * 100_000) == [(0, 100_000, 1)]
    part = [b"a"] * 2_000 + [b"b"]
    runs = periodic_runs.find_runs(part * 6)
    assert (0, 12_006, 2_001) in runs and len(runs) == 7


def test_cells_in_parts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "CELLS", 8)
    words = [b"a", b"b", b"a", b"c"] * 20 + [b"z"] * 9
    assert periodic_runs.find_runs(words) == brute(words)


def test_overlapping_runs_drop_together():
    words = [b"a", b"b"] * 4 + [b"b"] * 7
    runs = periodic_runs.find_runs(words)
    assert runs == brute(words) == [(0, 8, 2), (7, 8, 1)]
    assert periodic_runs.collapse(words, runs) == [b"a", b"b"]


def test_awkward_rows(messy, rows, nothing):
    got = sorted(map(str, ((r.doc_id, len(r.runs), sha(r.collapsed)) for r in periodic_runs.scanned(messy).collect())))
    want = []
    for doc_id, text, *_ in rows:
        if text and text.startswith("x x x"):  # 30,000 times, too long for every lag
            want.append((doc_id, 1, sha("x")))
        else:
            want.append((doc_id, *expected(doc_id, text, loop=False)[1::6]))
    assert got == sorted(map(str, want))
    assert periodic_runs.scanned(nothing).count() == periodic_runs.run_rows(nothing).count() == 0


def test_only_ascii_space_parts_words(spark):
    text = "a b c\x1cd\x85e " * 6
    got = periodic_runs.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_words == 6 and [tuple(r) for r in got.runs] == [(0, 6, 1)]


def test_query_on_a_whole_table(spark, messy, tmp_path):
    for sf in ("/root/testdata/sf0.001", str(tmp_path)):
        if sf == str(tmp_path):
            messy.filter("text is null or length(text) < 20000").write.parquet(f"{sf}/documents.parquet")
        got = QUERIES["op11_periodic_runs"](spark, sf)
        assert got.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
        want = [expected(r.doc_id, r.text) for r in docs]
        assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))
        assert sum(w[1] > 0 for w in want) > 1
