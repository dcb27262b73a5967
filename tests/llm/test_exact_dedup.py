import hashlib
import os
import random
import re
from collections import defaultdict

from casemart.llm import exact_dedup as ed
from casemart.llm.common import scratch


def test_index_inserts_deletes_and_grows():
    index = ed.CuckooIndex(2)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    assert all(index.add(k, n) for n, k in enumerate(keys))
    assert index.buckets > 2 and len(index) == 5000
    assert not any(index.add(k, n + 1) for n, k in enumerate(keys[:100]))
    assert {i: c for _, i, c in index.live() if i < 100} == dict.fromkeys(range(100), 2)
    assert all(index.remove(k) for k in keys[100:3000])
    assert index.find(keys[200]) < 0 and index.find(keys[4000]) >= 0 and len(index) == 2100
    assert index.add(keys[200], 7) and not index.remove(os.urandom(32))


def test_a_false_positive_is_no_hit():
    index = ed.CuckooIndex(4)
    a = bytes(8) + b"a" * 24
    assert index.add(a, 1)
    assert index.find(bytes(8) + b"b" * 24) < 0


def test_groups_against_brute_force(messy, rows):
    by = defaultdict(list)
    for r in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    want = []
    for t, ids in by.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in ed.exact_groups(messy).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_stage_keeps_one_row_of_each(messy, rows, nothing):
    kept = ed.keep_first(messy)
    assert kept.columns == messy.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows})
    assert ed.keep_first(nothing).count() == 0 and ed.exact_groups(nothing).count() == 0


def test_filter_loses_no_digest():
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    live = ed.CuckooFilter.of(keys[:2000])
    live = ed.CuckooFilter.unpacked(live.packed())
    assert all(k in live for k in keys[:2000]) and sum(k in live for k in keys[2000:]) < 20
    for k in keys[:1000]:
        live.remove(k)
    assert all(k in live for k in keys[1000:2000]) and sum(k in live for k in keys[:1000]) < 20
    small = ed.CuckooFilter(2)
    assert not all(map(small.add, keys[:20]))  # no room


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def test_the_next_id_speaks_when_the_smallest_goes(spark):
    path = scratch(spark, "test-index")
    index = ed.StoredIndex(spark, path, buckets=4)
    known = {r.doc_id: r.known for r in index.insert(texts(spark, (1, "a"), (2, "a"), (3, "b"), (4, "c"), (4, "c"))).collect()}
    assert known == {1: False, 2: False, 3: False, 4: False}
    index.withdraw(texts(spark, (1, "a"), (3, "b"), (4, "c"), (9, "c"), (2, "never there")))
    assert sorted((r.keep_id, r.n) for r in index.groups().collect()) == [(2, 1), (4, 1)]
    # another run
    index = ed.StoredIndex(spark, path, buckets=4)
    known = {r.doc_id: r.known for r in index.insert(texts(spark, (1, " a"), (5, "b"), (0, "c"), (None, "d"), (7, None))).collect()}
    assert known == {1: False, 5: False, 0: True, 7: False}
    assert {r.doc_id: r.known for r in index.insert(texts(spark, (8, "a"), (9, "b  "))).collect()} == {8: True, 9: False}
    index.withdraw(texts(spark, (0, "c")))
    got = {r.keep_id: r.n for r in index.groups().collect()}
    assert got == {1: 1, 2: 2, 5: 1, 9: 1, 4: 1, 7: 1}


def test_stored_index_against_a_dict(spark):
    """Random batches come and go; filters overflow on the way and every live digest stays in its filter."""
    rng, index, live = random.Random(8), ed.StoredIndex(spark, scratch(spark, "test-index"), buckets=3), defaultdict(set)
    for size in (5, 400, 60):
        batch = [(rng.randrange(10**6), f"t{rng.randrange(300)}") for _ in range(size)]
        before = {t for t, ids in live.items() if ids}
        said = index.insert(texts(spark, *batch)).collect()
        name = {hashlib.sha256(t.encode()).digest(): t for _, t in batch}
        assert all(r.known == (name[bytes(r.digest)] in before) for r in said)
        for i, t in batch:
            live[t].add(i)
        gone = [(i, t) for t, ids in live.items() for i in ids if rng.random() < 0.4]
        index.withdraw(texts(spark, *gone))
        for i, t in gone:
            live[t].discard(i)
        want = {hashlib.sha256(t.encode()).digest(): (min(ids), len(ids)) for t, ids in live.items() if ids}
        assert {bytes(r.digest): (r.keep_id, r.n) for r in index.groups().collect()} == want
    filters = {r.bucket: ed.CuckooFilter.unpacked(r["filter"]) for r in index.filters().collect()}
    assert all(bytes(r.digest) in filters[r.bucket] for r in index.rows().collect())
