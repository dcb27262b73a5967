import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from casemart.llm import near_dedup as nd

from .conftest import prose


def bag(text):
    w = nd.WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similar(a, b):
    both, either = sum((a & b).values()), sum((a | b).values())
    return both / either if either else 1.0


def classes(rows):
    bags, root = {i: bag(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in bags:
        for j in bags:
            if i < j and similar(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in bags}


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(1)
    k = rng.integers(0, 2**63, 300).astype(np.uint64)
    c = rng.integers(1, 9, 300)
    d = np.maximum(0, c + rng.integers(-2, 3, 300))
    a, b = (k, c), (k[d > 0], d[d > 0])
    s = nd.signatures([a, b], 4096)
    assert abs((s[0] == s[1]).mean() - nd.weighted_jaccard(a, b)) < 0.03
    assert (nd.signatures([(np.empty(0, np.uint64), np.empty(0, int))]) == 0).all()


def test_classes_against_brute_force(spark, rows):
    rng = random.Random(9)
    base = prose(rng, 200).split()
    docs = [(r[0], r[1]) for r in rows[:-2]]
    for k in range(60):  # copies of one base with a few to many edits, around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        docs.append((1000 + k, " ".join(w)))
    got = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == classes(docs)


def test_reachable_against_all_pairs(spark, monkeypatch):
    """The cells and blocks lose no pair that the bounds allow."""
    monkeypatch.setattr(nd, "BLOCK", 7)
    rng = random.Random(4)
    rows = []
    for node in range(120):
        weight = rng.randint(1, 40) if node < 60 else rng.randint(90, 130)
        rows.append((node % 3, node, node // rng.randint(1, 4), 5, weight, rng.randint(-(-4 * weight // 5), weight), 40))
    got = [tuple(r) for r in nd._reachable(spark.createDataFrame(rows, "token long, node long, root long, main long, weight long, left long, often long")).collect()]
    want = {
        (min(p[1], q[1]), max(p[1], q[1])) for p in rows for q in rows
        if p[0] == q[0] and p[2] != q[2] and p[2] != 5 and 5 * min(p[4], q[4]) >= 4 * max(p[4], q[4]) and 9 * min(p[5], q[5]) >= 4 * (p[4] + q[4])
    }
    assert set(got) == want and len(got) == len(want)


def test_a_shingle_of_many_classes_is_not_expanded(spark):
    """40,000 classes that share a shingle and can't be near: the join makes no pair of them, so it ends at once."""
    rows = spark.range(40_000).select(F.lit(1).cast("long").alias("token"), F.col("id").alias("node"), F.col("id").alias("root"), F.lit(-1).cast("long").alias("main"), F.lit(300).cast("long").alias("weight"), F.lit(250).cast("long").alias("left"), F.lit(40_000).cast("long").alias("often"))
    began = time.perf_counter()
    assert nd._reachable(rows).count() == 0
    assert time.perf_counter() - began < 15


def test_awkward_rows(messy, rows, nothing):
    got = nd.near_classes(messy).collect()
    assert len(got) == len(rows)
    assert all(r.kept and r.class_id is None for r in got if r.doc_id is None)
    kept = nd.keep_one(messy)
    assert kept.columns == messy.columns and 0 < kept.count() < len(rows)
    assert nd.near_classes(nothing).count() == 0 and nd.keep_one(nothing).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + k, 501 + k) for k in range(40)]
    nodes = sorted({x for p in links for x in p})
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = nd.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == root
