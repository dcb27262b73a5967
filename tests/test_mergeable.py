import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from casemart.operators import mergeable
from casemart.plans import slices

KEYS = ["ibge_code", "ano", "semestre"]


def make(seed, n=1_500):
    rng = random.Random(seed)
    return [(rng.choice("ABCD"), rng.randint(2018, 2022), rng.randint(1, 2), None if rng.random() < 0.05 else f"c{rng.randint(0, 300)}", rng.random() < 0.9, rng.choice([True, False, None])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "ibge_code string, ano long, semestre long, id string, reliable boolean, penal boolean").repartition(5)


def tables(fact, known=None):
    return mergeable.complaint_tables(fact, KEYS, "id", F.col("reliable"), F.col("penal"), known)


def brute(rows, where=lambda r: True, by=lambda r: ()):
    sums = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for r in filter(where, rows):
        if r[4] and r[3]:
            sums[by(r)][r[3]][0] += 1
            sums[by(r)][r[3]][1] += bool(r[5])
    return {k: (len(v), sum(p > 0 for _, p in v.values()), sum(2 * p > n for n, p in v.values())) for k, v in sums.items()}


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_any_choice_is_exact(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(mergeable, "BLOCK", block)
    rows = make(block % 100)
    stored = mergeable.save(tables(frame(spark, rows)), str(tmp_path), ["ano"])
    numbers = [r.number for r in stored.numbers.collect()]
    assert sorted(numbers) == list(range(len({r[3] for r in rows if r[3] and r[4]})))
    for where, column in ((lambda r: r[1] in (2018, 2021), F.col("ano").isin(2018, 2021)), (lambda r: r[0] != "B" and r[2] == 1, (F.col("ibge_code") != "B") & (F.col("semestre") == 1)), (lambda r: True, None)):
        got = {(r.ibge_code,): tuple(r)[1:] for r in mergeable.merged(stored, ["ibge_code"], column).collect()}
        assert got == brute(rows, where, lambda r: (r[0],))
        assert tuple(mergeable.merged(stored, [], column).first()) == brute(rows, where)[()]
    rough = mergeable.merged(stored, ["ano"], sketched=True).collect()
    assert all(abs(r.estimate - r.denuncias_unicas) <= max(1, 0.08 * r.denuncias_unicas) for r in rough)


def test_numbers_of_one_key_lie_together(spark):
    rows = [(p, 2020, 1, f"{p}{k}", True, True) for p in "ABC" for k in range(50)]
    numbers = {r.id: r.number for r in tables(frame(spark, rows)).numbers.collect()}
    for n, p in enumerate("ABC"):
        assert sorted(v for k, v in numbers.items() if k[0] == p) == list(range(50 * n, 50 * n + 50))


def test_known_numbers_stay(spark, tmp_path):
    rows = make(3)
    early = [r for r in rows if r[1] < 2021]
    old = mergeable.save(tables(frame(spark, early)), str(tmp_path / "a"))
    new = mergeable.save(tables(frame(spark, rows), known=old.numbers), str(tmp_path / "b"))
    before, after = ({r.id: r.number for r in t.numbers.collect()} for t in (old, new))
    assert before.items() <= after.items() and sorted(after.values()) == list(range(len(after)))
    assert tuple(mergeable.merged(new, []).first()) == brute(rows)[()]


def test_nothing(spark):
    none = tables(frame(spark, []))
    assert mergeable.merged(none, ["ano"]).count() == 0
    assert tuple(mergeable.merged(none, [], sketched=True).first()) == (0, 0, 0, 0, 0)


def test_slice_counts_a_complaint_once(spark):
    rows = [("A", 2020, 1, "x", True, True), ("A", 2020, 2, "x", True, False), ("A", 2021, 1, "x", True, False), ("A", 2021, 1, "y", True, True)]
    fact = frame(spark, rows)
    annual = spark.createDataFrame([("A", "a", "r", "i", 1000, y, h, n, n, n, n) for y, h, n in ((2020, 1, 1), (2020, 2, 1), (2021, 1, 2))], "ibge_code string, municipio_nome string, regiao_intermediaria string, regiao_imediata string, populacao_censo_2022 long, ano long, semestre long, total_denuncias long, denuncias_unicas long, denuncias_unicas_penal long, denuncias_unicas_maioria_penal long")
    f = slices.Filters(years=(2020, 2021), unit="complaints")
    summed, exact = slices.time_slice(annual, annual, f).first(), slices.time_slice(annual, annual, f, tables(fact)).first()
    assert (summed.denuncias_unicas, exact.denuncias_unicas) == (4, 2)
    assert (exact.total_denuncias, exact.denuncias_unicas_penal, exact.denuncias_unicas_maioria_penal, exact.halves) == (4, 2, 1, 3)
