import random
from collections import defaultdict
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from casemart.plans import star
from casemart.sources import files
from casemart.streaming import facts, ingest

SPELT = (
    {"vitima_uf": "uf", "vitima_cod_municipio": "place", "violacoes": "told"},
    {"UF": "uf", "hash_par_vitima_suspeito": "id", "Município da vítima": "place", "violacao": "told"},
    {"UF": "uf", "hash": "id", "Município": "place", "violacao": "told", "Grupo_vulnerável": "group"},
)
DIM = "ibge_code string, municipio_nome string, microrregiao string, regiao_imediata string, regiao_intermediaria string, populacao_censo_2022 long"


FILES = 400


def put(path, rows, spelling):
    """A period file of rows (uf, place, told, id, group)."""
    at = dict(zip(("uf", "place", "told", "id", "group"), range(5)))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({name: pa.array([r[at[c]] for r in rows], pa.string()) for name, c in spelling.items()}), path)


def some_rows(rng, n):
    return [(rng.choice(["SC", " sc ", "PR"]), rng.choice(["4200001", "Beta", "nowhere"]), rng.choice(["AMEAÇA", "RACISMO", "x"]), rng.choice([None, *(f"c{k}" for k in range(12))]), rng.choice(["Mulher", "Pessoa idosa", None])) for _ in range(n)]


def dim(spark):
    return spark.createDataFrame([("4200001", "Alfa", "m", "i", "R1", 1000), ("4200002", "Beta", "m", "i", "R2", None)], DIM)


def test_many_files_are_as_many_scans_as_spellings(spark, tmp_path):
    rng, want = random.Random(1), defaultdict(list)
    for k in range(FILES):
        rows, name = some_rows(rng, 3), f"cases-{'primeiro' if k % 2 else 'segundo'}-semestre-{2011 + k % 9}-{k}.parquet"
        put(f"{tmp_path}/{name}", rows, SPELT[k % 3])
        want[name] = rows
    raw = files.read_period_files(spark, f"{tmp_path}/*.parquet")
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3
    got = defaultdict(int)
    for r in raw.groupBy("arquivo_origem", "ano", "semestre", "id_column").count().collect():
        got[r.arquivo_origem] += r["count"]
        k = int(r.arquivo_origem.split("-")[-1].split(".")[0])
        assert (r.ano, r.semestre, r.id_column) == (2011 + k % 9, 1 if k % 2 else 2, (None, "hash_par_vitima_suspeito", "hash")[k % 3])
    assert got == {n: 3 for n in want}
    told = files.inventory(spark, f"{tmp_path}/*.parquet").collect()
    assert len(told) == FILES
    for r in told:
        k = int(r.file.split("-")[-1].split(".")[0])
        columns = [("uf", "place", "told", "id", "group").index(c) for c in SPELT[k % 3].values()]
        own = [tuple(row[c] for c in columns) for row in want[r.file] if row[0].strip().upper() == "SC"]
        ids = {row[3] for row in want[r.file] if row[0].strip().upper() == "SC" and row[3]}
        assert (r.rows, r.state_rows, r.distinct_state_rows, r.duplicates) == (3, len(own), len(set(own)), len(own) - len(set(own)))
        assert (r.distinct_ids, r.era) == ((None, "no_id"), (len(ids), "pair_id"), (len(ids), "complaint_id"))[k % 3]


def test_no_files(spark, tmp_path):
    for read in (files.read_period_files, files.inventory):
        with pytest.raises(FileNotFoundError):
            read(spark, f"{tmp_path}/none-*.parquet")


def rows_of(df, drop=()):
    columns = sorted(c for c in df.columns if c not in drop)
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_stream_equals_the_batch(spark, tmp_path, monkeypatch):
    """Files in three goes; a period comes in two of them; one go fails half-way and one is run again."""
    rng, land, out, log = random.Random(2), f"{tmp_path}/landing", f"{tmp_path}/star", f"{tmp_path}/log"
    goes = [
        [("cases-2018", 0), ("cases-primeiro-semestre-2020", 1)],
        [("cases-segundo-semestre-2020", 2), ("cases-segundo-semestre-2020-b", 2)],
        [("cases-segundo-semestre-2020-c", 2), ("cases-primeiro-semestre-2021", 2)],
    ]
    pattern = f"{land}/cases-*.parquet"
    for n, go in enumerate(goes):
        for name, spelling in go:
            put(f"{land}/{name}.parquet", some_rows(rng, 40), SPELT[spelling])
        if n == 1:
            real, calls = facts._put, []

            def failing(df, path, *partition):
                calls.append(path)
                if path.endswith("/kpi_period"):
                    raise RuntimeError("lost")
                real(df, path, *partition)

            monkeypatch.setattr(facts, "_put", failing)
            with pytest.raises(Exception, match="lost"):
                facts.follow(spark, pattern, dim(spark), out, log).awaitTermination()
            assert len(calls) == 3
            monkeypatch.setattr(facts, "_put", real)
        facts.follow(spark, pattern, dim(spark), out, log).awaitTermination()
    facts.take(spark, [f"{land}/{name}.parquet" for name, _ in goes[1]], 1, dim(spark), out)
    facts.follow(spark, pattern, dim(spark), out, log).awaitTermination()  # nothing new
    batch = star.build(spark, pattern, dim(spark), f"{tmp_path}/batch")
    stream = facts.tables(spark, out, dim(spark))
    for name in ("kpi_period", "kpi_category", "kpi_municipality"):
        assert rows_of(stream[name].select(*batch[name].columns)) == rows_of(batch[name]), name
    # several files of one period number their rows from 1 each
    assert rows_of(stream["fact"]) == rows_of(batch["fact"].withColumns({c: F.col(c).cast("long") for c in ("ano", "semestre")}))


def test_only_touched_periods_are_written_again(spark, tmp_path):
    rng, land, out, log = random.Random(3), f"{tmp_path}/landing", f"{tmp_path}/star", f"{tmp_path}/log"
    put(f"{land}/cases-2018.parquet", some_rows(rng, 20), SPELT[0])
    facts.follow(spark, f"{land}/*.parquet", dim(spark), out, log).awaitTermination()
    before = {p: p.stat().st_mtime_ns for p in Path(f"{out}/kpi_period/ano=2018").rglob("*.parquet")}
    put(f"{land}/cases-2019.parquet", some_rows(rng, 20), SPELT[1])
    facts.follow(spark, f"{land}/*.parquet", dim(spark), out, log).awaitTermination()
    assert before == {p: p.stat().st_mtime_ns for p in Path(f"{out}/kpi_period/ano=2018").rglob("*.parquet")} and before
    assert {r.ano for r in facts.tables(spark, out, dim(spark))["kpi_period"].collect()} == {2018, 2019}


def test_closed_windows_once_with_late_rows_and_restart(spark, tmp_path):
    src, out, log = (f"{tmp_path}/{n}" for n in ("src", "out", "log"))
    said = []
    for batch in ([(1, "a"), (1, "a"), (2, "b"), (6, "c")], [(5, "c"), (5, "d"), (1, "late"), (20, "e")], [(21, None), (40, "f")]):
        rows = spark.createDataFrame([(f"2024-01-01 10:00:00", d, u) for d, u in batch], "t string, d int, u string").select(F.expr("cast(t as timestamp) + make_interval(0, 0, 0, d - 1)").alias("t"), "u")
        rows.coalesce(1).write.mode("append").parquet(src)
        ingest.closed_kpi(spark, src, "t timestamp, u string", "t", "2 days", "2 days", "u", out, log).awaitTermination()
        found = spark.read.parquet(out).collect() if any(Path(out).glob("part-*")) else []
        said.append({(r.from_time.day, r.from_time.month): (r.records, r.ids) for r in found})
        assert len(said[-1]) == len(found)
    # windows begin on even days of January; that of the 1st is closed when its late row comes, that of the 4th is not; the last stays open
    assert said[-1] == {(31, 12): (2, 1), (2, 1): (1, 1), (4, 1): (2, 2), (6, 1): (1, 1), (20, 1): (2, 1)}
    assert said[0].items() <= said[1].items() <= said[2].items()


def test_exact_ids_keep_no_set(spark, tmp_path):
    src, out, log = (f"{tmp_path}/{n}" for n in ("src", "out", "log"))
    spark.range(2_000).select(F.lit("2024-01-02 00:00:00").cast("timestamp").alias("t"), (F.col("id") % 700).alias("u")).write.parquet(src)
    ingest.run_kpi(spark, src, "t timestamp, u long", "t", "7 days", "1 day", "u", out, log).awaitTermination()
    plan = ingest.running_ids(spark.read.parquet(src), "t", "7 days", "1 day", "u")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan
    updates = spark.read.parquet(out)
    assert updates.count() == 700
    row = ingest.latest(updates).first()
    assert (row.records, row.ids) == (2_000, 700)
    # the same batch once more changes nothing
    assert ingest.latest(updates.unionByName(updates)).first().ids == 700
