"""What the star schema costs: rules run once for each distinct case, tables are made when they are asked for."""

import pytest
from pyspark.sql import functions as F

from casemart import config
from casemart.plans import proxy_star, registry, slices, star
from casemart.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pattern(spark, tmp_path_factory):
    return proxy_star.write_periods(spark, SF, str(tmp_path_factory.mktemp("periods")))


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_rule_runs_for_every_record(spark, pattern):
    plan = plan_of(star.build_fact(files.read_period_files(spark, pattern), proxy_star.dimension(spark, SF)))
    assert "Contains(" not in plan and "AMEAÇA" not in plan


def test_paths_are_not_searched_by_a_pattern(spark, pattern):
    rows = files.read_period_files(spark, pattern)
    assert "[^/]+$" not in plan_of(rows)
    names = {(r.arquivo_origem, r.ano, r.semestre) for r in rows.select("arquivo_origem", "ano", "semestre").distinct().collect()}
    assert ("period=cases-2005", 2005, 0) in names and ("period=cases-segundo-semestre-2010", 2010, 2) in names


def test_cases_with_nulls_and_small_blocks(spark, pattern, monkeypatch):
    raw, dim = files.read_period_files(spark, pattern), proxy_star.dimension(spark, SF)

    def rows():
        return sorted(map(tuple, star.build_fact(raw, dim).collect()), key=str)

    whole = rows()
    assert len(whole) == raw.filter(F.upper(F.btrim("uf")) == "SC").count()
    monkeypatch.setattr(star, "BLOCK", 7)
    assert rows() == whole


@pytest.mark.parametrize("name", ["access_services", "access_kinds"])
def test_facilities_need_no_records(spark, monkeypatch, name):
    monkeypatch.setattr(proxy_star, "_BUILT", {})
    monkeypatch.setattr(proxy_star, "raw_rows", None)
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["audit_inventory", "missing_fields", "field_spellings"])
def test_files_are_listed_without_the_fact(spark, monkeypatch, name):
    monkeypatch.setattr(proxy_star, "_BUILT", {})
    monkeypatch.setattr(star, "build_fact", None)
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_one_indicator_makes_no_other(spark, monkeypatch):
    monkeypatch.setattr(proxy_star, "_BUILT", {})
    monkeypatch.setattr(star, "kpi_municipality", None)
    assert registry.QUERIES["nature_totals"](spark, SF).count() == 1


@pytest.mark.parametrize("name", ["nature_by_year", "nature_high_degree", "nature_totals", "batch_summary", "audit_incomplete_years", "audit_coverage", "published_rows", "slice_focus_of_nature", "slice_of_group"])
def test_what_shows_no_ids_numbers_no_rows(spark, monkeypatch, name):
    monkeypatch.setattr(proxy_star, "_BUILT", {})
    monkeypatch.setattr(star, "numbered", None)
    assert registry.QUERIES[name](spark, SF).columns


def test_records_are_the_fact_without_ids(spark, pattern, tmp_path):
    dim = proxy_star.dimension(spark, SF)
    fact, records = star.write_fact(spark, pattern, dim, str(tmp_path)), star.write_records(spark, pattern, dim, str(tmp_path))
    assert dict(records.dtypes) == {c: t for c, t in fact.dtypes if c != "id_fato"}
    assert records.count() and sorted(map(tuple, fact.select(*star.SAID).collect()), key=str) == sorted(map(tuple, records.select(*star.SAID).collect()), key=str)


def test_a_reliable_id_is_told_by_files_not_by_rows(spark, pattern):
    plan = plan_of(star.build_records(files.read_period_files(spark, pattern), proxy_star.dimension(spark, SF)))
    assert "id_column" not in plan and "Window" not in plan


def test_parts_of_a_report_wait_for_no_other(spark, monkeypatch):
    monkeypatch.setattr(slices.agg, "spread", None)
    monkeypatch.setattr(slices.agg, "pivot_top", None)
    fact = spark.createDataFrame([], "ano int, semestre long, id_denuncia string, grain_denuncia_confiavel long, indicio_penal long, ibge_code string, sem_grupo long, " + ", ".join(f"{f} long" for f in config.GROUPS.values()))
    report = slices.audit_report(fact, fact.select("ibge_code"))
    assert report["incomplete_years"].count() == 0 and set(report) == {"coverage", "incomplete_years", "spread", "reconciliation", "overlap"}
    nature = slices.penal_nature(spark.createDataFrame([], "indicio_penal long, registros long, grau_certeza string, categoria_penal string, orgao_prioritario string, fundamentacao_legal string, ano int"), slices.Filters())
    assert nature["totals"].count() == 1


@pytest.mark.parametrize("name", ["nature_totals", "audit_incomplete_years"])
def test_files_that_nobody_numbers_are_in_no_order(spark, monkeypatch, name):
    """Neither sampled for ranges nor sorted by their rows' keys; what the fact reads still is."""
    monkeypatch.setattr(proxy_star, "_BUILT", {})
    sorted_by, by_range = [], type(spark.range(0)).repartitionByRange
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda df, *keys: sorted_by.append(keys) or by_range(df, *keys))
    assert registry.QUERIES[name](spark, SF).columns
    assert not sorted_by
    assert registry.QUERIES["star_fact"](spark, SF).columns and len(sorted_by) == len(proxy_star.ERAS)


def test_counts_of_records_tell_no_complaints_apart(spark, monkeypatch):
    monkeypatch.setattr(proxy_star, "_BUILT", {})
    monkeypatch.setattr(star, "write_records", None)
    monkeypatch.setattr(star.agg, "first_grain", None)
    got = registry.QUERIES["nature_totals"](spark, SF).first()
    monkeypatch.undo()
    assert tuple(got) == tuple(slices.penal_nature(proxy_star.built(spark, SF)["kpi_category"], slices.Filters(years=(2007, 2009, 2010), regions=("ASIA", "AMERICA", "OUTRA")))["totals"].first()) and got.registros > 0


def test_incomplete_years_read_no_verdict(spark, monkeypatch):
    monkeypatch.setattr(proxy_star, "_BUILT", {})
    monkeypatch.setattr(star, "verdicts", None)
    assert [tuple(r) for r in registry.QUERIES["audit_incomplete_years"](spark, SF).collect()] == [(2011, 1, True)]


def test_unordered_files_hold_the_same_rows(spark, pattern, tmp_path):
    columns = ("arquivo_origem", "ano", "semestre", "id_column", *sorted(config.ALIASES))
    ordered, unordered = (files.read_period_files(spark, p).select(*columns) for p in (pattern, proxy_star.write_unordered(spark, SF, str(tmp_path))))
    assert ordered.count() == unordered.count() > 0 and not ordered.exceptAll(unordered).count()
