"""Slices: what a user asks of the indicator tables, as functions of tables and a filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import measures as m
from ..operators import aggregate as agg
from ..operators import rank
from ..operators.harmonise import metric_columns, with_default
from ..operators.mergeable import Complaints, merged


@dataclass(frozen=True)
class Filters:
    """The choices of a slice. Years empty: all periods; group empty: all records."""

    years: tuple[int, ...] = ()
    unit: str = "records"
    nature: str = "total"
    group: str = ""
    regions: tuple[str, ...] = ()
    scale: int = config.RATE_SCALE
    floor: int = config.RATE_FLOOR
    search: str = ""
    size_band: str = ""
    profile: str = ""
    distance_band: str = ""
    sort: str = "metric"
    descending: bool = True
    codes: tuple[str, ...] = field(default=())


class Parts(Mapping):
    """The parts of a report by name, each made when it is first asked for: some take jobs of their own, which no other part waits for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


KEYS = ["ibge_code", "municipio_nome", "regiao_intermediaria", "regiao_imediata", "populacao_censo_2022"]


def time_slice(municipal: DataFrame, annual: DataFrame, f: Filters, complaints: Complaints | None = None) -> DataFrame:
    """All periods from the municipal table, or chosen years summed from the annual one, with the halves that they cover.

    Sums count a complaint once in each of its periods; with the tables of
    `complaints` (by ibge_code, ano, semestre) it counts once in the slice.
    """
    if not f.years:
        halves = annual.select("ano", "semestre").distinct().agg(F.sum(F.when(F.col("semestre") == 0, 2).otherwise(1)).alias("halves"))
        return municipal.crossJoin(F.broadcast(halves))
    rows = annual.filter(F.col("ano").isin(*f.years))
    halves = agg.halves(rows.select("ano", "semestre").distinct()).agg(F.sum("halves").alias("halves"))
    summed = agg.resum(rows, KEYS, skip=("ano", "semestre"))
    if complaints is not None:
        exact = merged(complaints, ["ibge_code"], F.col("ano").isin(*f.years))
        counts = [c for c in exact.columns if c != "ibge_code"]
        summed = summed.drop(*counts).join(exact, "ibge_code", "left").fillna(0, counts)
    return summed.crossJoin(F.broadcast(halves))


def enrich(rows: DataFrame, distances: DataFrame | None, f: Filters) -> DataFrame:
    """Adds km and band (null and unknown where no distance is known), metric, pct_penal and rate."""
    if distances is not None:
        rows = rows.join(distances.select("ibge_code", "km", "nearest"), "ibge_code", "left")
    total, penal = metric_columns(f.group, f.unit)
    rows = with_default(rows, km=None, nearest=None, **{total: 0, penal: 0})
    t, p = F.col(total), F.col(penal)
    return rows.withColumns(
        {
            "band": m.distance_band(F.col("km").cast("double")),
            "metric": m.nature(f.nature, t, p),
            "pct_penal": m.percent(p, t),
            "rate": m.annual_rate(m.nature(f.nature, t, p), F.col("populacao_censo_2022"), F.col("halves"), f.scale),
        }
    )


def take(municipal: DataFrame, annual: DataFrame, f: Filters, distances: DataFrame | None = None, complaints: Complaints | None = None) -> DataFrame:
    rows = time_slice(municipal, annual, f, complaints)
    if f.regions:
        rows = rows.filter(F.col("regiao_intermediaria").isin(*f.regions))
    if f.codes:
        rows = rows.filter(F.col("ibge_code").isin(*f.codes))
    return enrich(rows, distances, f)


def table(rows: DataFrame, f: Filters) -> DataFrame:
    """The municipal table: size band, profile, distance band, search, in this order, sorted and numbered."""
    pop = F.col("populacao_censo_2022")
    if f.size_band:
        rows = rows.filter(m.population_band(pop) == f.size_band)
    if f.profile == "penal":
        rows = rows.filter("pct_penal >= 60")
    elif f.profile == "social":
        rows = rows.filter("pct_penal <= 40")
    elif f.profile == "above_mean":
        rows = rows.crossJoin(F.broadcast(rows.agg(F.avg("rate").alias("_mean")))).filter("rate >= _mean").drop("_mean")
    if f.distance_band:
        rows = rows.filter(F.col("band") == f.distance_band)
    if f.search:
        term = f.search.lower()
        hit: Column = F.lit(False)
        for c in ("municipio_nome", "ibge_code", "regiao_intermediaria", "regiao_imediata"):
            hit = hit | F.coalesce(F.lower(c).contains(term), F.lit(False))
        rows = rows.filter(hit)
    return rank.sorted_by(rows, f.sort, f.descending, "ibge_code", "position")


def summary(rows: DataFrame, f: Filters) -> DataFrame:
    """One row: totals, percentage, pooled rate, expansion over identifiable records where the column exists, majority percentage."""
    total, penal = metric_columns(f.group, f.unit)
    base = "registros_com_denuncia_identificavel" if "registros_com_denuncia_identificavel" in rows.columns else "total_denuncias"
    s = rows.agg(F.sum(total).alias("total"), F.sum(penal).alias("penal"), F.sum("metric").alias("metric"), F.sum("populacao_censo_2022").alias("population"), F.max("halves").alias("halves"), F.sum(base).alias("identifiable"), F.sum("denuncias_unicas").alias("complaints"), F.sum("denuncias_unicas_maioria_penal").alias("majority"))
    return s.withColumns(
        {
            "pct_penal": m.percent(F.col("penal"), F.col("total")),
            "rate": m.annual_rate(F.col("metric"), F.col("population"), F.col("halves"), f.scale),
            "expansion": F.try_divide("identifiable", "complaints"),
            "pct_majority": m.percent(F.col("majority"), F.col("complaints")),
        }
    )


def territory(rows: DataFrame, annual: DataFrame, f: Filters, top: int = 15) -> dict[str, DataFrame]:
    """Rankings by rate (with the floor) and by volume, focus points, the yearly series, the leader against the pooled rate."""
    years = annual.filter(F.col("ibge_code").isin(*f.codes)) if f.codes else annual
    series = years.groupBy("ano").agg(F.sum("total_denuncias").alias("total"), F.sum("total_penal").alias("penal"), F.count_distinct("semestre").alias("halves"))
    return {
        "by_rate": rank.top(rows, "rate", top, "ibge_code", ("populacao_censo_2022", f.floor)),
        "by_volume": rank.top(rows, "metric", top, "ibge_code"),
        "focus": rank.top(rows, "rate" if f.nature != "total" else "metric", top, "ibge_code", ("populacao_censo_2022", f.floor) if f.nature != "total" else None),
        "series": series.withColumn("social", F.col("total") - F.col("penal")),
        "leader": rank.leader_ratio(rows.filter(F.col("populacao_censo_2022") >= f.floor), "metric", "populacao_censo_2022", "municipio_nome", f.scale),
    }


def groups(rows: DataFrame) -> DataFrame:
    """The six groups and the row of records in none."""
    pairs = {g: (f"{g}_total", f"{g}_penal") for g in config.GROUPS} | {"sem_grupo": ("sem_grupo_total", "sem_grupo_penal")}
    return agg.group_table(rows, pairs)


def penal_nature(categories: DataFrame, f: Filters, top: int = 12) -> Mapping[str, DataFrame]:
    """Totals, share of high degree, categories, agencies, the top categories by year, the legal basis."""
    rows = categories
    if f.years:
        rows = rows.filter(F.col("ano").isin(*f.years))
    if f.regions:
        rows = rows.filter(F.col("regiao_intermediaria").isin(*f.regions))
    penal = rows.filter("indicio_penal = 1")

    def by(*keys: str) -> DataFrame:
        return penal.groupBy(*keys).agg(F.sum("registros").alias("registros"))

    high = F.sum(F.when(F.col("grau_certeza") == "ALTO", F.col("registros")))
    return Parts({
        "totals": lambda: rows.agg(F.sum("registros").alias("registros"), F.sum(F.when(F.col("indicio_penal") == 1, F.col("registros"))).alias("penal")),
        "high_degree": lambda: penal.agg(m.percent(high, F.sum("registros")).alias("pct_high")),
        "categories": lambda: rank.top(agg.share_of_total(by("categoria_penal"), "registros"), "registros", top, "categoria_penal"),
        "agencies": lambda: rank.top(by("orgao_prioritario"), "registros", top, "orgao_prioritario"),
        "by_year": lambda: agg.pivot_top(by("ano", "categoria_penal"), "ano", "categoria_penal", "registros", 4),
        "legal_basis": lambda: by("categoria_penal", "fundamentacao_legal").orderBy(F.desc("registros"), "categoria_penal"),
    })


def facility_access(facilities: DataFrame) -> dict[str, DataFrame]:
    """What services the facilities have, and their kinds; no record is needed for it."""
    services = [c for c in facilities.columns if c.startswith("tem_")]
    return {
        "services": facilities.agg(F.count(F.lit(1)).alias("facilities"), *[F.count_if(F.col(c)).alias(c) for c in services]),
        "kinds": facilities.groupBy("tipo").agg(F.count(F.lit(1)).alias("n")),
    }


def forensic_access(rows: DataFrame, facilities: DataFrame, speed: float = 60.0, top: int = 10) -> dict[str, DataFrame]:
    """Distance bands with their population, far places by penal volume with the travel estimate, what services the facilities have."""
    bands = rows.sparkSession.createDataFrame([("near",), ("middle",), ("far",)], "band string")
    counts = rows.groupBy("band").agg(F.count(F.lit(1)).alias("places"), F.sum("populacao_censo_2022").alias("population"))
    far = rank.top(rows.filter("band = 'far'"), "total_penal", top, "ibge_code").withColumn("minutes", m.travel_minutes(F.col("km"), speed))
    return {
        "bands": bands.join(counts, "band", "left").fillna(0, ["places", "population"]),
        "far": far,
    } | facility_access(facilities)


def distribution(fact: DataFrame, municipal: DataFrame, floor: int = config.RATE_FLOOR, top: int = 15) -> dict[str, DataFrame]:
    """The published bundle: totals, years with the partial flag, distributions, regions, rows with their predominant category, two rankings."""
    years = agg.two_grain(fact, ["ano"], "id_denuncia", F.col("grain_denuncia_confiavel") == 1, F.col("indicio_penal") == 1)
    partial = fact.groupBy("ano").agg((F.count_distinct("semestre") == 1).alias("_one"))
    regions = fact.groupBy("regiao_intermediaria").agg(F.count(F.lit(1)).alias("total_registros"), F.sum("indicio_penal").alias("total_penal"), F.count_distinct("ibge_code").alias("municipios"))
    people = municipal.groupBy("regiao_intermediaria").agg(F.sum("populacao_censo_2022").alias("population"))
    main = agg.predominant(fact.filter("indicio_penal = 1"), ["ibge_code"], "categoria_penal").select("ibge_code", F.col("categoria_penal").alias("categoria_penal_predominante"))
    rows = municipal.join(main, "ibge_code", "left")
    return {
        "totals": agg.two_grain(fact, [], "id_denuncia", F.col("grain_denuncia_confiavel") == 1, F.col("indicio_penal") == 1),
        "years": years.join(partial, "ano").withColumn("partial", F.col("_one") & (F.col("ano") >= 2020)).drop("_one"),
        "categories": agg.value_counts(fact, "categoria_penal", F.col("indicio_penal") == 1),
        "degrees": agg.value_counts(fact, "grau_certeza"),
        "groups": agg.value_counts(fact, "grupo_primario"),
        "regions": regions.join(people, "regiao_intermediaria", "left").withColumn("taxa_penal_10k", m.rate(F.col("total_penal"), F.col("population"))),
        "rows": rows,
        "by_rate": rank.top(rows, "taxa_penal_10k", top, "ibge_code", ("populacao_censo_2022", floor)),
        "by_volume": rank.top(rows, "total_penal", top, "ibge_code"),
    }


def incomplete_years(rows: DataFrame) -> DataFrame:
    """Years of which a half is missing, from any rows with ano and semestre."""
    return agg.halves(rows.select("ano", "semestre").distinct()).filter("incomplete")


def audit_report(fact: DataFrame, dim: DataFrame, inventories: DataFrame | None = None, floor: int = 30) -> Mapping[str, DataFrame]:
    """Coverage by half, incomplete years, spread of the expansion factor, municipal reconciliation, overlap, inventory."""
    from ..operators.audit import overlap

    n = {f: F.col(f) for f in (*config.GROUPS.values(), "sem_grupo")} | {"unidentified": (F.col("ibge_code") == config.SENTINEL_CODE).cast("long")}
    reliable, penal = F.col("grain_denuncia_confiavel") == 1, F.col("indicio_penal") == 1
    halves = agg.two_grain(fact, ["ano", "semestre"], "id_denuncia", reliable, penal, n)
    known = dim.select("ibge_code", F.lit(1).alias("_known"))
    placed = fact.join(known, "ibge_code", "left").agg(F.count(F.lit(1)).alias("records"), F.count("_known").alias("attributed"))
    return Parts({
        "coverage": lambda: halves.withColumn("expansion", m.expansion(F.col("reliable_records"), F.col("complaints"))).withColumn("expansion_all", m.expansion(F.col("records"), F.col("complaints"))),
        "incomplete_years": lambda: incomplete_years(fact),
        "spread": lambda: agg.spread(agg.two_grain(fact, ["ibge_code"], "id_denuncia", reliable, penal), "reliable_records", "complaints", floor),
        "reconciliation": lambda: placed.withColumn("unattributed", F.col("records") - F.col("attributed")),
        "overlap": lambda: overlap(fact, list(config.GROUPS.values())),
    } | ({} if inventories is None else {"inventory": lambda: inventories}))
