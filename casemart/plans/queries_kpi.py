"""Registered queries: counts on two grains, indicators by territory, period and category, slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as m
from ..operators import aggregate as agg
from ..operators import audit
from ..operators.harmonise import with_default
from ..operators.rank import leader_ratio
from .proxy import FACT, FLAGS, POPULATION, Book, fact, population, table

BOOK = Book()
GRAIN = """count(*) AS records, CAST(sum(CASE WHEN penal THEN 1 ELSE 0 END) AS BIGINT) AS penal,
  CAST(sum(CASE WHEN reliable THEN 1 ELSE 0 END) AS BIGINT) AS reliable_records,
  count(DISTINCT CASE WHEN reliable THEN id END) AS complaints, count(DISTINCT CASE WHEN reliable AND penal THEN id END) AS complaints_penal"""


def MAJORITY(keys: str) -> str:
    return f"""maj AS (SELECT {keys}, count(*) AS complaints_majority FROM (SELECT {keys}, id, count(*) AS n, sum(CASE WHEN penal THEN 1 ELSE 0 END) AS p
      FROM fact WHERE reliable GROUP BY {keys}, id) WHERE p * 2 > n GROUP BY {keys})"""


def grains(df, keys, sums=None):
    return agg.two_grain(df, keys, "id", F.col("reliable"), F.col("penal"), sums)


@BOOK.add(FACT + f""", {MAJORITY("territory, ano")}, {POPULATION}, a AS (SELECT territory, territory_name, ano, {GRAIN} FROM fact GROUP BY ALL)
SELECT a.territory_name, a.ano, records, penal, complaints, complaints_penal, coalesce(complaints_majority, 0) AS complaints_majority,
  round(100.0 * penal / records, 4) AS pct_penal, CASE WHEN population > 0 THEN round(penal / population * 10000, 2) END AS rate_10k
FROM a LEFT JOIN maj USING (territory, ano) LEFT JOIN pop USING (territory)""")
def two_grain_by_territory_year(spark, sf_dir):
    counted = grains(fact(spark, sf_dir), ["territory", "territory_name", "ano"])
    return counted.join(population(spark, sf_dir), "territory", "left").select(
        "territory_name", "ano", "records", "penal", "complaints", "complaints_penal", "complaints_majority",
        F.round(m.percent(F.col("penal"), F.col("records")), 4).alias("pct_penal"), m.rate(F.col("penal"), F.col("population")).alias("rate_10k"),
    )


@BOOK.add(FACT + f"SELECT {GRAIN} FROM fact")
def global_totals(spark, sf_dir):
    return grains(fact(spark, sf_dir), []).drop("complaints_majority")


@BOOK.add(FACT + """, c AS (SELECT id, count(*) AS n, sum(CASE WHEN penal THEN 1 ELSE 0 END) AS p FROM fact WHERE reliable GROUP BY id)
SELECT count(*) AS complaints, count_if(p = 0) AS none_penal, count_if(p > 0) AS some_penal, count_if(p * 2 > n) AS majority_penal, count_if(p = n) AS all_penal FROM c""")
def complaint_decomposition(spark, sf_dir):
    return agg.decomposition(agg.by_complaint(fact(spark, sf_dir), [], "id", F.col("reliable"), F.col("penal")))



def group_sums():
    return {f"{f[3:]}_total": F.col(f) for f in FLAGS} | {f"{f[3:]}_penal": F.when(F.col("penal"), F.col(f)).otherwise(0) for f in FLAGS}


GROUP_SQL = ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f[3:]}_total, CAST(sum(CASE WHEN penal THEN {f} ELSE 0 END) AS BIGINT) AS {f[3:]}_penal" for f in FLAGS)
GROUP_NAMES = [f"{f[3:]}_{k}" for f in FLAGS for k in ("total", "penal")]


@BOOK.add(FACT + f""", {MAJORITY("territory")}, {POPULATION}, a AS (SELECT territory, {GRAIN}, {GROUP_SQL} FROM fact WHERE territory <> 7 GROUP BY territory)
SELECT n_name AS territory_name, population, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ["records", "penal", "reliable_records", "complaints", "complaints_penal", *GROUP_NAMES])},
  CASE WHEN records IS NULL THEN 0 ELSE coalesce(complaints_majority, 0) END AS complaints_majority, coalesce(records, 0) - coalesce(penal, 0) AS social,
  CASE WHEN population > 0 THEN round(coalesce(records, 0) / population * 10000, 2) END AS rate_total, CASE WHEN population > 0 THEN round(coalesce(penal, 0) / population * 10000, 2) END AS rate_penal
FROM nation LEFT JOIN pop ON n_nationkey = pop.territory LEFT JOIN a ON n_nationkey = a.territory LEFT JOIN maj ON n_nationkey = maj.territory""")
def wide_kpi_territory(spark, sf_dir):
    """Every territory of the dimension, also one without records; counts become 0, a missing population stays null."""
    counted = grains(fact(spark, sf_dir).filter("territory <> 7"), ["territory"], group_sums())
    dim = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("territory"), F.col("n_name").alias("territory_name")).join(population(spark, sf_dir), "territory", "left")
    rows = dim.join(counted, "territory", "left").fillna(0, [c for c in counted.columns if c != "territory"])
    return rows.drop("territory").withColumn("social", F.col("records") - F.col("penal")).withColumn("rate_total", m.rate(F.col("records"), F.col("population"))).withColumn("rate_penal", m.rate(F.col("penal"), F.col("population")))


@BOOK.add(FACT + f""", {MAJORITY("territory, ano, semestre")}, a AS (SELECT territory, ano, semestre, {GRAIN}, {GROUP_SQL} FROM fact GROUP BY territory, ano, semestre)
SELECT a.*, coalesce(complaints_majority, 0) AS complaints_majority FROM a LEFT JOIN maj USING (territory, ano, semestre)""")
def wide_kpi_period(spark, sf_dir):
    return grains(fact(spark, sf_dir), ["territory", "ano", "semestre"], group_sums())


@BOOK.add(FACT + """SELECT ano, semestre, region, p_type AS category, degree, p_brand AS agency, CAST(CASE WHEN penal THEN 1 ELSE 0 END AS BIGINT) AS indicio_penal,
  count(*) AS registros, count(DISTINCT CASE WHEN reliable THEN id END) AS denuncias_unicas FROM fact GROUP BY ALL""")
def kpi_category(spark, sf_dir):
    keys = ["ano", "semestre", "region", "category", "degree", "agency", "indicio_penal"]
    rows = fact(spark, sf_dir).withColumns({"category": F.col("p_type"), "agency": F.col("p_brand"), "indicio_penal": F.col("penal").cast("long")})
    counted = grains(rows, keys).select(*keys, F.col("records").alias("registros"), F.col("complaints").alias("denuncias_unicas"))
    return counted.orderBy("ano", "semestre", F.desc("registros"))


@BOOK.add(FACT + f""", k AS (SELECT territory, ano, semestre, {GRAIN} FROM fact GROUP BY territory, ano, semestre)
SELECT territory, CAST(sum(records) AS BIGINT) AS records, CAST(sum(penal) AS BIGINT) AS penal, CAST(sum(reliable_records) AS BIGINT) AS reliable_records,
  CAST(sum(complaints) AS BIGINT) AS complaints, CAST(sum(complaints_penal) AS BIGINT) AS complaints_penal FROM k WHERE ano IN (1996, 1997, 1999) GROUP BY territory""")
def reaggregate_years(spark, sf_dir):
    periods = grains(fact(spark, sf_dir), ["territory", "ano", "semestre"]).drop("complaints_majority")
    return agg.resum(periods, ["territory"], F.col("ano").isin(1996, 1997, 1999), skip=("ano", "semestre"))


def one_half_last(rows):
    """The last year's rows all count to its first half, so that year is incomplete."""
    return rows.withColumn("semestre", F.when(F.col("ano") == 2001, 1).otherwise(F.col("semestre")))


@BOOK.add(FACT + """, k AS (SELECT ano, count(*) AS records, CAST(sum(CASE WHEN penal THEN 1 ELSE 0 END) AS BIGINT) AS penal, count(DISTINCT CASE WHEN reliable THEN id END) AS complaints,
  count(DISTINCT CASE WHEN ano = 2001 THEN 1 ELSE semestre END) AS halves FROM fact GROUP BY ano)
SELECT ano, records, penal, complaints, halves, halves = 1 AND ano >= 1995 AS partial, records - penal AS social, CASE WHEN complaints > 0 THEN round(records / complaints, 2) END AS expansion FROM k""")
def yearly_partial_flag(spark, sf_dir):
    rows = one_half_last(fact(spark, sf_dir))
    years = grains(rows, ["ano"]).join(rows.groupBy("ano").agg(F.count_distinct("semestre").alias("halves")), "ano")
    return years.select("ano", "records", "penal", "complaints", "halves", ((F.col("halves") == 1) & (F.col("ano") >= 1995)).alias("partial"), (F.col("records") - F.col("penal")).alias("social"), m.expansion(F.col("records"), F.col("complaints")).alias("expansion"))


@BOOK.add(FACT + """, s AS (SELECT DISTINCT ano, CASE WHEN ano = 2001 THEN 1 ELSE semestre END AS semestre FROM fact)
SELECT ano, CAST(CASE WHEN count(*) = 1 AND max(semestre) = 0 THEN 2 ELSE count(*) END AS INTEGER) AS halves, count(*) < 2 AND max(semestre) <> 0 AS incomplete FROM s GROUP BY ano""")
def halves_per_year(spark, sf_dir):
    return agg.halves(one_half_last(fact(spark, sf_dir)))


@BOOK.add(FACT + f""", {MAJORITY("territory")}, {POPULATION}, k AS (SELECT territory, {GRAIN} FROM fact WHERE region = 1 GROUP BY territory),
s AS (SELECT CAST(sum(records) AS BIGINT) AS records, CAST(sum(penal) AS BIGINT) AS penal, CAST(sum(complaints) AS BIGINT) AS complaints, CAST(sum(coalesce(complaints_majority, 0)) AS BIGINT) AS majority,
  CAST(sum(reliable_records) AS BIGINT) AS reliable_records, CAST(sum(population) AS BIGINT) AS population, count_if(population > 0) AS with_population FROM k LEFT JOIN maj USING (territory) LEFT JOIN pop USING (territory))
SELECT *, round(100.0 * penal / records, 4) AS pct_penal, round(penal / 7.0 / population * 100000, 4) AS pooled_rate, round(reliable_records / complaints, 4) AS expansion, round(100.0 * majority / complaints, 4) AS pct_majority FROM s""")
def slice_summary(spark, sf_dir):
    """One region over fourteen halves, per 100,000 inhabitants and year."""
    rows = grains(fact(spark, sf_dir).filter("region = 1"), ["territory"]).join(population(spark, sf_dir), "territory", "left")
    s = rows.agg(*[F.sum(c).alias(c) for c in ("records", "penal", "complaints")], F.sum("complaints_majority").alias("majority"), F.sum("reliable_records").alias("reliable_records"), F.sum("population").alias("population"), F.count_if(F.expr("population > 0")).alias("with_population"))
    return s.select(
        "*", F.round(m.percent(F.col("penal"), F.col("records")), 4).alias("pct_penal"), F.round(m.annual_rate(F.col("penal"), F.col("population"), F.lit(14), 100_000), 4).alias("pooled_rate"),
        F.round(F.try_divide("reliable_records", "complaints"), 4).alias("expansion"), F.round(m.percent(F.col("majority"), F.col("complaints")), 4).alias("pct_majority"),
    )


@BOOK.add(FACT + " UNION ALL ".join([f"SELECT '{f[3:]}' AS grupo, CAST(sum({f}) AS BIGINT) AS total, CAST(sum(CASE WHEN penal THEN {f} ELSE 0 END) AS BIGINT) AS penal, CAST(sum(CASE WHEN penal THEN 0 ELSE {f} END) AS BIGINT) AS social, round(100.0 * sum(CASE WHEN penal THEN {f} ELSE 0 END) / sum({f}), 4) AS pct_penal FROM fact" for f in FLAGS]))
def group_table(spark, sf_dir):
    rows = grains(fact(spark, sf_dir), ["territory"], group_sums())
    return agg.group_table(rows, {f[3:]: (f"{f[3:]}_total", f"{f[3:]}_penal") for f in FLAGS})


_N = " + ".join(FLAGS)


@BOOK.add(FACT + f"SELECT count(*) AS rows, count_if({_N} = 0) AS none, count_if({_N} = 1) AS one, count_if({_N} >= 2) AS several, CAST(sum({_N}) AS BIGINT) AS sum_of_groups FROM fact")
def group_overlap(spark, sf_dir):
    return audit.overlap(fact(spark, sf_dir), list(FLAGS))


@BOOK.add(FACT + f"""SELECT ano, semestre, count(*) AS records, count(DISTINCT CASE WHEN reliable THEN id END) AS complaints, {", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in FLAGS)},
  count_if(territory = 7) AS unidentified, round(100.0 * count_if(penal) / count(*), 4) AS pct_penal, round(100.0 * count_if({_N} = 0) / count(*), 4) AS pct_no_group,
  round(count(*) / count(DISTINCT CASE WHEN reliable THEN id END), 2) AS expansion FROM fact GROUP BY ano, semestre""")
def coverage_by_half(spark, sf_dir):
    n = sum((F.col(f) for f in list(FLAGS)[1:]), F.col(next(iter(FLAGS))))
    rows = grains(fact(spark, sf_dir).withColumn("_n", n), ["ano", "semestre"], {f: F.col(f) for f in FLAGS} | {"unidentified": (F.col("territory") == 7).cast("long"), "_none": (F.col("_n") == 0).cast("long")})
    return rows.select("ano", "semestre", "records", "complaints", *FLAGS, "unidentified", F.round(m.percent(F.col("penal"), F.col("records")), 4).alias("pct_penal"), F.round(m.percent(F.col("_none"), F.col("records")), 4).alias("pct_no_group"), m.expansion(F.col("records"), F.col("complaints")).alias("expansion"))


@BOOK.add(FACT + """, t AS (SELECT territory, count(*) AS r, count(DISTINCT CASE WHEN reliable THEN id END) AS c FROM fact GROUP BY territory HAVING count(DISTINCT CASE WHEN reliable THEN id END) >= 30)
SELECT count(*) AS n, round(min(r / c), 6) AS low, round(median(r / c), 6) AS middle, round(max(r / c), 6) AS high FROM t""")
def expansion_spread(spark, sf_dir):
    s = agg.spread(grains(fact(spark, sf_dir), ["territory"]), "records", "complaints", 30)
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("low", "middle", "high")])


@BOOK.add(FACT + """, t AS (SELECT count(*) AS records, CAST(count_if(penal) AS BIGINT) AS penal FROM fact), k AS (SELECT territory, count(*) AS r, count_if(penal) AS p FROM fact GROUP BY territory),
q AS (SELECT ano, semestre, territory, count(*) AS r, count_if(penal) AS p FROM fact WHERE territory <> 7 GROUP BY ALL),
u AS (SELECT 'fact' AS path, records, penal FROM t UNION ALL SELECT 'territory', CAST(sum(r) AS BIGINT), CAST(sum(p) AS BIGINT) FROM k UNION ALL SELECT 'attributed', CAST(sum(r) AS BIGINT), CAST(sum(p) AS BIGINT) FROM q)
SELECT path, u.records, u.penal, u.records = t.records AND u.penal = t.penal AS equal FROM u, t""")
def reconcile_three_paths(spark, sf_dir):
    """The third path leaves out one territory, so its difference is the unattributed part."""
    rows = fact(spark, sf_dir)
    total = rows.agg(F.count(F.lit(1)).alias("records"), F.count_if("penal").alias("penal"))
    sums = [F.sum("records").alias("records"), F.sum("penal").alias("penal")]
    # the paths differ in their tables; each of these is the sum of one table's rows
    by_territory = rows.groupBy("territory").agg(F.count(F.lit(1)).alias("records"), F.count_if("penal").alias("penal"))
    by_period = rows.filter("territory <> 7").groupBy("ano", "semestre", "territory").agg(F.count(F.lit(1)).alias("records"), F.count_if("penal").alias("penal"))
    return audit.reconcile(fact=total, territory=by_territory.agg(*sums), attributed=by_period.agg(*sums))


@BOOK.add(FACT + """, y AS (SELECT ano, count(*) AS records, count_if(penal) AS penal FROM fact GROUP BY ano HAVING ano < 2001)
SELECT min(ano) AS first, max(ano) AS last, round(arg_max(records, ano) / arg_min(records, ano), 6) AS records_growth, round(arg_max(penal, ano) / arg_min(penal, ano), 6) AS penal_growth FROM y""")
def growth_ratio(spark, sf_dir):
    years = grains(fact(spark, sf_dir), ["ano"])
    g = agg.growth(years, "ano", ["records", "penal"], F.col("ano") < 2001)
    return g.select("first", "last", F.round("records_growth", 6).alias("records_growth"), F.round("penal_growth", 6).alias("penal_growth"))


@BOOK.add(FACT + "SELECT ano, semestre, count(*) AS records, CAST(count_if(penal) AS BIGINT) AS penal, ano || '/' || semestre AS period FROM fact GROUP BY ALL ORDER BY records DESC, ano, semestre LIMIT 1")
def argmax_period(spark, sf_dir):
    from ..functions.text import period_label

    rows = fact(spark, sf_dir).groupBy("ano", "semestre").agg(F.count(F.lit(1)).alias("records"), F.count_if("penal").alias("penal")).withColumn("period", period_label(F.col("ano"), F.col("semestre")))
    return agg.peak(rows, "records", "period")


@BOOK.add(FACT + """, a AS (SELECT region, count(*) AS records, CAST(count_if(penal) AS BIGINT) AS penal, count(DISTINCT territory) AS territories FROM fact GROUP BY region),
d AS (SELECT n_regionkey AS region, CAST(sum(p) AS BIGINT) AS population FROM nation LEFT JOIN (SELECT c_nationkey AS k, CASE WHEN c_nationkey = 3 THEN NULL ELSE count(*) * 1000 END AS p FROM customer GROUP BY 1) ON n_nationkey = k GROUP BY 1)
SELECT r_name, records, penal, territories, population, round(penal / population * 10000, 2) AS rate_penal FROM a JOIN region ON region = r_regionkey LEFT JOIN d USING (region)""")
def region_rollup(spark, sf_dir):
    """Population comes from the dimension, so territories without records count too."""
    a = fact(spark, sf_dir).groupBy("region", "territory").agg(F.count(F.lit(1)).alias("r"), F.count_if("penal").alias("p")).groupBy("region").agg(F.sum("r").alias("records"), F.sum("p").alias("penal"), F.count(F.lit(1)).alias("territories"))
    dim = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("territory"), F.col("n_regionkey").alias("region")).join(population(spark, sf_dir), "territory", "left").groupBy("region").agg(F.sum("population").alias("population"))
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    return a.join(names, "region").join(dim, "region", "left").select("r_name", "records", "penal", "territories", "population", m.rate(F.col("penal"), F.col("population")).alias("rate_penal"))


@BOOK.add(FACT + "SELECT region, territory_name, count(*) AS records, CAST(count_if(penal) AS BIGINT) AS penal FROM fact GROUP BY ROLLUP (region, territory_name)")
def region_territory_rollup(spark, sf_dir):
    return fact(spark, sf_dir).rollup("region", "territory_name").agg(F.count(F.lit(1)).alias("records"), F.count_if("penal").alias("penal"))


@BOOK.add(FACT + """, t AS (SELECT p_type, count(*) AS n FROM fact GROUP BY 1 ORDER BY n DESC, p_type LIMIT 4)
SELECT ano, """ + ", ".join(f"CAST(count_if(p_type = (SELECT p_type FROM t ORDER BY n DESC, p_type LIMIT 1 OFFSET {i})) AS BIGINT) AS c{i}" for i in range(4)) + " FROM fact GROUP BY ano")
def pivot_top4(spark, sf_dir):
    rows = fact(spark, sf_dir).groupBy("ano", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return agg.pivot_top(rows, "ano", "p_type", "n", 4).toDF("ano", "c0", "c1", "c2", "c3")


@BOOK.add(FACT + "SELECT p_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM fact WHERE penal GROUP BY p_type")
def category_share(spark, sf_dir):
    rows = fact(spark, sf_dir).filter("penal").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return agg.share_of_total(rows, "n").withColumn("share", F.round("share", 6))


@BOOK.add(FACT + "SELECT ano, count(*) AS total, CAST(count_if(penal) AS BIGINT) AS penal, CAST(count_if(NOT penal) AS BIGINT) AS social, count(DISTINCT semestre) AS halves FROM fact WHERE region = 2 GROUP BY ano")
def annual_series(spark, sf_dir):
    rows = fact(spark, sf_dir).filter("region = 2").groupBy("ano", "semestre").agg(F.count(F.lit(1)).alias("t"), F.count_if("penal").alias("p"))
    return rows.groupBy("ano").agg(F.sum("t").alias("total"), F.sum("p").alias("penal"), F.count_distinct("semestre").alias("halves")).withColumn("social", m.nature("social", F.col("total"), F.col("penal")))


TOPIC_YEARS = " UNION ALL ".join(f"SELECT territory, ano, '{f[3:]}' AS topic, CAST(sum({f}) AS BIGINT) AS total, CAST(sum(CASE WHEN penal THEN {f} ELSE 0 END) AS BIGINT) AS penal FROM fact WHERE ano BETWEEN 1996 AND 1998 GROUP BY territory, ano" for f in FLAGS)


@BOOK.add(FACT + TOPIC_YEARS)
def topic_year_table(spark, sf_dir):
    """Both halves of a year are summed."""
    rows = grains(fact(spark, sf_dir).filter("ano between 1996 and 1998"), ["territory", "ano", "semestre"], group_sums())
    years = agg.resum(rows, ["territory", "ano"], skip=("semestre",))
    pairs = F.array(*[F.struct(F.lit(f[3:]).alias("topic"), F.col(f"{f[3:]}_total").alias("total"), F.col(f"{f[3:]}_penal").alias("penal")) for f in FLAGS])
    return years.select("territory", "ano", F.explode(pairs).alias("t")).select("territory", "ano", "t.*")


@BOOK.add(FACT + f""", {POPULATION}, t AS (SELECT territory_name, CAST(sum(is_mulher) AS BIGINT) AS total, CAST(sum(CASE WHEN penal THEN is_mulher ELSE 0 END) AS BIGINT) AS penal, any_value(population) AS population FROM fact LEFT JOIN pop USING (territory) GROUP BY territory_name)
SELECT territory_name, total, penal, round(100.0 * penal / total, 4) AS pct_penal, CASE WHEN population > 0 THEN round(penal / population * 10000, 2) END AS rate FROM t WHERE population > 0 ORDER BY rate DESC, territory_name LIMIT 10""")
def executive_panel(spark, sf_dir):
    from ..operators.rank import top

    rows = grains(fact(spark, sf_dir), ["territory", "territory_name"], group_sums()).join(population(spark, sf_dir), "territory", "left")
    rated = rows.select("territory_name", F.col("mulher_total").alias("total"), F.col("mulher_penal").alias("penal"), F.round(m.percent(F.col("mulher_penal"), F.col("mulher_total")), 4).alias("pct_penal"), m.rate(F.col("mulher_penal"), F.col("population")).alias("rate"))
    return top(rated, "rate", 10, "territory_name")


@BOOK.add(FACT + f""", {POPULATION}, t AS (SELECT territory, CASE WHEN any_value(population) > 0 THEN round(count(*) / 16 / any_value(population) * 10000, 2) END AS rate FROM fact LEFT JOIN pop USING (territory) WHERE region IN (0, 4) GROUP BY territory)
SELECT round(min(rate), 4) AS low, round((min(rate) + max(rate)) / 2, 4) AS middle, round(max(rate), 4) AS high FROM t""")
def displayed_range(spark, sf_dir):
    rows = grains(fact(spark, sf_dir).filter(F.col("region").isin(0, 4)), ["territory"]).join(population(spark, sf_dir), "territory", "left")
    rated = rows.select(m.legacy_rate(F.col("records"), F.col("population")).alias("rate"))
    return rated.agg(F.round(F.min("rate"), 4).alias("low"), F.round((F.min("rate") + F.max("rate")) / 2, 4).alias("middle"), F.round(F.max("rate"), 4).alias("high"))


_MEASURED = {"total": "p", "media_anual": "p / 16.0", "total_10k": "coalesce(CASE WHEN population > 0 THEN p / population * 10000 END, 0)", "taxa_anual_10k": "coalesce(CASE WHEN population > 0 THEN p / 16.0 / population * 10000 END, 0)", "taxa_anual_100k": "coalesce(CASE WHEN population > 0 THEN p / 16.0 / population * 100000 END, 0)"}


@BOOK.add(FACT + f""", {POPULATION}, t AS (SELECT territory, count_if(penal) AS p, any_value(population) AS population FROM fact LEFT JOIN pop USING (territory) GROUP BY territory),
v AS ({" UNION ALL ".join(f"SELECT territory, '{n}' AS measure, CAST({e} AS DOUBLE) AS v FROM t" for n, e in _MEASURED.items())})
SELECT territory, measure, round(v, 4) AS value, round(min(v) OVER (PARTITION BY measure), 4) AS low, round(max(v) OVER (PARTITION BY measure), 4) AS high FROM v""")
def displayed_measures(spark, sf_dir):
    """Every territory's penal records as each of the five measures, beside the measure's range over all territories."""
    rows = grains(fact(spark, sf_dir), ["territory"]).join(population(spark, sf_dir), "territory", "left")
    values = F.array(*[F.struct(F.lit(n).alias("measure"), m.displayed(n, F.col("penal"), F.col("population")).cast("double").alias("v")) for n in m.DISPLAYED])
    each = rows.select("territory", F.inline(values))
    ends = each.groupBy("measure").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return each.join(F.broadcast(ends), "measure").select("territory", "measure", *[F.round(c, 4).alias(n) for c, n in (("v", "value"), ("low", "low"), ("high", "high"))])


@BOOK.add(FACT + f""", {POPULATION}, t AS (SELECT territory_name, count_if(penal) AS p, any_value(population) AS population FROM fact LEFT JOIN pop USING (territory) GROUP BY territory_name),
r AS (SELECT *, CASE WHEN population > 0 THEN p / population * 10000 END AS rate FROM t)
SELECT (SELECT territory_name FROM r WHERE rate IS NOT NULL ORDER BY rate DESC, territory_name DESC LIMIT 1) AS leader, round(max(rate), 4) AS leader_rate,
  round(sum(CASE WHEN population > 0 THEN p END) / sum(population) * 10000, 4) AS pooled_rate, round(max(rate) / (sum(CASE WHEN population > 0 THEN p END) / sum(population) * 10000), 4) AS ratio FROM r""")
def leader_against_pool(spark, sf_dir):
    rows = grains(fact(spark, sf_dir), ["territory", "territory_name"]).join(population(spark, sf_dir), "territory", "left")
    return leader_ratio(rows, "penal", "population", "territory_name", 10_000).select("leader", *[F.round(c, 4).alias(c) for c in ("leader_rate", "pooled_rate", "ratio")])


@BOOK.add(FACT + """, o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS ano, count(*) AS official FROM orders GROUP BY 1), w AS (SELECT ano, count(DISTINCT CASE WHEN reliable THEN id END) AS own FROM fact GROUP BY 1)
SELECT ano, official, own, round(own / official, 4) AS ratio FROM o JOIN w USING (ano)""")
def official_validation(spark, sf_dir):
    official = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("ano")).agg(F.count(F.lit(1)).alias("official"))
    own = grains(fact(spark, sf_dir), ["ano"]).select("ano", F.col("complaints").alias("own"))
    return audit.against_official(own, official)


@BOOK.add(FACT + """, o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS ano, count(*) AS official FROM orders GROUP BY 1), w AS (SELECT ano, count(DISTINCT CASE WHEN reliable THEN id END) AS own FROM fact WHERE ano < 2000 GROUP BY 1)
SELECT ano, official, own, round(own / official, 4) AS ratio FROM o LEFT JOIN w USING (ano)""")
def official_validation_left(spark, sf_dir):
    """Official years without own records stay."""
    official = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("ano")).agg(F.count(F.lit(1)).alias("official"))
    own = grains(fact(spark, sf_dir).filter("ano < 2000"), ["ano"]).select("ano", F.col("complaints").alias("own"))
    return audit.against_official(own, official, how="left")


@BOOK.add(FACT + "SELECT territory, count(*) AS records, 0 AS distance_missing FROM fact GROUP BY territory HAVING count(*) >= 100")
def having_with_default(spark, sf_dir):
    rows = fact(spark, sf_dir).groupBy("territory").agg(F.count(F.lit(1)).alias("records")).filter("records >= 100")
    return with_default(rows, distance_missing=0)
