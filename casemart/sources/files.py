"""Readers and writers: tolerant CSV, period files, nested JSON, banded sheets, pages, exports."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import config
from ..functions import text as tx
from ..operators.audit import require, validate_copy
from ..operators.harmonise import Resolution, canonical, era, quoted, resolve

DELIMITERS = (";", ",", "\t", "|")


def period_of(name: str) -> tuple[int | None, int]:
    """Year and half (0: the whole year) that a file name tells."""
    year = re.search(r"20\d\d", name)
    half = 1 if "primeiro-semestre" in name else 2 if "segundo-semestre" in name else 0
    return (int(year[0]) if year else None), half


def with_period(df: DataFrame) -> DataFrame:
    """Adds arquivo_origem, ano, semestre from the file that each row comes from; a file that Spark wrote (part-...) goes by its folder."""
    # no pattern: each row's path is looked at, and a search for the last but one part tries every place of it
    folder = F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1)
    name = F.when(F.col("_metadata.file_name").startswith("part-"), folder).otherwise(F.col("_metadata.file_name"))
    file = F.col("arquivo_origem")
    half = F.when(file.contains("primeiro-semestre"), 1).when(file.contains("segundo-semestre"), 2).otherwise(0)
    return df.select("*", name.alias("arquivo_origem")).select("*", F.nullif(F.regexp_extract(file, r"(20\d\d)", 1), F.lit("")).cast("long").alias("ano"), half.cast("long").alias("semestre"))


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, sorted; found by Hadoop's file system, so any store will do."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found) if found else []


class Spelling(NamedTuple):
    """Files whose columns have the same names and types, and what these stand for."""

    schema: StructType
    resolution: Resolution
    paths: list[str]


def spelling_groups(spark: SparkSession, paths: list[str]) -> list[Spelling]:
    """Files by schema. Each footer is read once, several at a time; plans over the groups have a branch for each, not for each file."""
    if not paths:
        return []
    with ThreadPoolExecutor(min(32, len(paths))) as pool:
        schemas = list(pool.map(lambda path: spark.read.parquet(path).schema, paths))
    groups: dict[tuple, Spelling] = {}
    for path, schema in zip(paths, schemas, strict=True):
        key = tuple((f.name, f.dataType.simpleString()) for f in schema)
        groups.setdefault(key, Spelling(schema, resolve(schema.names), [])).paths.append(path)
    return list(groups.values())


def read_period_files(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """All files (or folders of one file's parts) of a pattern or a list, each by its own spellings, as one canonical frame with id_column, ano, semestre, part_file and row_index.

    Files of one schema are one scan of their resolved columns.
    """
    frames = []
    for group in spelling_groups(spark, list_files(spark, source) if isinstance(source, str) else source):
        r = group.resolution
        wanted = set(r.found.values())
        raw = spark.read.schema(StructType([f for f in group.schema if f.name in wanted])).parquet(*group.paths)
        rows = with_period(raw).select("*", F.col("_metadata.file_name").alias("part_file"), F.col("_metadata.row_index").alias("row_index"))
        frames.append(canonical(rows, r, ("arquivo_origem", "ano", "semestre", "part_file", "row_index")).withColumn("id_column", F.lit(r.found.get("id_denuncia")).cast("string")))
    if not frames:
        raise FileNotFoundError(source)
    return reduce(DataFrame.unionByName, frames)


def inventory(spark: SparkSession, source: str | list[str], state: str = config.STATE) -> DataFrame:
    """One row for each source file with rows: rows, state rows, distinct state rows, duplicates, id column, distinct ids, era, resolved and missing fields.

    One scan for each schema and one aggregate by file. Rows are told apart by
    the MD5 of all their values, ids by their value; both are made distinct on
    one shuffle, after partial counts. A file without a state column has no
    state rows.
    """
    frames, groups = [], spelling_groups(spark, list_files(spark, source) if isinstance(source, str) else source)
    if not groups:
        raise FileNotFoundError(source)
    for n, group in enumerate(groups):
        found = group.resolution.found
        raw = with_period(spark.read.schema(group.schema).parquet(*group.paths))
        own = F.coalesce(F.upper(F.btrim(quoted(found["uf"]).cast("string"))) == state, F.lit(False)) if "uf" in found else F.lit(False)
        id_ = quoted(found["id_denuncia"]).cast("string") if "id_denuncia" in found else F.lit(None).cast("string")
        frames.append(raw.select(F.col("arquivo_origem").alias("file"), F.lit(n).alias("n"), own.alias("own"), F.when(own, F.md5(F.to_json(F.struct(*map(quoted, group.schema.names))))).alias("row"), F.when(own, id_).alias("id")))
    kinds = F.array(F.struct(F.lit("row").alias("kind"), F.col("row").alias("value")), F.struct(F.lit("id").alias("kind"), F.col("id").alias("value")))
    each = reduce(DataFrame.unionByName, frames).select("file", "n", "own", F.inline(kinds)).groupBy("file", "n", "own", "kind", "value").agg(F.count(F.lit(1)).alias("m"))
    row, there = F.col("kind") == "row", F.col("own") & F.col("value").isNotNull()
    sums = each.groupBy("file", "n").agg(
        F.sum(F.when(row, F.col("m"))).alias("rows"), F.coalesce(F.sum(F.when(row & F.col("own"), F.col("m"))), F.lit(0)).alias("state_rows"), F.count_if(row & there).alias("distinct_state_rows"), F.count_if(~row & there).alias("ids")
    )
    told = [(n, g.resolution.found.get("id_denuncia"), era(g.resolution), sorted(g.resolution.found), sorted(g.resolution.missing)) for n, g in enumerate(groups)]
    facts = spark.createDataFrame(told, "n int, id_column string, era string, resolved array<string>, missing array<string>")
    return sums.join(F.broadcast(facts), "n").select(
        F.regexp_replace("file", r"^\w+=", "").alias("file"), "rows", "state_rows", "distinct_state_rows", (F.col("state_rows") - F.col("distinct_state_rows")).alias("duplicates"),
        "id_column", F.when(F.col("id_column").isNotNull(), F.col("ids")).alias("distinct_ids"), "era", "resolved", "missing",
    )


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent delimiter of the first line; a comma if it has none."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0].removeprefix("﻿") if head else ""
    best = max(DELIMITERS, key=line.count)
    return best if line.count(best) else ","


def detect_encoding(spark: SparkSession, path: str, probe: int = 256 * 1024) -> str:
    """UTF-8 if the first bytes are that, else Latin-1. A character that the probe cuts does not count. Only the head of the first file is read."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(where, "*") if fs.isDirectory(where) else where) or [] if x.isFile() and x.getLen() and not x.getPath().getName().startswith(("_", "."))]
    if not found:
        return "UTF-8"
    stream = fs.open(found[0].getPath())
    try:
        raw = bytes(stream.readNBytes(probe))
    finally:
        stream.close()
    for cut in range(4):
        try:
            raw[: len(raw) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "ISO-8859-1"


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """A tolerant scan: quotes are data, short rows are filled with null, extra fields dropped, null words become null. All columns are strings."""
    df = spark.read.options(header=True, sep=delimiter or detect_delimiter(spark, path), quote="", mode="PERMISSIVE", encoding=encoding or detect_encoding(spark, path), inferSchema=False).csv(path)
    df = df.toDF(*[c.removeprefix("﻿") for c in df.columns])
    return df.select([F.when(~quoted(c).isin(*config.CSV_NULLS), quoted(c)).alias(c) for c in df.columns])


def csv_to_parquet(spark: SparkSession, path: str, out: str, rows_per_file: int = 0) -> DataFrame:
    """Writes a CSV as zstd Parquet and compares every row of the copy with the source; raises if any differs."""
    source = read_csv(spark, path)
    write_parquet(source, out, rows_per_file=rows_per_file)
    report = validate_copy(source, spark.read.parquet(out))
    require(report)
    return report


def write_parquet(df: DataFrame, out: str, partition: list[str] | None = None, rows_per_file: int = 0, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition) if partition else writer).parquet(out)


EXPORTS = ("csv", "json", "parquet")


def export(df: DataFrame, out: str, kind: str, columns: list[str] | None = None) -> None:
    """The given columns that exist, unformatted, as CSV, JSON or Parquet."""
    if kind not in EXPORTS:
        raise ValueError(kind)
    rows = df.select([quoted(c) for c in columns if c in df.columns]) if columns else df
    writer = rows.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(out)


def bundle(**tables: DataFrame) -> DataFrame:
    """name, rows: every small table folded to a JSON array; for reports, whose tables are aggregates."""
    folded = [t.agg(F.to_json(F.collect_list(F.struct(*map(quoted, t.columns)))).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, folded)


def table_or_files(spark: SparkSession, table: str, path: str) -> DataFrame:
    return spark.table(table) if spark.catalog.tableExists(table) else spark.read.parquet(path)


def register(spark: SparkSession, saved: bool = False, **tables: DataFrame) -> None:
    """Tables for SQL: views of this session, or saved ones."""
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(name) if saved else df.createOrReplaceTempView(name)


SERVICE = "struct<disponivel:boolean,nome:string,endereco:string,telefone:string,horario:string>"
FACILITY = f"slug string, municipio string, ibge_code string, latitude double, longitude double, rodovia_principal string, url_oficial string, nome_unidade string, vinculacao string, responsavel string, email string, servicos struct<medicina_legal:{SERVICE},criminalistica:{SERVICE},identificacao:{SERVICE}>"


def facilities(raw: DataFrame) -> DataFrame:
    """The flat facility dimension of nested units (schema FACILITY)."""

    def t(c: str) -> Column:
        return F.btrim(F.coalesce(F.col(c).cast("string"), F.lit("")))

    def of(field: str, *services: str) -> Column:
        return F.btrim(F.coalesce(*[F.nullif(F.col(f"servicos.{s}.{field}"), F.lit("")) for s in services], F.lit("")))

    has = {f"tem_{s}": F.coalesce(F.col(f"servicos.{s}.disponivel"), F.lit(False)).alias(f"tem_{s}") for s in ("medicina_legal", "criminalistica", "identificacao")}
    name = t("nome_unidade")
    return raw.select(
        tx.facility_code(name).alias("sigla"), name.alias("nome"), t("municipio").alias("municipio"), t("ibge_code").alias("ibge_code"), tx.facility_kind(name).alias("tipo"),
        F.coalesce("latitude", F.lit(0.0)).alias("lat"), F.coalesce("longitude", F.lit(0.0)).alias("lon"),
        tx.parent_unit(F.col("vinculacao"), F.col("responsavel")).alias("vinculacao"), t("responsavel").alias("responsavel"), t("email").alias("email"), t("url_oficial").alias("url_oficial"), t("rodovia_principal").alias("rodovia_principal"),
        of("endereco", "medicina_legal", "criminalistica").alias("endereco"), of("telefone", "medicina_legal", "criminalistica").alias("telefone"),
        of("horario", "medicina_legal").alias("horario_medicina_legal"), of("horario", "criminalistica").alias("horario_criminalistica"), *has.values(),
    )


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    return facilities(spark.read.schema(FACILITY).json(path, multiLine=True))


def json_map(df: DataFrame, column: str, value_type: str, key: str = "key", value: str = "value") -> DataFrame:
    """key, value rows of a JSON object held in a string column."""
    return df.select(F.explode(F.from_json(column, f"map<string,{value_type}>")).alias(key, value))


def distances(df: DataFrame, column: str) -> DataFrame:
    """Distance records by code; the older key of the distance serves where the newer is absent."""
    fields = "struct<municipio:string,distancia_pci_km_linha_reta:double,distancia_pci_km:double,pci_proxima:string,faixa_distancia:string>"
    return json_map(df, column, fields, "ibge_code", "r").select("ibge_code", "r.municipio", F.coalesce("r.distancia_pci_km_linha_reta", "r.distancia_pci_km").alias("km"), "r.pci_proxima", "r.faixa_distancia")


def banded(df: DataFrame, label: str, value: str, order: str, state: str = config.STATE) -> DataFrame:
    """ano, value of the state's rows under "Ano 20XX" headings of a sheet; rows keep the sheet's order by `order`.

    A sheet is a small file with one order, so one task fills the years down.
    """
    year = F.nullif(F.regexp_extract(F.coalesce(F.col(label), F.lit("")), r"Ano\s+(20\d\d)", 1), F.lit("")).cast("long")
    down = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(F.last(year, ignorenulls=True).over(down).alias("ano"), F.upper(F.btrim(label)).alias("_l"), tx.plain_number(F.col(value)).alias("value"), F.col(order).alias("_o"))
    last = rows.filter((F.col("_l") == state) & F.col("ano").isNotNull() & F.col("value").isNotNull())
    return last.groupBy("ano").agg(F.max_by("value", "_o").alias("value"))


LINK = r"""(?is)<a[^>]+href=["']([^"']+\.csv(?:/view)?)["'][^>]*>"""


def links(pages: DataFrame, key: str = "page_id", html: str = "html", pattern: str = LINK) -> DataFrame:
    """page, href, base_name of the links that the pattern finds; of one page's links with one base name the first stays."""
    found = pages.select(F.col(key), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(pattern), F.lit(1))).alias("nth", "href"))
    base = F.regexp_replace(F.element_at(F.split(F.regexp_replace("href", r"/view$", ""), "/"), -1), r"\.csv$", "")
    return found.withColumn("base_name", base).groupBy(key, "base_name").agg(F.min_by("href", "nth").alias("href"))


def page_text(html: Column) -> Column:
    """Visible text: scripts, styles and tags away, white space collapsed."""
    no_code = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return tx.collapse(F.regexp_replace(no_code, r"<[^>]*>", " "))


# What a unit's page tells, as patterns over its text.
UNIT_PATTERNS = {
    "nome_unidade": r"(?i)((?:Núcleo Regional|Superintendência Regional)\s+de\s+Polícia\s+Científica[^\n\r]+)",
    "vinculacao": r"(?i)(Vinculad[oa]\s+à\s+Superintendência\s+Regional\s+de\s+Polícia\s+Científica\s+em\s+[\w\s]+)",
    "responsavel": r"(?i)((?:Perit[oa]\s+Regional|Superintendente\s+Regional|Responsável)[^\n\r]+)",
    "email": r"([\w\.-]+@[\w\.-]+\.gov\.br)",
    "telefone": r"(\(\d{2}\)\s*\d{4,5}-?\d{4})",
    "endereco": r"(?i)((?:Rua|Avenida|Av\.|Rodovia|Travessa|Praça)[^–\(\n]+(?:–\s*[\w\s]+)?)",
}


def page_records(pages: DataFrame, key: str = "page_id", html: str = "html", patterns: dict[str, str] | None = None) -> DataFrame:
    """A row of fields for every page, empty where a pattern finds nothing; line ends stay, as patterns stop at them."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    return pages.select(key, body.alias("_t")).select(key, *[tx.collapse(F.regexp_extract("_t", p, 1)).alias(n) for n, p in (patterns or UNIT_PATTERNS).items()])


# What heads a service's part of a unit's page, and what such a part tells.
SERVICE_HEADINGS = {"medicina_legal": "MEDICINA LEGAL", "criminalistica": "CRIMINALÍSTICA", "identificacao": "IDENTIFICAÇÃO"}
SERVICE_PATTERNS = {
    "telefone": r"(\(\d{2}\)\s*\d{4,5}-?\d{4})",
    "endereco": r"(?i)((?:Rua|Avenida|Av\.|Rodovia|Travessa|Praça)[^–\(]+(?:–\s*[\w\s]+)?)",
}
#: Hours, which the page may tell in a line of its own.
HOURS = r"(?i)((?:Segunda|Plantão|Todos os dias)[^\n\r]*\d\s*h[^\n\r]*)"
_CUT = "\x01"


def page_sections(pages: DataFrame, key: str = "page_id", html: str = "html", headings: dict[str, str] = SERVICE_HEADINGS) -> DataFrame:
    """key, nth, service, body: the visible text of every page, cut where a heading begins; part 0, before the first one, has no service.

    Headings are found in either case. A null page has one empty part; tags
    and scripts are no text, line ends stay.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    any_ = "|".join(re.escape(h) for h in headings.values())
    marked = F.regexp_replace(F.translate(text, _CUT, " "), f"(?iu)({any_})", f"{_CUT}$1")
    parts = pages.select(F.col(key), F.posexplode(F.split(marked, _CUT)).alias("nth", "body"))
    head = F.upper("body")
    service = F
    for name, heading in headings.items():
        service = service.when((F.col("nth") > 0) & head.startswith(heading), name)
    return parts.select(key, "nth", service.otherwise(F.lit(None)).alias("service"), "body")


def page_units(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The nested unit (schema FACILITY) of every page, with its key: fields of the page, and of each service those of its parts.

    A service is there if the page has a part for it; where several parts tell
    a field, the last one counts. What `pages` knows of a unit (slug, municipio,
    ibge_code, latitude, longitude, rodovia_principal, url_oficial) is taken
    over, else null.
    """
    parts = page_sections(pages, key, html)
    fields = {n: tx.collapse(F.regexp_extract("_flat", p, 1)) for n, p in SERVICE_PATTERNS.items()} | {"horario": tx.collapse(F.regexp_extract("body", HOURS, 1)), "nome": tx.collapse(F.regexp_extract("body", r"^([^\n\r(:<]{1,80})", 1))}
    told = parts.filter("service is not null").withColumn("_flat", tx.collapse(F.col("body"))).select(key, "nth", "service", *[F.nullif(v, F.lit("")).alias(n) for n, v in fields.items()])
    last = told.groupBy(key, "service").agg(*[F.max(F.when(F.col(n).isNotNull(), F.struct("nth", n)))[n].alias(n) for n in fields])
    one = F.struct(F.lit(True).alias("disponivel"), *[F.col(n) for n in ("nome", "endereco", "telefone", "horario")])
    nested = last.groupBy(key).agg(F.struct(*[F.first(F.when(F.col("service") == s, one), ignorenulls=True).alias(s) for s in SERVICE_HEADINGS]).alias("servicos"))
    known = {c: F.col(c).cast(t) if c in pages.columns else F.lit(None).cast(t) for c, t in (("slug", "string"), ("municipio", "string"), ("ibge_code", "string"), ("latitude", "double"), ("longitude", "double"), ("rodovia_principal", "string"), ("url_oficial", "string"))}
    own = pages.select(F.col(key), *[v.alias(n) for n, v in known.items()])
    whole = own.join(page_records(pages, key, html).select(key, "nome_unidade", "vinculacao", "responsavel", "email"), key).join(nested, key, "left")
    return whole


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    """codarea, kind, polygons (schema geography.MESH) of GeoJSON files, each a collection of features or one feature.

    Coordinates are as deep as the kind of geometry says, so a file's values
    are read as variants and each feature by its kind. A Polygon is one
    polygon; other kinds have none; features without a code drop out.
    """
    values = spark.read.format("json").option("singleVariantColumn", "v").option("multiLine", True).load(path)
    return mesh_features(values)


def mesh_features(values: DataFrame, column: str = "v") -> DataFrame:
    """The features of variants that are collections or single features."""

    def get(v: str, where: str, kind: str) -> Column:
        return F.try_variant_get(F.col(v), where, kind)

    several = F.coalesce(get(column, "$.features", "array<variant>"), F.array(F.col(column)))
    rows = values.select(F.explode(several).alias("f"))
    kind = get("f", "$.geometry.type", "string")
    ring = "array<array<array<double>>>"
    shapes = F.when(kind == "Polygon", F.array(get("f", "$.geometry.coordinates", ring))).when(kind == "MultiPolygon", get("f", "$.geometry.coordinates", f"array<{ring}>")).otherwise(F.array().cast(f"array<{ring}>"))
    code = F.btrim(F.coalesce(get("f", "$.properties.codarea", "string"), F.lit("")))
    return rows.select(code.alias("codarea"), kind.alias("kind"), shapes.alias("polygons")).filter("codarea <> ''")
