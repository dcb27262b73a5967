"""Schema harmonisation: many spellings and eras to one canonical frame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import key_of


@dataclass(frozen=True)
class Resolution:
    """Which real column stands for which canonical field, and the fields without one."""

    found: dict[str, str]
    missing: tuple[str, ...]


def resolve(columns: list[str], aliases=config.ALIASES) -> Resolution:
    """The first alias, in their order, that a column spells; of columns that spell alike the first counts. A column may stand for several fields."""
    by_key: dict[str, str] = {}
    for c in columns:
        by_key.setdefault(key_of(c), c)
    found = {}
    for field, spellings in aliases.items():
        real = next((by_key[k] for k in map(key_of, spellings) if k in by_key), None)
        if real is not None:
            found[field] = real
    return Resolution(found, tuple(f for f in aliases if f not in found))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def canonical(df: DataFrame, resolution: Resolution | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every canonical field as a string, null where the file has none, and the `extra` columns as they are."""
    r = resolution or resolve(df.columns)
    fields = [(quoted(r.found[f]).cast("string") if f in r.found else F.lit(None).cast("string")).alias(f) for f in (*r.found, *r.missing)]
    return df.select(*fields, *extra)


def era(resolution: Resolution) -> str:
    real = resolution.found.get("id_denuncia")
    if real is None:
        return "no_id"
    return "pair_id" if key_of(real) == "hash_par_vitima_suspeito" else "complaint_id"


def unify(df: DataFrame, canon: str, *spellings: str) -> DataFrame:
    """One column of whichever of these exist, the first that holds something."""
    have = [s for s in (canon, *spellings) if s in df.columns]
    return df.withColumn(canon, F.coalesce(*map(quoted, have))) if have else df


def with_default(df: DataFrame, **defaults) -> DataFrame:
    """Missing columns as constants; columns that exist stay."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def as_strings(df: DataFrame) -> DataFrame:
    return df.select([quoted(c).cast("string").alias(c) for c in df.columns])


def union_diagonal(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with different columns; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


EMPTY_WORDS = ("null", "none", "nan", "n/a", "n/d")


def filled_counts(df: DataFrame) -> DataFrame:
    """One row: for every column the number of values that say something."""
    text = {c: F.lower(F.btrim(quoted(c).cast("string"))) for c in df.columns}
    return df.agg(*[F.count_if(v.isNotNull() & (v != "") & ~v.isin(*EMPTY_WORDS)).alias(c) for c, v in text.items()])


def drop_empty(df: DataFrame) -> DataFrame:
    """Without the columns that say nothing in any row; found in one pass."""
    counts = filled_counts(df).first()
    return df.select([quoted(c) for c in df.columns if counts[c]])


def labelled(c: Column, labels: dict[str, str]) -> Column:
    """The label of a value, or the value itself."""
    if not labels:
        return c
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), c)


def spellings(schemas: dict[str, list[str]], spark, aliases=config.ALIASES) -> DataFrame:
    """field, spelling, n_files over the schemas of many files."""
    rows = [(f, real, name) for name, columns in schemas.items() for f, real in resolve(columns, aliases).found.items()]
    return spark.createDataFrame(rows, "field string, spelling string, file string").groupBy("field", "spelling").agg(F.count(F.lit(1)).alias("n_files"))


def metric_columns(group: str | None, unit: str) -> tuple[str, str]:
    """The total and penal columns that a slice shows: a group has records only, whatever unit is asked for."""
    if group:
        return f"{group}_total", f"{group}_penal"
    return ("denuncias_unicas", "denuncias_unicas_penal") if unit == "complaints" else ("total_denuncias", "total_penal")
