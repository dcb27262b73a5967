"""Text functions of the harmoniser, as column expressions; the name functions work on the driver's schemas."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config


def _fold_map() -> tuple[str, str]:
    """Latin letters whose decomposition is a plain letter, and those letters."""
    pairs = [(c, unicodedata.normalize("NFKD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFKD", c)) > 1]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _fold_map()


def key_of(name: str | None) -> str:
    """A column name without accents, case and punctuation: words joined by one underscore."""
    if name is None:
        return ""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    return "_".join("".join(c if c.isalnum() else " " for c in plain).split())


def fold(c: Column) -> Column:
    """Without accents, within Latin letters; combining marks go too. A value of as many bytes as characters has neither."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{M}+", ""))


def normal_key(c: Column) -> Column:
    """`key_of` for values; null becomes the empty key."""
    return F.coalesce(F.btrim(F.regexp_replace(F.lower(fold(c)), r"[^\p{L}\p{N}]+", "_"), F.lit("_")), F.lit(""))


def clean(c: Column) -> Column:
    """Upper case and trimmed, or empty where the value says that nothing is known. Never null."""
    s = F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    # one pattern, so that the key is computed once; absent values, and those that begin with a letter or digit that no such word begins with, need none
    nothing = normal_key(s).rlike(NOTHING)
    return F.when(s == "", s).when(F.lower(F.substring(s, 1, 1)).isin(*SAYING) | ~nothing, F.upper(s)).otherwise(F.lit(""))


#: Keys of values that say nothing; keys are letters, digits and underscores.
NOTHING = rf"^(?:(?:{'|'.join(config.NULL_TOKENS)})\z|(?:{'|'.join(config.NULL_PREFIXES)}))"
#: ASCII letters and digits that begin no word for nothing.
SAYING = sorted(set("abcdefghijklmnopqrstuvwxyz0123456789") - {w[0] for w in (*config.NULL_TOKENS, *config.NULL_PREFIXES) if w})


def join_filled(*columns: Column, sep: str = " ; ") -> Column:
    """The fields that hold something, joined."""
    return F.concat_ws(sep, *[F.nullif(c, F.lit("")) for c in columns])


def has_any(c: Column, terms) -> Column:
    """Whether a literal term occurs; terms are never patterns. A null text holds none."""
    found = F.lit(False)
    for t in terms:
        found = found | c.contains(t)
    return F.coalesce(found, F.lit(False))


def collapse(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def plain_number(c: Column) -> Column:
    """Digits with thousands marks as a whole number, else null."""
    digits = F.btrim(F.translate(c, ".,", ""))
    return F.when(digits.rlike(r"^[0-9]+$"), digits.cast("long"))


def municipality_code(c: Column) -> Column:
    """The seven-digit code of the state at the beginning of the value, else null."""
    s = F.btrim(c)
    return F.when(s.startswith(config.CODE_PREFIX), F.nullif(F.regexp_extract(s, r"^(\d{7})", 1), F.lit("")))


def municipality_key(c: Column) -> Column:
    """The normalised name left after a state mark and a leading number are taken away; null where nothing is said."""
    s = F.btrim(c)
    nothing = s.isNull() | (s == "") | F.upper(s).isin("NAN", "NULL", "NONE", "<NA>", "NI")
    bare = F.regexp_replace(F.regexp_replace(s, r"(?i)\s*\(SC\)\s*", " "), r"^\d+\s*[|/-]\s*", "")
    return F.when(~nothing, F.nullif(normal_key(F.btrim(bare)), F.lit("")))


def age_range_of(s: Column) -> Column:
    """struct(lo, hi) of a cleaned age bracket in any of the series' forms, else null."""

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(s, pattern, group).cast("int")

    def made(lo: Column, hi: Column) -> Column:
        return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    or_more, between, exact = r"(\d{1,3})\s*ANOS?\s*OU\s*MAIS", r"(\d{1,3})\s*A\s*(\d{1,3})\s*ANOS?\b", r"^(\d{1,3})\s*ANOS?$"
    return (
        F.when(s.rlike(or_more), made(number(or_more, 1), F.lit(config.OPEN_AGE)))
        .when(s.rlike(between), made(F.least(number(between, 1), number(between, 2)), F.greatest(number(between, 1), number(between, 2))))
        .when(s.rlike(exact), made(number(exact, 1), number(exact, 1)))
        .when(has_any(s, config.NEWBORN_TERMS), made(F.lit(0), F.lit(0)))
    )


def is_child(s: Column, age: Column) -> Column:
    """Of a cleaned bracket and its range: wholly under 18, or a label that says so."""
    return F.coalesce(age["hi"] <= config.CHILD_MAX_AGE, F.lit(False)) | has_any(s, config.CHILD_TERMS)


def is_elderly(s: Column, age: Column) -> Column:
    return F.coalesce(age["lo"] >= config.ELDERLY_MIN_AGE, F.lit(False)) | has_any(s, config.ELDERLY_TERMS)


def with_age(df: DataFrame, bracket: Column, text: str = "_bracket", age: str = "_age") -> DataFrame:
    """Adds the cleaned bracket and its range as columns, so that neither is computed again for every use."""
    return df.withColumn(text, clean(bracket)).withColumn(age, age_range_of(F.col(text)))


def declared_modules(c: Column) -> Column:
    """The group flags whose module a label names, sorted and distinct."""
    label = fold(F.upper(F.coalesce(c, F.lit(""))))
    return F.sort_array(F.array_distinct(F.array_compact(F.array(*[F.when(label.contains(p), F.lit(g)) for p, g in config.MODULE_PATTERNS]))))


def facility_code(c: Column) -> Column:
    return F.regexp_extract(c, r"(PCI/[A-Z0-9/]+)", 1)


def facility_kind(c: Column) -> Column:
    return F.when(c.contains("Superintend"), "Superintendência Regional").when(c.contains("Núcleo") | c.contains("Nucleo"), "Núcleo Regional").otherwise("Unidade Regional")


def parent_unit(parent: Column, manager: Column) -> Column:
    """The parent unit's name without the manager and the mail slug that page text ran into it."""
    p, m = F.btrim(F.coalesce(parent, F.lit(""))), F.btrim(F.coalesce(manager, F.lit("")))
    at = F.locate("\x00", F.when(m != "", F.replace(p, m, F.lit("\x00"))).otherwise(p))
    cut = F.when(at > 0, F.btrim(F.substring(p, F.lit(1), at - 1))).otherwise(p)
    return F.btrim(F.regexp_replace(cut, r"(?i)\s+(nr|sr)[a-z]{2,4}$", ""))


def period_label(year: Column, half: Column) -> Column:
    return F.when(half == 0, year.cast("string")).otherwise(F.concat_ws("/", year.cast("string"), half.cast("string")))
