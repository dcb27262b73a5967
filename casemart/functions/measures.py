"""Rates, shares and bands. Null stays null where nothing can be measured; it never becomes 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def rate(count: Column, population: Column, scale: int = config.RATE_SCALE) -> Column:
    """Per `scale` inhabitants, two decimals; null without a population."""
    return F.when(population > 0, F.round(count / population * scale, 2))


def years_covered(halves: Column) -> Column:
    return F.greatest(halves, F.lit(1)) / 2


def annual_rate(count: Column, population: Column, halves: Column, scale: int = config.RATE_SCALE) -> Column:
    return F.when(population > 0, count / years_covered(halves) / population * scale)


def legacy_rate(count: Column, population: Column, scale: int = config.RATE_SCALE, annual: bool = True) -> Column:
    """The fixed 16-year divisor of the published map; `annual_rate` is the measured one."""
    return F.when(population > 0, F.round(count / (config.LEGACY_YEARS if annual else 1) / population * scale, 2))


#: The five measures of the published map: whether by year, and the scale of a rate.
DISPLAYED = {"total": (False, None), "media_anual": (True, None), "total_10k": (False, 10_000), "taxa_anual_10k": (True, 10_000), "taxa_anual_100k": (True, 100_000)}


def displayed(measure: str, count: Column, population: Column) -> Column:
    """A count as one of DISPLAYED, with the fixed divisor of years. As on the map a missing count is 0, and so is a rate without a population; an unknown measure is the count."""
    annual, scale = DISPLAYED.get(measure, (False, None))
    n = F.coalesce(count, F.lit(0)) / (config.LEGACY_YEARS if annual else 1)
    return n if scale is None else F.when(population > 0, n / population * scale).otherwise(0.0)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100 * part / whole)


def expansion(records: Column, complaints: Column) -> Column:
    """Records per complaint, two decimals."""
    return F.when(complaints > 0, F.round(records / complaints, 2))


def travel_minutes(km: Column, speed: float) -> Column:
    return km * config.ROAD_FACTOR / speed * 60


def nature(kind: str, total: Column, penal: Column) -> Column:
    """total, penal or social."""
    return {"total": total, "penal": penal, "social": total - penal}[kind]


def distance_band(km: Column) -> Column:
    """near below 25 km, middle up to and with 50, far beyond, unknown without a distance."""
    return F.when(km.isNull(), "unknown").when(km < config.NEAR_KM, "near").when(km <= config.FAR_KM, "middle").otherwise("far")


def population_band(n: Column) -> Column:
    return F.when(n < 20_000, "<20k").when(n < 50_000, "20-50k").when(n < 100_000, "50-100k").when(n >= 100_000, ">=100k")
