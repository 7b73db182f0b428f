"""Traffic estimates with their uncertainty: log-log interpolation, geometric means, errors added in quadrature.

The curves are a few dozen constants, so they live in the expressions: no join, no UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans import curves as K

FORBIDDEN_LABELS = ("measured traffic", "real traffic", "actual visits")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sigma_from_range(low: Column, high: Column) -> Column:
    """Standard deviation of ln x whose 90 % range is low to high."""
    return F.log(high / low) / (2 * K.Z90)


def geo_mean2(a: Column, b: Column) -> Column:
    return F.sqrt(a * b)


def interpolated(curve: dict[int, float], position: Column) -> Column:
    """struct(percent, mode) of a curve: ``tabulated``, ``interpolated``, ``gap`` over missing points, null beyond."""
    points = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(v).alias("v")) for p, v in sorted(curve.items())])
    below = F.filter(points, lambda x: x["p"] <= position)
    above = F.filter(points, lambda x: x["p"] >= position)

    def between(ends: Column) -> Column:
        low, high = ends["low"], ends["high"]
        share = F.log(position / low["p"]) / F.log(high["p"] / low["p"])
        exact = low["p"] == high["p"]
        value = F.when(exact, low["v"]).otherwise(F.exp(F.log(low["v"]) + share * F.log(high["v"] / low["v"])))
        mode = F.when(low["p"].isNull() | high["p"].isNull(), None).when(exact, "tabulated").when(high["p"] - low["p"] > 1, "gap").otherwise("interpolated")
        return F.struct(value.alias("percent"), mode.alias("mode"))

    return let(F.struct(F.try_element_at(below, F.lit(-1)).alias("low"), F.get(above, F.lit(0)).alias("high")), between)


def percents(curves: dict[str, dict[int, float]], position: Column) -> Column:
    """The curves' percents at a position, without those that do not reach it."""
    return F.array_compact(F.array(*[interpolated(c, position)["percent"] for c in curves.values()]))


def spread(values: Column) -> Column:
    """Largest over smallest."""
    return F.array_max(values) / F.array_min(values)


def array_geo_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.log(x))
    return F.when(F.size(values) > 0, F.exp(total / F.size(values)))


def ctr_retained(position: Column) -> Column:
    """struct(ctr, low, high, sigma, curves): geometric mean of the curves that reach the position; a lone curve gets
    the typical disagreement as its range; none leaves it blind."""
    root = math.sqrt(K.typical_disagreement())

    def joined(v: Column) -> Column:
        n = F.size(v)

        def ranged(centre: Column) -> Column:
            low = F.when(n > 1, F.array_min(v)).otherwise(centre / root)
            high = F.when(n > 1, F.array_max(v)).otherwise(centre * root)
            return F.struct(centre.alias("ctr"), low.alias("low"), high.alias("high"), sigma_from_range(low, high).alias("sigma"), n.cast("long").alias("curves"))

        return let(array_geo_mean(v), ranged)

    return let(percents(K.CURVES, position), joined)


def country_sigma(position: Column, country: Column) -> Column:
    """Extra doubt for a country without its own curve: the gap between those that have one."""
    gap = let(percents(K.BY_COUNTRY, position), spread)
    return F.when(country.isin(*K.COUNTRIES), 0.0).otherwise(F.log(gap) / (2 * K.Z90))


def serp_multiplier(types: Column) -> Column:
    """struct(low, high, centre, sigma): product of the ranges of what stands on the result page, floored. An unknown
    type raises."""
    table = F.create_map(*[F.lit(x) for k, (a, b) in K.SERP_EFFECTS.items() for x in (k, F.array(F.lit(a), F.lit(b)))])
    pair = lambda t: F.coalesce(F.try_element_at(table, t), F.raise_error(F.concat(F.lit("unknown result type: "), t)).cast("array<double>"))
    product = lambda i: F.greatest(F.lit(K.SERP_FLOOR), F.aggregate(types, F.lit(1.0), lambda a, t: a * F.get(pair(t), F.lit(i))))
    both = F.struct(product(0).alias("low"), product(1).alias("high"))
    return let(both, lambda b: F.struct(b["low"].alias("low"), b["high"].alias("high"), geo_mean2(b["low"], b["high"]).alias("centre"), sigma_from_range(b["low"], b["high"]).alias("sigma")))


def parse_bucket(text: Column) -> Column:
    """``100 - 1 K`` as struct(low, high)."""
    unit = lambda u: F.when(F.upper(u) == "K", 1e3).when(F.upper(u) == "M", 1e6).otherwise(1.0)
    pattern = r"([0-9.]+)\s*([KMkm]?)\s*-\s*([0-9.]+)\s*([KMkm]?)"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.struct((part(1).try_cast("double") * unit(part(2))).alias("low"), (part(3).try_cast("double") * unit(part(4))).alias("high"))


def volume_central(exact: Column, single: Column, low: Column, high: Column) -> Column:
    """struct(centre, sigma): an exact volume is certain, a single one is good to a factor of sqrt 2 either way, a
    range has its geometric mean; bounds of zero or less become 1."""
    lo, hi = F.greatest(low, F.lit(1.0)), F.greatest(high, F.lit(1.0))
    centre = F.when(exact.isNotNull(), exact).when(single.isNotNull(), single).otherwise(geo_mean2(lo, hi))
    sigma = F.when(exact.isNotNull(), 0.0).when(single.isNotNull(), math.log(2) / (2 * K.Z90)).otherwise(sigma_from_range(lo, hi))
    return F.struct(centre.alias("centre"), sigma.alias("sigma"))


def estimate(volume: Column, position: Column, country: Column, types: Column) -> Column:
    """struct(centre, low, high, sigma, state) of one query's clicks; BLIND where no curve reaches the position."""
    inputs = F.struct(volume.alias("volume"), ctr_retained(position).alias("ctr"), serp_multiplier(types).alias("serp"), country_sigma(position, country).alias("country"))

    def clicks(i: Column) -> Column:
        centre = i["volume"]["centre"] * i["ctr"]["ctr"] / 100 * i["serp"]["centre"]
        sigma = F.sqrt(sum((F.pow(s, F.lit(2.0)) for s in (i["volume"]["sigma"], i["ctr"]["sigma"], i["serp"]["sigma"], i["country"])), F.lit(0.0)))
        return F.struct(centre.alias("centre"), sigma.alias("sigma"))

    def ranged(e: Column) -> Column:
        width = F.exp(K.Z90 * e["sigma"])
        state = F.when(e["centre"].isNull(), "BLIND").otherwise("MEASURED")
        return F.struct(e["centre"].alias("centre"), (e["centre"] / width).alias("low"), (e["centre"] * width).alias("high"), e["sigma"].alias("sigma"), state.alias("state"))

    return let(let(inputs, clicks), ranged)


def estimate_domain(estimates: DataFrame, key: str) -> DataFrame:
    """Sums by domain: bounds added as if errors were shared, and the half-width they would have if independent."""
    half = (F.col("high") - F.col("low")) / 2
    kept = F.col("state") != "BLIND"
    return estimates.groupBy(key).agg(
        F.sum("centre").alias("centre"),
        F.sum("low").alias("low"),
        F.sum("high").alias("high"),
        F.sqrt(F.sum(F.pow(half, F.lit(2.0)))).alias("independent"),
        F.count(F.when(kept, 1)).alias("retained"),
        F.count(F.when(~kept, 1)).alias("excluded"),
    )


def guard_label(label: str) -> str:
    """The label for the modelled total; names that would pass it off as a measurement raise."""
    if label.strip().lower() in FORBIDDEN_LABELS:
        raise ValueError(f"{label!r} would present an estimate as a measurement")
    return label


FORBIDDEN_LABEL = r"(?i)(organic\s*traffic|trafic\s*organique)"


def guarded_label(label: Column) -> Column:
    """``label``, raising where it calls a modelled floor organic traffic."""
    said = F.concat(F.lit("forbidden label: "), label, F.lit("; a modelled floor over a fixed pool is no traffic"))
    return F.when(label.rlike(FORBIDDEN_LABEL), F.raise_error(said).cast("string")).otherwise(label)
