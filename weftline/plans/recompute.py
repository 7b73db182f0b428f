"""The flagship plan: from the journal to ranked domain scores.

Snapshot (latest row of each key), one row per domain with the latest of each metric, axes as Columns, the
weighted composite in long form, and the rank of what enough was measured of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.tristate import BLIND
from weftline.operators import composite as C
from weftline.operators.journal import latest
from weftline.operators.relational import placed
from weftline.session import written

METRICS = ("click", "view", "purchase", "error", "signup")
LEAST_SHARE = 0.60


def context(journal: DataFrame) -> DataFrame:
    """One row per domain: for each metric the latest (value, state) over its sources, null if never asked."""
    last = lambda m: F.max(F.when(F.col("metric") == m, F.struct("measured_at", "seq", "value", "state"))).alias(m)
    return latest(journal).groupBy("domain").agg(*map(last, METRICS))


def axes() -> dict[str, Column]:
    """The five axes from a context row. A metric that was never asked or is blind leaves its axis blind."""
    value = lambda m: F.when(F.col(f"{m}.state") == "MEASURED", F.col(f"{m}.value"))
    asked = lambda m: F.coalesce(F.col(f"{m}.state") != BLIND, F.lit(False))
    given = lambda m, v: F.when(~asked(m), C.whole(None)).when(value(m).isNull(), C.point(5.0, "ABSENT")).otherwise(C.point(F.least(F.lit(100.0), v), "MEASURED"))
    return {
        "TR": C.popularity(F.floor(value("click") * 5000) + 1, F.lit(200), asked("click")),
        "AA": given("signup", value("signup")),
        "PO": given("purchase", value("purchase") / 2),
        "CO": C.axis_coverage(F.floor(value("view") * 10), F.lit(1.0), F.lit(1.0)),
        "ST": given("error", 100 - F.least(F.lit(100.0), value("error"))),
    }


def recompute(journal: DataFrame) -> DataFrame:
    """(domain, value, low, high, share, place): place ranks the domains of which LEAST_SHARE was measured, over ranges of
    scores, so that no task sorts all domains, nor all those of one score."""
    parts = [
        F.struct(F.lit(C.AXES[n]).alias("w"), F.floor(p["value"] * 100 + 0.5).cast("double").alias("v100"), p["state"].alias("state"), p["low"].cast("double").alias("lo"), p["high"].cast("double").alias("hi"), F.when(p["state"] == BLIND, 0.0).otherwise(1.0).alias("part"))
        for n, p in axes().items()
    ]
    long = context(journal).select("domain", F.inline(F.array(*parts))).withColumn("v", F.col("v100") / 100)
    scores = C.aggregate(long, "domain").withColumn("shown", F.col("value").isNotNull() & (F.round("share", 9) >= LEAST_SHARE))
    return with_places(scores).select("domain", "value", "low", "high", "share", "place")


def with_places(scores: DataFrame) -> DataFrame:
    """``place`` by value descending, then domain, for rows that are ``shown``: they come first in an order of all rows. Values
    are compared at nine decimals: two domains may reach one value by other parts, and sums of doubles differ in their last bit."""
    ranked = placed(written(scores, "scores"), [F.when(F.col("shown"), 0).otherwise(1), F.round("value", 9).desc(), F.col("domain")])
    return ranked.withColumn("place", F.when(F.col("shown"), F.col("place")))
