"""The observation journal: append-only facts, snapshots, series, movements and runs.

Every "latest" is a window over a total order (time, then sequence), never max_by, whose ties are arbitrary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.tristate import BLIND, MEASURED
from weftline.operators.relational import placed, with_previous

SNAPSHOT_KEY = ("domain", "metric", "source")
MOVED_COLUMNS = ("value", "state")


def content_key() -> Column:
    """What makes two journal rows the same fact: identity, state and value, the latter as its shortest exact text."""
    return F.sha1(F.concat_ws("|", "domain", "metric", "source", F.col("measured_at").cast("date").cast("string"), "state", F.coalesce(F.col("value").cast("string"), F.lit("null"))))


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of SHA-1 over the identity parts joined by ``|``; nulls are empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


def validate(rows: DataFrame) -> DataFrame:
    """The rows that break the journal's rules: an unknown state, or a value in a blind row."""
    return rows.filter(~F.col("state").isin("MEASURED", "ABSENT", "BLIND") | ((F.col("state") == BLIND) & F.col("value").isNotNull()))


def check(rows: DataFrame) -> DataFrame:
    """``rows``, raising while it runs where one breaks the rules."""
    ok = F.col("state").isin("MEASURED", "ABSENT", "BLIND") & ~((F.col("state") == BLIND) & F.col("value").isNotNull())
    return rows.withColumn("state", F.when(ok, F.col("state")).otherwise(F.raise_error(F.lit("a journal row has an unknown state or a value while blind"))))


def latest(rows: DataFrame, key: tuple[str, ...] = SNAPSHOT_KEY, last_wins: bool = True) -> DataFrame:
    """The latest row of each key; among equal times the last written wins, or the first."""
    order = [F.col("measured_at").desc(), F.col("seq").desc() if last_wins else F.col("seq").asc()]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def new_facts(old: DataFrame, batch: DataFrame, allow_repeats: bool = False) -> DataFrame:
    """Rows of ``batch`` whose content key is new, against the journal and within the batch (the first stays)."""
    if allow_repeats:
        return batch
    keyed = batch.withColumn("_key", content_key())
    first = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy("seq"))).filter("_rn = 1")
    return first.join(old.select(content_key().alias("_key")), "_key", "left_anti").drop("_key", "_rn")


def compact(rows: DataFrame, key: str = "obs_id") -> DataFrame:
    """The last row of each id; rows without an id all stay."""
    w = Window.partitionBy(key).orderBy(F.col("seq").desc())
    with_id = rows.filter(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return with_id.unionByName(rows.filter(F.col(key).isNull()))


def purge(rows: DataFrame, doomed: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows to back up)."""
    gone = F.coalesce(doomed, F.lit(False))
    return rows.filter(~gone), rows.filter(gone)


def series(rows: DataFrame, **equal: str | int | float) -> DataFrame:
    """Rows whose columns equal the given values (no coercion), in time order; gaps stay as null points."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows.orderBy("measured_at", "seq")


def movements(rows: DataFrame, since: Column, key: tuple[str, ...] = SNAPSHOT_KEY) -> DataFrame:
    """Per key, the last row before ``since`` against the last row from it on: ``appeared`` without one before,
    ``changed`` if value or state differ; a key without recent rows says nothing. One aggregation, no join."""
    at = F.struct("measured_at", "seq", *MOVED_COLUMNS)
    both = rows.groupBy(*key).agg(F.max(F.when(F.col("measured_at") < since, at)).alias("b"), F.max(F.when(F.col("measured_at") >= since, at)).alias("a"))
    moved = ~(F.col("a.value").eqNullSafe(F.col("b.value")) & F.col("a.state").eqNullSafe(F.col("b.state")))
    return both.filter(F.col("a").isNotNull() & (F.col("b").isNull() | moved)).select(
        *key,
        F.when(F.col("b").isNull(), "appeared").otherwise("changed").alias("movement"),
        F.col("b.value").alias("before"),
        F.col("a.value").alias("after"),
        F.col("b.state").alias("state_before"),
        F.col("a.state").alias("state_after"),
        (F.col("a.value") - F.col("b.value")).alias("delta"),
    )


def _latest_first() -> list[Column]:
    return [F.col("ended_at").desc(), F.col("run").desc()]


def _ended(rows: DataFrame) -> DataFrame:
    run = F.coalesce("run_id", F.col("measured_at").cast("date").cast("string")).alias("run")
    return rows.groupBy(run).agg(F.max("measured_at").alias("ended_at"), F.count("*").alias("n_rows"))


def runs(rows: DataFrame) -> DataFrame:
    """(run, ended_at, n_rows, place): a run is its id, or the day of measure; place 1 is the latest."""
    return placed(_ended(rows), _latest_first())


def last_runs(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` first rows of runs(); only they are ever in one task."""
    last = _ended(rows).orderBy(*_latest_first()).limit(n)
    return last.withColumn("place", F.row_number().over(Window.orderBy(*_latest_first())).cast("long"))


def run_states(targets: DataFrame, rows: DataFrame, total: Column, target: str = "domain") -> DataFrame:
    """(target, state, last, before, n) of each of ``targets``, whether or not its runs can be compared: ``never`` measured,
    ``first`` with one run alone, ``silent`` where the latest row of its ``total`` is blind, since a run that says nothing about
    the whole says nothing about what is gone; else ``compared``. ``n`` counts the rows of the last run."""
    run = F.coalesce("run_id", F.col("measured_at").cast("date").cast("string"))
    each = rows.groupBy(target, run.alias("run")).agg(F.max("measured_at").alias("ended_at"), F.count("*").alias("n"))
    whole = rows.groupBy(target).agg(F.max(F.when(total, F.struct("measured_at", "seq", "state")))["state"].alias("told"))
    back = Window.partitionBy(target).orderBy(*_latest_first())
    two = each.withColumn("place", F.row_number().over(back)).filter("place <= 2").groupBy(target).agg(*[F.max(F.when(F.col("place") == p, F.col(c))).alias(name) for name, p, c in (("last", 1, "run"), ("before", 2, "run"), ("n", 1, "n"))])
    known = targets.select(target).join(two, target, "left").join(whole, target, "left")
    state = F.when(F.col("last").isNull(), "never").when(F.col("before").isNull(), "first").when(F.col("told") == BLIND, "silent").otherwise("compared")
    return known.select(target, state.alias("state"), "last", "before", F.coalesce("n", F.lit(0)).alias("n"))


def run_diff(rows: DataFrame, last: str | None = None, before: str | None = None, key: str = "domain", limit: int = 500, total: Column | None = None) -> DataFrame:
    """Full comparison of two runs, the last two of runs() where none are named: appeared, gone, moved, same. Where there is
    one run alone, all it holds is ``first``: nothing can have appeared. When the latest row of the ``total`` is blind, every
    outcome is ``silent``; when the latest run is blind about a key, nothing is said of that one to be gone. ``truncated`` tells
    that either side has measured ``limit`` keys or more, the most the source gives."""
    run = F.coalesce("run_id", F.col("measured_at").cast("date").cast("string"))
    if last is None:
        picked = last_runs(rows, 2).select(F.col("run").alias("_run"), F.when(F.col("place") == 1, "new").otherwise("old").alias("_side"))
        rows = rows.withColumn("_run", run).join(F.broadcast(picked), "_run")
    else:
        rows = rows.withColumn("_side", F.when(run == last, "new").when(run == before, "old"))
    side = lambda name: rows.filter((F.col("_side") == name) & (F.col("state") != BLIND)).groupBy(key).agg(F.max("value").alias(name), F.lit(True).alias(f"in_{name}"))
    blind = rows.filter((F.col("_side") == "new") & (F.col("state") == BLIND)).select(key, F.lit(True).alias("is_blind")).distinct()
    told = F.max(F.when(total, F.struct("measured_at", "seq", "state")))["state"] if total is not None else F.lit(MEASURED)
    full = rows.filter(F.col("_side").isNotNull()).agg(
        (F.greatest(*[F.countDistinct(F.when((F.col("_side") == s) & (F.col("state") == MEASURED), F.col(key))) for s in ("old", "new")]) >= limit).alias("truncated"),
        (F.countDistinct("_side") < 2).alias("alone"), F.coalesce(told == BLIND, F.lit(False)).alias("mute"),
    )
    both = side("old").join(side("new"), key, "full").join(blind, key, "left").join(F.broadcast(full))
    outcome = (
        F.when(F.col("alone"), "first")
        .when(F.col("mute"), "silent")
        .when(F.col("in_old").isNull(), "appeared")
        .when(F.col("in_new").isNull() & F.col("is_blind"), "silent")
        .when(F.col("in_new").isNull(), "gone")
        .when(F.col("old").eqNullSafe(F.col("new")), "same")
        .otherwise("moved")
    )
    return both.select(key, "old", "new", outcome.alias("outcome"), "truncated")


def series_delta(rows: DataFrame, key: tuple[str, ...] = SNAPSHOT_KEY) -> DataFrame:
    """Difference to the point before, only where both are measured; marks a change of collector. A long series is shared
    among tasks."""
    rows = with_previous(rows.select(*key, "seq", "measured_at", "value", "state", "collector"), list(key), ["measured_at", "seq"], ["state", "value", "collector"])
    both = (F.col("state") == MEASURED) & (F.col("previous.state") == MEASURED)
    return rows.select(
        *key, "seq", "measured_at", "value",
        F.when(both, F.col("value") - F.col("previous.value")).alias("delta"),
        F.coalesce(F.col("previous.collector") != F.col("collector"), F.lit(False)).alias("collector_changed"),
    )


def collisions(rows: DataFrame, key: str = "obs_id", content: str = "content") -> DataFrame:
    """Ids under which different rows stand: a batch with any is refused."""
    return rows.groupBy(key).agg(F.countDistinct(content).alias("n_contents")).filter("n_contents > 1")
