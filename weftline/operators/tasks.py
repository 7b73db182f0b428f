"""The crawl's state machine. A candidate page is waiting until it has been read: then read (it links), mention (it names the
target without a link), empty or wall. A task is waiting, then has candidates, is in verification while some have been read
and others wait, and is done when none waits. States only ever move on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.txlog import Conflict


def outcome(http: Column, links: Column, mentions: Column) -> Column:
    return F.when(F.coalesce(http, F.lit(0)) != 200, "wall").when(links > 0, "read").when(mentions > 0, "mention").otherwise("empty")


def step(candidates: DataFrame, readings: DataFrame) -> DataFrame:
    """``candidates`` (task, page, state) after a batch of ``readings`` (task, page, seq, http, links, mentions): pages not
    yet known join, waiting ones take the outcome of their first reading, decided ones stay."""
    first = readings.groupBy("task", "page").agg(F.min(F.struct("seq", outcome(F.col("http"), F.col("links"), F.col("mentions")).alias("to"))).alias("r"))
    both = candidates.join(first, ["task", "page"], "full")
    state = F.when(F.coalesce("state", F.lit("waiting")) == "waiting", F.coalesce("r.to", F.lit("waiting"))).otherwise(F.col("state"))
    return both.select("task", "page", state.alias("state"))


def task_states(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(task, state, n_waiting, n_decided) of ``tasks`` (task)."""
    counts = candidates.groupBy("task").agg(F.count(F.when(F.col("state") == "waiting", 1)).alias("n_waiting"), F.count(F.when(F.col("state") != "waiting", 1)).alias("n_decided"))
    n, m = F.coalesce("n_waiting", F.lit(0)), F.coalesce("n_decided", F.lit(0))
    state = F.when((n == 0) & (m == 0), "waiting").when(m == 0, "candidates").when(n > 0, "verification").otherwise("done")
    return tasks.join(counts, "task", "left").select("task", state.alias("state"), n.alias("n_waiting"), m.alias("n_decided"))


def recover(queue, now: Column, after_minutes: int = 10) -> int | None:
    """At the start of a crawl, pages of the stored ``queue`` (a TransactionTable with state and taken_at) that were busy for longer
    than ``after_minutes`` before ``now`` wait again. Only the parts that hold such pages are written anew, in one commit; gives
    its version, or None where nothing was stale. Run again after a crash of its own, it does what was left."""
    stale = (F.col("state") == "busy") & (F.col("taken_at") < now - F.make_interval(mins=F.lit(after_minutes)))
    base = queue.snapshot()
    parts = queue.parts_of(queue.read(base).filter(stale))
    if not parts:
        return None
    mended = queue.read(base, parts).withColumn("state", F.when(stale, "waiting").otherwise(F.col("state")))
    return queue.commit(base, "recover", queue.write(mended), [f for f, part in base.files.items() if part in parts], read=parts)


def claim(queue: DataFrame, busy: DataFrame, k: int, low: int = 1, high: int = 9) -> DataFrame:
    """(pick, host, priority, depth, seq): the pages that ``k`` readers take who ask one after the other. A reader takes the waiting
    page of least (priority, depth, seq) in the band from ``low`` to ``high`` whose host is not ``busy`` (host), and its host is
    busy from then on; with none left in the band it takes one of a less important band, never of a more important one.

    As a host gives one page at most, those who ask take the hosts' first pages of the band in their order, then the first pages
    below it of the hosts that are left: a matching found in one aggregation by host and one sort of ``k`` rows, not in ``k`` queries."""
    free = queue.filter((F.col("state") == "waiting") & (F.col("priority") >= low)).join(busy.select("host"), "host", "left_anti")
    at = F.struct("priority", "depth", "seq")
    firsts = free.groupBy("host").agg(F.min(F.when(F.col("priority") <= high, at)).alias("own"), F.min(F.when(F.col("priority") > high, at)).alias("below"))
    # hosts with a page in the band come first; of a host that was taken nothing below the band is
    found = firsts.select("host", F.col("own").isNull().alias("late"), F.coalesce("own", "below").alias("p")).orderBy("late", "p").limit(k)
    pick = F.row_number().over(Window.orderBy("late", "p"))  # of k rows
    return found.select(pick.cast("long").alias("pick"), "host", "p.priority", "p.depth", "p.seq")


def take(queue, now: Column, k: int, low: int = 1, high: int = 9, hold_seconds: int = 60) -> list[int]:
    """Claim ``k`` pages of the stored ``queue`` (a TransactionTable with seq, host, priority, depth, state, taken_at) and mark them
    busy since ``now``, in one commit; their numbers, in order. A host is busy for ``hold_seconds`` after one of its pages was
    taken. Of readers that take at the same time one commits first, and the others choose anew: no page is taken twice."""
    while True:
        base = queue.snapshot()
        rows = queue.read(base)
        held = rows.filter((F.col("state") == "busy") & (F.col("taken_at") > now - F.make_interval(secs=F.lit(hold_seconds)))).select("host").distinct()
        picked = [r["seq"] for r in claim(rows, held, k, low, high).orderBy("pick").collect()]  # k numbers
        if not picked:
            return []
        mine = F.col("seq").isin(picked)
        parts = queue.parts_of(rows.filter(mine))
        taken = queue.read(base, parts).withColumn("taken_at", F.when(mine, now).otherwise(F.col("taken_at"))).withColumn("state", F.when(mine, "busy").otherwise(F.col("state")))
        try:
            queue.commit(base, "take", queue.write(taken), [f for f, part in base.files.items() if part in parts], read=set(base.files.values()))
            return picked
        except Conflict:
            continue
