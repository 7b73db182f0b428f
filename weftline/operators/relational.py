"""Relational patterns of the link index: capped lists with overflow, top-k, medians, suffix joins, three-state joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.tristate import state_of
from weftline.functions.urls import suffixes
from weftline.session import shared_folder

SALTS = 64  #: parts of a key that are cut first


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal ``keys``, of which a null equals a null."""
    right = right.select(*[F.col(k).alias(f"_of_{k}") if k in keys else F.col(k) for k in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(right, same).drop(*[f"_of_{k}" for k in keys])


def laid_in_ranges(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """``df`` with ``_range``, the number of the range of ``order`` that a row lies in. The ranges come from a sample, which two
    runs of one plan may draw differently: they are drawn once and written to the shared folder. The driver sees nothing."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "ranges")
    ranged = (df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(folder)
    return spark.read.schema(ranged.schema).parquet(folder)


def placed(df: DataFrame, order: list[Column], key: str | None = None, total: str | None = None) -> DataFrame:
    """``place`` from 1 by a total order, of all rows or within each ``key`` (which ``order`` begins with; null is a key like
    others); with ``total`` a column of that name for how many places there are. Rows are sorted by ranges; a place is the count of the ranges before plus the place in the own range, so no task
    holds all rows of a key."""
    keys = [key] if key else []
    ranged = laid_in_ranges(df, order)
    counts = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_c"))
    each = Window.partitionBy(*keys)  # one row a range
    whole = [F.sum("_c").over(each).alias(total)] if total else []
    before = counts.select("_range", *keys, (F.sum("_c").over(each.orderBy("_range")) - F.col("_c")).alias("_before"), *whole)
    within = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    return joined(within, before, ["_range", *keys]).withColumn("place", (F.col("_r") + F.col("_before")).cast("long")).drop("_range", "_r", "_before")


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``previous``, a struct of ``columns`` of the row before in the same key by ``order`` (a total one), null for the
    first: an as-of join of a table with itself. Rows are sorted by ranges; what a range's first row of a key needs is the last row
    of that key in the ranges before, one row a key and range, which is carried over. No task holds all rows of a key."""
    carried = F.struct(*columns)
    ranged = laid_in_ranges(df, [F.col(c) for c in [*keys, *order]], parts)
    last = ranged.groupBy("_range", *keys).agg(F.max(F.struct(*order, carried.alias("_v")))["_v"].alias("_last"))
    before = last.select("_range", *keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")).alias("_carry"))
    w = Window.partitionBy("_range", *keys).orderBy(*order)
    within = ranged.withColumn("_first", F.row_number().over(w) == 1).withColumn("_own", F.lag(carried).over(w))
    return joined(within, before, ["_range", *keys]).withColumn("previous", F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_own"))).drop("_range", "_first", "_own", "_carry")


def capped_with_all(df: DataFrame, key: str, always: Column, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key by a total order and every row that is ``always`` shown, with the number
    ``hidden``. The rank limit is applied before the shuffle too, so a hot key sends ``cap`` rows of each task; rows that
    are always shown skip the ranking, and the hidden ones are counted."""
    marked = df.withColumn("_always", always)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = marked.withColumn("_rn", rank).filter(F.col("_rn") <= cap).drop("_rn")
    shown = marked.filter("_always").unionByName(first.filter("NOT _always"))
    counts = marked.groupBy(key).agg(F.count("*").alias("_n"), F.count(F.when(F.col("_always"), 1)).alias("_kept"))
    counts = counts.join(first.filter("NOT _always").groupBy(key).agg(F.count("*").alias("_first")), key, "left")
    hidden = counts.select(key, (F.col("_n") - F.col("_kept") - F.coalesce("_first", F.lit(0))).alias("hidden"))
    return shown.drop("_always").join(hidden, key)


def first_rows(df: DataFrame, key: str, order: list[Column], cap: int) -> DataFrame:
    """``place`` 1 to ``cap`` of each key. Spark limits ranks before a shuffle up to 1000 only; beyond, the rows of a key are
    first cut in SALTS parts of their own, so that no task holds a hot key whole."""
    ranked = lambda rows, *by: rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("place") <= cap)
    if cap > 1000:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        df = ranked(salted, key, "_salt").drop("_salt", "place")
    return ranked(df, key)


def cap_per_key(df: DataFrame, key: str, order: list[Column], cap: int = 3000) -> DataFrame:
    """At most ``cap`` rows of each key, with the number cut off (``overflow``) and the nature of the count:
    ``floor`` where rows were cut. The count is a partial aggregation, so a hot key costs no single task."""
    total = df.groupBy(key).agg(F.count("*").alias("total"))
    return first_rows(df, key, order, cap).join(total, key).withColumn("overflow", F.greatest(F.col("total") - cap, F.lit(0))).withColumn("nature", F.when(F.col("total") > cap, "floor").otherwise("measured"))


def first_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def upper_median(df: DataFrame, column: str, *keys: str, parts: int | None = None) -> DataFrame:
    """The element at floor(n / 2) of the sorted values, of each key (null is one) or of all. Equal values are counted first; the
    counts are laid in ranges, whose bounds a sample of them draws, so wide, skewed or far-off values fill no range more than
    others; sums of the ranges say in which one the element lies, and only that one is sorted. ``parts`` is the number of
    ranges, that of shuffle partitions if not given."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("median")).agg(F.count("*").alias("_c"))
    ranged = laid_in_ranges(counts, [F.col(c) for c in [*keys, "median"]], parts)
    totals = ranged.groupBy("_range", *keys).agg(F.sum("_c").alias("_t"))
    w = Window.partitionBy(*keys)  # one row a range
    sums = totals.select("_range", *keys, "_t", (F.sum("_t").over(w.orderBy("_range")) - F.col("_t")).alias("_before"), F.floor(F.sum("_t").over(w) / 2).alias("_at"))
    chosen = sums.filter("_before <= _at AND _at < _before + _t").drop("_t")
    run = F.sum("_c").over(Window.partitionBy("_range", *keys).orderBy("median")) + F.col("_before")
    ranked = joined(ranged, chosen, ["_range", *keys]).withColumn("_to", run)
    return ranked.filter("_to > _at AND _to - _c <= _at").select(*keys, "median")


def median_and_mad(df: DataFrame, column: str, floor: float = 0.05) -> DataFrame:
    """One row: upper median, and the upper median of absolute deviations from it, at least ``floor``."""
    median = upper_median(df, column)
    deviations = df.join(F.broadcast(median)).select(F.abs(F.col(column) - F.col("median")).alias("_d"))
    mad = upper_median(deviations, "_d").select(F.greatest("median", F.lit(floor)).alias("mad"))
    return median.join(F.broadcast(mad))


def suffix_join(left: DataFrame, host: str, right: DataFrame, domain: str, how: str = "inner") -> DataFrame:
    """Rows whose host is ``domain`` or below it: an equi-join on the host's suffixes instead of a theta join."""
    return left.withColumn("_suffix", F.explode(suffixes(F.col(host)))).join(right, F.col("_suffix") == right[domain], how).drop("_suffix")


def not_below(left: DataFrame, host: str, denied: DataFrame, domain: str) -> DataFrame:
    """Rows whose host is neither denied nor below a denied domain."""
    bad = suffix_join(left.select(host).distinct(), host, denied, domain).select(host).distinct()
    return left.join(bad, host, "left_anti")


def three_state_join(asked: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, state): found, asked and not found (ABSENT), never asked (BLIND). ``asked`` has a boolean column
    of that name for every key."""
    return asked.join(found.select(key, value), key, "left").withColumn("state", state_of(F.col(value), F.col("asked"))).drop("asked")


def sample_stride(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at floor(i * count / n) of the order; all rows if there are fewer."""
    ranked = placed(df, [F.col(order)]).withColumn("_rank", F.col("place") - 1)
    total = ranked.agg(F.count("*").alias("_n"))
    i = F.ceil(F.col("_rank") * n / F.col("_n"))
    picked = ranked.join(F.broadcast(total)).filter((F.col("_n") <= n) | ((F.floor(i * F.col("_n") / n) == F.col("_rank")) & (i < n)))
    return picked.drop("place", "_rank", "_n")


PROBES = 8  #: captures that are read for one page, at most


def bracket_appearance(captures: DataFrame, key: str, targets: DataFrame | None = None, probes: int = PROBES) -> DataFrame:
    """(key, outcome, last_without, first_with, n_probed): between which captures a link appeared, by halving, all keys at once.
    ``captures`` (key, at, read, present), of which each probe reads one: ``read`` tells whether it can be, ``present`` whether
    the link is in it.

    The latest capture comes first: ``unreadable`` or ``absent`` there ends the search, as does ``single``, the only one. The
    earliest is next: a link in it is older than the archive (``before_archive``). Then the interval is halved while probes are left;
    a capture that cannot be read moves its lower end without vouching for it. What is left is ``bracketed`` or, if captures
    in between were not reached, ``coarse``. ``budget``: nothing could be read, for lack of captures or probes.

    Which captures a search can come by follows from their number alone, 2 ** (probes - 2) + 1 of a key at most; only these are
    brought together, in one aggregation, and searched in one expression. Captures are numbered by ranges, so a key with any
    number of them crosses tasks."""
    ranked = placed(captures.select(key, "at", "read", "present"), [F.col(key), F.col("at")], key, total="n").withColumn("i", F.col("place") - 1)
    steps = F.slice(F.sequence(F.lit(1), F.lit(max(probes - 2, 1))), F.lit(1), F.lit(max(probes - 2, 0)))
    whole = lambda low, high: F.call_function("div", low + high, F.lit(2))

    def can_be_reached(i: Column, n: Column) -> Column:
        def step(a: Column, _: Column) -> Column:
            mid, go = whole(a["lo"], a["hi"]), ~a["hit"] & (a["hi"] - a["lo"] > 1)
            return F.struct(F.when(go & (i > mid), mid).otherwise(a["lo"]).alias("lo"), F.when(go & (i < mid), mid).otherwise(a["hi"]).alias("hi"), (a["hit"] | (go & (i == mid))).alias("hit"))

        return F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("lo"), (n - 1).alias("hi"), F.lit(False).alias("hit")), step)["hit"]

    i, n = F.col("i"), F.col("n")
    facts = F.struct("at", F.coalesce("read", F.lit(False)).alias("read"), F.coalesce("present", F.lit(False)).alias("present"))
    some = ranked.filter((i == 0) | (i == n - 1) | can_be_reached(i, n))
    seen = some.groupBy(key).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("i", facts.alias("f")))).alias("f"))
    seen = seen if targets is None else targets.select(key).distinct().join(seen, key, "left")
    early, late = F.col("f")[F.lit(0).cast("long")], F.col("f")[n - 1]
    ended = (
        F.when(n.isNull() | F.lit(probes <= 0), "budget")
        .when(~late["read"], "unreadable")
        .when(~late["present"], "absent")
        .when(early["at"] == late["at"], "single")
        .when(early["read"] & early["present"], "before_archive")
    )

    def halve(a: Column, _: Column) -> Column:
        mid = whole(a["lo"], a["hi"])
        c = F.col("f")[mid]
        go, hit = a["hi"] - a["lo"] > 1, c["read"] & c["present"]
        return F.struct(F.when(go & ~hit, mid).otherwise(a["lo"]).alias("lo"), F.when(go & hit, mid).otherwise(a["hi"]).alias("hi"), (a["sure"] | (go & ~hit & c["read"])).alias("sure"), F.when(go, a["left"] - 1).otherwise(a["left"]).alias("left"))

    begin = F.struct(F.lit(0).cast("long").alias("lo"), (n - 1).alias("hi"), early["read"].alias("sure"), F.lit(probes - 2).alias("left"))
    found = seen.select(key, "f", ended.alias("ended"), early["at"].alias("early"), late["at"].alias("late"), F.when(ended.isNull(), F.aggregate(steps, begin, halve)).alias("s"))
    first_with = F.when(F.col("ended") == "single", F.col("late")).when(F.col("ended") == "before_archive", F.col("early")).otherwise(F.col("f")[F.col("s.hi")]["at"])
    outcome = F.coalesce("ended", F.when(F.col("s.hi") - F.col("s.lo") > 1, "coarse").otherwise("bracketed"))
    used = F.when(F.col("ended") == "budget", 0).when(F.col("ended").isin("unreadable", "absent", "single"), 1).when(F.col("ended") == "before_archive", 2).otherwise(probes - F.col("s.left"))
    return found.select(key, outcome.alias("outcome"), F.when(F.col("s.sure"), F.col("f")[F.col("s.lo")]["at"]).alias("last_without"), first_with.alias("first_with"), used.cast("long").alias("n_probed"))


def page_of(df: DataFrame, order: list[Column], page: int, size: int = 200) -> DataFrame:
    """One page of a stable order; pages 0 to 50."""
    return df.orderBy(*order).offset(min(max(page, 0), 50) * size).limit(size)


TABLE_SIZE = 10_000_000  #: ranks of the longer table
DEVIATIONS = 5


def rank_divergence(ranks: DataFrame, size: int = TABLE_SIZE) -> DataFrame:
    """(domain, divergence, nature) of ranks (domain, asked, o, m). ``drift``: the log ratio of both ranks lies DEVIATIONS
    median deviations or more off its median. ``floor``: a rank in ``m`` alone although ``o`` was asked; the divergence is
    at least what lies between the expected rank and the end of ``o``. A rank in ``o`` alone gives no row."""
    calibration = median_and_mad(ranks.filter("o IS NOT NULL AND m IS NOT NULL").select(F.log10(F.col("o") / F.col("m")).alias("l")), "l")
    rows = ranks.filter("m IS NOT NULL").join(F.broadcast(calibration)).withColumn("drift", F.log10(F.col("o") / F.col("m")) - F.col("median"))
    floor = F.greatest(F.log10(F.lit(size) / (F.col("m") * F.pow(F.lit(10.0), F.col("median")))), F.lit(0.0))
    both, missed = F.col("o").isNotNull(), F.col("o").isNull() & F.col("asked")
    rows = rows.filter((both & (F.abs("drift") >= DEVIATIONS * F.col("mad"))) | missed)
    return rows.select("domain", F.when(both, F.col("drift")).otherwise(floor).alias("divergence"), F.when(both, "drift").otherwise("floor").alias("nature"))
