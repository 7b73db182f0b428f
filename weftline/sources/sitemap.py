"""Walk over the sitemaps of domains: indexes lead to further sitemaps, url sets hold pages.

The sitemaps have been fetched into a table; the walk decides which of them a domain's budgets let it read, and what the
count is worth. It goes level by level, all domains at once; of a level no domain keeps more than it may still read. Each level
is written, and so are the addresses it adds to those that have been seen: what a level reads are folders, so its plan is as
long at depth 40 as at the start, and a lost executor costs one level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import shared_folder
from weftline.sources.parsers import sitemap_dates, sitemap_entries

MAX_SITEMAPS = 40
MAX_URLS = 200_000
MAX_BYTES = 60_000_000
GUESSED = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap.xml.gz")  # fixed values: usual places


def is_index(xml: Column) -> Column:
    return F.substring(xml, 1, 3000).rlike("(?i)<sitemapindex")


def is_sitemap(xml: Column) -> Column:
    return F.substring(xml, 1, 3000).rlike("(?i)<urlset|<sitemapindex")


def candidates(domains: DataFrame) -> DataFrame:
    """(domain, url, place, guessed): the sitemaps that ``domains`` (domain, declared array) declare in robots.txt, or the
    usual places where they declare none."""
    declared = F.coalesce("declared", F.array().cast("array<string>"))
    guessed = F.array(*[F.concat(F.lit("https://"), "domain", F.lit(p)) for p in GUESSED])
    return domains.select("domain", (F.size(declared) == 0).alias("guessed"), F.posexplode(F.when(F.size(declared) > 0, declared).otherwise(guessed)).alias("place", "url")).select("domain", "url", F.col("place").cast("long").alias("place"), "guessed")


def read_level(queue: DataFrame, fetched: DataFrame) -> DataFrame:
    """The queue with what its sitemaps hold: MEASURED, ABSENT (404, 410) or BLIND (a wall, never fetched, or a 200 that is no
    sitemap, such as a page that says there is none)."""
    facts = fetched.select("url", "http", "xml", F.octet_length("xml").cast("long").alias("bytes"))
    state = F.when((F.col("http") == 200) & F.coalesce(is_sitemap(F.col("xml")), F.lit(False)), "MEASURED").when(F.col("http").isin(404, 410), "ABSENT").otherwise("BLIND")
    locs = F.when(state == "MEASURED", sitemap_entries(F.col("xml"))).otherwise(F.array().cast("array<string>"))
    dates = F.when(F.col("state") == "MEASURED", sitemap_dates(F.col("xml"))).otherwise(F.array().cast("array<string>"))
    rows = queue.join(facts, "url", "left").withColumn("state", state).withColumn("locs", locs).withColumn("dates", dates)
    return rows.select("domain", "url", "level", "place", "guessed", "state", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"), F.coalesce(is_index(F.col("xml")) & (F.col("state") == "MEASURED"), F.lit(False)).alias("index"), "locs", F.size("dates").cast("long").alias("n_dated"), F.array_max("dates").alias("newest"))


def walk(domains: DataFrame, fetched: DataFrame, max_sitemaps: int = MAX_SITEMAPS, max_urls: int = MAX_URLS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(domain, state, n_urls, n_read, n_walls, n_absent, bytes, n_dated, newest, capped) from ``domains`` (domain, declared) and
    ``fetched`` (url, http, xml). Sitemaps are read in the order in which a queue would give them; one is read while fewer than
    ``max_sitemaps``, ``max_urls`` pages and ``max_bytes`` have been. ``capped`` names the budget that ran out: the count
    is then a floor, and BLIND. An index holds no pages; once a guessed place answers, the other guesses are not tried.
    ``newest`` is the latest date that a page is said to have been changed on."""
    spark, folder = domains.sparkSession, shared_folder(domains.sparkSession, "sitemaps")

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    queue = written(candidates(domains).withColumn("level", F.lit(0)), "seen/0")
    for level in range(max_sitemaps):
        own = Window.partitionBy("domain").orderBy("place", "url")
        rows = read_level(queue.withColumn("_i", F.row_number().over(own)).filter(F.col("_i") <= max_sitemaps + 1).drop("_i"), fetched)
        if level == 0:  # of guesses, those after the first that answers go
            answered = F.min(F.when(F.col("guessed") & (F.col("state") == "MEASURED"), F.col("place"))).over(Window.partitionBy("domain"))
            rows = rows.withColumn("_a", answered).filter(F.col("_a").isNull() | (F.col("place") <= F.col("_a"))).drop("_a")
        rows = written(rows, f"read/{level}")
        seen = spark.read.schema(queue.schema).parquet(f"{folder}/seen/*").select("domain", "url")
        children = rows.filter("index").select("domain", F.col("place").alias("_p"), F.posexplode("locs").alias("_at", "url"))
        first = children.groupBy("domain", "url").agg(F.min(F.struct("_p", "_at")).alias("_f")).join(seen, ["domain", "url"], "left_anti")
        order = F.row_number().over(Window.partitionBy("domain").orderBy("_f", "url"))
        found = first.withColumn("place", order.cast("long")).filter(F.col("place") <= max_sitemaps + 1)
        queue = written(found.select("domain", "url", "place", F.lit(False).alias("guessed"), F.lit(level + 1).alias("level")), f"seen/{level + 1}")
        if queue.isEmpty():
            break
    everything = spark.read.schema(rows.schema).parquet(f"{folder}/read/*")
    urls = F.when(F.col("index"), 0).otherwise(F.size("locs")).cast("long")
    before = Window.partitionBy("domain").orderBy("level", "place", "url").rowsBetween(Window.unboundedPreceding, -1)
    run = everything.withColumn("urls", urls).drop("locs")
    for name, what in (("_read", F.lit(1)), ("_urls", F.col("urls")), ("_bytes", F.col("bytes"))):
        run = run.withColumn(name, F.coalesce(F.sum(what).over(before), F.lit(0)))
    over = F.when(F.col("_read") >= max_sitemaps, "sitemaps").when(F.col("_urls") >= max_urls, "urls").when(F.col("_bytes") >= max_bytes, "bytes")
    run = run.withColumn("over", over)
    read = F.col("over").isNull()
    counts = run.groupBy("domain").agg(
        F.sum(F.when(read, F.col("urls")).otherwise(0)).alias("n_urls"),
        F.count(F.when(read, 1)).alias("n_read"),
        F.count(F.when(read & (F.col("state") == "BLIND"), 1)).alias("n_walls"),
        F.count(F.when(read & (F.col("state") == "ABSENT"), 1)).alias("n_absent"),
        F.sum(F.when(read, F.col("bytes")).otherwise(0)).alias("bytes"),
        F.sum(F.when(read & ~F.col("index"), F.col("n_dated")).otherwise(0)).alias("n_dated"),
        F.max(F.when(read & ~F.col("index"), F.col("newest"))).alias("newest"),
        F.min(F.when(~read, F.struct("level", "place", "over"))).alias("_stop"),
    )
    capped = F.col("_stop.over")
    state = F.when(capped.isNotNull(), "BLIND").when((F.col("n_urls") == 0) & (F.col("n_walls") > 0), "BLIND").when(F.col("n_urls") == 0, "ABSENT").otherwise("MEASURED")
    return counts.select("domain", state.alias("state"), "n_urls", "n_read", "n_walls", "n_absent", "bytes", "n_dated", "newest", capped.alias("capped"))
