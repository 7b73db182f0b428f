"""Web-graph operators: who links to whom, for any number of targets in one pass over the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.relational import cap_per_key

CAP = 3000  #: referring domains named for each target; the rest is counted


def referring_domains(edges: DataFrame, vertices: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """(target, state, referrer, place, total, nature) for each target domain. A target that the graph does not know
    is BLIND, one that nothing links to is ABSENT; more than ``cap`` referrers make the count a ``floor``.
    Spark broadcasts the targets where they are few and sorts both sides where they are not; the edges are read
    once for the whole batch, and a hot target's edges are counted partially before they meet."""
    wanted = targets.join(vertices.select(F.col("domain").alias("target"), F.col("id").alias("dst")), "target", "left")
    found = edges.join(wanted.filter("dst IS NOT NULL").select("target", "dst"), "dst").select("target", "src").distinct()
    named = cap_per_key(found, "target", [F.col("src")], cap).join(vertices.select(F.col("id").alias("src"), F.col("domain").alias("referrer")), "src", "left")
    state = F.when(F.col("dst").isNull(), "BLIND").when(F.col("total").isNull(), "ABSENT").otherwise("MEASURED")
    return wanted.join(named, "target", "left").select("target", state.alias("state"), "referrer", "place", "total", "nature")


def degrees(edges: DataFrame, end: str, other: str) -> DataFrame:
    return edges.groupBy(end).agg(F.countDistinct(other).alias("degree"))


def co_citation(links: DataFrame, seed: Column, least: int = 50, share: float = 0.25, top: int = 60) -> DataFrame:
    """Targets cited by the pages that cite a seed, counted by row, without those that are everywhere: cited from more
    than max(least, share of all pages)."""
    pages = links.filter(seed).select("url_src").distinct()
    near = links.filter(~seed).join(pages, "url_src", "left_semi").groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("url_src").alias("n_pages"))
    total = pages.agg(F.count("*").alias("total"))
    kept = near.join(F.broadcast(total)).filter(F.col("n_pages") <= F.greatest(F.lit(least), F.floor(F.col("total") * share)))
    return kept.select("target", "n").orderBy(F.desc("n"), "target").limit(top)


def opportunities(links: DataFrame, host: str, own: Column, rival: Column, rivals: DataFrame) -> DataFrame:
    """Hosts that cite at least one rival, none of our own domains, and are no rivals themselves."""
    counts = links.groupBy(host).agg(F.sum(F.when(own, 1).otherwise(0)).alias("n_own"), F.countDistinct(F.when(rival, F.col("target"))).alias("n_rivals"))
    return counts.filter("n_own = 0 AND n_rivals > 0").join(rivals, host, "left_anti").select(host, "n_rivals")


def reciprocal(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) that link both ways, each once."""
    p = pairs.select(a, b).distinct().filter(F.col(a) != F.col(b))
    return p.join(p.select(F.col(a).alias(b), F.col(b).alias(a)), [a, b], "left_semi").filter(F.col(a) < F.col(b))
