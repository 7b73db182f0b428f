"""Published golden values and the properties that protect the scores from manipulation."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import composite as C


def authority(spark, groups):
    """groups: (count, nl, class, distinct domains, disavowed)."""
    rows, d = [], 0
    for count, nl, kind, domains, disavowed in groups:
        rows += [("x", f"d{d + i % domains}", float(nl), kind, disavowed) for i in range(count)]
        d += domains
    links = spark.createDataFrame(rows, "t string, domain string, nl double, class string, disavowed boolean")
    known = links.groupBy("t").agg(F.countDistinct("domain").alias("known"))
    return C.acquired_authority(links, "t", known).first()


def domain_score(spark, aa):
    parts = [("x", 0.32, 25.0), ("x", 0.26, round(aa, 2)), ("x", 0.17, 20.0), ("x", 0.15, 75.0), ("x", 0.10, 25.0)]
    df = spark.createDataFrame(parts, "t string, w double, v double").withColumns({"state": F.lit("MEASURED"), "lo": F.lit(0.0), "hi": F.lit(100.0), "part": F.lit(1.0)})
    return C.aggregate(df, "t").first()["value"]


START = [(12, 55, "USEFUL", 12, False), (18, 22, "NEUTRAL", 18, False)]


@pytest.mark.parametrize(
    ("more", "aa", "nd"),
    [
        ([], 50.62, 38.31),
        ([(1, 8, "TOXIC", 1, False)], 50.62, 38.31),
        ([(100, 4, "NEUTRAL", 100, False)], 50.62, 38.31),
        ([(100, 60, "USEFUL", 100, False)], 81.76, 46.41),
        ([(100, 8, "TOXIC", 100, False)], 7.16, 27.01),
    ],
)
def test_domain_score_goldens(spark, more, aa, nd):
    row = authority(spark, START + more)
    assert row["value"] == pytest.approx(aa, abs=0.006)
    assert domain_score(spark, row["value"]) == pytest.approx(nd, abs=0.006)


def test_unrated_links_change_nothing(spark):
    assert authority(spark, START + [(5, 0, "UNRATED", 5, False)])["value"] == pytest.approx(authority(spark, START)["value"])


def test_axes(spark):
    one = spark.range(1)
    lit = F.lit
    row = one.select(
        C.popularity(lit(100000), lit(200), lit(True)).alias("tr"),
        C.popularity(lit(None).cast("long"), lit(200), lit(True)).alias("gone"),
        C.popularity(lit(1), lit(403), lit(True)).alias("blind"),
        C.axis_coverage(lit(203), lit(1.0), lit(1.0)).alias("co"),
        C.axis_health(lit(200), lit(3), lit(3100), lit(920), lit(False), lit(True), lit(True)).alias("st"),
        C.page_traffic(lit(0.28 * 3), lit(100000), lit(200), lit(True)).alias("t"),
    ).first()
    assert row["tr"]["value"] == pytest.approx(25.0)
    assert (row["gone"]["value"], row["gone"]["state"]) == (5.0, "ABSENT")
    assert (row["blind"]["state"], row["blind"]["high"]) == ("BLIND", 100.0)
    assert row["co"]["value"] == pytest.approx(75.0, abs=0.01)
    assert row["st"]["value"] == pytest.approx(25.0)


def test_blind_part_moves_only_range_and_share(spark):
    base = [("a", 1.0, 40.0, "MEASURED", 0.0, 100.0, 1.0)]
    blind = [*base, ("a", 1.0, None, "BLIND", 0.0, 100.0, 0.0)]
    ddl = "t string, w double, v double, state string, lo double, hi double, part double"
    a, b = (C.aggregate(spark.createDataFrame(x, ddl), "t").first() for x in (base, blind))
    assert a["value"] == b["value"] == 40.0
    assert (a["low"], a["high"], a["share"]) == (40.0, 40.0, 1.0)
    assert (b["low"], b["high"], b["share"]) == (20.0, 70.0, 0.5)


def test_nothing_measured_is_null_not_zero(spark):
    row = C.aggregate(spark.createDataFrame([("a", 1.0, None, "BLIND", 0.0, 100.0, 0.0)], "t string, w double, v double, state string, lo double, hi double, part double"), "t").first()
    assert row["value"] is None and (row["low"], row["high"]) == (0.0, 100.0)


def test_transmission_lowest_rule_wins(spark):
    n = F.lit(None)
    t = lambda *a: spark.range(1).select(C.transmission(*a).alias("t")).first()["t"]
    true, false = F.lit(True), F.lit(False)
    assert t(true, true, F.lit("nofollow"), true, true, true, true)["value"] == 0.05
    assert t(true, false, n.cast("string"), false, true, true, true)["value"] == 0.0
    unread = t(false, true, n.cast("string"), false, true, true, true)
    assert (unread["value"], unread["state"]) == (0.70, "BLIND")


def test_spots_are_refused(spark):
    with pytest.raises(Exception, match="spot"):
        C.refuse_spots(spark.createDataFrame([("a", "spot")], "domain string, role string")).collect()
