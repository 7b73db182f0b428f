import math

import pytest
from pyspark.sql import functions as F

from weftline.operators import traffic as T
from weftline.plans import curves as K

CASES = [  # position, low, high, single, result types, country, centre, low, high
    (4.2, 100, 1000, None, ["ai_overview"], "FR", 10.068, 2.576, 39.348),
    (15.0, None, None, 210, [], "FR", 0.945, 0.355, 2.515),
    (2.0, 100, 1000, None, ["snippet_other"], "FR", 29.172, 7.469, 113.930),
    (8.0, 10000, 100000, None, ["ai_overview", "snippet_other"], "US", 312.365, 71.225, 1369.920),
    (6.5, None, None, 90, [], "FR", 2.466, 1.130, 5.384),
]


@pytest.mark.parametrize("case", CASES)
def test_estimates(spark, case):
    position, low, high, single, types, country, centre, lo, hi = case
    d = lambda x: F.lit(x).cast("double")
    volume = T.volume_central(d(None), d(single), d(low), d(high))
    kinds = F.array(*map(F.lit, types)).cast("array<string>")
    e = spark.range(1).select(T.estimate(volume, d(position), F.lit(country), kinds).alias("e")).first()["e"]
    assert (e["centre"], e["low"], e["high"]) == pytest.approx((centre, lo, hi), rel=2e-3)


def test_beyond_the_curves_is_blind(spark):
    d = lambda x: F.lit(x).cast("double")
    e = spark.range(1).select(T.estimate(T.volume_central(d(None), d(5), d(None), d(None)), d(24), F.lit("US"), F.array().cast("array<string>")).alias("e")).first()["e"]
    assert e["centre"] is None and e["state"] == "BLIND"


def test_typical_disagreement():
    assert K.typical_disagreement() == pytest.approx(3.63196, abs=1e-5)


def test_loglog_midpoint():
    assert K.interpolate(K.CLEAN, math.sqrt(2)) == pytest.approx(math.sqrt(39.8 * 18.7), abs=1e-9)


def test_floor_and_unknown_types(spark):
    m = lambda *t: spark.range(1).select(T.serp_multiplier(F.array(*map(F.lit, t))).alias("m")).first()["m"]
    assert m("ai_overview", "snippet_other", "local_pack")["low"] == pytest.approx(0.20)
    with pytest.raises(Exception, match="unknown result type"):
        m("hologram")


def test_label_guard():
    assert T.guard_label("modelled clicks") == "modelled clicks"
    with pytest.raises(ValueError, match="estimate"):
        T.guard_label("Measured traffic")
