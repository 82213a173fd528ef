"""Order statistics by ranges against sorted lists."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from phylospark.operators import summary

SCHEMA = "part string, v double"


def plain(values, share):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    if not values:
        return None
    spot = Fraction(share) * (len(values) - 1)
    low, high = values[math.floor(spot)], values[math.ceil(spot)]
    return low if low == high else float(math.ceil(spot) - spot) * low + float(spot - math.floor(spot)) * high


def groups():
    r = random.Random(4)
    return {
        "even": [float(i) for i in range(1001)],
        "ties": [r.choice([1.0, 2.0, 2.5]) for _ in range(900)],
        "one value": [7.25] * 300,
        "wide": [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(700)],
        "ends": [-1.7e308, 1.7e308, -1.0, 0.0, 1.0, 5e-324, -5e-324, 1e-323],
        "least": [0.0, 5e-324, 1e-323, 1.5e-323],
        "infinite": [math.inf, -math.inf, 3.0, 4.0, math.inf, -math.inf, 5.0],
        "gaps": [None, 1.0, None, math.nan, 3.0, 2.0, math.nan],
        "no value": [None, math.nan, None],
        "single": [4.0],
        None: [float(r.randrange(50)) for _ in range(400)],
    }


@pytest.mark.parametrize("held", [0, 10**6])
def test_quantiles_of_any_group(spark, monkeypatch, held):
    monkeypatch.setattr(summary, "PARTS", 64)  # more rounds
    rows = [(part, v) for part, own in groups().items() for v in own]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"lo": F.lit("clash"), "g": F.lit(1)}).repartition(5)
    shares = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = {x["part"]: x["q"] for x in summary.quantiles(frame, "v", ["part"], shares, held).collect()}
    assert set(got) == set(groups())
    for part, own in groups().items():
        for k, share in enumerate(shares):
            expected = plain(own, share)
            assert (got[part] and got[part][k]) == (expected if expected is None else pytest.approx(expected, rel=1e-12, abs=0)), (part, share)


def test_quantiles_without_groups_or_rows(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert summary.quantiles(frame, "v", [], held=3).first()["q"] == [2.25, 4.5, 6.75]
    assert summary.quantiles(spark.createDataFrame([], SCHEMA), "v", ["part"], held=0).count() == 0


def test_boxes_and_outliers_agree_whatever_is_held(spark):
    r = random.Random(9)
    rows = [("a", r.gauss(0, 1)) for _ in range(500)] + [("a", 40.0), ("a", -35.0)] + [(None, float(i)) for i in range(20)] + [("b", None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    small, large = ({x["part"]: x for x in summary.box_statistics(frame, "v", "part", held=h).collect()} for h in (10**6, 10))
    assert small == large and set(small) == {"a", "b", None}
    beyond = summary.outliers(frame, "v", "part", held=10).collect()
    assert len(beyond) == small["a"]["n_outliers"] and {x["part"] for x in beyond} == {"a"}
    assert {(x["v"], x["high"]) for x in beyond} >= {(40.0, True), (-35.0, False)}
