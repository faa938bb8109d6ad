"""The median by narrowing ranges against the plain one."""

import random
import statistics

import pytest

from folium.operators.profile import exact_median


@pytest.mark.parametrize("kind, most", [("odd", 3), ("even", 1), ("even", 1000), ("ties", 3), ("one value", 1), ("far apart", 1), ("two", 1)])
def test_exact_median(spark, kind, most):
    rng = random.Random(4)
    rows = {
        "odd": [rng.gauss(0, 1) for _ in range(201)], "even": [rng.gauss(5, 100) for _ in range(200)], "ties": [float(rng.choice([1, 2, 2, 2, 3, 50])) for _ in range(151)],
        "one value": [7.5] * 30, "far apart": [-1.7e308, 1.7e308, 0.0, 1e-300, 2e-300, 5.0], "one": [3.0], "two": [1.0, 2.0],
    }[kind]
    df = spark.createDataFrame([(x,) for x in rows] + [(None,), (float("nan"),)], "v double").repartition(3)
    assert exact_median(df, "v", bins=7, most=most) == pytest.approx(statistics.median(rows), rel=1e-15)


def test_no_numbers(spark):
    assert exact_median(spark.createDataFrame([(None,)], "v double"), "v") is None
