"""Order statistics against sorting."""

import math
import random

import pytest

from trailbase.operators import selection

POINTS = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def groups():
    draw = random.Random(7)
    inf = float("inf")
    own = {
        ("one", 1): [3.5], ("two", 1): [1.0, 2.0], ("equal", 1): [0.25] * 500, ("few", 2): [float(draw.randint(0, 3)) for _ in range(900)], ("even", 1): [draw.random() for _ in range(2000)],
        ("wide", 1): [draw.choice([-1, 1]) * 10.0 ** draw.randint(-300, 300) for _ in range(700)], ("tiny", 1): [1.0 + i * 2**-52 for i in range(300)], ("infinite", 1): [-inf, -inf, -5.0, 0.0, 0.0, 2.0, inf],
        ("zero", 1): [-0.0, 0.0, 0.0], ("below", 1): [-(10.0**-k) for k in range(200)], ("far", 1): [-1.7e308, 1.7e308, 1.6e308], ("subnormal", 1): [5e-324 * i for i in range(50)],
    }
    return own


def mixed(values, p):
    values, at = sorted(values), (len(values) - 1) * p
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else low + (high - low) * (at - math.floor(at))


@pytest.fixture(scope="module")
def table(spark):
    rows = [(a, b, v) for (a, b), values in groups().items() for v in values] + [("none", 1, None), ("none", 1, float("nan")), ("one", 1, None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "name string, b int, v double").repartition(5)


def test_percentiles_equal_sorting(table):
    out = {(r.name, r.b): r for r in selection.percentiles(table, ["name", "b"], "v", POINTS).collect()}
    assert set(out) == set(groups())
    for key, values in groups().items():
        for k, p in POINTS.items():
            want = mixed(values, p)
            assert out[key][k] == pytest.approx(want, rel=1e-12) or out[key][k] == want, (key, k)
        assert out[key]["max"] == max(values)


def test_discrete_percentiles_of_all_rows(table):
    own = sorted(v for values in groups().values() for v in values)
    row = selection.discrete_percentiles(table, [], "v", POINTS).first()
    assert row.asDict() == {k: own[max(0, math.ceil(len(own) * p) - 1)] for k, p in POINTS.items()}


def test_nothing(table):
    assert selection.percentiles(table.filter("false"), ["name"], "v", POINTS).count() == 0
    assert selection.at_ranks(table.filter("name = 'two'"), ["name"], "v", {"a": selection.F.col("n") + 1, "b": selection.F.lit(1)}).first().asDict() == {"name": "two", "n": 2, "a": None, "b": 2.0}
