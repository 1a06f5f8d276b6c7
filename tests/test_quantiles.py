"""Exact quantiles by brackets against a plain sort."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsift.operators import quantiles as Q

PROBS = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)


def check(spark, rows, probs=PROBS, **how):
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["g"]: r for r in Q.summarised_quantiles(df, ["g"], "v", probs, **how).collect()}
    values = {}
    for g, v in rows:
        if v is not None:
            values.setdefault(g, []).append(v)
    assert set(got) == set(values)
    for g, vs in values.items():
        r = got[g]
        assert (r["n"], r["least"], r["most"]) == (len(vs), min(vs), max(vs)) and abs(r["mean"] - np.mean(vs)) < 1e-6
        assert np.allclose(r["q"], np.quantile(vs, probs), rtol=1e-12, atol=1e-9), g


def test_groups_of_all_kinds(spark):
    """A hot group, one of equal values, small ones, a null key, null values."""
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1000)) for _ in range(20_000)] + [("equal", 7.5)] * 3000 + [("few", float(i % 5)) for i in range(4000)]
    rows += [("one", 1.0), ("two", 1.0), ("two", 4.0), (None, 3.0), (None, 9.0), ("none", None), ("hot", None)]
    rows += [("skewed", float(x)) for x in [1] * 1000 + list(range(1000, 1100))]
    check(spark, rows)
    check(spark, rows, (0.5,))


@pytest.mark.parametrize("accuracy", [3, 20])
def test_rough_sketches_change_nothing(spark, accuracy):
    rng = random.Random(8)
    check(spark, [(rng.choice("abc"), float(rng.randint(0, 10_000))) for _ in range(5000)], accuracy=accuracy)


def test_a_missed_bracket_is_mended(spark, monkeypatch):
    """Brackets that hold nothing: the ranks are found another way."""
    monkeypatch.setattr(Q.F, "percentile_approx", lambda c, edges, accuracy: F.array(*[F.lit(-1.0) for _ in edges]))
    check(spark, [("a", float(i)) for i in range(500)] + [("b", 2.0)], (0.25, 0.5))


def test_no_rows(spark):
    assert Q.summarised_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", PROBS).collect() == []
