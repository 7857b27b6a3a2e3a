"""Column functions against plain arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import polar, ragged, vectors


def test_polar_and_back_with_jacobians(spark):
    points = [(3.0, 4.0), (-2.0, 0.5), (-1.0, -7.0), (0.0, 2.0), (1e-3, -1e-3)]
    df = spark.createDataFrame(points, "x double, y double")
    r, angle = polar.to_polar(F.col("x"), F.col("y"))
    x, y = polar.to_cartesian(r, angle)
    p, c = polar.polar_jacobian(F.col("x"), F.col("y")), polar.cartesian_jacobian(r, angle)
    s = polar.carried(p, (F.lit(2.0), F.lit(0.3), F.lit(1.0)))
    for row, (px, py) in zip(df.select(r, angle, x, y, F.array(*p), F.array(*c), F.array(*s)).collect(), points, strict=True):
        assert row[:2] == pytest.approx((math.hypot(px, py), math.atan2(py, px))) and row[2:4] == pytest.approx((px, py))
        j, back = np.array(row[4]).reshape(2, 2), np.array(row[5]).reshape(2, 2)
        assert np.allclose(j @ back, np.eye(2))
        h = 1e-7 * math.hypot(px, py)
        assert (math.hypot(px + h, py) - math.hypot(px, py)) / h == pytest.approx(j[0, 0], abs=1e-4)
        want = j @ np.array([[2.0, 0.3], [0.3, 1.0]]) @ j.T
        assert row[6] == pytest.approx([want[0, 0], want[0, 1], want[1, 1]])
    at = spark.createDataFrame([(0.0, 0.0)], "x double, y double").select(*polar.to_polar(F.col("x"), F.col("y")), F.array(*polar.polar_jacobian(F.col("x"), F.col("y")))).first()
    assert tuple(at[:2]) == (0.0, 0.0) and at[2] == [None] * 4
    turns = [0.5, math.pi + 0.5, -math.pi - 0.25, 9 * math.pi]
    got = [v[0] for v in spark.createDataFrame([(t,) for t in turns], "t double").select(polar.wrapped(F.col("t"))).collect()]
    assert got == pytest.approx([0.5, -math.pi + 0.5, math.pi - 0.25, -math.pi])


def test_ragged_edits(spark):
    one = spark.range(1).select(F.array(*map(F.lit, (1, 2, 3))).alias("a"), F.array(F.lit(8), F.lit(9)).alias("b"), F.array().cast("array<int>").alias("none"))
    a, b, none = F.col("a"), F.col("b"), F.col("none")
    places = F.array(*map(F.lit, (3, 1, 1, 0, 4)))
    row = one.select(ragged.inserted(a, 1, b), ragged.inserted(a, 3, b), ragged.inserted(a, 4, b), ragged.inserted(a, 5, b), ragged.inserted(a, 0, b), ragged.inserted(none, 1, b), ragged.reordered(a, places), ragged.reordered(a, none)).first()
    assert list(row) == [[8, 9, 1, 2, 3], [1, 2, 8, 9, 3], [1, 2, 3, 8, 9], None, None, [8, 9], [3, 1, 1, None, None], []]


def test_vectors_of_five_dimensions(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, 5))
    s, d = a @ a.T + np.eye(5), rng.normal(size=5)
    df = spark.createDataFrame([(s.ravel().tolist(), d.tolist()), ((-s).ravel().tolist(), d.tolist())], "s array<double>, d array<double>")
    got = vectors.whitened(vectors.cholesky(df, "s", 5), [F.col("d")[k] for k in range(5)]).select(vectors.squared(5), vectors.log_normal(5)).collect()
    q = float(d @ np.linalg.solve(s, d))
    assert got[0][0] == pytest.approx(q) and got[0][1] == pytest.approx(-0.5 * q - 0.5 * np.linalg.slogdet(s)[1] - 2.5 * math.log(2 * math.pi))
    assert tuple(got[1]) == (None, None)
