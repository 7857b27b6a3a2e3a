"""Two-dimensional Gaussian algebra as column expressions, and covariance vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_normal_2d(dx: Column, dy: Column, sxx: Column, sxy: Column, syy: Column) -> Column:
    det = sxx * syy - sxy * sxy
    return -0.5 * mahalanobis_2d(dx, dy, sxx, sxy, syy) - 0.5 * F.ln(det) - math.log(2 * math.pi)


def mahalanobis_2d(dx: Column, dy: Column, sxx: Column, sxy: Column, syy: Column) -> Column:
    return (syy * dx * dx - 2 * sxy * dx * dy + sxx * dy * dy) / (sxx * syy - sxy * sxy)


def missed_existence(exi: Column, pd: float) -> Column:
    """Probability that a track exists after a scan that missed it."""
    return exi * (1 - pd) / (1 - exi + exi * (1 - pd))


def missed_log_weight(exi: Column, pd: float) -> Column:
    return F.ln(1 - exi + exi * (1 - pd))


def covariance_vector(matrix: list[list[float]]) -> list[float]:
    """The diagonal, then the strictly lower columns."""
    n = len(matrix)
    return [matrix[k][k] for k in range(n)] + [matrix[i][j] for j in range(n) for i in range(j + 1, n)]


def covariance_matrix(vector: list[float]) -> list[list[float]]:
    n = int((math.isqrt(8 * len(vector) + 1) - 1) // 2)
    out = [[0.0] * n for _ in range(n)]
    rest = iter(vector[n:])
    for k in range(n):
        out[k][k] = vector[k]
    for j in range(n):
        for i in range(j + 1, n):
            out[i][j] = out[j][i] = next(rest)
    return out


def ellipse_point(angle: Column, mx: Column, my: Column, sxx: Column, sxy: Column, syy: Column, scale: float = 1.0) -> tuple[Column, Column]:
    """A point of the ellipse mean + scale * L (cos, sin), where L is the lower Cholesky factor."""
    a = F.sqrt(sxx)
    b = sxy / a
    c = F.sqrt(syy - b * b)
    return mx + scale * a * F.cos(angle), my + scale * (b * F.cos(angle) + c * F.sin(angle))
