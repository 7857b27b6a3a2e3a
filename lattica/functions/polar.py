"""Polar and Cartesian coordinates as column expressions, with Jacobians and covariances carried over by them. Angles are in radians, from the
first axis towards the second; matrices are (xx, xy, yy) of symmetric ones, rows end to end of others."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Three = tuple[Column, Column, Column]
Four = tuple[Column, Column, Column, Column]


def to_polar(x: Column, y: Column) -> tuple[Column, Column]:
    """Range and angle (-pi to pi); the angle of the origin is 0."""
    return F.hypot(x, y), F.atan2(y, x)


def to_cartesian(r: Column, angle: Column) -> tuple[Column, Column]:
    return r * F.cos(angle), r * F.sin(angle)


def polar_jacobian(x: Column, y: Column) -> Four:
    """Derivatives of (range, angle) by (x, y); null at the origin."""
    q = x * x + y * y
    r = F.sqrt(q)
    away = lambda c: F.when(q > 0, c)
    return away(x / r), away(y / r), away(-y / q), away(x / q)


def cartesian_jacobian(r: Column, angle: Column) -> Four:
    """Derivatives of (x, y) by (range, angle)."""
    return F.cos(angle), -r * F.sin(angle), F.sin(angle), r * F.cos(angle)


def carried(jacobian: Four, covariance: Three) -> Three:
    """J S J' of a Jacobian and a covariance."""
    a, b, c, d = jacobian
    xx, xy, yy = covariance
    return a * a * xx + 2 * a * b * xy + b * b * yy, a * c * xx + (a * d + b * c) * xy + b * d * yy, c * c * xx + 2 * c * d * xy + d * d * yy


def wrapped(angle: Column) -> Column:
    """The same angle from -pi to under pi."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi
