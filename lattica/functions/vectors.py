"""Gaussian algebra of any small dimension as column expressions: vectors are arrays, matrices arrays of their rows end to end."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cholesky(df: DataFrame, matrix: str, dims: int, to: str = "l") -> DataFrame:
    """df with the lower factor's entries in the columns {to}{i}{j}; null where the matrix isn't positive definite."""
    for j in range(dims):
        for i in range(j, dims):
            rest = F.col(matrix)[i * dims + j]
            for k in range(j):
                rest = rest - F.col(f"{to}{i}{k}") * F.col(f"{to}{j}{k}")
            df = df.withColumn(f"{to}{i}{j}", F.when(rest > 0, F.sqrt(rest)) if i == j else rest / F.col(f"{to}{j}{j}"))
    return df


def whitened(df: DataFrame, difference: list[Column], to: str = "y", factor: str = "l") -> DataFrame:
    """df with the solution of L y = difference in the columns {to}{i}."""
    for i, d in enumerate(difference):
        for k in range(i):
            d = d - F.col(f"{factor}{i}{k}") * F.col(f"{to}{k}")
        df = df.withColumn(f"{to}{i}", d / F.col(f"{factor}{i}{i}"))
    return df


def squared(dims: int, of: str = "y") -> Column:
    """The sum of squares of the columns {of}{i}."""
    return sum((F.col(f"{of}{i}") * F.col(f"{of}{i}") for i in range(1, dims)), F.col(f"{of}0") * F.col(f"{of}0"))


def log_root_det(dims: int, factor: str = "l") -> Column:
    """Half the log-determinant."""
    return sum((F.ln(f"{factor}{i}{i}") for i in range(1, dims)), F.ln(f"{factor}00"))


def log_normal(dims: int, of: str = "y", factor: str = "l") -> Column:
    """Log-density of whitened differences."""
    return -0.5 * squared(dims, of) - log_root_det(dims, factor) - 0.5 * dims * math.log(2 * math.pi)
