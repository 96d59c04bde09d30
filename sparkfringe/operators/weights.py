"""Robust weights: residuals as Student-t distributed, by expectation-maximisation.

Each step is an aggregation over a chunk and an expression: eta = (dof + n) / (dof + sum r^H C^-1 r), the inverse
covariance 1 / mean(eta |r|^2), and dof from the root of log(dof) - digamma(dof) + constant in [1, 30].
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jones import Jones
from ..plans.schemas import CHUNK

START_DOF, LOW, HIGH, ROUNDS, NEAR = 5.0, 1.0, 30.0, 50, 1e-8


def digamma(x: float) -> float:
    """By recurrence to x > 6 and the asymptotic series."""
    out = 0.0
    while x <= 6:
        out -= 1 / x
        x += 1
    # The coefficients B_2k / 2k.
    series = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760, 1 / 12)
    return out + log(x) - 0.5 / x - sum(c / x ** (2 * k + 2) for k, c in enumerate(series))


def degrees_of_freedom(mean_log_eta_less_eta: float, dof: float, n_corr: int) -> float:
    """The dof that the mean of log(eta) - eta asks for, by bisection."""
    constant = mean_log_eta_less_eta + 1 + digamma(dof + n_corr) - log(dof + n_corr)
    value = lambda x: log(x) - digamma(x) + constant
    low, high = LOW, HIGH
    middle = (low + high) / 2
    for _ in range(ROUNDS):
        middle = (low + high) / 2
        if value(middle) == 0 or high - low < NEAR:
            break
        if np.sign(value(middle)) == np.sign(value(low)):
            low = middle
        else:
            high = middle
    return middle


def mean_weight(vis: DataFrame, n_corr: int, keys: Sequence[str] = CHUNK) -> DataFrame:
    good = F.col("flag") == 0
    return vis.groupBy(*keys).agg(F.array(*[F.avg(F.when(good, F.col("weight")[k])) for k in range(n_corr)]).alias("icov"))


def eta(vis: DataFrame, n_corr: int, of: str = "residual") -> DataFrame:
    """``vis`` (with icov and dof) with eta, 0 where flagged."""
    parts = Jones.of(F.col(of), n_corr).parts
    size = sum((p.abs2() * F.col("icov")[k] for k, p in enumerate(parts[1:], 1)), parts[0].abs2() * F.col("icov")[0])
    return vis.withColumn("eta", F.when(F.col("flag") == 0, (F.col("dof") + n_corr) / (F.col("dof") + size)).otherwise(0.0))


def inverse_covariance(vis: DataFrame, n_corr: int, of: str = "residual", keys: Sequence[str] = CHUNK) -> DataFrame:
    """Per chunk, 1 / mean(eta |r|^2) of each correlation, 0 without data."""
    good = F.col("flag") == 0
    parts = Jones.of(F.col(of), n_corr).parts
    n = F.count(F.when(good, 1))
    made = []
    for p in parts:
        total = F.sum(F.when(good, F.col("eta") * p.abs2()))
        made.append(F.when(total > 0, n / total).otherwise(0.0))
    shape = F.avg(F.when(good & (F.col("eta") > 0), F.ln("eta") - F.col("eta"))).alias("log_eta")
    return vis.groupBy(*keys).agg(F.array(*made).alias("icov"), shape)


def next_dof(stats: DataFrame, n_corr: int, keys: Sequence[str] = CHUNK) -> DataFrame:
    """``stats`` (keys, icov, log_eta, dof) with the new dof."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = batch["log_eta"].notna()
            batch["dof"] = [degrees_of_freedom(x, d, n_corr) if fine else d for x, d, fine in zip(batch["log_eta"], batch["dof"], ok, strict=True)]
            yield batch

    return stats.mapInPandas(solve, stats.schema)


def robust_weights(vis: DataFrame, n_corr: int, of: str = "residual", keys: Sequence[str] = CHUNK) -> DataFrame:
    """One reweighting: weight becomes eta times the inverse covariance."""
    keys = list(keys)
    start = mean_weight(vis, n_corr, keys).withColumn("dof", F.lit(START_DOF))
    first = eta(vis.join(start, keys), n_corr, of).drop("icov", "dof")
    stats = inverse_covariance(first, n_corr, of, keys).withColumn("dof", F.lit(START_DOF))
    last = eta(first.drop("eta").join(next_dof(stats, n_corr, keys), keys), n_corr, of)
    weight = F.array(*[F.col("eta") * F.col("icov")[k] for k in range(n_corr)])
    return last.withColumn("weight", weight).select(*vis.columns)
