"""Numerical agreement of two maps within a stated tolerance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.functions.columns import finite, wrap_distance

EPS64 = 2.220446049250313e-16
EPS32 = 1.1920928955078125e-07


@dataclass(frozen=True)
class Tolerance:
    """metric: linear, wrap (with a period) or exact."""

    metric: str
    atol: float = 0.0
    rtol: float = 0.0
    period: float = 0.0

    @staticmethod
    def absolute(k: float, eps: float = EPS64) -> Tolerance:
        return Tolerance("linear", atol=k * eps)

    @staticmethod
    def relative(k: float, eps: float = EPS64, floor: float = 1.0) -> Tolerance:
        return Tolerance("linear", atol=floor * eps, rtol=k * eps)

    @staticmethod
    def wrap(period: float, k: float, eps: float = EPS64, scale: float = 1.0) -> Tolerance:
        return Tolerance("wrap", atol=k * eps * scale, period=period)

    @staticmethod
    def exact() -> Tolerance:
        return Tolerance("exact")

    def scaled(self, kappa: float) -> Tolerance:
        return Tolerance(self.metric, self.atol * kappa, self.rtol * kappa, self.period)


def agreement(
    a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tol: Tolerance, by: Sequence[str] = ("rec_id",)
) -> DataFrame:
    """Per `by` group: failures, largest differences, positions finite on one side only, and a verdict.

    Rows present on one side only count as a mismatch. A comparison with nothing finite is vacuous,
    which is not agreement.
    """
    keys, by = list(keys), list(by)
    j = a.select(*keys, F.col(value).cast("double").alias("_a"), F.lit(1).alias("_ia")).join(
        b.select(*keys, F.col(value).cast("double").alias("_b"), F.lit(1).alias("_ib")), keys, "full_outer"
    )
    fa, fb = finite("_a"), finite("_b")
    both = fa & fb
    lone = F.col("_ia").isNull() | F.col("_ib").isNull()
    scale = F.greatest(F.abs("_a"), F.abs("_b"))
    dist = wrap_distance("_a", "_b", tol.period) if tol.metric == "wrap" else F.abs(F.col("_a") - F.col("_b"))
    if tol.metric == "exact":
        ok = F.col("_a") == F.col("_b")
    else:
        ok = (dist <= tol.atol) | (dist <= scale * tol.rtol) | (F.col("_a") == F.col("_b"))
    g = j.groupBy(*by).agg(
        F.count(F.when(both & ~ok, 1)).alias("n_fail"),
        F.coalesce(F.max(F.when(both, dist)), F.lit(0.0)).alias("max_abs"),
        F.coalesce(F.max(F.when(both & (scale > 0), F.try_divide(dist, scale))), F.lit(0.0)).alias("max_rel"),
        F.count(F.when(lone | (fa != fb), 1)).alias("n_nan_mismatch"),
        F.count(F.when(both, 1)).alias("n_finite"),
    )
    vacuous = (F.col("n_finite") == 0) & (F.col("n_nan_mismatch") == 0)
    return g.withColumn("vacuous", vacuous).withColumn(
        "agrees", (F.col("n_fail") == 0) & (F.col("n_nan_mismatch") == 0) & ~vacuous
    )
