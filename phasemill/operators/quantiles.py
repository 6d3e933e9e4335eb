"""Exact order statistics per key without sorting a whole key in one task.

Each wanted rank has a bracket of values with the number of rows below it. Histogram passes narrow the
brackets, one partial aggregation a pass, until each holds few rows; only the distinct values inside a
bracket are then ordered. Counts are exact throughout, so a bracket holds its rank by construction.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasemill.session import cut, join_small

TALLY = 65_536  # rows inside a bracket that are tallied value by value
BINS = 1024

Rank = tuple[float, Callable[[Column], Column]]  # (fraction, 0-based rank as a function of n)


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """0 below the finite range, 1..BINS inside, then infinity, then NaN: monotone in Spark's order."""
    width = hi / 2 - lo / 2  # halved, so that it cannot overflow
    inside = F.when(width > 0, F.least(F.floor((v / 2 - lo / 2) / width * BINS), F.lit(BINS - 1)) + 1).otherwise(F.lit(1))
    return F.when(F.isnan(v), BINS + 2).when(v > hi, BINS + 1).when(v < lo, 0).otherwise(inside).cast("int")


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Rank]
) -> DataFrame:
    """One row per key: `n` and, for each pick, the value at that 0-based rank. NULLs are ignored, NaN is last."""
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    names = list(picks)
    fine = F.when(~F.isnan("_v") & (F.abs("_v") < float("inf")), F.col("_v"))
    whole = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"),
        F.min(fine).alias("flo"), F.max(fine).alias("fhi"),
    )
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("i"), picks[name][1](F.col("n")).cast("bigint").alias("rank"))
            for i, name in enumerate(names)
        ]
    )
    state = ["i", "rank", "lo", "hi", "flo", "fhi", "inside"]
    wanted = cut(
        whole.select(*keys, "n", "lo", "hi", "flo", "fhi", F.col("n").alias("inside"), F.explode(entries).alias("_e"))
        .select(*keys, "n", "_e.i", "_e.rank", "lo", "hi", "flo", "fhi", "inside")
    )
    ready = wanted.filter(f"inside <= {TALLY} OR lo = hi")
    wide = cut(wanted.filter(f"inside > {TALLY} AND NOT lo = hi"))
    while not wide.isEmpty():
        hist = (
            join_small(rows, wide, keys).filter("_v >= lo AND _v <= hi")
            .groupBy(*keys, "n", "i", "rank", _bin(F.col("_v"), F.coalesce("flo", F.lit(0.0)), F.coalesce("fhi", F.lit(0.0))).alias("_b"))
            .agg(
                F.count(F.lit(1)).alias("inside"), F.min("_v").alias("lo"), F.max("_v").alias("hi"),
                F.min(fine).alias("flo"), F.max(fine).alias("fhi"),
            )
        )
        upto = F.sum("inside").over(Window.partitionBy(*keys, "i").orderBy("_b"))  # at most BINS + 3 rows
        narrowed = cut(
            hist.withColumn("_cum", upto).filter("_cum > rank AND _cum - inside <= rank")
            .withColumn("rank", F.col("rank") - (F.col("_cum") - F.col("inside"))).select(*keys, "n", *state)
        )
        ready = ready.unionByName(narrowed.filter(f"inside <= {TALLY} OR lo = hi"))
        wide = cut(narrowed.filter(f"inside > {TALLY} AND NOT lo = hi"))
    # a bracket of one value is its own answer; the others are tallied
    single = ready.filter("lo = hi").select(*keys, "n", "i", F.col("lo").alias("_v"))
    open_ = ready.filter("NOT lo = hi")
    tally = (
        join_small(rows, open_, keys).filter("_v >= lo AND _v <= hi")
        .groupBy(*keys, "n", "i", "rank", "_v").agg(F.count(F.lit(1)).alias("_c"))
    )
    w = Window.partitionBy(*keys, "i").orderBy("_v")  # at most TALLY rows
    hit = tally.withColumn("_cum", F.sum("_c").over(w)).filter("_cum > rank AND _cum - _c <= rank")
    return single.unionByName(hit.select(*keys, "n", "i", "_v")).groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("i") == i, F.col("_v"))).alias(name) for i, name in enumerate(names)],
    )


def median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Interpolated median: mean of the two middle values when n is even."""
    lo = (0.5, lambda n: F.floor((n - 1) / 2))
    hi = (0.5, lambda n: F.ceil((n - 1) / 2))
    s = order_statistics(df, keys, value, {"_lo": lo, "_hi": hi})
    return s.select(*keys, "n", ((F.col("_lo") + F.col("_hi")) / 2.0).alias(name))


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Order statistic ⌈(n−1)/2⌉."""
    return order_statistics(df, keys, value, {name: (0.5, lambda n: F.ceil((n - 1) / 2))})


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Order statistic round(p·(n−1)) for each named fraction."""
    picks = {k: (p, lambda n, p=p: F.floor((n - 1) * p + 0.5)) for k, p in fractions.items()}
    return order_statistics(df, keys, value, picks)


def hazen(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str = "q") -> DataFrame:
    """Linear interpolation through the points ((k−½)/n, x_k), clamped at both ends."""
    return hazen_many(df, keys, value, {name: p})


def hazen_many(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    def pos(n, p):  # 0-based fractional position
        return F.greatest(F.lit(0.0), F.least(n - 1.0, n * p - 0.5))

    picks: dict[str, Rank] = {}
    for name, p in fractions.items():
        picks[f"_a_{name}"] = (p, lambda n, p=p: F.floor(pos(n, p)))
        picks[f"_b_{name}"] = (p, lambda n, p=p: F.ceil(pos(n, p)))
    s = order_statistics(df, keys, value, picks)

    def between(name, p):
        t = pos(F.col("n"), p) - F.floor(pos(F.col("n"), p))
        a, b = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        return (a + (b - a) * t).alias(name)

    return s.select(*keys, "n", *[between(n, p) for n, p in fractions.items()])
