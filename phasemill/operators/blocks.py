"""Ordered operators over keys that may be very large.

A plain window over one recording would put all of that recording's rows into one task. The helpers
here split the order into blocks: work inside a block needs only (key, block), and what must cross a
block boundary is carried by a one-row-per-block summary or by copying a few boundary rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
HOUR_US = 3_600_000_000


def block_of(position: str | Column, size: int | float | Column) -> Column:
    c = F.col(position) if isinstance(position, str) else position
    return F.floor(c / (size if isinstance(size, Column) else F.lit(size))).cast("bigint")


def index_rows(
    df: DataFrame, keys: list[str], block: str, order: list, name: str, start: int = 0
) -> DataFrame:
    """Global row number per key; `block` must be monotone in `order` within a key."""
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    within = Window.partitionBy(*keys, block).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(within))
        .join(offsets, [*keys, block])
        .withColumn(name, (F.col("_off") + F.col("_rn") - 1 + start).cast("bigint"))
        .drop("_rn", "_off")
    )


def running_sum(df: DataFrame, keys: list[str], block: str, order: list, value: str, name: str) -> DataFrame:
    """Inclusive running sum per key, block by block."""
    sums = df.groupBy(*keys, block).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, block, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off")
    )
    within = (
        Window.partitionBy(*keys, block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        df.withColumn("_cum", F.sum(value).over(within))
        .join(offsets, [*keys, block])
        .withColumn(name, F.col("_cum") + F.col("_off"))
        .drop("_cum", "_off")
    )


def with_halo(
    df: DataFrame, index: str, before: int = 0, after: int = 0, size: int = BLOCK_ROWS
) -> DataFrame:
    """Assign rows of a dense 0-based `index` to blocks, copying boundary rows to the next or previous block.

    Adds `_blk` and `_own` (false for copies). Window functions partitioned by (key, _blk) then see
    `before` earlier and `after` later rows; filter on `_own` afterwards.
    """
    if max(before, after) > size:
        raise ValueError("the reach of the window must not exceed the block size")
    i = F.col(index)
    home = block_of(index, size)
    into = [home]
    if before:  # rows at the end of a block are needed by the next one
        into.append(F.when(i % size >= size - before, home + 1))
    if after:
        into.append(F.when((i % size < after) & (home > 0), home - 1))
    copies = F.array_compact(F.array(*into))
    return df.withColumn("_blk", F.explode(copies)).withColumn("_own", F.col("_blk") == home)


def neighbour_rows(
    df: DataFrame, keys: list[str], index: str, columns: dict, before: int = 0, after: int = 0,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Evaluate window columns that look at most `before`/`after` rows away.

    `columns` maps an output name to a function of the window specification.
    """
    w = Window.partitionBy(*keys, "_blk").orderBy(index)
    out = with_halo(df, index, before, after, size)
    for name, make in columns.items():
        out = out.withColumn(name, make(w))
    return out.filter("_own").drop("_blk", "_own")


def asof_nearest(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
    right_index: str, bucket: float | Column, name: str,
) -> DataFrame:
    """For each left row, the index of the right row nearest in time; ties go to the earlier index.

    Both sides are cut into time buckets, so a hot key is spread over its own time line; neighbours in
    other buckets are found through one summary row per (key, bucket). `bucket` may be a column of both sides that is
    constant in a key.
    """
    pt = F.struct(
        F.col(right_time).alias("t"), (-F.col(right_index)).alias("n"), F.col(right_index).alias("i")
    )
    r = right.select(*keys, block_of(right_time, bucket).alias("_b"), pt.alias("_p"))
    summary = r.groupBy(*keys, "_b").agg(F.min_by("_p", F.struct("_p.t", "_p.i")).alias("_lo"), F.max("_p").alias("_hi"))
    lb = left.withColumn("_b", block_of(left_time, bucket))
    # carry across buckets on the summaries only
    wanted = lb.select(*keys, "_b").distinct()
    line = summary.join(wanted, [*keys, "_b"], "full_outer")
    back = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    fore = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    edges = line.select(
        *keys, "_b",
        F.last("_hi", True).over(back).alias("_prev"),
        F.first("_lo", True).over(fore).alias("_next"),
    )
    # inside a bucket: one ordered pass over both sides
    tagged = lb.select(
        *keys, "_b", F.col(left_time).alias("_t"), F.lit(None).cast(r.schema["_p"].dataType).alias("_p"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_row"),
    ).unionByName(
        r.select(
            *keys, "_b", F.col("_p.t").alias("_t"), "_p",
            F.lit(None).cast(left.schema).alias("_row"),
        )
    )
    cell = Window.partitionBy(*keys, "_b")
    up = cell.orderBy(F.col("_t"), F.col("_p.n").asc_nulls_last())
    down = cell.orderBy(F.col("_t").desc(), F.col("_p.n").asc_nulls_last())
    past = Window.unboundedPreceding
    near = (
        tagged.withColumn("_before", F.last("_p", True).over(up.rowsBetween(past, -1)))
        .withColumn("_after", F.last("_p", True).over(down.rowsBetween(past, -1)))
        .filter(F.col("_row").isNotNull())
        .join(edges, [*keys, "_b"])
    )
    cands = F.array_compact(F.array("_before", "_after", "_prev", "_next"))
    ranked = F.array_min(
        F.transform(cands, lambda p: F.struct(F.abs(p["t"] - F.col("_t")).alias("d"), p["i"].alias("i")))
    )
    return near.withColumn(name, ranked["i"]).select("_row.*", name)

