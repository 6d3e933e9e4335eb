"""Mixing sources to target weights by whole-document repetition.

Sizes are summed per source (partial sums before the shuffle), targets follow from the sums alone, and
every document is emitted floor(rate) times plus once more with the fraction as probability, decided by a
hash of its id. No document meets another one after the sums, so a hot source costs nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
import pyarrow as pa

from phasemill.llm.texts import cut, unused
from phasemill.operators.blocks import index_rows

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_REPEATS = 2


@F.arrow_udf(T.LongType())
def count_words(raw: pa.Array) -> pa.Array:
    """Words between white space of UTF-8 bytes; null has none."""
    return pa.array([len(x.split()) if x is not None else 0 for x in raw.to_pylist()], pa.int64())


def sum_sources(sized: DataFrame, source: str, size: str) -> DataFrame:
    """(source, source_size, rank): rank counts the sources from 0 in code-point order, null last."""
    sums = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    # blocks by first character keep the ranking distributed whatever the number of sources
    block = F.when(F.col("source").isNull(), F.lit(1 << 24)).otherwise(F.ascii("source"))
    return index_rows(
        sums.withColumn("_block", block.cast("bigint")), [], "_block", [F.col("source").asc_nulls_last()], "rank"
    ).drop("_block")


def targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share_percent: int = SHARE_PERCENT,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """Adds `target`: the shared total by weight, no source above `most` times its size.

    Each round fixes the sources whose share would exceed their bound and shares the rest among the
    others; two sums a round reach the driver. It ends because every round but the last fixes a source.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = cut(
        sources.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * most).cast("double"))
        .withColumn("_level", F.col("_cap") / F.col("_w"))
    )
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share_percent / 100
    level, fixed = -1.0, None
    while True:
        free = F.col("_level") > level
        caps, w, n = rows.agg(
            F.coalesce(F.sum(F.when(~free, F.col("_cap"))), F.lit(0.0)), F.sum(F.when(free, F.col("_w"))),
            F.count(F.when(~free, 1)),
        ).first()
        if not w or n == fixed:
            break
        level, fixed = (total - caps) / w, n
    return rows.withColumn(
        "target", F.when(F.col("_level") > level, F.lit(level) * F.col("_w")).otherwise(F.col("_cap"))
    ).drop("_w", "_cap", "_level")


def chance(*columns: Column | str, seed: str = "mix") -> Column:
    """A number in [0, 1) from a hash of the columns; the same in every run and engine."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan_mix(
    docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text",
    weights: Sequence[float] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_REPEATS,
) -> DataFrame:
    """`docs` with `size`, `source_size`, `target` (the source's), `copies` and `taken` (size times copies).

    A null text has size 0, a null source is a source of its own, rows without doc_id share one draw, and
    repeated rows draw alike. A source of no words has target 0 and no copies of its documents are drawn.
    Result columns replace input columns of the same name.
    """
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies", "taken")]
    sized = docs.select(*kept).withColumn("size", count_words(F.col(text).cast("binary")))
    plan = targets(sum_sources(sized.select(source, "size"), source, "size"), weights, share_percent, most)
    name = unused(sized, "_mix_source")
    plan = plan.select(F.col("source").alias(name), "source_size", "target")
    # one row per source; the planner or adaptive execution broadcasts it only when its size allows
    out = sized.join(plan, sized[source].eqNullSafe(plan[name]), "left").drop(name)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = whole + F.when(chance(doc_id) < rate - whole, 1).otherwise(0)
    return out.withColumn("copies", copies.cast("bigint")).withColumn("taken", F.col("size") * F.col("copies"))


def emit_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of `docs` as often as `plan_mix` says, with the columns of `docs`."""
    planned = plan_mix(docs, **options)
    n = unused(planned, "_copy")
    return planned.filter("copies > 0").withColumn(
        n, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    ).select(*docs.columns)
