"""Session defaults and reliable lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 32 << 20  # largest measured side that is sent to every executor


def local_session(cores: str | int = "8", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-node session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("phasemill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def size_broadcasts_at_runtime(spark: SparkSession, limit: str = "32MB") -> None:
    """Let only measured sizes decide on broadcasts.

    The planner's estimate ignores how much `explode` multiplies rows, so a side that looks small may not
    be. With adaptive execution the shuffled size is known before a join is turned into a broadcast.
    """
    if spark.conf.get("spark.sql.adaptive.enabled", "true") == "true":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the session's own, else the one the cluster names.

    Only a session whose executors are this very process may fall back to a temporary folder; anywhere else
    each executor would write its part files to a disk that the others cannot see.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-ckpt-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder as parquet and continue from the files.

    Like `checkpoint()` it ends the lineage and survives lost executors, but it runs the plan once,
    keeps column pruning, and lets later joins see the true size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_width(kind: T.DataType) -> int:
    """Bytes that a value of the type is taken to need in memory."""
    if isinstance(kind, T.StructType):
        return 8 + sum(row_width(f.dataType) for f in kind.fields)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return 1024
    return 64 if isinstance(kind, (T.StringType, T.BinaryType)) else 16


def join_small(left: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join a large table with one that has a row per recording or the like, without moving the large one.

    The small side is written and counted first. Up to `limit` bytes it is broadcast; beyond that it is
    joined like any other table.
    """
    s = cut(small)
    fits = s.count() * row_width(s.schema) <= limit
    return left.join(F.broadcast(s) if fits else s, on, how)
