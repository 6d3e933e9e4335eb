"""Line deduplication: a line that several documents hold stays in the first of them only.

Hashes of normalised lines are range-partitioned by (hash, document) and sorted, and each partition is
streamed: the first document of a run of equal hashes keeps its lines, the others lose theirs. A hash of
very many documents is spread over partitions, because the document is part of the range key; what
crosses a partition border is settled by the heads of each partition's first and last run, two rows a
partition. The result is a compressed bitmap of kept lines per document, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm.texts import as_bytes, cut, lists, put_columns, unused, with_fields

LINE = "doc_id bigint, text_key bigint, n_lines int, hi bigint, lo bigint, positions array<int>"
DROP, FIRST_RUN, LAST_RUN = 0, 1, 2


def _enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or (len(key) >= least and len(key.decode("utf-8", "replace")) >= least)


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per document and distinct normalised line of at least `min_chars` code points."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = batch[0].to_pylist(), batch[1].to_pylist(), as_bytes(batch[2])
            out: list[list] = [[], [], [], [], [], []]
            for doc, text_key, text in zip(ids, keys, texts):
                lines = text.split(b"\n")
                held: dict[bytes, list[int]] = {}
                for at, line in enumerate(lines):
                    key = line.strip().lower()
                    if _enough(key, min_chars):
                        held.setdefault(key, []).append(at)
                for key, at in held.items():
                    h = xxhash.xxh3_128_digest(key)
                    row = (doc, text_key, len(lines), h[:8], h[8:], at)
                    for column, value in zip(out, row):
                        column.append(value)
            hi, lo = (np.frombuffer(b"".join(x), ">i8").astype(np.int64) for x in (out[3], out[4]))
            counts = np.fromiter(map(len, out[5]), np.int64, len(out[5]))
            flat = np.fromiter((i for at in out[5] for i in at), np.int32, counts.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                    pa.array(hi), pa.array(lo), lists(flat, np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                ],
                ["doc_id", "text_key", "n_lines", "hi", "lo", "positions"],
            )

    return docs.mapInArrow(explode, LINE)


def _stream_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads one sorted partition; yields the lines to drop and the heads of the border runs."""
    last = None  # hash and first document of the run in progress
    in_first = True
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = {n: batch.column(n) for n in batch.schema.names}
        hi, lo, doc = (col[n].to_numpy() for n in ("hi", "lo", "doc_id"))
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        if last is not None:
            new[0] = (hi[0], lo[0]) != last[:2]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(hi)), -1))
        head = np.where(begin >= 0, doc[begin], last[2] if last is not None else 0)
        run = np.cumsum(new) - (1 if last is None else 0)  # 0 while the run of the batch before goes on
        first = in_first & (run == 0)
        kind = np.where(doc != head, DROP, np.where(first, FIRST_RUN, -1)).astype(np.int8)
        last, in_first = (hi[-1], lo[-1], head[-1]), bool(first[-1])
        told = np.flatnonzero(kind >= 0)
        if len(told):
            yield put_columns(batch.take(pa.array(told)), kind=pa.array(kind[told]))
    if last is not None:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(last[2])], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int32()),
                pa.array([int(last[0])], pa.int64()), pa.array([int(last[1])], pa.int64()),
                pa.array([[]], pa.list_(pa.int32())), pa.array([LAST_RUN], pa.int8()),
            ],
            ["doc_id", "text_key", "n_lines", "hi", "lo", "positions", "kind"],
        )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist()):
            keep = np.ones(n, bool)
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        n_dropped = [len(g) for g in batch.column("gone").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), batch.column("n_lines"), pa.array(n_dropped, pa.int32()), pa.array(maps, pa.binary())],
            ["doc_id", "text_key", "n_lines", "n_dropped", "keep"],
        )


def line_bitmaps(docs: DataFrame, min_chars: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text_key, n_lines, n_dropped, keep) of the documents that lose lines.

    `keep` is a zlib-compressed bitmap, first line first; `text_key` is `xxhash64` of the text, so that
    rows that repeat a doc_id are told apart. A document without a row keeps all its lines. Lines are
    compared without outer white space and without regard to the case of A-Z; all lines of a key stay in
    the smallest doc_id that holds it. Rows without doc_id or text neither lose lines nor hold any.
    """
    source = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")
    ).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = cut(line_rows(source, min_chars))  # range partitioning samples its input, so it is written first
    ordered = lines.repartitionByRange("hi", "lo", "doc_id").sortWithinPartitions("hi", "lo", "doc_id")
    told = cut(ordered.mapInArrow(_stream_runs, f"{LINE}, kind tinyint"))
    border = told.filter(F.col("kind") != DROP)
    heads = border.groupBy("hi", "lo").agg(F.min("doc_id").alias("head"))
    late = border.filter(F.col("kind") == FIRST_RUN).join(heads, ["hi", "lo"]).filter("doc_id > head")
    drops = told.filter(F.col("kind") == DROP).select("doc_id", "text_key", "n_lines", "positions").unionByName(
        late.select("doc_id", "text_key", "n_lines", "positions")
    )
    by_doc = drops.groupBy("doc_id", "text_key", "n_lines").agg(
        F.array_distinct(F.flatten(F.collect_list("positions"))).alias("gone")
    )
    return by_doc.mapInArrow(_pack, "doc_id bigint, text_key bigint, n_lines int, n_dropped int, keep binary")


def dedup_lines(docs: DataFrame, min_chars: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with repeated lines taken out of the text, and `n_lines` (before), `n_dropped`.

    A null text stays null and counts as one empty line. Result columns replace input columns of the
    same name.
    """
    bits = line_bitmaps(docs, min_chars, doc_id, text)
    key, keep = unused(docs, "text_key"), unused(docs, "keep")
    bits = bits.select(F.col("doc_id").alias("_bits_id"), F.col("text_key").alias(key), F.col("keep").alias(keep))
    left = docs.withColumn(key, F.xxhash64(text))
    joined = left.join(
        bits, (left[doc_id].cast("bigint") == bits["_bits_id"]) & (left[key] == bits[key]), "left"
    ).select(*[left[c] for c in docs.columns], bits[keep])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for raw, bitmap in zip(as_bytes(batch.column(text)), batch.column(keep).to_pylist()):
                n, dropped = (raw or b"").count(b"\n") + 1, 0
                if bitmap is not None:
                    stay = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n)
                    raw = b"\n".join(line for line, s in zip(raw.split(b"\n"), stay) if s)
                    dropped = n - int(stay.sum())
                n_lines.append(n)
                n_dropped.append(dropped)
                kept.append(raw)
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            yield put_columns(
                batch.drop_columns([keep]),
                **{text: texts, "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())},
            )

    return joined.mapInArrow(apply, with_fields(docs, **{text: "string", "n_lines": "bigint", "n_dropped": "bigint"}))
