"""Prefix trie of conversations by truncation peeling.

Turns become 24-byte digests before anything is grouped, so no text is shuffled. A conversation is then the
list of hashes of its prefixes, and equal conversations are folded to one item with the hash of their ids.
Peeling starts at the deepest turn: conversations that end there meet the nodes that survived from below,
every node is finished and counted, its last turn is stripped, and what is left is grouped again one turn
higher, so that nodes are found and aggregated in the same pass.

A subtree with at most `LARGEST_GROUP` items is peeled whole in one task. Above that, prefixes shared by more
items are heavy: the subtrees below them are summed to one item per heavy node with partial sums before the
shuffle, and the next round peels these items. A prefix that a third of all conversations share is therefore
never one group. Each round leaves strictly fewer heavy nodes; a path of heavy nodes of length n takes
n / LARGEST_GROUP rounds, bushy trees a logarithm of their size.

A conversation is one row: about 60 bytes a turn have to fit a task, its texts do not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm.texts import cut, join_spread

LARGEST_GROUP = 128  # items that one task peels as one group
CHUNK_IDS = 50_000  # ids of one node handed on as one row
BATCH_ROWS = 20_000  # rows of an Arrow batch that a task gives out

ROOT = bytes(16)
TURNS = "array<struct<digest:binary,size:bigint>>"
PATH = "conv_id bigint, key binary, keys array<binary>, sizes array<bigint>"
RUN = "key binary, n bigint, first bigint, sha string, part string, keys array<binary>, sizes array<bigint>"
NODE = (
    "depth bigint, key binary, parent binary, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, keys array<binary>, sizes array<bigint>"
)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_ARROW = {
    "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<binary>": pa.list_(pa.binary()),
    "array<bigint>": pa.list_(pa.int64()),
}


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of the schema."""
    names, kinds = zip(*(field.split() for field in schema.split(", ")))
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, _ARROW[kind]) for column, kind in zip(zip(*held), kinds)], list(names)
        )

    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield from zip(*(column.to_pylist() for column in part.columns))


def turn_lists(rows: DataFrame) -> DataFrame:
    """conv_id and its turns, as (128-bit digest of role and text, UTF-8 bytes of the text), in the order of `turn`.

    Rows: conv_id, turn, role, text; other columns are ignored. A null turn comes first, equal turns are
    ordered by digest, repeated rows stay repeated turns, a null role or text counts as empty, and rows
    without conv_id belong to no conversation and are left out. An empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = rows.filter("conv_id IS NOT NULL").select(
        "conv_id", F.struct("turn", F.unhex(digest).alias("digest"), F.octet_length(text).cast("bigint").alias("size")).alias("t")
    )
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def _paths(sequences: DataFrame) -> DataFrame:
    """The hash of every prefix of a conversation; the turnless one ends at the root."""

    def hash_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for conv, turns in _rows(batches):
                h, keys = hashlib.blake2b(digest_size=16), []
                for turn in turns:
                    h.update(turn["digest"])
                    keys.append(h.copy().digest())
                yield conv, keys[-1] if keys else ROOT, keys, [turn["size"] for turn in turns]

        yield from _batches(rows(), PATH)

    return sequences.select("conv_id", "turns").mapInArrow(hash_prefixes, PATH)


def _fold_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal conversations in a sorted partition. Runs that may go on in another partition
    and runs of more than CHUNK_IDS come out in parts, with their ids instead of the hash of them."""

    def rows():
        key, ids, first_run, parts = None, [], True, False
        for conv, k, keys, sizes in _rows(batches):
            if k != key and key is not None:
                listed = ",".join(map(str, ids))
                whole = not (first_run or parts)
                yield key, len(ids), ids[0], hashlib.sha256(listed.encode()).hexdigest() if whole else None, None if whole else listed, *path
                first_run, parts, ids = False, False, []
            elif len(ids) == CHUNK_IDS:
                yield key, len(ids), ids[0], None, ",".join(map(str, ids)), *path
                parts, ids = True, []
            key, path = k, (keys, sizes)
            ids.append(conv)
        if key is not None:
            yield key, len(ids), ids[0], None, ",".join(map(str, ids)), *path

    yield from _batches(rows(), RUN)


def _close_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of runs, sorted by their first id, streamed through one hash per run."""

    def rows():
        key = None
        for k, n, first, _, part, keys, sizes in _rows(batches):
            if k != key:
                if key is not None:
                    yield key, total, least, h.hexdigest(), None, *path
                key, total, least, path, h = k, 0, first, (keys, sizes), hashlib.sha256()
            else:
                h.update(b",")
            h.update(part.encode())
            total += n
        if key is not None:
            yield key, total, least, h.hexdigest(), None, *path

    yield from _batches(rows(), RUN)


def _fold_equal(paths: DataFrame) -> DataFrame:
    """One item per distinct conversation: how many there are, the smallest id, the hash of the sorted ids.

    The hash of a list is sequential by definition. Ids are sorted by ranges of (conversation, id), so a
    conversation that a third of all ids share is spread over tasks; only its comma-joined parts are
    streamed through one task.
    """
    runs = cut(paths.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_fold_runs, RUN))
    parts = runs.filter("part IS NOT NULL").repartition("key").sortWithinPartitions("key", "first")
    whole = runs.filter("part IS NULL").unionByName(parts.mapInArrow(_close_runs, RUN))
    return whole.select(
        "key", "keys", "sizes", "n", "first", F.lit(0).cast("bigint").alias("children"), F.lit(0).cast("bigint").alias("leaves"),
        F.lit(0).cast("bigint").alias("saved"), "sha",
    )


def _peel_group(rows: list[tuple]) -> Iterator[tuple]:
    """Truncation peeling of one subtree, from the deepest turn to the depth `top` that its items share."""
    top = rows[0][-1]
    ending: dict[int, list[tuple]] = {}
    for row in rows:
        ending.setdefault(len(row[1]), []).append(row)
    level: dict[bytes, list] = {}
    done, firsts = [], {}
    for depth in range(max(ending), top - 1, -1):
        for key, keys, sizes, n, first, children, leaves, saved, sha, _ in ending.get(depth, ()):
            node = level.get(key)
            if node is None:
                level[key] = [n, first, children, leaves, saved, sha, keys, sizes]
            else:
                node[0] += n
                node[1] = min(node[1], first)
                node[2] += children
                node[3] += leaves
                node[4] += saved
                node[5] = sha or node[5]
        above: dict[bytes, list] = {}
        for key, (n, first, children, leaves, saved, sha, keys, sizes) in level.items():
            leaves = leaves if children else 1
            saved += (n - 1) * (sizes[depth - 1] if depth else 0)
            parent = None if depth == 0 else keys[depth - 2] if depth > 1 else ROOT
            done.append((depth, key, parent, first, n, children, leaves, saved, sha or _EMPTY_SHA, keys, sizes))
            firsts[key] = first
            if depth > top:
                node = above.get(parent)
                if node is None:
                    above[parent] = [n, first, 1, leaves, saved, None, keys, sizes]
                else:
                    node[0] += n
                    node[1] = min(node[1], first)
                    node[2] += 1
                    node[3] += leaves
                    node[4] += saved
        level = above
    for depth, key, parent, first, n, children, leaves, saved, sha, keys, sizes in done:
        survives = depth == top and depth > 0
        yield (
            depth, key, parent, first, firsts.get(parent) if depth > top else None, n, children, leaves, saved, sha,
            keys[: depth - 1] if survives else None, sizes[: depth - 1] if survives else None,
        )


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        group, held = None, []
        for g, *row in _rows(batches):
            if g != group and held:
                yield from _peel_group(held)
                held = []
            group = g
            held.append(tuple(row))
        if held:
            yield from _peel_group(held)

    yield from _batches(rows(), NODE)


def _with_top(items: DataFrame, most: int) -> DataFrame | None:
    """Items with the number of their heavy prefixes, `top`; None while no prefix is heavy.

    The root is a prefix of all items and needs no join. Heavy prefixes are at most a `most`-th of all prefixes.
    """
    if items.count() <= most:
        return None
    prefixes = items.select(F.col("key").alias("end"), F.explode("keys").alias("key"))
    heavy = prefixes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("key")
    held = join_spread(prefixes, heavy, "key", "end", "inner").groupBy(F.col("end").alias("key")).agg((1 + F.count(F.lit(1))).alias("top"))
    return items.join(held, "key", "left").withColumn("top", F.coalesce("top", F.lit(1).cast("bigint")))


def _next_items(nodes: DataFrame, heavy_ends: DataFrame) -> DataFrame:
    """Finished subtrees below heavy nodes, and items that end at them, summed to one item per heavy node."""
    survivors = nodes.filter("keys IS NOT NULL").select(
        F.col("parent").alias("key"), "keys", "sizes", F.col("n_convs").alias("n"), F.col("conv_id").alias("first"),
        F.lit(1).cast("bigint").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"),
        F.lit(None).cast("string").alias("sha"),
    )
    both = survivors.unionByName(heavy_ends.drop("top"))
    summed = both.groupBy("key").agg(
        F.first(F.struct("keys", "sizes")).alias("path"), F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("sha").alias("sha"),
    )
    return summed.select("key", "path.keys", "path.sizes", "n", "first", "children", "leaves", "saved", "sha")


def prefix_trie(sequences: DataFrame, most: int | None = None) -> DataFrame:
    """One row per node of the trie of turn sequences.

    `sequences`: conv_id (unique, not null) and turns as given by `turn_lists`; a conversation without turns is
    a member of the root alone, and other columns are ignored. Columns: depth, key and parent (hashes of the
    prefixes; the root's parent is null), conv_id (smallest member), parent_conv_id (the parent's), n_convs
    (members), n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, members
    beyond the first times the size of the last turn), ends_sha256 (hash of the ascending ids of the members
    that end here). Conversations that repeat are folded; ties in depth need no order. No conversations, no rows.
    """
    most = most or LARGEST_GROUP
    items = cut(_fold_equal(_paths(sequences)))
    rounds: list[DataFrame] = []
    while True:
        topped = _with_top(items, most)
        marked = items.withColumn("top", F.lit(0).cast("bigint")) if topped is None else cut(topped)
        group = F.when(F.col("top") == 0, F.lit(ROOT)).otherwise(F.get("keys", (F.col("top") - 1).cast("int")))
        below = marked.filter(F.size("keys") >= F.col("top")).withColumn("group", group)
        spread = below.select("group", *marked.columns).repartition("group").sortWithinPartitions("group")
        nodes = cut(spread.mapInArrow(_peel, NODE))
        rounds.append(nodes)
        if topped is None:
            break
        items = cut(_next_items(nodes, marked.filter(F.size("keys") < F.col("top"))))
    found = reduce(DataFrame.unionByName, rounds).drop("keys", "sizes")
    if len(rounds) == 1:
        return found
    heavy = reduce(DataFrame.unionByName, rounds[1:]).select(F.col("key").alias("parent"), F.col("conv_id").alias("_above"))
    joined = join_spread(found, heavy, "parent", "key", "left")
    return joined.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above")).drop("_above")
