"""Alignment of two tokenizers on the same bytes, as an Arrow pipeline.

Tokens of a batch of documents are flat Arrow columns with the row of their document as parent index. Byte
ends are segmented cumulative sums of token lengths; an Acero join of (document, end) finds the ends that
both tokenizers share, and these cut the tokens into groups. A join of distinct ids by group gives the linked
id pairs, grouped by document with the number of occurrences. Each task adds up in how many of its documents
a pair occurs (`Table.group_by`), Spark merges the sums, and the counts come back to the documents' pairs by
a join: frequent pairs by a broadcast of measured size, the rest by shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasemill.llm.texts import BROADCAST_BYTES, as_bytes, cut, unused

TOKENIZERS = "/opt/tokenizers"
BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 1 << 20  # text bytes handled together; a longer text is a chunk of its own
PAIRS_AT_ONCE = 2_000_000  # id pairs that one join may give before they are grouped
COUNTED_PAIRS = 1_000_000  # distinct pairs that a task counts before it hands them on
PAIR_BYTES = 48  # a counted pair in a broadcast hash table, at most

# fixed value: the split pattern of byte-level BPE vocabularies of this kind
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

FACTS = {
    "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int64()), "docs": pa.list_(pa.int64()),
}
RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, the others
    follow from U+0100 on in the order of their bytes."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in seen}
    for n, b in enumerate(sorted(set(range(256)) - set(seen))):
        table[chr(256 + n)] = b
    return table


class ByteTokenizer:
    """Byte-level BPE from a tokenizer JSON file.

    Where the merges stand in the order of their ids, ranks alone define the encoding, and the rank encoder is
    used (about four times faster); any other vocabulary takes the encoder of the JSON format itself.
    """

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        alphabet = _byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes = [b""] * (max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        for t in spec["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        pre = spec["pre_tokenizer"] or {}
        by_rank = (
            made == sorted(set(made)) and set(made).isdisjoint(vocabulary[c] for c in alphabet) and len(made) + 256 == len(vocabulary)
            and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        )
        if by_rank:
            import tiktoken

            ranks = {self.bytes[i]: i for i in vocabulary.values()}
            encoder = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.encode = encoder.encode_ordinary
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_str(data.decode())
            slow.encode_special_tokens = True
            self.encode = lambda text: slow.encode(text, add_special_tokens=False).ids


class PieceTokenizer:
    """A piece model with byte fallback; U+2581 stands for a space."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = [
            bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("\u2581", " ").encode()
            for i in range(model.get_piece_size())
        ]
        self.encode = lambda text: model.encode(text, num_threads=1)


@dataclass
class _Side:
    """Tokens of a chunk of documents: ids, the row of their document, byte ends within it."""

    ids: pa.Array
    doc: pa.Array
    end: pa.Array
    per_doc: np.ndarray


def _lay_out(encoded: list[list[int]], widths: pa.Array) -> _Side:
    nested = pa.array(encoded, pa.list_(pa.int32()))
    ids, doc = pc.list_flatten(nested), pc.list_parent_indices(nested).cast(pa.int64())
    total = pc.cumulative_sum(pc.take(widths, ids))  # over all documents, then minus what lies before each
    per_doc = pc.list_value_length(nested).to_numpy(zero_copy_only=False).astype(np.int64)
    last = np.cumsum(per_doc)
    before = np.concatenate([[0], total.to_numpy()])[last - per_doc] if len(per_doc) else np.zeros(0, np.int64)
    return _Side(ids, doc, pc.subtract(total, pc.take(pa.array(before, pa.int64()), doc)), per_doc)


def _same_bytes(side: _Side, spelled: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Documents whose joined token bytes equal their text."""
    flat = pc.take(spelled, side.ids)
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = memoryview(flat.buffers()[2] or b"").cast("B")
    last = np.cumsum(side.per_doc)
    at = zip(offsets[last - side.per_doc].tolist(), offsets[last].tolist(), texts)
    return np.fromiter((data[a:b] == text for a, b, text in at), bool, len(texts))


def _select(side: _Side, keep: np.ndarray) -> _Side:
    mask = pc.take(pa.array(keep), side.doc)
    return _Side(side.ids.filter(mask), side.doc.filter(mask), side.end.filter(mask), np.where(keep, side.per_doc, 0))


def _groups(a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token, numbered through the chunk: it ends where both sides end."""
    def ends(side: _Side, name: str) -> pa.Table:
        return pa.table({"doc": side.doc, "end": side.end, name: pa.array(np.arange(len(side.ids)))})

    both = ends(a, "a").join(ends(b, "b"), ["doc", "end"], join_type="inner", use_threads=False)
    out = []
    for side, name in ((a, "a"), (b, "b")):
        closes = np.zeros(len(side.ids), np.int64)
        closes[both[name].to_numpy()] = 1
        out.append(np.cumsum(closes) - closes)
    return out[0], out[1]


def _group_strings(a: _Side, b: _Side, in_a: np.ndarray, in_b: np.ndarray) -> list[str]:
    """Hash of `a1,a2|b1;a3|b2,b3` per document; empty without tokens.

    Ids and separators are joined element by element; a document is a slice of the data of that column.
    """
    def followed(groups: np.ndarray, doc: np.ndarray, last: str) -> np.ndarray:
        code = np.zeros(len(groups), np.int8)  # a comma follows
        at_end = np.ones(len(groups), bool)
        at_end[:-1] = groups[1:] != groups[:-1]
        code[at_end] = 1
        if last == ";":
            of_doc = np.ones(len(groups), bool)
            of_doc[:-1] = doc[1:] != doc[:-1]
            code[of_doc] = 2
        return code

    doc_a, doc_b = a.doc.to_numpy(), b.doc.to_numpy()
    codes = np.concatenate([followed(in_a, doc_a, "|"), followed(in_b, doc_b, ";") + 3])
    order = np.argsort(np.concatenate([2 * in_a, 2 * in_b + 1]), kind="stable")
    ids = pc.take(pa.concat_arrays([a.ids, b.ids]), pa.array(order))
    between = pc.take(pa.array([",", "|", "", ",", ";", ""], pa.large_string()), pa.array(codes[order]))
    flat = pc.binary_join_element_wise(ids.cast(pa.large_string()), between, pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1]
    data = memoryview(flat.buffers()[2]) if len(flat) else memoryview(b"")
    per_doc = a.per_doc + b.per_doc
    last = np.cumsum(per_doc)
    return [
        hashlib.sha256(data[x:y]).hexdigest() if y > x else ""
        for x, y in zip(offsets[last - per_doc].tolist(), offsets[last].tolist())
    ]


def _pairs(a: _Side, b: _Side, in_a: np.ndarray, in_b: np.ndarray) -> pa.Table:
    """Linked id pairs of each document and how often they occur: doc, pair (a << 32 | b), times.

    Ids that repeat in a group are folded first; a group joins with itself alone, in slices of bounded output.
    """
    def folded(side: _Side, group: np.ndarray, name: str) -> pa.Table:
        rows = pa.table({"group": group, "doc": side.doc, name: side.ids.cast(pa.int64())})
        return rows.group_by(["group", "doc", name], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", "doc", name, f"n_{name}"])

    left, right = folded(a, in_a, "a"), folded(b, in_b, "b").drop_columns("doc")
    partners = np.bincount(right["group"].to_numpy(), minlength=int(in_a.max()) + 1 if len(in_a) else 0)
    made = np.cumsum(partners[left["group"].to_numpy()])
    cuts = np.searchsorted(made, np.arange(PAIRS_AT_ONCE, int(made[-1]) if len(made) else 0, PAIRS_AT_ONCE), side="left") + 1
    bounds = np.unique(np.concatenate([[0], cuts, [len(left)]]))
    parts = []
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        some = left.slice(x, y - x).join(right, "group", join_type="inner", use_threads=False)
        pair = pc.bit_wise_or(pc.shift_left(some["a"], 32), some["b"])
        found = pa.table({"doc": some["doc"], "pair": pair, "times": pc.multiply(some["n_a"], some["n_b"])})
        parts.append(_add_up(found, ["doc", "pair"], "times"))
    if not parts:
        return pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
    return parts[0] if len(parts) == 1 else _add_up(pa.concat_tables(parts), ["doc", "pair"], "times")


def _add_up(rows: pa.Table, keys: list[str], value: str) -> pa.Table:
    return rows.group_by(keys, use_threads=False).aggregate([(value, "sum")]).rename_columns([*keys, value])


def _per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> pa.ListArray:
    starts = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(values, pa.int64()))


class _Aligner:
    def __init__(self, byte_model: bytes, piece_model: bytes) -> None:
        self.a, self.b = ByteTokenizer(byte_model), PieceTokenizer(piece_model)
        self.spelled = [pa.array(t.bytes, pa.large_binary()) for t in (self.a, self.b)]
        self.widths = [pc.binary_length(s).cast(pa.int64()) for s in self.spelled]

    def align(self, texts: list[bytes | None]) -> tuple[list[pa.Array], pa.Table]:
        """The columns of FACTS and the pairs of a chunk of documents."""
        plain = [text.decode() if text else None for text in texts]
        a = _lay_out([self.a.encode(" " + t) if t else [] for t in plain], self.widths[0])
        b = _lay_out([self.b.encode(t) if t else [] for t in plain], self.widths[1])
        want = [b" " + text if text else b"" for text in texts]
        keep = _same_bytes(a, self.spelled[0], want) & _same_bytes(b, self.spelled[1], want)
        if not keep.all():
            a, b = _select(a, keep), _select(b, keep)
        in_a, in_b = _groups(a, b)
        n = len(texts)
        n_groups = int(in_a[-1]) + 1 if len(in_a) else 0
        size_a, size_b = np.bincount(in_a, minlength=n_groups), np.bincount(in_b, minlength=n_groups)
        of_group = np.zeros(n_groups, np.int64)
        of_group[in_a] = a.doc.to_numpy()
        links = np.zeros(n, np.int64)
        np.add.at(links, of_group, size_a * size_b)
        pairs = _pairs(a, b, in_a, in_b).sort_by([("doc", "ascending"), ("pair", "ascending")])
        doc = pairs["doc"].to_numpy()
        facts = [
            pa.array(a.per_doc), pa.array(b.per_doc), pa.array(np.bincount(of_group, minlength=n).astype(np.int64)), pa.array(links),
            pa.array(_group_strings(a, b, in_a, in_b), pa.string()), _per_doc(pairs["pair"].to_numpy(), doc, n),
            _per_doc(pairs["times"].to_numpy(), doc, n), pa.nulls(n, pa.list_(pa.int64())),
        ]
        return facts, pairs


def _count_row(counted: pa.Table, own: pa.Schema) -> pa.RecordBatch:
    """Partial counts as one row without a document."""
    lists = {
        name: pa.ListArray.from_arrays(pa.array([0, len(counted)], pa.int32()), counted[column].combine_chunks())
        for name, column in (("pairs", "pair"), ("docs", "docs"))
    }
    facts = [lists.get(name, pa.nulls(1, kind)) for name, kind in FACTS.items()]
    return pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in own), *facts], [*own.names, *FACTS])


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or b"")
        if held >= CHUNK_BYTES:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _encode_all(docs: DataFrame, folder: str) -> DataFrame:
    """The columns before the last one, `text`, with the facts and pairs of every text; and rows of partial
    document counts of pairs, in which all other columns are null.

    The two vocabularies, a few MB, are read by the driver and go along with the tasks.
    """
    models = []
    for name in (BYTE_VOCABULARY, PIECE_VOCABULARY):
        with open(f"{folder.rstrip('/')}/{name}", "rb") as f:
            models.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(models))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        aligner = _Aligner(*shared.value)
        counted: list[pa.Table] = []
        for batch in batches:
            own = pa.schema([f for f in batch.schema][:-1])
            texts = as_bytes(batch[batch.num_columns - 1])
            for x, y in _chunks(texts):
                facts, pairs = aligner.align(texts[x:y])
                yield pa.RecordBatch.from_arrays([*batch.slice(x, y - x).columns[:-1], *facts], [*own.names, *FACTS])
                ones = pairs.select(["pair"]).group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "docs"])
                counted.append(ones)
                if sum(map(len, counted)) > COUNTED_PAIRS:
                    counted = [_add_up(pa.concat_tables(counted), ["pair"], "docs")]
                    if len(counted[0]) > COUNTED_PAIRS // 2:
                        yield _count_row(counted[0], own)
                        counted = []
        if counted:
            yield _count_row(_add_up(pa.concat_tables(counted), ["pair"], "docs"), own)

    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType()}
    facts = [T.StructField(name, kinds.get(kind, T.ArrayType(T.LongType()))) for name, kind in FACTS.items()]
    own = [T.StructField(f.name, f.dataType) for f in docs.schema.fields[:-1]]
    return docs.mapInArrow(encode, T.StructType([*own, *facts]))


def _pair_counts(partial: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best (the count is the highest of its A id)."""
    parts = partial.select(F.inline(F.arrays_zip("pairs", "docs"))).toDF("pair", "docs")
    counts = cut(parts.groupBy("pair").agg(F.sum("docs").alias("count")))
    a = F.shiftright("pair", 32)
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))  # at most a row per id of vocabulary A
    joined = counts.withColumn("a", a).join(F.broadcast(highest), "a")
    return joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _link_sums(found: DataFrame, counts: DataFrame, budget: int) -> DataFrame:
    """n_best and count_sum per row.

    Pairs are taken by falling count, in powers of two, while their hash table fits the budget; these are
    broadcast. A pair outside has fewer documents than the broadcast ones on average, hence a vanishing share
    of all rows: these are joined by shuffle. Neither join has a hot key.
    """
    links = found.select("row", F.inline(F.arrays_zip("pairs", "times"))).toDF("row", "pair", "times")
    steps = counts.groupBy(F.floor(F.log2("count")).alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    room, least = budget // PAIR_BYTES, None
    for step, n in steps:
        room -= n
        if room < 0:
            break
        least = 1 << step
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    if steps and least is not None and room >= 0:
        return links.join(F.broadcast(counts), "pair").groupBy("row").agg(*sums)
    often = counts.filter(F.col("count") >= (least or 1 << 62))
    met = links.join(F.broadcast(often), "pair", "left")
    known = met.filter("count IS NOT NULL").groupBy("row").agg(*sums)
    rare = met.filter("count IS NULL").select("row", "pair", "times").join(counts.filter(F.col("count") < (least or 1 << 62)), "pair").groupBy("row").agg(*sums)
    return known.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, folder: str = TOKENIZERS, budget: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Align a byte-level and a piece tokenizer on every text.

    Returns the documents (without `text`; other columns stay, but columns named like a result, in any case, go)
    with n_a and n_b tokens, n_groups, n_links, n_best, count_sum and groups_sha256, and the table of linked id
    pairs: a, b, count, best. Texts that are null, empty or not spelled alike by both have zeros and an empty
    groups_sha256. Every row is a document of its own, also where rows repeat. A text is one row and has to fit a
    task with about 100 bytes a token. Empty tables give empty tables.
    """
    names = {*FACTS, *RESULTS, "text"}
    kept = [c for c in docs.columns if c.lower() not in names]
    row = unused(docs, "_row")
    numbered = docs.select(F.monotonically_increasing_id().alias(row), *kept, "text")
    encoded = cut(_encode_all(numbered, folder))  # written, so that numbers stay with their rows
    counts = cut(_pair_counts(encoded.filter(F.col(row).isNull())))
    found = encoded.filter(F.col(row).isNotNull())
    sums = _link_sums(found.select(F.col(row).alias("row"), "pairs", "times"), counts, budget).withColumnRenamed("row", row)
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_best", "count_sum")}
    out = found.drop("pairs", "times", "docs").join(sums, row, "left").withColumns(zero).select(*kept, *RESULTS)
    pairs = counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "count", "best")
    return out, pairs
