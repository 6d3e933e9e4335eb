"""Benchmark decontamination over a distributed positional inverted index of the training texts.

The index is document-partitioned: a segment holds the postings of some consecutive documents, at most
about `SEGMENT_WORDS` words (a longer document is a segment of its own), one row per term with its
positions in the segment. Building it needs no shuffle. A search sends only the postings of test terms and,
for every test phrase, the segments that hold its rarest term, to the segment's task; there the
offset-adjusted lists are intersected from the rarest term on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm.texts import alnum_words, as_bytes, cut, lists, unused

SEGMENT_WORDS = 1_000_000
GAP = 64  # free positions between documents, so that no phrase or proximity match spans two of them

INDEX = (
    "segment bigint, term binary, n bigint, at array<int>, ids array<bigint>, keys array<bigint>, lengths array<int>"
)


def build_index(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """Index rows of `docs` (doc_id, text_key, text).

    A row with a term has its `n` ascending positions `at`. A row without one is the segment's directory:
    for every document its id, key, number of words and first position. Null texts have no words.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        ids, keys, lengths, parts, number = [], [], [], [], {}
        n_words = 0

        def flush() -> pa.RecordBatch:
            length = np.array(lengths, np.int64)
            base = np.concatenate([[0], np.cumsum(length + gap)])[:-1]
            codes = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            within = np.arange(len(codes)) - np.repeat(np.concatenate([[0], np.cumsum(length)])[:-1], length)
            at = (np.repeat(base, length) + within).astype(np.int32)
            order = np.argsort(codes, kind="stable")
            counts = np.bincount(codes, minlength=len(number))
            terms = len(number)
            none = np.zeros(terms + 1, np.int64)
            one = lambda x, kind: lists(np.array(x), np.concatenate([none, [len(x)]]), kind)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(terms + 1, segment)), pa.array([*number, None], pa.binary()),
                    pa.array(np.append(counts, len(ids))),
                    lists(
                        np.concatenate([at[order], base.astype(np.int32)]),
                        np.concatenate([[0], np.cumsum(np.append(counts, len(base)))]), pa.int32(),
                    ),
                    pa.ListArray.from_arrays(pa.array(np.append(none, len(ids)), pa.int32()), pa.array(ids, pa.int64())),
                    one(keys, pa.int64()), one(lengths, pa.int32()),
                ],
                ["segment", "term", "n", "at", "ids", "keys", "lengths"],
            )

        for batch in batches:
            for doc, key, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), as_bytes(batch[2])):
                words = alnum_words(text)
                if ids and n_words + len(words) + gap > SEGMENT_WORDS:
                    yield flush()
                    segment += 1
                    ids, keys, lengths, parts, number = [], [], [], [], {}
                    n_words = 0
                code = number.setdefault
                parts.append(np.fromiter((code(w, len(number)) for w in words), np.int32, len(words)))
                ids.append(doc)
                keys.append(key)
                lengths.append(len(words))
                n_words += len(words) + gap
        if ids:
            yield flush()

    return docs.mapInArrow(build, INDEX)


def phrases(items: DataFrame, width: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of `width` words: (phrase, terms array<binary>, items array<string>).

    An item of fewer words, but not none, is one window. `items` lists the ids that have the window; rows
    without id have windows but are not listed.
    """

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, terms = [], []
            for item, text_ in zip(batch[0].to_pylist(), as_bytes(batch[1])):
                words = alnum_words(text_)
                for i in range(max(len(words) - width + 1, min(len(words), 1))):
                    own.append(item)
                    terms.append(words[i : i + width])
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.string()), pa.array(terms, pa.list_(pa.binary()))], ["item", "terms"]
            )

    windows = items.select(F.col(item_id).cast("string"), F.col(text)).mapInArrow(cut_windows, "item string, terms array<binary>")
    return windows.groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn(
        "phrase", F.sha2(F.concat_ws(" ", F.transform("terms", lambda t: t.cast("string"))), 256)
    )


def _positions(groups: pd.DataFrame) -> tuple[dict[bytes, np.ndarray], pd.Series]:
    named = groups["term"].notna()
    return dict(zip(groups.loc[named, "term"], groups.loc[named, "at"])), groups[~named].iloc[0]


def _exact(lists_of: dict[bytes, np.ndarray], terms: list[bytes]) -> np.ndarray:
    """Start positions of the phrase: offset-adjusted lists intersected from the rarest term on."""
    order = sorted(range(len(terms)), key=lambda i: len(lists_of.get(terms[i], ())))
    found = None
    for i in order:
        at = lists_of.get(terms[i])
        if at is None:
            return np.zeros(0, np.int64)
        if found is None:
            found = at - i
        else:
            where = np.searchsorted(at, found + i)
            where[where == len(at)] = 0
            found = found[at[where] == found + i]
        if len(found) == 0:
            break
    return found[found >= 0]


def _near(lists_of: dict[bytes, np.ndarray], terms: list[bytes], reach: int) -> np.ndarray:
    """Positions of any of the terms that have every other term at most `reach` words away."""
    distinct = sorted(set(terms), key=lambda t: len(lists_of.get(t, ())))
    if any(t not in lists_of for t in distinct):
        return np.zeros(0, np.int64)
    parts = []
    for own in distinct:
        found = lists_of[own]
        for t in distinct:
            if t == own:
                continue
            at = lists_of[t]
            found = found[np.searchsorted(at, found - reach) < np.searchsorted(at, found + reach, side="right")]
            if len(found) == 0:
                break
        parts.append(found)
    return np.sort(np.concatenate(parts))


def search(index: DataFrame, queries: DataFrame, reach: int | None = None, gap: int = GAP) -> DataFrame:
    """Matches of `queries` (phrase, terms, items) per document of a written index that has any.

    Returns (segment, slot, n_hit, items, spans): the document's place in the segment, the number of its
    words inside exact matches, the sorted ids of the matching items, and a row (phrase, start, end) per
    match. With `reach` a match is a word of the phrase that has all other terms of the phrase within that many
    words instead; it depends on the document alone. A `reach` above the index's `gap` would span documents and
    is refused.
    """
    if reach is not None and not 0 <= reach <= gap:
        raise ValueError(f"reach {reach} is not within 0 and the index's gap of {gap}")
    queries = cut(queries)
    terms = queries.select("phrase", F.explode(F.array_distinct("terms")).alias("term"))
    wanted = cut(terms.select("term").distinct())  # from its files the planner knows the size
    postings = index.filter("term IS NOT NULL").join(wanted, "term", "left_semi")
    tally = postings.groupBy("term").agg(F.sum("n").alias("total"))
    rank = F.struct(F.coalesce("total", F.lit(0)).alias("total"), "term")
    rarest = terms.join(tally, "term", "left").groupBy("phrase").agg(F.min(rank).alias("r"))
    keyed = queries.join(rarest.filter("r.total > 0").select("phrase", F.col("r.term").alias("term")), "phrase")
    visits = cut(postings.select("segment", "term").join(keyed, "term").select("segment", "phrase", "terms", "items"))
    held = postings.select("segment", "term", "at", "lengths", "ids").unionByName(
        index.filter("term IS NULL").select("segment", "term", "at", "lengths", "ids")
    )

    def intersect(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"segment": [], "slot": [], "n_hit": [], "items": [], "spans": []}
        if len(left) and len(right):
            lists_of, directory = _positions(left)
            base, length = directory["at"].astype(np.int64), directory["lengths"].astype(np.int64)
            lists_of = {t: p.astype(np.int64) for t, p in lists_of.items()}
            by_slot: dict[int, list[tuple[int, int, int]]] = {}
            for q, words in enumerate(right["terms"]):
                words = list(words)
                if reach is None:
                    start = _exact(lists_of, words)
                    end = start + len(words)
                else:
                    start = _near(lists_of, words, reach)
                    end = start + 1
                for s, e in zip(start.tolist(), end.tolist()):
                    slot = int(np.searchsorted(base, s, side="right")) - 1
                    # empty documents share no position with others, so the last base at or below s is the place
                    by_slot.setdefault(slot, []).append((s, e, q))
            for slot, spans in by_slot.items():
                hit = np.zeros(int(length[slot]) + 1, np.int64)
                first = int(base[slot])
                for s, e, _ in spans:
                    hit[s - first] += 1
                    hit[e - first] -= 1
                out["segment"].append(int(left["segment"].iloc[0]))
                out["slot"].append(slot)
                out["n_hit"].append(int((np.cumsum(hit) > 0).sum()))
                out["items"].append(sorted({i for *_, q in spans for i in right["items"].iloc[q]}))
                out["spans"].append([(right["phrase"].iloc[q], s - first, e - first) for s, e, q in sorted(spans)])
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()})

    return held.groupBy("segment").cogroup(visits.groupBy("segment")).applyInPandas(
        intersect,
        "segment bigint, slot int, n_hit bigint, items array<string>, "
        "spans array<struct<phrase string, start bigint, end bigint>>",
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, width: int = 13, percent: int = 5, doc_id: str = "doc_id",
    text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """`docs` with `n_words`, `n_hit`, `matched_items`, `spans` and `contaminated`.

    A word is hit if it lies in an occurrence of a window of `width` item words; a document is
    contaminated if it has hits and `100 * n_hit >= percent * n_words`. Null and wordless texts have no
    hits. Rows that repeat a doc_id and text get the same result; a null doc_id is an id like any other.
    Result columns replace input columns of the same name.
    """
    source = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")
    )
    index = cut(build_index(source, max(GAP, width)))
    hits = search(index, phrases(items, width, item_id, item_text))
    places = index.filter("term IS NULL").select(
        "segment", F.posexplode(F.arrays_zip("ids", "keys", "lengths")).alias("slot", "d")
    )
    found = places.join(hits, ["segment", "slot"], "left")
    none = F.array().cast("array<string>")
    # repeated rows have equal results; one of them is enough for the join
    name = {c: unused(docs, f"_{c}") for c in ("did", "dkey", "n_words", "n_hit", "items", "spans")}
    by_key = found.groupBy(F.col("d.ids").alias(name["did"]), F.col("d.keys").alias(name["dkey"])).agg(
        F.max("d.lengths").cast("bigint").alias(name["n_words"]), F.coalesce(F.max("n_hit"), F.lit(0)).alias(name["n_hit"]),
        F.coalesce(F.first("items", True), none).alias(name["items"]),
        F.coalesce(F.first("spans", True), F.array().cast(hits.schema["spans"].dataType)).alias(name["spans"]),
    )
    gone = {"n_words", "n_hit", "matched_items", "spans", "contaminated"}
    kept = [c for c in docs.columns if c.lower() not in gone]
    key, own = unused(docs, "_doc_key"), unused(docs, "_doc_id")
    left = docs.select(*kept, F.col(doc_id).cast("bigint").alias(own), F.xxhash64(text).alias(key))
    out = left.join(by_key, left[own].eqNullSafe(by_key[name["did"]]) & (left[key] == by_key[name["dkey"]]), "left")
    n_words, n_hit = F.col(name["n_words"]), F.col(name["n_hit"])
    return out.select(
        *[left[c] for c in kept], n_words.alias("n_words"), n_hit.alias("n_hit"),
        F.col(name["items"]).alias("matched_items"), F.col(name["spans"]).alias("spans"),
        ((n_hit > 0) & (n_hit * 100 >= n_words * percent)).alias("contaminated"),
    )
