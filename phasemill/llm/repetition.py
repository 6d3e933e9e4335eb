"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Word hashes of a chunk of documents lie in one array; windows of 5 to 10 words are hashed by rolling one
word further, and a window can be duplicated only where the shorter one was, so the longer lengths look at
the remains of the shorter ones. Everything stays inside the document: no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from phasemill.llm.texts import WordHashes, as_bytes, mix, plain_words, put_columns, with_fields, word_chunks

SYMBOLS = b"#*$%&|<>"
# largest share of word characters inside duplicated n-grams (all occurrences count), by n
NGRAM_LIMITS = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
LINE_LIMIT = 0.20  # largest share of word characters in lines that repeat an earlier line
LEAST_WORDS = 10
REPEAT_PERCENT = 20

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def duplicated(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Marks the words inside windows of `width` words from `starts`."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


def ngram_cover(words: np.ndarray, starts: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each n-gram length, ascending: the words inside n-grams that their document has twice or more."""
    doc = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    end = np.repeat(starts[1:], np.diff(starts))
    at = np.arange(len(words))
    rolled, reach = mix(words + mix(doc)), 1  # the document is part of the hash
    for n in lengths:
        inside = at + n <= end[at]
        at, rolled = at[inside], rolled[inside]
        for k in range(reach, n):
            rolled = mix(rolled + words[at + k])
        twice = duplicated(rolled)
        at, rolled, reach = at[twice], rolled[twice], n
        yield n, covered(at, n, len(words))


def _line_counts(text: bytes | None) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and their word characters."""
    seen, n, chars = set(), 0, 0
    for line in (text or b"").split(b"\n"):
        words = line.split()
        if not words:
            continue
        if line in seen:
            n += 1
            chars += len(b"".join(words).decode("utf-8", "replace"))
        seen.add(line)
    return n, chars


COUNTS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint"}


def repetition(
    docs: DataFrame, text: str = "text", limits: Mapping[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT,
) -> DataFrame:
    """`docs` with word, symbol and repetition counts and the verdict `kept`.

    `cover` maps an n-gram length to the share of word characters inside n-grams that occur twice or more;
    `line_cover` is the share in repeated lines. A document is kept if it does not fail the base rule
    (`base_failed`: under 10 words, or over 20 % of the words in repeated windows of 5) and every share is
    within its limit. Null and empty texts have no words, so they fail. Result columns replace input
    columns of the same name.
    """
    lengths = sorted({5, *limits})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            raw = as_bytes(batch.column(text))
            out: dict[str, list] = {c: [] for c in COUNTS}
            covers: list[np.ndarray] = []
            line_cover = []
            for first, words, starts in word_chunks(raw, plain_words):
                rows = len(starts) - 1
                n_words = np.diff(starts)
                joined = np.frombuffer(b"".join(words), np.uint8)
                begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
                chars = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])[begin]  # code points up to each word
                symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[joined])])[begin[starts]]
                size = np.diff(chars)
                total = chars[starts[1:]] - chars[starts[:-1]]
                shares = np.zeros((rows, len(limits)))
                sum_by_doc = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
                at = 0
                for n, inside in ngram_cover(hashes.of(words), starts, lengths):
                    if n == 5:
                        repeat = sum_by_doc(inside)
                    if n in limits:
                        shares[:, at] = sum_by_doc(inside * size) / np.maximum(total, 1)
                        at += 1
                lines = [_line_counts(t) for t in raw[first : first + rows]]
                out["n_words"].append(n_words)
                out["word_chars"].append(total)
                out["n_symbols"].append(np.diff(symbols))
                out["n_dup_lines"].append(np.array([n for n, _ in lines], np.int64))
                out["n_repeat_words"].append(repeat)
                covers.append(shares)
                line_cover.append(np.array([c for _, c in lines]) / np.maximum(total, 1))
            if not covers:
                continue
            got = {c: np.concatenate(x).astype(np.int64) for c, x in out.items()}
            share, by_line = np.concatenate(covers), np.concatenate(line_cover)
            failed = (got["n_words"] < LEAST_WORDS) | (100 * got["n_repeat_words"] > REPEAT_PERCENT * got["n_words"])
            most = np.array([limits[n] for n in sorted(limits)])
            kept = ~failed & (share <= most).all(axis=1) & (by_line <= line_limit)
            n_of = np.tile(np.array(sorted(limits), np.int32), len(share))
            cover = pa.MapArray.from_arrays(
                pa.array(np.arange(len(share) + 1) * len(limits), pa.int32()), pa.array(n_of), pa.array(share.ravel())
            )
            yield put_columns(
                batch, **{c: pa.array(x) for c, x in got.items()}, cover=cover, line_cover=pa.array(by_line),
                base_failed=pa.array(failed), kept=pa.array(kept),
            )

    kinds = {**COUNTS, "cover": "map<int,double>", "line_cover": "double", "base_failed": "boolean", "kept": "boolean"}
    return docs.mapInArrow(measure, with_fields(docs, **kinds))
