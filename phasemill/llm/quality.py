"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-Proximal.

Training rows are a bounded sample, dealt over a few tasks; each runs the per-coordinate updates over its
own rows and the models are averaged. Scoring is a sparse dot product per text, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.llm.texts import CACHED_WORDS, as_bytes, mix, plain_words, put_columns, with_fields, word_chunks

BITS = 18
SAMPLE = 20_000  # distinct labelled texts a model is fitted on, about, at most
SHARDS = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.005, 0.0

_SHAPE = bytes(
    88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256)
)


class WordCodes(dict):
    """Hash of a word and of its shape (runs of capitals, small letters and digits as one character each)."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        raw = word.translate(_SHAPE)
        shape = bytes(b for i, b in enumerate(raw) if i == 0 or b != raw[i - 1])
        code = self[word] = (xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(shape, seed=1))
        return code


def features(words: list[bytes], starts: np.ndarray, codes: WordCodes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sparse unit vectors (indices, values) of each document of a chunk; index 0 is the constant."""
    both = np.array([codes[w] for w in words], np.uint64).reshape(-1, 2)
    word, shape = both[:, 0], both[:, 1]
    two = mix(mix(word[:-1]) + word[1:])
    two = np.where(word[:-1] == word[1:], np.uint64(7), two)  # a word said twice is one feature whatever the word
    shapes = mix(mix(shape[:-1]) + shape[1:] + np.uint64(1))
    shift = np.uint64(64 - BITS)
    one, two, shapes = ((mix(x + np.uint64(k)) >> shift).astype(np.int64) for k, x in enumerate((word, two, shapes)))
    for s, e in zip(starts[:-1], starts[1:]):
        at, n = np.unique(np.concatenate([one[s:e], two[s : max(e - 1, s)], shapes[s : max(e - 1, s)]]), return_counts=True)
        value = 1 + np.log(n)
        value = value / max(np.sqrt((value * value).sum()), 1e-12)
        yield np.append(at, 0), np.append(value, 1.0)


def _ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    order = np.arange(len(rows))
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(order):
            at, x = rows[i]
            w = _ftrl_weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y[i]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return _ftrl_weights(z, n)


@dataclass
class Model:
    weights: np.ndarray


def sample_share(rows: DataFrame, most: int) -> float:
    """The share of the rows that makes about `most` of them at most."""
    total = rows.count()
    return min(1.0, most / total) if total else 1.0


def in_share(share: float, *keys: str) -> Column:
    """The same rows each time, chosen by a hash of the keys."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(int(share * (1 << 63)))


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """About `most` distinct rows at most, the same ones each time: copies of a row count once."""
    share = sample_share(rows.select(F.xxhash64(*rows.columns).alias("o")).distinct(), most)
    return rows.filter(in_share(share, *rows.columns)).distinct()


def fit(rows: DataFrame, text: str = "text", label: str = "label", sample: int = SAMPLE, shards: int = SHARDS) -> Model:
    """Learns P(label = 1); rows without label are left out. Without rows the model is constant at 1/2."""
    known = rows.select(F.coalesce(text, F.lit("")).alias("text"), F.col(label).cast("double").alias("y")).filter("y IS NOT NULL")
    dealt = bounded_sample(known, sample).withColumn("shard", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(shards)))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["text", "y"])
        codes, built = WordCodes(), []
        for _, words, starts in word_chunks([t.encode() for t in pdf["text"]], plain_words):
            built += features(words, starts, codes)
        w = _train(built, pdf["y"].to_numpy())
        at = np.flatnonzero(w)
        return pd.DataFrame({"rows": [len(pdf)], "at": [at.astype(np.int32)], "w": [w[at]]})

    got = dealt.groupBy("shard").applyInPandas(train, "rows bigint, at array<int>, w array<double>").collect()
    weights, total = np.zeros(1 << BITS), sum(r["rows"] for r in got)
    for r in got:  # one sparse model per shard
        weights[r["at"]] += np.array(r["w"]) * r["rows"] / total
    return Model(weights.astype(np.float32))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """`docs` with `score` (P(label = 1)) and `predicted` (1 from `threshold` on).

    Null and empty texts have the constant feature only and get the score of an empty text. Result columns
    replace input columns of the same name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)  # 2^BITS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, codes = shared.value, WordCodes()
        for batch in batches:
            raw, logit = as_bytes(batch.column(text)), []
            for _, words, starts in word_chunks(raw, plain_words):
                logit += [w[at] @ x for at, x in features(words, starts, codes)]
            p = 1 / (1 + np.exp(-np.clip(np.array(logit, float), -35, 35)))
            yield put_columns(batch, score=pa.array(p), predicted=pa.array((p >= threshold).astype(np.int32)))

    return docs.mapInArrow(run, with_fields(docs, score="double", predicted="int"))
