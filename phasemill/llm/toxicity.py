"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon of words and word beginnings (log-odds of document frequencies) is learned from the training
rows. The trees see each half of them through the lexicon of the other half, so they do not learn from
words that their own rows have put there, and the calibration uses rows that the trees have not seen. Features need the document alone; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm.quality import bounded_sample
from phasemill.llm.texts import CACHED_WORDS, as_bytes, cut, lower_words, put_columns, unused, with_fields, word_chunks

SAMPLE = 20_000  # labelled rows a model is fitted on, at most
LEXICON = 500  # entries, at most
PREFIX = 5  # characters of a word beginning
LEAST_DOCS = 4  # labelled documents an entry must occur in
ODDS = 8.0  # how much likelier an entry must be in a toxic document
NEAR = 6  # words between a second-person word and a lexicon word that count as near
TREES, DEPTH = 20, 3

# second-person words of the languages at hand, ASCII-lower-cased
SECOND_PERSON = frozenset(
    w.encode() for w in "you your yours yourself du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split()
)
_EDGE = b".,;:!?\"'()[]{}<>-"
# characters that stand in for letters
_PLAIN = bytes.maketrans(b"013457@$!|", b"oieastasil")
_MASK = b"*#_.-+~"

FEATURES = (
    "word_density", "prefix_density", "hidden_density", "distinct_hits", "near_person", "person_density",
    "capitals", "shouted", "punctuation", "exclaims", "obfuscated", "log_words",
)


@dataclass
class Lexicon:
    words: frozenset[bytes] = field(default_factory=frozenset)
    prefixes: frozenset[bytes] = field(default_factory=frozenset)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Any
    calibration: Any
    base: float


class _Flags(dict):
    """What a lower-cased word is: 1 lexicon word, 2 lexicon beginning, 4 lexicon word in disguise,
    8 second person, 16 letters mixed with stand-ins; the word's own number above that if it is a hit."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        bare = word.strip(_EDGE)
        plain = bare.translate(_PLAIN, _MASK)
        mixed = plain != bare and not bare.isdigit() and any(97 <= b <= 122 for b in bare)
        code = (bare in self.lexicon.words) + 2 * (_prefix(bare) in self.lexicon.prefixes)
        code += 4 * (mixed and (plain in self.lexicon.words)) + 8 * (bare in SECOND_PERSON) + 16 * mixed
        self[word] = code
        return code


def _prefix(word: bytes) -> bytes:
    return word.decode("utf-8", "replace")[:PREFIX].encode()


def _words_of(text: bytes | None) -> set[bytes]:
    return {w.strip(_EDGE) for w in lower_words(text)} - {b""}


def learn_lexicons(rows: DataFrame, most: int = LEXICON) -> list[Lexicon]:
    """Words and beginnings that are `ODDS` times likelier in rows (text, y, half) with y = 1, the best first:
    learned from half 0, from half 1, and from both."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, words, ys, halves = [], [], [], []
            labels = zip(batch.column("y").to_pylist(), batch.column("half").to_pylist())
            for text, (y, half) in zip(as_bytes(batch.column("text")), labels):
                own = _words_of(text)
                begin = {_prefix(w) for w in own if len(w) > PREFIX}
                for kind, group in ((0, own), (1, begin)):
                    kinds += [kind] * len(group)
                    words += group
                    ys += [y] * len(group)
                    halves += [half] * len(group)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int8()), pa.array(words, pa.binary()), pa.array(ys, pa.float64()), pa.array(halves, pa.int8())],
                ["kind", "word", "y", "half"],
            )

    made = rows.mapInArrow(entries, "kind tinyint, word binary, y double, half tinyint")
    totals = {r["half"]: (r["n"], r["bad"]) for r in rows.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")).collect()}
    counts = cut(made.groupBy("kind", "word").agg(
        *[F.sum(F.when(F.col("half") == h, x)).alias(f"{name}{h}") for h in (0, 1) for name, x in (("t", F.col("y")), ("c", 1 - F.col("y")))]
    ).na.fill(0.0).filter(F.col("t0") + F.col("t1") + F.col("c0") + F.col("c1") >= LEAST_DOCS))
    out = []
    for halves in ((0,), (1,), (0, 1)):
        n, bad = (sum(totals.get(h, (0, 0.0))[k] for h in halves) for k in (0, 1))
        t, c = (sum((F.col(f"{name}{h}") for h in halves), F.lit(0.0)) for name in "tc")
        odds = ((t + 0.5) / (bad + 1.0)) / ((c + 0.5) / (n - bad + 1.0))
        best = (
            counts.select("kind", "word", t.alias("t"), c.alias("c"), odds.alias("odds"))
            .filter(F.col("t") + F.col("c") >= LEAST_DOCS).filter(F.col("odds") >= ODDS)
            .orderBy(F.log("odds") * F.sqrt("t"), "word", ascending=[False, True]).limit(most).collect()
        )
        out.append(Lexicon(*(frozenset(bytes(r["word"]) for r in best if r["kind"] == k) for k in (0, 1))))
    return out


def measure(docs: DataFrame, lexicon: Lexicon, text: str, name: str) -> DataFrame:
    """Adds the array of `FEATURES` of the whole text; zeros for null and wordless texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _Flags(lexicon)
        for batch in batches:
            raw, rows = as_bytes(batch.column(text)), []
            for first, words, starts in word_chunks(raw, lower_words):
                code = np.fromiter(map(flags.__getitem__, words), np.int64, len(words))
                hit = (code & 5) > 0
                person = np.flatnonzero(code & 8)
                at = np.flatnonzero(hit)
                after = np.searchsorted(person, at - NEAR)
                near = np.zeros(len(words), bool)
                near[at] = after < np.searchsorted(person, at + NEAR, side="right")
                n = np.maximum(np.diff(starts), 1)
                tally = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
                counted = [tally(x) / n for x in ((code & 1) > 0, (code & 2) > 0, (code & 4) > 0)]
                near_n, person_n, mixed = tally(near), tally((code & 8) > 0) / n, tally((code & 16) > 0) / n
                for i, s in enumerate(starts[:-1]):
                    own = raw[first + i] or b""
                    a = np.frombuffer(own, np.uint8)
                    size = max(len(a), 1)
                    capital = int(((a >= 65) & (a <= 90)).sum())
                    distinct = len({words[j].strip(_EDGE) for j in np.flatnonzero(hit[s : starts[i + 1]]) + s})
                    bang = own.count(b"!")
                    marks = bang + sum(own.count(c) for c in (b"?", b".", b",", b";", b":"))
                    shouted = sum(w.isupper() for w in own.split()) / n[i] if capital > size / 20 else 0.0
                    rows.append([
                        counted[0][i], counted[1][i], counted[2][i], distinct, near_n[i], person_n[i],
                        capital / size, shouted, marks / size, bang / size, mixed[i], math.log1p(starts[i + 1] - s),
                    ])
            flat = np.array(rows, np.float64).reshape(-1, len(FEATURES))
            kept = pa.ListArray.from_arrays(
                pa.array(np.arange(len(flat) + 1) * len(FEATURES), pa.int32()), pa.array(flat.ravel())
            )
            yield put_columns(batch, **{name: kept})

    return docs.mapInArrow(run, with_fields(docs, **{name: "array<double>"}))


def fit(rows: DataFrame, text: str = "text", label: str = "label", sample: int = SAMPLE) -> Model:
    """Learns P(label = 1). Rows without label are left out; labels of one kind only give a constant model."""
    known = rows.select(F.coalesce(text, F.lit("")).alias("text"), F.col(label).cast("double").alias("y")).filter("y IS NOT NULL")
    part = F.pmod(F.xxhash64("text", F.lit(2)), F.lit(8))
    dealt = cut(bounded_sample(known, sample).withColumn("part", part).withColumn("half", (part % 2).cast("tinyint")))
    total, bad = dealt.agg(F.count(F.lit(1)), F.sum("y")).first()
    base = (bad or 0.0) / total if total else 0.0
    if not 0 < base < 1:
        return Model(Lexicon(), None, None, base)
    first, second, lexicon = learn_lexicons(dealt)
    crossed = measure(dealt.filter("half = 1"), first, "text", "dense").unionByName(
        measure(dealt.filter("half = 0"), second, "text", "dense")
    )
    dense = cut(crossed.select(array_to_vector("dense").alias("features"), "y", "part"))
    train, held = dense.filter("part < 6"), dense.filter("part >= 6")
    if train.select("y").distinct().count() < 2 or held.select("y").distinct().count() < 2:
        return Model(lexicon, None, None, base)
    trees = GBTClassifier(featuresCol="features", labelCol="y", maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=11, subsamplingRate=1.0).fit(train)
    raw = trees.transform(held).select(vector_to_array("probability")[1].alias("raw"), "y")
    calibration = IsotonicRegression(featuresCol="raw", labelCol="y").fit(raw)
    return Model(lexicon, trees, calibration, base)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """`docs` with `score` (calibrated P(label = 1)) and `predicted` (1 from `threshold` on).

    Null and empty texts are scored by their all-zero features. Result columns replace input columns of the
    same name.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    if model.trees is None:
        value = F.lit(model.base)
        out = docs.select(*kept)
    else:
        dense, vector, raw, fine = (unused(docs, c) for c in ("_dense", "_vector", "_raw", "_fine"))
        out = measure(docs.select(*kept), model.lexicon, text, dense).withColumn(vector, array_to_vector(dense))
        trees = model.trees.copy().setFeaturesCol(vector).setPredictionCol("").setRawPredictionCol("").setProbabilityCol(raw)
        out = trees.transform(out).withColumn(raw, vector_to_array(raw)[1])
        out = model.calibration.copy().setFeaturesCol(raw).setPredictionCol(fine).transform(out)
        value = F.least(F.greatest(F.col(fine), F.lit(0.0)), F.lit(1.0))
    return out.select(*[out[c] for c in kept], value.alias("score"), (value >= threshold).cast("int").alias("predicted"))
