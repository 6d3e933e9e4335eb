"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte n-grams of its ASCII-lower-cased letters. Document
frequencies come from all training rows; every language's centroids come from spherical k-means over a
bounded sample of its distinct texts, one task per language. Centroids stay in a written table, dealt into blocks
of bounded size; a text meets one block after another and gets the language of the centroid of highest cosine. It
is rejected when it lies far below what texts of that language reach that were not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasemill.llm.texts import as_bytes, cut, put_columns, unused, with_fields
from phasemill.session import join_small

DIMS = 4096
SAMPLE_PER_LANG = 1000  # distinct texts per language that its centroids are fitted on
CENTROIDS = 4
ROUNDS = 10
LOW = 0.02  # share of a language's own texts that may lie below its reach
SLACK = 0.55  # share of a language's reach below which a text is rejected
BLOCK_CENTROIDS = 1000  # centroids that a task compares with at once, about; the driver holds one such block
BLOCK = 256  # texts that are vectors at once
UNDETERMINED = "und"

# ASCII that is no letter becomes a space; A-Z becomes a-z
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_SHIFT = np.uint32(32 - DIMS.bit_length() + 1)


def has_letter(text: bytes | None) -> bool:
    return bool(text) and any(map(str.isalpha, text.decode("utf-8", "replace")))


def ngram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams."""
    a = np.frombuffer(b" " + b" ".join(text.translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    pair = a[:-1] * _FACTORS[0] ^ a[1:] * _FACTORS[1]
    triple = pair[:-1] * _FACTORS[1] ^ a[2:] * _FACTORS[2]
    mixed = np.concatenate([pair * _FACTORS[2], (triple ^ (triple >> np.uint32(15))) * _FACTORS[0]])
    return np.bincount((mixed >> _SHIFT).astype(np.int64), minlength=DIMS)


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: (1 + log count) x idf."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, text in enumerate(texts):
        n = ngram_counts(text)
        at = np.flatnonzero(n)
        out[i, at] = (1 + np.log(n[at])) * idf[at]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-12)


@dataclass
class Model:
    """`centroids` is a written table (lang, reach, center, block). `reach` is the cosine that all but the share LOW
    of unseen texts of the centroid's language reach; `blocks` counts the blocks."""

    centroids: DataFrame
    blocks: int
    idf: np.ndarray


def _block(model: Model, number: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, centroids and reaches of one block, by language."""
    got = model.centroids.filter(F.col("block") == number).select("lang", "reach", "center").toArrow()
    langs, reach = got.column("lang").to_pylist(), got.column("reach").to_numpy()
    center = got.column("center").combine_chunks().flatten().to_numpy().reshape(len(langs), -1)
    order = sorted(range(len(langs)), key=lambda i: (langs[i], *center[i, :8].tolist()))
    return [langs[i] for i in order], np.ascontiguousarray(center[order], np.float32), reach[order]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, df = 0, np.zeros(DIMS, np.int64)
    for batch in batches:
        for text in as_bytes(batch.column("text")):
            if has_letter(text):
                total += 1
                df += ngram_counts(text) > 0
    yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([df], pa.list_(pa.int64()))], ["total", "df"])


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of spherical k-means that starts from the first rows; rows come in random order.

    A centroid of less than the share LOW of the rows is given up and its rows go to the others, so that an
    odd row, such as one of hexadecimal digits, does not attract texts like it.
    """
    centers = x[:k]
    while True:
        for _ in range(ROUNDS):
            own = np.argmax(x @ centers.T, axis=1)
            sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centers[c] for c in range(len(centers))])
            centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        n = np.bincount(np.argmax(x @ centers.T, axis=1), minlength=len(centers))
        large = n >= max(1, min(LOW * len(x), n.max()))
        if large.all():
            return centers
        centers = centers[large]


def _reach(x: np.ndarray, k: int) -> float:
    """Low quantile of the cosines of each half of the rows to the centroids of the other; NaN for one row."""
    if len(x) < 2:
        return float("nan")
    cos = [(x[i::2] @ _cluster(x[1 - i :: 2], k).T).max(axis=1) for i in (0, 1)]
    return float(np.quantile(np.concatenate(cos), LOW))


def fit(
    rows: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS, text: str = "text", lang: str = "lang",
    block_centroids: int = BLOCK_CENTROIDS,
) -> Model | None:
    """Learns from all rows that have a language and a letter; None if there are none, as in an empty table.

    Any number of languages is learned. Copies of a text count once. A text is one vector, whatever its length.
    """
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    made = cut(rows.select("text").mapInArrow(_document_frequencies, "total bigint, df array<bigint>"))
    total = made.agg(F.sum("total")).first()[0] or 0
    if not total:
        return None
    found = made.select(F.posexplode("df").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS)
    for r in found:  # DIMS rows, whatever the input
        df[r["at"]] = r["n"]
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    # a language's sample is drawn from its distinct texts, so that copies neither stand in for each other nor
    # are all in or out together; only keys are counted and ranked, texts are fetched for the chosen keys
    told = rows.filter(F.col("text").rlike(r"\p{L}")).withColumn("o", F.xxhash64("text"))
    keys = cut(told.select("lang", "o").distinct())
    counts = cut(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    # thin before the ordered choice, so that the window meets a bounded number of rows
    thin = join_small(keys, counts, "lang").filter(
        F.pmod("o", F.lit(1_000_000)) < F.lit(1_500_000.0) * sample_per_lang / F.col("n")
    )
    ranked = thin.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("o")))
    chosen = ranked.filter(F.col("k") <= sample_per_lang).select("lang", "o")
    sample = join_small(told, chosen, ["lang", "o"]).groupBy("lang", "o").agg(F.min("text").alias("text"))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t.encode() for t in pdf.sort_values("o")["text"]]
        texts = [t for t in texts if has_letter(t)]
        if not texts:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("lang", "reach", "center")})
        x = vectors(texts, idf)
        centers = _cluster(x, centroids).astype(np.float32)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "reach": _reach(x, centroids), "center": list(centers)})

    got = sample.groupBy("lang").applyInPandas(group, "lang string, reach double, center array<float>")
    got = cut(got)
    without = [r["lang"] for r in counts.join(got, "lang", "left_anti").select("lang").limit(5).collect()]
    if without:
        raise ValueError(f"no centroid for languages with letters: {without}")
    n, least = got.agg(F.count(F.lit(1)), F.min("reach")).first()
    if not n:
        return None
    blocks = -(-n // block_centroids)
    # a language of a single text takes the smallest reach of the others
    dealt = got.withColumn("reach", F.coalesce("reach", F.lit(least), F.lit(0.0))).withColumn(
        "block", F.pmod(F.xxhash64("lang"), F.lit(blocks))
    )
    return Model(cut(dealt), blocks, idf)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred`, `score` (cosine, 0 to 1) and `rejected`.

    Null, empty and letterless texts are `und` with score 0 and rejected; so is every text if there is no
    model. Ties go to the language that sorts first. Equal texts get equal results; an empty table gives none.
    Result columns replace input columns of the same name, in either case. A model of several blocks is applied
    block by block, each pass keeping the better centroid.
    """
    near = unused(docs, "_reach")
    kinds = {"lang_pred": "string", "score": "double", near: "double"}

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            yield put_columns(batch, **{
                "lang_pred": pa.array([UNDETERMINED] * n, pa.string()), "score": pa.array(np.full(n, -2.0)), near: pa.array(np.zeros(n)),
            })

    def compare(shared, idf: np.ndarray, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            langs, centroids, reaches = shared.value
            for batch in batches if not first else begin(batches):
                raw, lang = as_bytes(batch.column(text)), batch.column("lang_pred").to_pylist()
                cos, reach = (batch.column(c).to_numpy().copy() for c in ("score", near))
                told = [i for i, t in enumerate(raw) if has_letter(t)]
                for b in range(0, len(told), BLOCK):
                    at = told[b : b + BLOCK]
                    all_cos = vectors([raw[i] for i in at], idf) @ centroids.T
                    best = np.argmax(all_cos, axis=1)
                    for i, c, value in zip(at, best, all_cos[np.arange(len(at)), best].tolist()):
                        if value > cos[i] or value == cos[i] and langs[c] < lang[i]:
                            lang[i], cos[i], reach[i] = langs[c], value, reaches[c]
                yield put_columns(batch, **{"lang_pred": pa.array(lang, pa.string()), "score": pa.array(cos), near: pa.array(reach)})

        return run

    out = with_fields(docs, **kinds)
    found = docs
    if model is None:
        found = docs.mapInArrow(begin, out)
    else:
        sc = docs.sparkSession.sparkContext
        for number in range(model.blocks):  # the driver lets go of a block before it reads the next
            found = found.mapInArrow(compare(sc.broadcast(_block(model, number)), model.idf, number == 0), out)
    final = {
        "lang_pred": F.col("lang_pred"), "score": F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)),
        "rejected": (F.col("score") == -2.0) | (F.col("score") < SLACK * F.col(near)),
    }
    kept = [c for c in found.columns if c != near and c.lower() not in final]
    return found.select(*kept, *[v.alias(c) for c, v in final.items()])
