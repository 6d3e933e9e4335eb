"""Words, hashes and Arrow batches shared by the text operators.

Texts are handled as UTF-8 bytes: `bytes.split()` separates at exactly `[\\x20\\x09-\\x0D]`, and
`bytes.lower()` changes A-Z only, so both follow the operators' definitions without regular expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasemill.session import BROADCAST_BYTES, cut  # noqa: F401  (re-exported for the operators)

CHUNK_WORDS = 200_000  # words of short documents handled together; a longer document is a chunk of its own
CACHED_WORDS = 200_000  # distinct words whose hash a task remembers

# every byte outside words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ becomes a space; A-Z becomes a-z
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def plain_words(text: bytes | None) -> list[bytes]:
    """Words between white space."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all code points from U+0080."""
    return text.translate(_WORD_BYTES).split() if text else []


class WordHashes(dict):
    """64-bit hash of a word; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator on an array of uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n consecutive word hashes (empty if there are fewer)."""
    m = max(len(words) - n + 1, 0)
    out = mix(words[:m])
    for k in range(1, n):
        out = mix(out + words[k : k + m])
    return out


def word_chunks(
    texts: list[bytes | None], split: Callable[[bytes | None], list[bytes]]
) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """Cuts a batch into chunks of whole documents: (first row, words, start of each row and the end)."""
    first, words, starts = 0, [], [0]
    for i, text in enumerate(texts):
        words += split(text)
        starts.append(len(words))
        if len(words) >= CHUNK_WORDS:
            yield first, words, np.array(starts)
            first, words, starts = i + 1, [], [0]
    if len(starts) > 1:
        yield first, words, np.array(starts)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from one flat array and the row starts."""
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def join_spread(left: DataFrame, right: DataFrame, on: str, by: str, how: str, row_bytes: int | Column = 64, salts: int = 16) -> DataFrame:
    """Join many rows of `left` with the unique keys of `right`, whatever share of `left` one key holds.

    The right side is written and measured by `row_bytes`, an upper bound for a row of it: up to 32 MB it is
    broadcast; beyond that, it is copied to `salts` salts and the rows of a key are dealt over them by a hash
    of the column `by`.
    """
    small = cut(right)
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    if (small.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        return left.join(F.broadcast(small), on, how)
    salt = unused(left, "_salt")
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [on, salt], how).drop(salt)


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def put_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns replaced, in whichever case they are written, or appended."""
    for name, values in columns.items():
        at = next((i for i, c in enumerate(batch.schema.names) if c.lower() == name.lower()), None)
        batch = batch.append_column(name, values) if at is None else batch.set_column(at, name, values)
    return batch


def with_fields(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of `df` with columns of the named types replaced, in whichever case, or appended."""
    fields = [f for f in df.schema.fields]
    for name, kind in kinds.items():
        new = T.StructField(name, T._parse_datatype_string(kind))
        at = next((i for i, f in enumerate(fields) if f.name.lower() == name.lower()), None)
        fields = [*fields, new] if at is None else [*fields[:at], new, *fields[at + 1 :]]
    return T.StructType(fields)
