"""Small helpers that run on batches of texts inside tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

WORD = re.compile(r"\w+")
#: Entries of a worker's cache before it starts anew.
CACHE = 1 << 17
#: Words of more characters or bytes are hashed one by one and not remembered.
_LONG = 64
#: Texts that are Python objects at one time.
SLICE = 512


class Codes(dict):
    """Word -> 32-bit code, remembered for the words seen lately, but for very long ones."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        code = crc32(word.encode("utf-8", "surrogatepass"))
        if len(word) <= _LONG:
            self[word] = code
        return code


CODES = Codes()
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def codes(words: list[str]) -> np.ndarray:
    """A 64-bit code for each word."""
    return np.fromiter(map(CODES.__getitem__, words), np.uint64, len(words)) * MIX[0] + MIX[1]


#: Bytes of a lower-cased text that belong to a word, once other signs beyond ASCII are blanked.
_IN_WORD = np.array([chr(b).isalnum() and b < 128 or b == 0x5F or b >= 128 for b in range(256)])
_NO_WORD = re.compile(r"[^\w\x00-\x7f]")
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_codes(batch: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for each word (as WORD finds them in the lower-cased texts) of all texts in a row, and how many each text has."""
    parts = [b""]
    for t in batch:
        t = (t or "").lower()
        parts.append((t if t.isascii() else _NO_WORD.sub(" ", t)).encode("utf-8", "surrogatepass"))
    line = b" ".join(parts) + bytes(8)
    edge = np.diff(_IN_WORD[np.frombuffer(line, np.uint8)].view(np.int8))
    lo, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    eight = np.ndarray((len(line) - 7,), "<u8", line, strides=(1,))
    size = end - lo
    h = (eight[lo] & _FIRST[np.minimum(size, 8)]) * MIX[0] + size.astype(np.uint64) * MIX[1]
    for k in range(8, _LONG, 8):
        at = np.flatnonzero(size > k)
        if not len(at):
            break
        x = h[at]
        h[at] = (x ^ (x >> np.uint64(29))) * MIX[2] + (eight[lo[at] + k] & _FIRST[np.minimum(size[at] - k, 8)]) * MIX[3]
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh64_intdigest(line[lo[i] : end[i]])
    h = (h ^ (h >> np.uint64(32))) * MIX[4]
    begins = np.cumsum([len(p) + 1 for p in parts])
    return h ^ (h >> np.uint64(29)), np.diff(np.searchsorted(lo, begins))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with names that ``mapInArrow`` can look up, as it cannot those with a dot or a backquote."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


@contextmanager
def small_batches(spark: SparkSession, most: int = 1000) -> Iterator[None]:
    """What runs inside the block goes to Python in batches of at most ``most`` rows, so tasks hold fewer long rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def add_columns(docs: DataFrame, fields: list[T.StructField], of_texts: Callable[[list[str | None]], list], text: str = "text") -> DataFrame:
    """``docs`` with columns that ``of_texts`` makes of a list of texts; nothing else about a row changes."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                made = of_texts(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(m, k) for m, k in zip(made, kinds))], names=names)

    return _numbered(docs).mapInArrow(run, schema)


def filter_rows(docs: DataFrame, of_texts: Callable[[list[str | None]], list[bool]], text: str = "text") -> DataFrame:
    """The rows of ``docs`` for whose texts ``of_texts`` says so, with all their columns, whatever their names."""
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                yield batch.filter(pa.array(of_texts(batch.column(at).to_pylist()), pa.bool_())).rename_columns(names)

    return _numbered(docs).mapInArrow(run, docs.schema)


def hash_share(key: Column, seed: str) -> Column:
    """A number from 0 to 1 that a key always gets, for samples that are the same in every run."""
    return F.crc32(F.concat(F.lit(seed), key.cast("string")).cast("binary")) / F.lit(float(1 << 32))


def bounded_sample(rows: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """About ``most`` of ``rows``, by the hash of ``key``; all where there are fewer."""
    share = min(1.0, most / max(1, rows.count()))
    return rows if share == 1.0 else rows.filter(hash_share(F.col(key), seed) < share)
