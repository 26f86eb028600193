"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is found inside a document when the document holds at least ``threshold`` of the item's distinct
word shingles, however long the document is. Items are partitioned by the number u of shingles they may have
at most (powers of two), and every item of a partition is represented by its
floor((1 - threshold) * u) + 1 smallest shingle hashes, a bottom-k MinHash sketch. A document that reaches
the threshold misses too few shingles to miss the whole sketch, so looking up a document's shingle hashes
among the sketches finds every contained item; candidates are then verified on the shingles themselves.

Items are sent to the tasks in blocks of about BLOCK_CHARS characters, and each block meets every document where it lies.
Where there are several, the finds of a block are written and the block leaves the driver and the tasks before the next
one comes, so no more than one block is held whatever the benchmark holds; documents are then read once a block. Words are runs of letters, digits and ``_``,
lower-cased; shingles have ``n`` words, and items or documents with fewer words are one shingle as a whole (items
of fewer than ``n`` words are looked up at their own length).

Null or wordless items match nothing; null texts hold nothing. Repeated documents match alike, repeated item
rows count once per item_id and text. An empty table on either side gives no matches. Other columns are
kept by ``drop_contaminated`` and ignored by ``search``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import scratch, skew, texts

BLOCK_CHARS = 8_000_000


def words_of(text: str | None) -> list[str]:
    return texts.WORD.findall((text or "").lower())


def shingles(words: list[str], n: int) -> set[str]:
    n = min(n, len(words))
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def rolled(c: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` word codes."""
    out = np.zeros(len(c) - n + 1, np.uint64)
    for i in range(n):
        out = out * texts.MIX[0] + c[i : len(c) - n + 1 + i]
    out ^= out >> np.uint64(29)
    return out * texts.MIX[2]


class Items:
    """A block of test items, ready to be looked up."""

    def __init__(self, rows: list[tuple[int | None, str]], n: int, threshold: float):
        self.threshold = threshold
        self.items, self.sizes = [], []
        found: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            m = min(n, len(words))
            held = shingles(words, n)
            hashes = np.unique(rolled(texts.word_codes([text])[0], m))
            class_size = 1 << (len(held) - 1).bit_length()
            k = min(len(hashes), int((1 - threshold) * class_size) + 1)
            found.setdefault(m, []).extend((int(x), len(self.items)) for x in hashes[:k])
            self.items.append((item_id, held))
        self.sketch = {}
        for m, pairs in found.items():
            pairs.sort()
            self.sketch[m] = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)

    def inside(self, batch: list[str | None]) -> list[list[tuple[int | None, int, int]]]:
        """For each text (item_id, shared shingles, the item's shingles) of the items that it contains."""
        c, size = texts.word_codes(batch)
        last = np.cumsum(size)
        out: list[list] = [[] for _ in batch]
        words: dict[int, list[str]] = {}
        for m, (hashes, of) in self.sketch.items():
            if len(c) < m:
                continue
            h = rolled(c, m)
            at = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h)
            text = np.searchsorted(last, at, "right")
            inside = at + m <= last[text]  # not across two texts
            at, text = at[inside], text[inside]
            for k in np.unique(text).tolist():
                hit = np.unique(h[at[text == k]])
                a, b = np.searchsorted(hashes, hit), np.searchsorted(hashes, hit, "right")
                if k not in words:
                    words[k] = words_of(batch[k])
                mine = shingles(words[k], m)
                for i in np.unique(np.concatenate([of[x:y] for x, y in zip(a, b)])):
                    item_id, held = self.items[i]
                    shared = len(held & mine)
                    if shared >= self.threshold * len(held):
                        out[k].append((item_id, shared, len(held)))
        return out


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, bool]]:
    """The distinct items, a bounded block at a time, and whether there are other blocks."""
    items = benchmark.select("item_id", "text").dropna(subset=["text"]).distinct()
    chars = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-chars // BLOCK_CHARS))
    for k in range(count):
        block = items if count == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        rows = [(r["item_id"], r["text"]) for r in block.collect()]
        if rows:
            yield rows, count > 1


def search(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, shared, item_shingles and containment for every item that a document contains."""
    found = None
    slim = docs.select("doc_id", "text")
    schema = "doc_id long, item_id long, shared long, item_shingles long, containment double"
    for rows, others in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, n, threshold)
            for whole in batches:
                for lo in range(0, whole.num_rows, texts.SLICE):
                    batch = whole.slice(lo, texts.SLICE)
                    hits = [(i, x) for i, found in enumerate(items.inside(batch.column(1).to_pylist())) for x in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([i for i, _ in hits], pa.int64())),
                            *(pa.array([x[j] for _, x in hits], pa.int64()) for j in range(3)),
                            pa.array([x[1] / x[2] for _, x in hits], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "shared", "item_shingles", "containment"],
                    )

        part = slim.mapInArrow(run, schema)
        if others:
            part = scratch.materialize(part, "leaks")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents that contain no test item, with all their columns."""
    slim = docs.select("doc_id", "text", skew.row_hash(docs).alias("row_hash"))
    leaks = None
    for rows, others in _blocks(benchmark):
        sent, held = docs.sparkSession.sparkContext.broadcast(rows), {}

        def leaking(batch: list[str | None], sent=sent, held=held) -> list[bool]:
            if not held:
                held["items"] = Items(sent.value, n, threshold)
            return [bool(found) for found in held["items"].inside(batch)]

        if not others:
            return texts.filter_rows(docs, lambda batch, leaking=leaking: [not x for x in leaking(batch)])
        part = scratch.materialize(texts.filter_rows(slim, leaking).select("doc_id", "row_hash"), "leaks")
        sent.destroy()
        leaks = part if leaks is None else leaks.unionByName(part)
    return docs if leaks is None else skew.keep_rows(docs, leaks.withColumn("kept", F.lit(False)))
