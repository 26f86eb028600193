"""Hard negatives of anchors among labelled vectors, by exact inner products of packed integers.

Components are integers. Several candidates share one 64-bit word for each component (Kronecker packing): their
components, biased to be nonnegative, lie in separated fields, wide enough for any inner product with an anchor. A word is
multiplied once by the anchor's component for all its candidates; products are added up over the components, and the
fields of the sum, less the biases, are the exact inner products. Field widths follow from the data: the range of
all components and the largest sum of absolute components of an anchor.

Anchors are a stated query set. They are taken in blocks of bounded bytes; a block is broadcast, every task
multiplies it with its own vectors and keeps the best of each anchor, and these meet in one small shuffle. The first pass
finds each anchor's positives (its best rows of the same label), the second the best rows of other labels whose score
lies between two percentages of the positive's. No pair is written but the best of a task.

Rows with a null vec_id or label, a null vector, or a null or non-finite component take no part. Higher scores come first, then
smaller vec_ids, then (among repeated vec_ids, each a row and an anchor of its own) the earlier row of the stored table.
A vector shorter than another counts as filled up with zeros; components beyond 2^26 / scale (less for more than 64
of them) count as that bound. An anchor without a positive, or a positive without a negative in its range, gives no row. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm import scratch, texts, vectors

LIMIT = 1 << 26
#: Anchors whose scores a task holds at one time.
STEP = 64
LEAST = np.iinfo(np.int64).min
SCHEMA = "anchor_no int, positive_no int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_uid long, negative_score long"


class Packing:
    """Inner products with candidates packed ``fields`` to a word, each field ``width`` bits."""

    def __init__(self, low: int, high: int, largest_sum: int, bound: int):
        """``low``, ``high``: range of all components; ``largest_sum``: of the absolute components of an anchor; ``bound``: of each."""
        self.bound, self.low = bound, max(min(low, 0), -bound)
        most = largest_sum * (min(max(high, 0), bound) - self.low)
        self.width = most.bit_length() + 1
        self.fields = max(1, 64 // self.width)

    def pack(self, candidates: np.ndarray) -> np.ndarray:
        """One word for each component of ``fields`` neighbouring candidates."""
        n, dims = candidates.shape
        padded = np.zeros((-(-n // self.fields), self.fields, dims), np.uint64)
        padded.reshape(-1, dims)[:n] = candidates - self.low
        words = padded[:, 0].copy()
        for i in range(1, self.fields):
            words |= padded[:, i] << np.uint64(i * self.width)
        return np.ascontiguousarray(words.T)

    def products(self, anchors: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """Exact inner products of ``anchors`` with the ``n`` candidates of ``words``."""
        factors = anchors.astype(np.uint64)  # negative ones wrap, as the sums do
        total = np.zeros((len(anchors), words.shape[1]), np.uint64)
        total += sum(1 << (i * self.width + self.width - 1) for i in range(self.fields))  # makes every field nonnegative
        one = np.empty_like(total)
        for j in range(words.shape[0]):
            np.multiply(factors[:, j, None], words[j][None, :], out=one)
            total += one
        out = np.empty((*total.shape, self.fields), np.int64)
        mask = np.uint64((1 << self.width) - 1)
        for i in range(self.fields):
            out[:, :, i] = (total >> np.uint64(i * self.width) & mask).astype(np.int64) - (1 << (self.width - 1))
        return out.reshape(len(anchors), words.shape[1] * self.fields)[:, :n] + self.low * anchors.sum(axis=1)[:, None]


class Best:
    """The best ``k`` of each row of an array of lists: score, vec_id and uid."""

    def __init__(self, *shape: int):
        self.k = shape[-1]
        self.score, self.id, self.uid = (np.full(shape, fill, np.int64) for fill in (LEAST, 0, 0))

    def add(self, at, score: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Merge new entries into the lists ``at``; LEAST stands for none."""
        score, ids, uids = (np.concatenate([old[at], new], axis=-1) for old, new in ((self.score, score), (self.id, ids), (self.uid, uids)))
        order = np.lexsort((uids, ids, -np.maximum(score, LEAST + 1)), axis=-1)[..., : self.k]
        self.score[at], self.id[at], self.uid[at] = (np.take_along_axis(x, order, axis=-1) for x in (score, ids, uids))


def _batches(batches: Iterator[pa.RecordBatch], dims: int, bound: int) -> Iterator[tuple[np.ndarray, ...]]:
    """vec_id, uid, label and components, in the order of vec_id and uid."""
    rows = max(1, vectors.BLOCK_BYTES // (8 * max(1, dims)))
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            b = whole.slice(lo, rows)
            ids, uids, labels = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "uid", "label"))
            order = np.lexsort((uids, ids))
            yield ids[order], uids[order], labels[order], np.clip(vectors.matrix(b.column("v"), dims), -bound, bound)[order]


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest scores of each row, the first ones on ties."""
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _positives(table: DataFrame, block: dict, packing: Packing, k: int) -> DataFrame:
    """For each anchor of the block its best ``k`` other rows of the same label."""
    sent = table.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        best = Best(len(own["uid"]), k)
        for ids, uids, labels, v in _batches(batches, own["v"].shape[1], packing.bound):
            for label in np.intersect1d(labels, own["label"]):
                here, of = np.flatnonzero(labels == label), np.flatnonzero(own["label"] == label)
                words = packing.pack(v[here])
                for at in np.split(of, range(STEP, len(of), STEP)):
                    score = packing.products(own["v"][at], words, len(here))
                    score[own["uid"][at][:, None] == uids[here][None, :]] = LEAST + 1
                    top = _top(score, k)
                    score = np.take_along_axis(score, top, axis=1)
                    score[score == LEAST + 1] = LEAST
                    best.add(at, score, ids[here][top], uids[here][top])
        a, p = np.nonzero(best.score != LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), *(pa.array(x[a, p]) for x in (best.score, best.id, best.uid))], names=["anchor_no", "score", "id", "uid"])

    return table.mapInArrow(run, "anchor_no int, score long, id long, uid long")


def _negatives(table: DataFrame, block: dict, packing: Packing, k: int, low: int, high: int) -> DataFrame:
    """For each anchor and positive of the block the best ``k`` rows of other labels between ``low`` and ``high`` percent of the positive's score."""
    sent = table.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        score_of, id_of = own["positive_score"], own["positive_id"]  # anchors x positives; LEAST where there is none
        there = score_of != LEAST
        most = np.where(there, score_of * high // 100, LEAST)
        least = np.where(there, -(-score_of * low // 100), 0)
        best = Best(*score_of.shape, k)
        for ids, uids, labels, v in _batches(batches, own["v"].shape[1], packing.bound):
            words = packing.pack(v)
            for lo in range(0, len(score_of), STEP):
                at = np.arange(lo, min(lo + STEP, len(score_of)))
                score = packing.products(own["v"][at], words, len(ids))
                score[own["label"][at][:, None] == labels[None, :]] = LEAST + 1
                order = np.argsort(-score, axis=1, kind="stable")
                score = np.take_along_axis(score, order, axis=1)
                for p in range(score_of.shape[1]):
                    begin = (score > most[at, p, None]).sum(axis=1)
                    cols = begin[:, None] + np.arange(k)[None, :]
                    inside = np.minimum(cols, len(ids) - 1)
                    s = np.take_along_axis(score, inside, axis=1)
                    found = np.take_along_axis(order, inside, axis=1)
                    s = np.where((cols < len(ids)) & (s >= least[at, p, None]) & there[at, p, None] & (s != LEAST + 1), s, LEAST)
                    best.add((at, p), s, ids[found], uids[found])
        a, p, r = np.nonzero(best.score != LEAST)
        whole = [pa.array(a, pa.int32()), pa.array(p, pa.int32()), pa.array(own["vec_id"][a]), pa.array(id_of[a, p]), pa.array(score_of[a, p])]
        names = ["anchor_no", "positive_no", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_uid", "negative_score"]
        yield pa.RecordBatch.from_arrays([*whole, *(pa.array(x[a, p, r]) for x in (best.id, best.uid, best.score))], names=names)

    return table.mapInArrow(run, SCHEMA)


def _block(anchors: DataFrame, dims: int, bound: int) -> dict:
    """The anchors of one block as arrays; their bytes are bounded."""
    got = anchors.orderBy("vec_id", "uid").toArrow()
    v = np.clip(vectors.matrix(got.column("v"), dims), -bound, bound) if got.num_rows else np.zeros((0, dims), np.int64)
    return {"v": v} | {c: got.column(c).to_numpy() for c in ("vec_id", "uid", "label")}


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``rows(vec_id, label, embedding)``.

    Anchors are the rows whose vec_id is divisible by ``every``; for each of an anchor's first ``positives`` rows of its label come the first
    ``negatives`` rows of other labels whose score lies from ``low`` to ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vectors.whole("embedding"))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vectors.integers("embedding", scale, LIMIT).alias("v"))
    table = scratch.materialize(vectors.spread(kept).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    anchors = table.filter(F.col("vec_id") % every == 0)
    size = F.aggregate("v", F.lit(0).cast("long"), lambda t, x: t + F.abs(x))
    facts = table.agg(
        F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims"),
        F.max(F.when(F.col("vec_id") % every == 0, size)).alias("sum"), F.count_if(F.col("vec_id") % every == 0).alias("anchors"),
    ).first()
    dims = facts["dims"]
    bound = min(LIMIT, math.isqrt((1 << 58) // max(1, dims)))
    packing = Packing(facts["low"] or 0, facts["high"] or 0, min(facts["sum"] or 0, dims * bound), bound)
    blocks = -(-facts["anchors"] // max(1, vectors.BLOCK_BYTES // (8 * max(1, dims))))
    made = []
    for b in range(blocks):
        block = _block(anchors.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b), dims, bound)
        n = len(block["uid"])
        first = Window.partitionBy("anchor_no").orderBy(F.desc("score"), "id", "uid")
        with texts.small_batches(spark):
            best = _positives(table, block, packing, positives).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= positives).toArrow()
        at = (best.column("anchor_no").to_numpy(), best.column("rank").to_numpy() - 1)
        block |= {"positive_score": np.full((n, positives), LEAST, np.int64), "positive_id": np.zeros((n, positives), np.int64)}
        block["positive_score"][at], block["positive_id"][at] = best.column("score").to_numpy(), best.column("id").to_numpy()
        order = Window.partitionBy("anchor_no", "positive_no").orderBy(F.desc("negative_score"), "negative_id", "negative_uid")
        found = _negatives(table, block, packing, negatives, low, high).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
        with texts.small_batches(spark):
            made.append(scratch.materialize(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
    if not made:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(made[0].schema).parquet(*[m._scratch_path for m in made])
