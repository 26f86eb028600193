"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of hashed words, pairs of neighbours, and pairs with one or two words between
them. A feature enters once LEAST of the labelled documents
hold it. Learning keeps a rate for each coordinate and an L1 bound, so that most weights are exactly 0 and the
model that reaches the executors is a short list of (feature, weight).

The model is fitted on at most about ``most`` labelled rows (a documented bound, by hash of doc_id; an
online learner is sequential, so this sample is seen by one task, features ready-made by many). Every
document is then scored over its whole text where it lies, without a shuffle.

A null or empty text has the score of the bias alone. Labels with null doc_id or null label are not used;
with no label left nothing is known to be toxic and every score is 0. Of several labels of a doc_id the largest counts, and
of several texts one, so that repeated rows do not lengthen the sample. Repeated rows score alike. An empty
table gives an empty result; other columns are kept by ``drop_toxic`` and ignored by ``score``.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm import texts

BITS = 20
#: Rows that the model is fitted on at most, about.
MOST_LABELLED = 12_000
GAPS = (1, 2, 3)
RATE, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.0, 3
#: Documents that must hold a feature before it is learnt; rarer ones would only memorise their documents.
LEAST = 8


def features(text: str | None) -> np.ndarray:
    """Hashed features of a text, with repeats."""
    words = texts.WORD.findall((text or "").lower())
    c = texts.codes(words)
    kinds = [c * texts.MIX[2], *((c[:-g] * texts.MIX[3]) ^ (c[g:] * texts.MIX[4] + np.uint64(g)) for g in GAPS if len(c) > g)]
    return (np.concatenate([k * texts.MIX[0] for k in kinds]) >> np.uint64(64 - BITS)).astype(np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, their weights, and the bias. ``rows`` hold distinct features."""
    bias_at = 1 << BITS
    seen = np.zeros(1 << BITS, np.int64)
    for r in rows:
        seen[r] += 1
    # what is left lies in one array too
    left = np.empty(sum(int((seen[r] >= least).sum()) + 1 for r in rows), np.int32)
    ends = [0]
    for r in rows:
        r = r[seen[r] >= least]
        ends.append(ends[-1] + len(r) + 1)
        left[ends[-2] : ends[-1] - 1], left[ends[-1] - 1] = r, bias_at
    rows = [left[i:j] for i, j in zip(ends, ends[1:])]
    z, n = np.zeros(bias_at + 1), np.zeros(bias_at + 1)

    def weights(at):
        zi, ni = z[at], n[at]
        l1 = np.where(at == bias_at, 0.0, L1)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / RATE + L2))

    for _ in range(EPOCHS):
        for at, y in zip(rows, labels):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            ni = n[at]
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / RATE * w
            n[at] = ni + g * g
    w = weights(np.arange(bias_at + 1))
    at = np.flatnonzero(w[:-1])
    return at, w[at], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, least: int = LEAST) -> dict | None:
    """Fit on ``labels(doc_id, label)`` and the texts of ``docs``; None without labels."""
    known = labels.select("doc_id", F.col(label).cast("double").alias("__y")).dropna().groupBy("doc_id").agg(F.max("__y").alias("__y"))
    known = texts.bounded_sample(known, "doc_id", most, "toxicity")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "__y")  # about `most` small rows at most

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([np.unique(features(t)) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), x], names=["doc_id", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # all features stay in one block, which a worker gives back whole; rows are views of it
        flat, ends, y, ids = array("i"), [0], [], []
        for b in batches:
            lists = b.column(2)
            flat.frombytes(np.ascontiguousarray(lists.flatten(), np.int32).view(np.uint8))
            ends += (np.cumsum(np.diff(np.array(lists.offsets, np.int64))) + ends[-1]).tolist()
            y += b.column(1).to_pylist()
            ids += b.column(0).to_pylist()
        if y:
            held = np.frombuffer(flat, np.int32)
            x = [held[i:j] for i, j in zip(ends, ends[1:])]
            order = np.argsort(np.array([texts.crc32(str(i).encode()) for i in ids]), kind="stable")
            at, w, bias = fit([x[i] for i in order], np.array(y)[order], least)
            yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32)]), pa.array([w]), pa.array([bias])], names=["feature", "weight", "bias"])

    made = rows.mapInArrow(make, "doc_id long, y double, x array<int>")
    made = made.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x"))  # a repeated doc_id counts once
    model = made.repartition(1).sortWithinPartitions("doc_id", "y").mapInArrow(learn, "feature array<int>, weight array<double>, bias double").collect()
    return model[0].asDict() if model else None


def _scorer(docs: DataFrame, model: dict | None):
    sent = docs.sparkSession.sparkContext.broadcast(model)
    dense: dict = {}

    def of_texts(batch: list[str | None]) -> list:
        m = sent.value
        if m is None:
            return [[0.0] * len(batch)]
        if not dense:
            dense["w"] = np.zeros(1 << BITS)
            dense["w"][np.array(m["feature"], np.int64)] = m["weight"]
        w, out = dense["w"], []
        for t in batch:
            f = features(t)
            f = np.unique(f[w[f] != 0])
            out.append(float(1 / (1 + np.exp(-np.clip(m["bias"] + w[f].sum(), -35, 35)))))
        return [out]

    return of_texts


def add_score(docs: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic."""
    return texts.add_columns(docs, [T.StructField(name, T.DoubleType())], _scorer(docs, model))


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from; a fifth is held out."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = train(docs, learnable(labels))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return add_score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents with a score below ``limit``, with all their columns."""
    model = train(docs, learnable(labels))
    of_texts = _scorer(docs, model)
    return texts.filter_rows(docs, lambda batch: [s < limit for s in of_texts(batch)[0]])
