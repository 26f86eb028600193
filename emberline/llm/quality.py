"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x): one set of weights over hashed text features, shared by all grades,
and ordered thresholds. A document gets its expected grade and the tail probabilities P(grade >= k) that
selection cuts at. Features are hashed words, hashed token shapes (letters, digits and other signs, runs
collapsed; a token that repeats its neighbour has a shape of its own) and pairs of neighbouring shapes, each
weighted by the root of its share of the document, so long and short texts compare.

The model is fitted on at most about ``most`` rated rows (a documented bound, by hash of doc_id); every
document is then scored over its whole text where it lies, without a shuffle.

A null or empty text has no features: its score is that of the thresholds. Ratings with a null doc_id or grade are not
used; without ratings every document gets grade 0 with certainty. Of several ratings of a doc_id the largest counts, and of
several texts one. Repeated rows score alike. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm import texts

BITS = 18
#: Rated rows that the model is fitted on at most, about.
MOST_RATED = 8_000
RATE, RIDGE, EPOCHS, LEAST = 0.5, 1e-5, 8, 4


def shape(token: str) -> str:
    """Kinds of signs of a token, runs collapsed: ``Word,`` is ``Aa,`` and ``WORD!!`` is ``A!``."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    return "".join(k for k, _ in groupby(kinds))


class Tokens(dict):
    """Token -> codes of its word and of its shape, remembered for the tokens seen lately, but for very long ones."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= texts.CACHE:
            self.clear()
        word = "".join(c for c in token.lower() if c.isalnum())
        found = crc32(word.encode("utf-8", "surrogatepass")), crc32(shape(token).encode("utf-8", "surrogatepass"))
        if len(token) <= 64:
            self[token] = found
        return found


TOKENS = Tokens()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of a text and their values."""
    tokens = (text or "").split()
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    c = np.array(list(map(TOKENS.__getitem__, tokens)), np.uint64)
    word, form = c[:, 0], c[:, 1].copy()
    form[1:][c[1:, 0] == c[:-1, 0]] = 7  # repeats its neighbour
    kinds = [word * texts.MIX[0], form * texts.MIX[1] + texts.MIX[2], form[:-1] * texts.MIX[3] + form[1:] * texts.MIX[4]]
    at, count = np.unique(np.concatenate(kinds) * texts.MIX[0] >> np.uint64(64 - BITS), return_counts=True)
    return at.astype(np.int64), np.sqrt(count / len(tokens))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, top: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Weights and the ``top`` ordered thresholds for grades 0 to ``top``, by adaptive gradient steps."""
    seen = np.zeros(1 << BITS, np.int64)
    for at, _ in rows:
        seen[at] += 1
    rows = [(at[keep], x[keep]) for at, x in rows for keep in [seen[at] >= least]]
    w, n = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    share = np.clip([np.mean(grades <= k) for k in range(top)], 0.02, 0.98)
    theta, tn = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(top)), np.full(top, 1.0)
    for _ in range(EPOCHS):
        for (at, x), y in zip(rows, grades):
            s = float(w[at] @ x)
            a = _sigmoid(theta[y] - s) if y < top else 1.0
            b = _sigmoid(theta[y - 1] - s) if y else 0.0
            g = (1 - a - b) * x + RIDGE * w[at]
            n[at] += g * g
            w[at] -= RATE * g / np.sqrt(n[at])
            for k, slope in ((y, -a * (1 - a)), (y - 1, b * (1 - b))):
                if 0 <= k < top:
                    t = slope / max(a - b, 1e-6)
                    tn[k] += t * t
                    theta[k] -= RATE * t / np.sqrt(tn[k])
            theta = np.maximum.accumulate(theta)
    return w, theta


def train(docs: DataFrame, ratings: DataFrame, top: int, most: int = MOST_RATED, least: int = LEAST) -> dict | None:
    """Fit on ``ratings(doc_id, grade)``, grades 0 to ``top``, and the texts of ``docs``; None without ratings."""
    known = ratings.select("doc_id", F.col("grade").cast("int").alias("__y")).dropna().filter(F.col("__y").between(0, top))
    known = texts.bounded_sample(known.groupBy("doc_id").agg(F.max("__y").alias("__y")), "doc_id", most, "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about `most` small rows at most

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = [features(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["__y"], "at": [x[0] for x in f], "x": [x[1] for x in f]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, y, ids = [], [], []
        for b in batches:
            rows += [*zip(b["at"], b["x"])]
            y += [*b["y"]]
            ids += [*b["doc_id"]]
        if rows:
            order = np.argsort(np.array([crc32(str(i).encode()) for i in ids]), kind="stable")
            w, theta = fit([rows[i] for i in order], np.array(y)[order], top, least)
            at = np.flatnonzero(w)
            yield pd.DataFrame({"feature": [at], "weight": [w[at]], "theta": [theta]})

    made = rows.mapInPandas(make, "doc_id long, y int, at array<int>, x array<double>")
    made = made.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct("at", "x")).alias("f")).select("doc_id", "y", "f.at", "f.x")  # a repeated doc_id counts once
    model = made.repartition(1).sortWithinPartitions("doc_id", "y").mapInPandas(learn, "feature array<int>, weight array<double>, theta array<double>").collect()
    return model[0].asDict() if model else None


def add_grades(docs: DataFrame, model: dict | None, top: int) -> DataFrame:
    """``docs`` with expected_grade and p_at_least_1 ... p_at_least_<top>."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    dense: dict = {}

    def of_texts(batch: list[str | None]) -> list:
        m = sent.value
        if m is None:
            return [[0.0] * len(batch)] * (top + 1)
        if not dense:
            dense["w"] = np.zeros(1 << BITS)
            dense["w"][np.array(m["feature"], np.int64)] = m["weight"]
        f = [features(t) for t in batch]
        s = np.array([dense["w"][at] @ x for at, x in f])
        tails = 1 - _sigmoid(np.array(m["theta"])[:, None] - s[None, :])
        return [tails.sum(axis=0), *tails]

    names = ["expected_grade", *(f"p_at_least_{k + 1}" for k in range(top))]
    return texts.add_columns(docs, [T.StructField(n, T.DoubleType()) for n in names], of_texts)


def score(docs: DataFrame, ratings: DataFrame, top: int, least_grade: int = 1, limit: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail probabilities, and selected: P(grade >= least_grade) >= limit.

    A fifth of the ratings, by crc32 of doc_id, is held out of learning.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = train(docs, ratings.filter(~held), top)
    graded = add_grades(docs.select("doc_id", "text"), model, top)
    tails = [f"p_at_least_{k + 1}" for k in range(top)]
    return graded.select("doc_id", held.alias("held_out"), "expected_grade", *tails, (F.col(f"p_at_least_{least_grade}") >= limit).alias("selected"))
