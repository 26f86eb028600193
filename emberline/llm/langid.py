"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (1 to GRAM letters, words padded with a
blank), most frequent first. A document's own list is compared with each profile: for every n-gram of the
document, how far out of place it is there, or the most possible where it is absent. The language with the
least sum wins; ties go to the first name.

Profiles are learnt from a bounded sample of at most about ``most`` documents of each language; n-grams are
counted in many tasks and summed by Spark. Every document is then classified over its whole text where it
lies. Words are runs of letters, lower-cased.

A null text, or one without a letter, is ``und`` with score 0. Rows with null lang are not learnt from. Without
any profile every document is ``und``. Repeated rows get the same answer. Equal frequencies are ordered by a
hash of the n-gram, then by the n-gram itself in profiles. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm import texts

LETTERS = re.compile(r"[^\W\d_]+")  # and signs such as ½ and Ⅷ, which are numbers and no letters
GRAM, LENGTH = 4, 300
#: Documents of a language that its profile is learnt from at most, about.
MOST_LABELLED = 4_000
#: n-grams and words that a worker remembers before it starts anew.
KNOWN = 200_000


def words_of(text: str) -> Counter:
    """How often each word, a run of letters, is in the lower-cased text."""
    found = Counter(LETTERS.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


class Grams:
    """n-grams of words as numbers, with what ranks need; remembered for the words seen lately."""

    def __init__(self, profiles: dict[str, dict[str, int]]):
        self.profiles, self.langs = profiles, sorted(profiles)
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.of_word: dict[str, np.ndarray] = {}
        self.tie = np.zeros(1 << 12, np.int64)
        self.rank = np.full((len(self.langs), 1 << 12), LENGTH, np.int64)

    def of(self, word: str) -> np.ndarray:
        found = self.of_word.get(word)
        if found is None:
            found = np.array([self.numbered(g) for g in grams(word)], np.int64)
            if len(word) <= 40:
                self.of_word[word] = found
        return found

    def numbered(self, gram: str) -> int:
        at = self.number.get(gram)
        if at is None:
            at = self.number[gram] = len(self.number)
            if at >= len(self.tie):
                self.tie = np.concatenate([self.tie, np.zeros_like(self.tie)])
                self.rank = np.concatenate([self.rank, np.full_like(self.rank, LENGTH)], axis=1)
            self.tie[at] = crc32(gram.encode("utf-8", "surrogatepass"))
            for k, lang in enumerate(self.langs):
                self.rank[k, at] = self.profiles[lang].get(gram, LENGTH)
        return at

    def distances(self, text: str) -> np.ndarray | None:
        """Out-of-place distance to each language, as a share of the most possible; None without a letter."""
        words = words_of(text)
        if not words:
            return None
        if len(self.number) > KNOWN or len(self.of_word) > KNOWN:
            self.reset()
        lists = [self.of(w) for w in words]
        often = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(x) for x in lists])
        count = np.bincount(np.concatenate(lists), weights=often)
        at = np.flatnonzero(count)
        order = (count[at].astype(np.int64) << 32) + (1 << 32) - 1 - self.tie[at]
        if len(at) > LENGTH:
            top = np.argpartition(-order, LENGTH)[:LENGTH]
            at, order = at[top], order[top]
        at = at[np.argsort(-order, kind="stable")]
        place = np.arange(len(at))
        ranks = self.rank[:, at]
        away = np.where(ranks >= LENGTH, LENGTH, np.abs(ranks - place))
        return away.sum(axis=1) / (LENGTH * len(at))


def grams(word: str) -> list[str]:
    """n-grams of a padded word, n from 1 to GRAM, but for the lone blank."""
    w = f" {word} "
    return [w[i : i + n] for n in range(1, GRAM + 1) for i in range(len(w) - n + 1) if n > 1 or w[i] != " "]


def learn(docs: DataFrame, most: int = MOST_LABELLED) -> dict[str, dict[str, int]]:
    """Rank of each n-gram in the profile of each language of ``docs(doc_id, text, lang)``."""
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", "lang").dropna(subset=["lang"])
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return {}
    shares = spark.createDataFrame([(r["lang"], min(1.0, most / r["n"])) for r in counts], "lang string, share double")
    sample = known.join(F.broadcast(shares), "lang").filter(
        texts.hash_share(F.xxhash64("doc_id", "text"), "langid") < F.col("share")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                words[lang].update(words_of(text or ""))
        for lang, c in words.items():
            total: Counter = Counter()
            for w, n in c.items():
                for g in grams(w):
                    total[g] += n
            if total:
                yield pd.DataFrame({"lang": lang, "gram": list(total), "n": list(total.values())})

    first = Window.partitionBy("lang").orderBy(F.desc("n"), F.crc32(F.col("gram").cast("binary")), "gram")
    top = (
        sample.select("lang", "text")
        .mapInPandas(count, "lang string, gram string, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(first) - 1)
        .filter(F.col("rank") < LENGTH)
    )
    profiles: dict[str, dict[str, int]] = {r["lang"]: {} for r in counts}
    for r in top.select("lang", "gram", "rank").collect():  # LENGTH rows for each language
        profiles[r["lang"]][r["gram"]] = r["rank"]
    return {k: p for k, p in profiles.items() if p}


def identify(docs: DataFrame, profiles: dict[str, dict[str, int]]) -> DataFrame:
    """``docs`` with lang_pred and score, the share of the winner in a soft vote of the distances."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    held: dict = {}

    def of_texts(batch: list[str | None]) -> list:
        if not held:
            held["g"] = Grams(sent.value)
        g = held["g"]
        langs, scores = [], []
        for t in batch:
            d = g.distances(t) if t and g.langs else None
            if d is None:
                langs.append("und")
                scores.append(0.0)
            else:
                vote = np.exp(-20 * (d - d.min()))
                langs.append(g.langs[int(np.argmin(d))])
                scores.append(float(vote.max() / vote.sum()))
        return [langs, scores]

    return texts.add_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], of_texts)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document; a quarter of the rows is held out of learning."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    profiles = learn(docs.filter(~held))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")
