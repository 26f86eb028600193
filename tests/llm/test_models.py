from zlib import crc32

import numpy as np
import pytest
from conftest import ROWS
from emberline.llm import langid, quality, queries, toxicity


def auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return (pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2


@pytest.fixture(scope="module")
def ten(sf):
    return sf.replace("sf0.001", "sf0.01")


def test_toxicity_holds_out_and_finds(spark, ten):
    got = queries.op2_toxicity(spark, ten).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{ten}/labels.parquet").toPandas().set_index("doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert all(h == (crc32(str(i).encode()) % 5 == 0) for i, h in got.held_out.items())
    assert (got.predicted == (got.score >= 0.5)).all()
    both = got.join(labels, how="inner").query("held_out")
    assert auc(both.score.to_numpy(), both.toxic.to_numpy()) > 0.9


def test_toxicity_ignores_held_out_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (toxicity.score(docs, x).toPandas().sort_values("doc_id") for x in (labels, flipped))
    assert (a.score.to_numpy() == b.score.to_numpy()).all()


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.append(rng.integers(0, 5000, 30), [7] if i % 4 == 0 else [])).astype(int) for i in range(400)]
    at, w, bias = toxicity.fit(rows, np.array([float(i % 4 == 0) for i in range(400)]))
    weights = dict(zip(at.tolist(), w))
    assert weights[7] > 1 and len(weights) < 50 and bias < 0


def test_skip_grams_are_features():
    a, b = toxicity.features("you are so bad"), toxicity.features("you are very bad")
    assert len(np.intersect1d(a, b)) >= 5  # three words, "you are", "are _ bad", "you _ _ bad"


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (8, None), (1, 1)], "doc_id long, toxic int")
    for df in (odd, empty):
        got = toxicity.score(df, labels)
        assert got.count() == df.count()
        assert toxicity.drop_toxic(df, labels.limit(0)).columns == df.columns
        assert toxicity.drop_toxic(df, labels.limit(0)).count() == df.count()
        assert langid.predict(df).count() == df.count()
        ratings = labels.selectExpr("doc_id", "toxic AS grade")
        assert quality.score(df, ratings, 2).count() == df.count()
        assert quality.score(df, ratings.limit(0), 2).filter("expected_grade <> 0").count() == 0


def test_language(spark, ten):
    got = queries.op10_language_id(spark, ten).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{ten}/documents.parquet").toPandas().set_index("doc_id")
    assert all(h == (crc32(str(i).encode()) % 4 == 2) for i, h in got.held_out.items())
    both = got.join(docs.lang)[got.held_out]
    assert (both.lang == both.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_distance_by_brute_force():
    profiles = {"a": {g: i for i, g in enumerate(["e", "th", "the", "x"])}, "b": {"z": 0}}
    got = langid.Grams(profiles).distances("the the e1 x")
    counts = {}
    for w in ("the", "the", "e", "x"):
        for g in langid.grams(w):
            counts[g] = counts.get(g, 0) + 1
    order = sorted(counts, key=lambda g: (-counts[g], crc32(g.encode())))[: langid.LENGTH]
    for k, lang in enumerate("ab"):
        away = sum(abs(i - profiles[lang][g]) if g in profiles[lang] else langid.LENGTH for i, g in enumerate(order))
        assert got[k] == away / (langid.LENGTH * len(order))


def test_language_without_letters(spark, odd):
    got = {r.doc_id: r for r in langid.predict(odd).collect()}
    for i in (4, 5, 6, 10):
        assert got[i].lang_pred == "und" and got[i].score == 0.0
    assert {r.lang_pred for r in got.values()} <= {"und", "en", "fr", "de"}
    assert len(ROWS) == odd.count()


def test_quality(spark, ten):
    got = queries.op9_quality(spark, ten).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{ten}/labels.parquet").toPandas().set_index("doc_id")
    assert len(got) == 1000 and (got.p_at_least_1 >= got.p_at_least_2 - 1e-12).all()
    assert np.allclose(got.expected_grade, got.p_at_least_1 + got.p_at_least_2)
    both = got.join(labels, how="inner").query("held_out")
    assert (both.selected == (both.quality == 1)).mean() > 0.95


def test_cumulative_link_orders_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=600)
    grades = np.digitize(x + rng.normal(scale=0.3, size=600), [-0.5, 0.7])
    w, theta = quality.fit([(np.array([3]), np.array([v])) for v in x], grades, 2)
    assert theta[0] < theta[1] and w[3] > 1
    assert abs(theta[0] / w[3] + 0.5) < 0.3 and abs(theta[1] / w[3] - 0.7) < 0.3


def test_toxicity_sample_is_not_lowered():
    assert toxicity.MOST_LABELLED >= 12_000


def test_numbers_that_look_like_letters_are_none(spark, odd):
    rows = [(i, t, None) for i, t in enumerate(["½ ²", "Ⅷ", "①", "12 ٣", "½a", "ª", "٣ب"])]
    df = odd.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(100 + i, t, la) for i, t, la in rows], "doc_id long, text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df).collect()}
    assert all(got[100 + i] == ("und", 0.0) for i in range(4)) and all(got[100 + i][0] != "und" for i in range(4, 7))
    assert langid.words_of("½a b½b a") == {"a": 2, "b": 2}


def test_rows_without_an_id_do_not_lengthen_the_sample(spark):
    df = spark.sql("SELECT CAST(IF(id % 3 = 0, NULL, 7) AS BIGINT) AS doc_id, concat('word ', CAST(id AS STRING)) AS text, 'en' AS lang FROM range(3000)")
    assert langid.learn(df, 100)["en"]
    share = df.filter(langid.texts.hash_share(langid.F.xxhash64("doc_id", "text"), "langid") < 100 / 3000).count()
    assert 60 < share < 140
