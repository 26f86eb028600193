"""Rows that stay come back with all their columns, whatever these are called and hold."""

import pytest
from emberline.llm import decontaminate, exact_dedup, simhash_dedup, toxicity

NAMES = ["__h", "__i", "__n", "__perhaps", "__s0", "__w0", "__m0", "__k", "__g", "__score", "__leak", "a.b", "row", "i", "n", "size", "perhaps", "kept", "uid", "row_hash", "a`b", "score", "codes"]
PASSAGE = " ".join(f"w{i}" for i in range(40))


@pytest.fixture(scope="module")
def wide(spark):
    columns = ", ".join(f"concat('v', id) AS `{n.replace('`', '``')}`" for n in NAMES)
    return spark.sql(
        f"""SELECT CAST(id % 6 AS BIGINT) AS doc_id, CASE WHEN id < 4 THEN '{PASSAGE}' WHEN id = 9 THEN NULL WHEN id = 8 THEN '' ELSE concat('text ', id % 6) END AS text,
        {columns}, map('k', id) AS m, array(map('x', id)) AS ms FROM range(10)"""
    )


def rows_of(df):
    return sorted(repr(sorted(r.asDict().items(), key=str)) for r in df.collect())


@pytest.mark.parametrize("drop", [exact_dedup.drop_duplicates_of, simhash_dedup.drop_near_duplicates, simhash_dedup.drop_similar])
def test_copies_go_and_columns_stay(wide, drop):
    kept = drop(wide)
    assert kept.columns == wide.columns and kept.schema.simpleString() == wide.schema.simpleString()
    got = rows_of(kept)
    assert set(got) <= set(rows_of(wide)) and len(got) == len(set(got))
    assert sum(PASSAGE in r for r in got) == 1


def test_filters_keep_columns(spark, wide):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert rows_of(toxicity.drop_toxic(wide, none)) == rows_of(wide)
    item = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    clean = decontaminate.drop_contaminated(wide, item)
    assert clean.columns == wide.columns and rows_of(clean) == [r for r in rows_of(wide) if PASSAGE not in r]


def test_one_row_repeated_for_a_third_of_the_table(spark):
    df = spark.sql("SELECT IF(id % 3 = 0, -1, id) AS doc_id, IF(id % 3 = 0, 'the same', concat('text number ', id)) AS text, map('a', 1) AS m FROM range(6000)")
    got = exact_dedup.drop_duplicates_of(df)
    assert got.count() == 4001 and got.filter("doc_id = -1").count() == 1


def test_repeated_ids_do_not_lengthen_the_sample(spark):
    docs = spark.sql("SELECT 5L AS doc_id, 'bad words here' AS text FROM range(4000) UNION ALL SELECT id, 'bad words here' FROM range(100, 140) UNION ALL SELECT id, 'fine words there' FROM range(200, 240)")
    labels = spark.sql("SELECT 5L AS doc_id, CAST(id % 2 AS INT) AS toxic FROM range(500) UNION ALL SELECT id, 1 FROM range(100, 140) UNION ALL SELECT id, 0 FROM range(200, 240)")
    once = toxicity.train(docs.distinct(), labels.groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic"), least=2)
    assert once["feature"] and toxicity.train(docs, labels, least=2) == once
