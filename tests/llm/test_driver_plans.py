"""Plans of the near stage stay small, as the driver holds each of them whole; rows are the same with and without hot groups."""

from collections import Counter

import pytest
from emberline.llm import components, scratch, skew


@pytest.fixture
def exchanges(monkeypatch):
    """The number of exchanges in the plan of each table that is written."""
    found, write = [], scratch.materialize

    def counted(df, label):
        found.append((df._jdf.queryExecution().executedPlan().toString().count("Exchange"), label))
        return write(df, label)

    monkeypatch.setattr(scratch, "materialize", counted)
    return found


def test_a_round_of_components_is_no_single_plan(spark, exchanges):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 180)], "a long, b long")
    got = {r.node: r.root for r in components.components(links, "a", "b").collect()}
    assert got == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 180)}
    assert max(exchanges)[0] <= 10, max(exchanges)


@pytest.mark.parametrize("copies", [3, skew.FEW + 40])
def test_kept_rows_with_and_without_hot_groups(spark, exchanges, copies):
    rows = [(1, "a")] * copies + [(2, "b")] * 2 + [(k, "c") for k in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keep = {1: 2, 2: 0}  # of rows that are identical two stay, or none
    at, kept = Counter(), []
    for doc_id, _ in rows:
        at[doc_id] += 1
        kept.append((doc_id, at[doc_id] <= keep.get(doc_id, 1)))
    kept = spark.createDataFrame([(r.doc_id, r.row_hash, k) for r, (_, k) in zip(docs.withColumn("row_hash", skew.row_hash(docs)).collect(), kept)], "doc_id long, row_hash long, kept boolean")
    assert Counter(r.doc_id for r in skew.keep_rows(docs, kept).collect()) == {1: 2} | {k: 1 for k in range(3, 40)}
    none = kept.withColumn("kept", kept.doc_id > 2)
    out = skew.keep_rows(docs, none)
    assert Counter(r.doc_id for r in out.collect()) == {k: 1 for k in range(3, 40)}
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 20


@pytest.mark.parametrize("copies", [3, skew.FEW + 40])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_joined_groups_with_and_without_hot_groups(spark, copies, how):
    rows = spark.createDataFrame([(None, 0)] * copies + [(7, 1)] * 2 + [(8, 2)], "k long, x int")
    groups = spark.createDataFrame([(None, copies, "null"), (7, 2, "seven")], "k long, n long, g string")
    got = Counter((r.k, r.x, r.g) for r in skew.join_groups(rows, groups, "k", "n", copies + 3, how).collect())
    assert got == {(None, 0, "null"): copies, (7, 1, "seven"): 2} | ({(8, 2, None): 1} if how == "left" else {})
