"""All stages in a row, with labels, a benchmark and odd rows, against what each stage must do."""

import corpus_pipeline
import pytest
from emberline.llm import packing

CLEAN = "the quiet river runs past the old mill and the children watch the slow water turn the wheel in the evening light of day"
ITEM = "which of the seven coloured lamps in the great hall was lit by the youngest keeper on the third night of the winter feast"


def text(seed, n=60):
    return " ".join(f"w{(seed * 7919 + k * 104729) % 5000}x{seed}" for k in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(i, f"you are a vile stupid wretched fool number {i % 3} " + text(i, 5), None) for i in range(100)]  # toxic
    rows += [(100 + i, CLEAN + " " + text(100 + i, 30), None) for i in range(100)]  # clean
    copy = text(900)
    rows += [(300, copy, "a"), (301, copy.replace(" ", "  "), "b"), (302, copy, "c"), (302, copy, "c")]  # equal but for blanks; the longest stays
    near = text(901, 300).split()
    rows += [(310, " ".join(near), None), (311, " ".join(near[:150] + ["changed"] + near[151:]), None)]
    rows += [(320, text(902, 40) + " " + ITEM + " " + text(903, 40), None), (321, ITEM, None)]  # contaminated
    rows += [(330, None, None), (331, "", None), (332, " \n ", None), (None, text(904), None), (340, "word " * 6000, None), (341, "x" * 50_000, None)]
    spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100)) for i in range(0, 200)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    for name, schema in (("documents", "doc_id long, text string"), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{at}/none/{name}.parquet")
    return str(at)


def test_each_stage_takes_what_it_must(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "a.b"]
        docs = corpus_pipeline.scratch.materialize(docs, "test")
        left[name] = [r["doc_id"] for r in docs.collect()]
    sound = set(range(100, 200)) | {300, 301, 302, 310, 311, 320, 321, 330, 331, 332, None, 340, 341}
    assert set(left["toxicity"]) == sound and left["toxicity"].count(302) == 2
    assert set(left["exact dedup"]) == sound - {300, 302} - {331, 330} and len(left["exact dedup"]) == len(set(left["exact dedup"]))
    assert set(left["SimHash near-dedup"]) == set(left["exact dedup"]) - {311}
    assert set(left["benchmark decontamination"]) == set(left["SimHash near-dedup"]) - {320, 321}

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    got = corpus_pipeline.run(spark, folder).collect()
    assert spark.conf.get(key) == before
    assert {r["doc_id"] for r in got} == set(left["benchmark decontamination"])
    pieces = packing.pack(docs).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in got) == sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in pieces)


def test_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/none").collect() == []
