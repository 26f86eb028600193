import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

from conftest import ROWS
from emberline.llm import bloom, exact_dedup, sharding, skew
from pyspark.sql import functions as F


def packed(text):
    return re.sub(r"[\x20\x09-\x0d]+", "", text or "")


def test_exact_decisions(odd):
    got = exact_dedup.decide(odd).collect()
    assert len(got) == len(ROWS)
    groups = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[hashlib.sha256(packed(text).encode()).hexdigest()].append((-len(text or ""), doc_id is not None, doc_id or 0, doc_id))
    for r in got:
        g = sorted(groups[r.text_sha256], key=lambda x: x[:3])
        assert r.group_size == len(g) and r.keep_id == g[0][3]
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == set(groups) and set(kept.values()) == {1}  # one of each, also of rows that tie in everything


def test_exact_keeps_columns_and_one_of_each(odd):
    kept = exact_dedup.drop_duplicates_of(odd)
    assert kept.columns == odd.columns
    texts = [packed(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({packed(t) for _, t, *_ in ROWS})


def test_repeated_row_that_stays_once(spark):
    df = spark.createDataFrame([(1, "a b", "x")] * 3 + [(2, "c", "x")], "doc_id long, text string, group_size string")
    assert sorted(r.text for r in exact_dedup.drop_duplicates_of(df).collect()) == ["a b", "c"]


def test_exact_empty(empty):
    assert exact_dedup.decide(empty).count() == 0
    assert exact_dedup.drop_duplicates_of(empty).count() == 0


def test_full_filter_loses_nothing(docs):
    full = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.decide(docs, max_bits=bloom.MIN_BITS >> 12).collect()}
    assert full == {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.decide(docs).collect()}


def test_no_python_on_main_path(docs):
    plan = exact_dedup.decide(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_bloom_forms_agree(spark):
    df = spark.range(5000).select(F.xxhash64(F.col("id") % 4000).alias("h"))
    bits = 1 << 17
    words = {r.word: r.mask & (2**64 - 1) for r in bloom.of_keys(df, F.col("h"), bits).collect()}
    octets = bloom.keys_as_bytes(df, F.col("h"), bits)
    whole = b"".join(words.get(i, 0).to_bytes(8, "little") for i in range(bits // 64))
    assert bytes(octets) == whole
    marked = bloom.probe(df, bloom.of_repeats(df, F.col("h"), bits), F.col("h"), bits, "maybe")
    repeated = df.groupBy("h").count().filter("count > 1").select("h")
    assert marked.join(repeated, "h", "left_semi").filter("NOT maybe").count() == 0


def test_hot_groups_join_whole(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    out = skew.join_groups(rows, groups, "k", "n", 3000)
    assert out.count() == 3000 and out.filter("k = 0 AND n = 1000 AND first = 0").count() == 1000


def check_shards(rows, shards, sizes=True):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    counts = [len(by[s]) for s in range(shards)]
    return counts


def test_shards_are_even(docs, odd, empty):
    for df, n in ((docs, 16), (odd, 5)):
        got = sharding.assign(df, n).collect()
        assert len(got) == df.count()
        counts = check_shards(got, n)
        assert max(counts) - min(counts) <= 1
    assert sharding.assign(empty, 4).count() == 0
    text = {i: t or "" for i, t, *_ in ROWS}
    for r in sharding.assign(odd, 5).collect():
        if r.doc_id is not None and r.doc_id != 7:
            assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == crc32(text[r.doc_id].encode())


def test_bounded_loads_and_limited_movement(docs):
    n = docs.count()
    rows = {s: {r.doc_id: r.shard for r in sharding.assign(docs, s, slack=0.25).collect()} for s in (8, 9)}
    for s, at in rows.items():
        assert max(Counter(at.values()).values()) <= -(-1.25 * n // s)
    moved = sum(rows[8][i] != rows[9][i] for i in rows[8])
    assert moved < n / 2  # rehashing would move 8 of 9


def test_overflow_continues_clockwise():
    points = sharding.ring(3, 2)
    cell = points[0][0]
    plan = sharding.plan({cell: 9}, 3, 2, 0.0)
    assert plan[0][3] == points[0][1] and sum(hi - lo for _, lo, hi, *_ in plan) == 9
    assert [p[3] for p in plan] == list(dict.fromkeys(s for _, s in points))


def test_large_cell_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 50)
    df = spark.range(600).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    counts = check_shards(sharding.assign(df, 4).collect(), 4)
    assert counts == [150] * 4
