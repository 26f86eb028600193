"""One query for each operator, over the whole table it is meant for, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import (
    centroid_clustering,
    chat_format,
    decontaminate,
    exact_dedup,
    hard_negatives,
    langid,
    packing,
    quality,
    sentence_pieces,
    sharding,
    simhash_dedup,
    substring_dedup,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 of equal counts."""
    return sharding.assign(_table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learnt from the labels that are not held out."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the one of its equal texts that stays."""
    return exact_dedup.decide(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS FIRST) AS k, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT a.doc_id, b.doc_id AS keep_id, a.group_size, a.k = 1 AS kept, a.text_sha256 FROM r a JOIN r b ON a.text_sha256 = b.text_sha256 AND b.k = 1
"""

def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document shares with another, and copies of whole texts."""
    return substring_dedup.passages(_table(spark, sf_dir, "documents"))


#: A conversation made of control strings, which op5 formats besides the table's own.
HARD = r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, read back from the formatted text."""
    own = _table(spark, sf_dir, "conversations")
    hard = spark.sql("SELECT -7L AS conv_id, turn, role FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)").withColumn("text", F.lit(HARD))
    turns = own.select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat_format.digests(chat_format.format_conversations(turns))


OP5_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
w AS (SELECT *, length(role) + length(text) + 15 + (length(text) - length(replace(text, '###', ''))) // 3 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS written FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(written) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, over 3-word shingles."""
    return simhash_dedup.group(_table(spark, sf_dir, "documents"), 3).select(
        "doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id"
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains at 0.8 or more of its 5-word shingles."""
    return decontaminate.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles, count(*) / any_value(item_shingles)::DOUBLE AS containment
FROM bs JOIN ds USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(item_shingles)
"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces, packed into sequences of 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade of every document: 0 poor, 1 sound but toxic, 2 sound; selected from grade 1."""
    labels = _table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", F.expr("quality + quality * (1 - toxic)").alias("grade"))
    return quality.score(_table(spark, sf_dir, "documents"), ratings, 2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by profiles of the rows that are not held out."""
    return langid.predict(_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of 64 components after ten rounds with eight centroids."""
    return centroid_clustering.with_inertia(*centroid_clustering.cluster(_table(spark, sf_dir, "embeddings")))


_ROUND = """
a{n} AS MATERIALIZED (SELECT v.vec_id, v.v, min([list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.v) + list_inner_product(c.v, c.v), c.c]) AS best
  FROM kept v, c{n} c GROUP BY v.vec_id, v.v)"""
_MOVE = """
c{m} AS MATERIALIZED (SELECT p.c, coalesce(n.v, p.v) AS v FROM c{n} p LEFT JOIN (SELECT c, list(x ORDER BY i) AS v
  FROM (SELECT best[2] AS c, i, floor(sum(v[i]) / count(*)) AS x FROM a{n}, range(1, 65) r(i) GROUP BY best[2], i) GROUP BY c) n ON n.c = p.c)"""
OP11_SQL = (
    """
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS DOUBLE) AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 8)),"""
    + ",".join(_ROUND.format(n=n) + "," + _MOVE.format(n=n, m=n + 1) for n in range(10))
    + ","
    + _ROUND.format(n=10)
    + """
SELECT a.vec_id, CAST(best[2] AS INT) AS cluster, CAST(best[1] AS BIGINT) AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a10 a JOIN c10 c ON c.c = best[2]
"""
)


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to pieces and decoded again."""
    made = sentence_pieces.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return made.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score nearly as high as an anchor's positives."""
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved))


OP13_SQL = """
WITH kept AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n USING (anchor_id) WHERE NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 10
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_toxicity,
        op3_exact_dedup,
        op4_substring_dedup,
        op5_chat_format,
        op6_simhash,
        op7_decontamination,
        op8_best_fit_packing,
        op9_quality,
        op10_language_id,
        op11_centroid_clustering,
        op12_sentence_pieces,
        op13_hard_negatives,
    )
}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op5_chat_format": OP5_SQL, "op7_decontamination": OP7_SQL, "op11_centroid_clustering": OP11_SQL, "op13_hard_negatives": OP13_SQL}
