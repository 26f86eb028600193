"""Exact deduplication by two passes over a Bloom filter.

Pass 1 counts, for each position of the filter, the rows that hit it; positions hit twice make a filter
of hashes that are possibly repeated. Pass 2 probes every row against it: rows that certainly have no
equal pass straight through, and only the rest shuffle to be grouped. A false "perhaps" costs a shuffled
row and never changes the result. All steps are DataFrame functions.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``; a null text counts
as empty, and all empty texts are equal. Of equal texts the row with the most code points in its original
text stays, then the smallest doc_id (null first); of rows that tie in both exactly one stays. An empty
table gives an empty result. Further columns, whatever their names, are carried by ``drop_duplicates_of``
and ignored by ``decide``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import bloom, scratch, skew

WHITE = r"[\x20\x09-\x0D]+"


def _digests(docs: DataFrame) -> DataFrame:
    """A narrow row for each document, with an id of its own that is fixed once written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    packed = F.regexp_replace(text, WHITE, "")
    return docs.select(
        "doc_id",
        F.char_length(text).alias("n_points"),
        F.sha2(packed, 256).alias("text_sha256"),
        F.xxhash64(packed).alias("h"),
        skew.row_hash(docs).alias("row_hash"),
        F.monotonically_increasing_id().alias("uid"),
    )


def decide(docs: DataFrame, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """One row for each document: doc_id, row_hash, uid, keep_id, group_size, kept, text_sha256."""
    rows = scratch.materialize(_digests(docs), "exact")
    total = rows.count()
    bits = bloom.bits_for(total, most=max_bits)
    h = F.col("h")
    marked = bloom.probe(rows, bloom.of_repeats(rows, h, bits), h, bits, "perhaps")
    alone = marked.filter(~F.col("perhaps")).select(
        "doc_id", "row_hash", "uid", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    perhaps = marked.filter("perhaps").select("doc_id", "row_hash", "uid", "n_points", "text_sha256")
    groups = perhaps.groupBy("text_sha256").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct(-F.col("n_points"), "doc_id", "uid")).alias("best"),
    )
    grouped = skew.join_groups(perhaps, groups, "text_sha256", "group_size", total).select(
        "doc_id", "row_hash", "uid", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256",
    )
    return alone.unionByName(grouped)


def drop_duplicates_of(docs: DataFrame) -> DataFrame:
    """The documents of which :func:`decide` says kept, with all their columns."""
    return skew.keep_rows(docs, decide(docs).select("doc_id", "row_hash", "kept"))
