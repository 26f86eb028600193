"""Joins that stay even when one group holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm import bloom, scratch

#: A group is hot above this share of all rows, so there are fewer than 1000 hot groups at any size. One of at most FEW rows is never hot.
HOT_SHARE, FEW = 1000, 64


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with the one row of ``groups`` that has their ``key``.

    ``size`` counts a group's rows among ``total``. Hot groups, fewer than HOT_SHARE by arithmetic, are
    broadcast, so their rows stay where they are; the rest shuffles by key and no key of it is large. Where none is hot,
    ``rows`` are read once and nothing is broadcast.
    """
    if not hasattr(groups, "_scratch_path"):
        groups = scratch.materialize(groups, "groups")
    least = max(FEW, total // HOT_SHARE)
    if (groups.agg(F.max(size)).first()[0] or 0) <= least:
        held = groups.withColumnRenamed(key, "__k")
        joined = rows.join(held, F.col(key).eqNullSafe(F.col("__k")), how)
        return joined.select(*rows.columns, *[c for c in groups.columns if c != key])
    hot = groups.filter(F.col(size) > least)
    named = F.broadcast(hot.select(F.col(key).alias("__k"), F.struct(*[c for c in groups.columns if c != key]).alias("__g")))
    tried = rows.join(named, F.col(key).eqNullSafe(F.col("__k")), "left")
    rest = [c for c in groups.columns if c != key]
    here = tried.filter("__g IS NOT NULL").select(*rows.columns, *[F.col(f"__g.{c}").alias(c) for c in rest])
    cold = groups.filter(F.col(size) <= least).withColumnRenamed(key, "__k")
    away = tried.filter("__g IS NULL").drop("__k", "__g")
    joined = away.join(cold, F.col(key).eqNullSafe(F.col("__k")), how).drop("__k")
    return here.unionByName(joined.select(*here.columns))


def quoted(name: str) -> str:
    """A column's name as SQL reads it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def row_hash(df: DataFrame) -> Column:
    """One number for the content of a row, over all its columns. Maps, which have no hash, count as JSON."""
    of = lambda f: F.to_json(F.struct(F.col(quoted(f.name)).alias("x"))) if _has_map(f.dataType) else F.col(quoted(f.name))
    return F.xxhash64(*map(of, df.schema.fields))


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions(doc_id, row_hash, kept)`` keeps.

    A Bloom filter of the identities that lose a row lets every other document pass without a shuffle.
    Rows that are identical in all columns are interchangeable: as many of them stay as are kept. The columns travel
    inside a struct, so no name of theirs meets one that is used here.
    """
    lost = scratch.materialize(
        decisions.groupBy(F.xxhash64("doc_id", "row_hash").alias("i"))
        .agg(F.count_if("kept").alias("n"), F.count("*").alias("size"))
        .filter("n < size"),
        "lost",
    )
    bits = bloom.bits_for(lost.count())
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")
    packed = docs.select(row, F.xxhash64("doc_id", row_hash(docs)).alias("i"))
    words = scratch.materialize(bloom.of_keys(lost, F.col("i"), bits), "words")  # once, though the rows are read several times
    marked = bloom.probe(packed, words, F.col("i"), bits, "perhaps")
    total, some = lost.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    tried = join_groups(marked.filter("perhaps").drop("perhaps"), lost, "i", "size", total, "left")
    free = marked.filter(~F.col("perhaps")).select("row").unionByName(tried.filter("n IS NULL").select("row"))
    if not some:
        return free.select("row.*")
    twins = tried.filter("n > 0").groupBy("i").agg(F.first("row").alias("row"), F.first("n").alias("n"))  # identical rows, some of them kept
    twins = twins.select(F.explode(F.expr("array_repeat(row, CAST(n AS INT))")).alias("row"))
    return free.unionByName(twins).select("row.*")
