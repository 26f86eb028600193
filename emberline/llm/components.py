"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step replaces links by links to smaller numbers without losing connectivity; when a round changes
nothing, every node is linked to the smallest of its component. Only links are moved, a group never meets
in one task: the minimum of a node's neighbours is combined before the shuffle and sent to the links of a hub. The links after each
step and the smallest neighbours are written to the shared folder, so that a plan is half a step and the driver never plans a whole round at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import scratch, skew


def _least(links: DataFrame) -> DataFrame:
    """a, m, its smallest neighbour, and n, how many it has."""
    return scratch.materialize(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")


def _with_least(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """a, b, and m, the smallest neighbour of a. The hubs, fewer than HOT_SHARE by their counts, are broadcast."""
    limit = max(1, total // skew.HOT_SHARE)
    hubs = F.broadcast(least.filter(F.col("n") > limit).select(F.col("a").alias("hub"), F.col("m").alias("hub_m")))
    tried = links.join(hubs, F.col("a") == F.col("hub"), "left")
    here = tried.filter("hub IS NOT NULL").select("a", "b", F.col("hub_m").alias("m"))
    away = tried.filter("hub IS NULL").select("a", "b").join(least.filter(F.col("n") <= limit).select("a", "m"), "a")
    return here.unionByName(away)


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, _least(both), 2 * total).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """``links`` with a > b: each a and its smaller neighbours go to the smallest of them."""
    least = _least(links)
    moved = _with_least(links, least, total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node with a link; root is the smallest node that it reaches."""
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    now = scratch.materialize(now, "links")
    state = _state(now)
    while True:
        with scratch.Scope(links.sparkSession) as scope:
            starred = scratch.materialize(_large_star(now, state[0]).distinct(), "starred")
            now = scope.keep(scratch.materialize(_small_star(starred, state[0]).distinct(), "links"))
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
