"""Near-duplicates by SimHash, found with a byte-position inverted index and count filtering.

A fingerprint has 8 bytes at 8 positions. Two fingerprints that differ in at most 3 bits share at least 5
positional bytes; that is the guaranteed minimum of matches. The index has postings under three positional
bytes at once: of any 5 of the 8 positions, 3 lie in the same half, so the 8 triples within the halves
meet every pair that reaches the minimum, at a selectivity of 2**-24 in place of a single byte's 2**-8. For
each pair that a posting proposes the shared positional bytes are tallied, pairs below the minimum go, and the
rest is verified bit by bit.

No posting list is paired that is longer than LONG: a long list is dealt again under one more byte (any
pair that shares 5 shares two more than a triple, and one more than a quadruple), and a list that is still long
under five bytes, so that its members differ in 24 bits only, is linked without pairs: every member is
entered under each value within one and two bit flips, and where a value has a member within one flip, all members
there are within three bits of it and are linked to it; any two members within three bits meet at such
a value. So no link between components is lost and no list grows with the square of its length.

Equal fingerprints are one node, so copies are never paired. Texts are lower-cased in A-Z only and cut at
``[\\x20\\x09-\\x0D]``; shingles are of ``n`` words, repeats counted; fewer words make one shingle, none (or null)
the fingerprint zero, linked like any other. The smallest doc_id (null last) names a component. An empty
table gives an empty result; other columns are kept by ``drop_near_duplicates`` and ignored by ``group``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm import bloom, components, scratch, skew, texts

SEED = 42
BITS_APART = 3
SHARED = 8 - BITS_APART
#: The longest posting list whose members are paired.
LONG = 256
TRIPLES = [sum(0xFF << (8 * i) for i in range(lo, lo + 4) if i != out) for lo in (0, 4) for out in range(lo, lo + 4)]


def fingerprint(text: str | None, n: int) -> int:
    """The SimHash of the word shingles of a text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    firsts = [0, *ends[:-1].tolist()]
    lasts = (ends - 1).tolist()
    n = min(n, len(words))
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(line[a:b], SEED) for a, b in zip(firsts, lasts[n - 1 :])], np.uint64)
    on = np.zeros(64, np.int64)
    for lo in range(0, len(h), 4096):
        on += np.unpackbits(h[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * on > len(h), bitorder="little").view(np.int64)[0])


def add_fingerprint(docs: DataFrame, n: int, name: str) -> DataFrame:
    return texts.add_columns(docs, [T.StructField(name, T.LongType())], lambda batch: [[fingerprint(t, n) for t in batch]])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _shared(a: str, b: str) -> str:
    """SQL for the number of positional bytes that two fingerprints share."""
    return " + ".join(f"CAST((({a} ^ {b}) & {_signed(0xFF << (8 * i))}L) = 0 AS INT)" for i in range(8))


def _pairs(postings: DataFrame, long: int) -> tuple[DataFrame, DataFrame]:
    """Verified links of the lists of at most ``long`` members; the postings of the longer ones.

    The postings of hot lists, fewer than HOT_SHARE by arithmetic, are told by a broadcast of these lists and stay where they are.
    """
    sized = postings.groupBy("mask", "part").agg(F.count("*").alias("n")).filter("n > 1")
    sized = scratch.materialize(sized, "lists")
    limit = max(long, postings.count() // skew.HOT_SHARE)
    hot = F.broadcast(sized.filter(F.col("n") > limit).select("mask", "part"))
    cold = postings.join(hot, ["mask", "part"], "left_anti")
    short = cold.join(sized.filter(F.col("n") <= long).select("mask", "part"), ["mask", "part"])
    a, b = short.withColumnRenamed("f", "a"), short.withColumnRenamed("f", "b")
    links = (
        a.join(b, ["mask", "part"])
        .filter("a < b")
        .filter(F.expr(_shared("a", "b")) >= SHARED)
        .filter(F.bit_count(F.expr("a ^ b")) <= BITS_APART)
        .select("a", "b")
    )
    others = cold.join(sized.filter((F.col("n") > long) & (F.col("n") <= limit)), ["mask", "part"], "left_semi")
    return links, postings.join(hot, ["mask", "part"], "left_semi").unionByName(others)


def _deal_again(postings: DataFrame) -> DataFrame:
    """Postings under one more byte than before."""
    more = F.explode(F.array(*[F.lit(_signed(0xFF << (8 * i))) for i in range(8)]))
    wider = postings.select("f", "mask", more.alias("byte")).filter("(mask & byte) = 0").select("f", F.expr("mask | byte").alias("mask"))
    return wider.distinct().withColumn("part", F.expr("f & mask"))


def _flips(postings: DataFrame) -> DataFrame:
    """Links of lists of any length: members that meet within one flip on one side and two on the other."""
    bit = [_signed(1 << i) for i in range(64)]
    free = F.filter(F.array(*[F.lit(x) for x in bit]), lambda x: x.bitwiseAND(F.col("mask")) == 0)
    p = postings.withColumn("free", free)
    near = p.select("mask", "part", "f", F.explode(F.concat(F.array(F.lit(0).cast("long")), "free")).alias("flip"), "free")
    one = near.select("mask", "part", "f", F.expr("f ^ flip").alias("v"), F.lit(1).alias("d"))
    two = near.filter("flip <> 0").select("mask", "part", "f", "flip", F.explode("free").alias("flip2")).filter("flip < flip2")
    both = one.unionByName(two.select("mask", "part", "f", F.expr("f ^ flip ^ flip2").alias("v"), F.lit(2).alias("d")))
    hub = one.groupBy("mask", "part", "v").agg(F.min("f").alias("b"))
    return both.join(hub, ["mask", "part", "v"]).filter("f <> b").select(F.col("f").alias("a"), "b")


def links(fingerprints: DataFrame, long: int = LONG) -> DataFrame:
    """(a, b) of different fingerprints ``f`` within BITS_APART bits: enough of them to connect every such pair."""
    masks = F.explode(F.array(*[F.lit(_signed(m)) for m in TRIPLES]))
    postings = fingerprints.select("f", masks.alias("mask")).withColumn("part", F.expr("f & mask"))
    found = None
    for _ in range(3):  # under three, four and five bytes
        near, rest = _pairs(postings, long)
        found = near if found is None else found.unionByName(near)
        rest = scratch.materialize(rest, "long")
        if rest.isEmpty():
            return found.distinct()
        postings = scratch.materialize(_deal_again(rest), "postings")
    return found.unionByName(_flips(rest)).distinct()


def group(docs: DataFrame, n: int = 3, long: int = LONG) -> DataFrame:
    """doc_id, row_hash, uid, f (fingerprint), component_id, best (whether the row stands for its component)."""
    rows = docs.select("doc_id", "text", skew.row_hash(docs).alias("row_hash"))
    rows = add_fingerprint(rows, n, "f").drop("text").withColumn("uid", F.monotonically_increasing_id())
    rows = scratch.materialize(rows, "simhash")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    nodes = scratch.materialize(rows.groupBy("f").agg(F.count("*").alias("copies"), F.min(first).alias("first")), "nodes")
    roots = scratch.materialize(components.components(links(nodes.select("f"), long), "a", "b"), "roots")
    rooted = nodes.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    classes = rooted.select("f", "copies", "root").join(best, "root").select("f", "copies", "best")
    return skew.join_groups(rows, classes, "f", "copies", rows.count()).select(
        "doc_id", "row_hash", "uid", "f", F.col("best.doc_id").alias("component_id"), (F.col("uid") == F.col("best.uid")).alias("best")
    )


def drop_near_duplicates(docs: DataFrame, n: int = 3) -> DataFrame:
    """One document of each component, the one of the smallest doc_id, with all its columns."""
    return skew.keep_rows(docs, group(docs, n).select("doc_id", "row_hash", F.col("best").alias("kept")))


#: Fingerprints of a document for copies at a similarity, and the longest list that is paired for them.
SKETCHES, STAR = 6, 16
#: Bits that two of these fingerprints may differ in, if they share SHARED bytes: one more than the minimum of matches is guaranteed for.
NEAR_BITS = BITS_APART + 1
#: Parts that a text's shingles are counted in by their codes, for a bound of what two texts share.
COUNTS = 128
#: Four positions whose numbers cancel under XOR. Three positions leave such a four among the other five, so these 14 meet every pair that shares five.
PLANES = [sum(0xFF << (8 * i) for i in q) for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
#: Links that a copy of a hub's shingles goes to.
SPLIT = 1024
#: The longest list under four bytes whose members are compared in blocks.
WIDE = 1024
#: Members of a list still long under five bytes that all others are verified with first, and the members that a block of a list has on a side.
HUBS, BLOCK = 4, 128


def sketches(text: str | None, k: int = SKETCHES) -> list[int]:
    """``k`` SimHashes of the set of 4-byte runs of a text (A-Z lower-cased, white space collapsed), each under its own hash."""
    b = np.frombuffer(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), np.uint8).astype(np.uint64)
    grams = np.zeros(max(1, len(b) - 3), np.uint64)
    if len(b) >= 4:
        for i in range(4):
            grams = grams * np.uint64(256) + b[i : len(b) - 3 + i]
    grams = np.unique(grams)
    out = []
    for seed in range(k):
        h = (grams + np.uint64(7919 * seed + 1)) * texts.MIX[0]
        for shift, m in ((30, texts.MIX[1]), (27, texts.MIX[2]), (31, texts.MIX[3])):
            h = (h ^ (h >> np.uint64(shift))) * m
        h ^= h >> np.uint64(29)
        on = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * on > len(h), bitorder="little").view(np.int64)[0]))
    return out


def shingle_codes(text: str | None, n: int) -> bytes:
    """The distinct word shingles of a text as sorted 32-bit codes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = min(n, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    h = [xxhash.xxh32_intdigest(line[a : b - 1]) for a, b in zip([0, *ends], ends[n - 1 :])] if n else []
    return np.unique(np.array(h, "<u4")).tobytes()


def shingle_counts(codes: bytes) -> bytes:
    """How many of the codes fall into each of COUNTS parts, in numbers of one, two or four bytes, whichever hold the largest."""
    c = np.bincount(np.frombuffer(codes, "<u4") % COUNTS, minlength=COUNTS)
    return c.astype("u1" if c.max() < 1 << 8 else "<u2" if c.max() < 1 << 16 else "<u4").tobytes()


def shared_at_most(x: bytes, y: bytes) -> tuple[int, int]:
    """From two texts' counts: as many shingles as they can share at most, and how many both have together."""
    p, q = (np.frombuffer(c, f"<u{len(c) // COUNTS}").astype(np.int64) for c in (x, y))
    return int(np.minimum(p, q).sum()), int(p.sum() + q.sum())


def shared_codes(x: bytes, y: bytes) -> tuple[int, int]:
    """From two texts' codes: how many they share, and how many both have together."""
    p, q = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
    return len(np.intersect1d(p, q, assume_unique=True)), len(p) + len(q)


def _close(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate links (a, b) of nodes (id, fs) that are near under one of their fingerprints, and what is left of long lists.

    Near are those that share SHARED positional bytes and differ in NEAR_BITS bits at most. Postings are under the four bytes of each
    of PLANES. All near pairs of lists of at most STAR members are candidates. The members (at, id, large) of lists of at most WIDE come second; the head of a
    list is the member of most long lists, and a member's link to the head of most of its lists is a candidate, one for each member however many lists it is in. Lists
    that are longer are dealt again under one more byte, as comparing all of them grows with the square. The members of those that are still over STAR come second
    too, as large; they have their links to HUBS members among the candidates. Of these, lists of the same members count once.
    """
    masks = F.explode(F.array(*[F.lit(_signed(m)) for m in PLANES]))
    at = F.xxhash64("k", "mask", F.expr("f & mask")).alias("at")
    postings = nodes.select("id", F.posexplode("fs").alias("k", "f")).select("id", "k", "f", masks.alias("mask")).select("id", "k", "f", "mask", at)
    near, rest = _near_pairs(postings)
    some = rest.filter(F.col("n") <= WIDE).select("at", "id")
    lists = some.withColumn("lists", F.count("*").over(Window.partitionBy("id"))).groupBy("at")
    lists = lists.agg(F.max_by("id", F.struct("lists", "id")).alias("b"), F.collect_list("id").alias("ids"))
    heads = lists.select(F.explode("ids").alias("a"), "b").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("lists"))
    stars = heads.groupBy("a").agg(F.max_by("b", F.struct("lists", "b")).alias("b"))
    found, members = near.unionByName(stars), some.withColumn("large", F.lit(False))
    wide = rest.filter(F.col("n") > WIDE)
    if wide.isEmpty():
        return found.distinct(), members
    more = F.explode(F.filter(F.array(*[F.lit(_signed(0xFF << (8 * i))) for i in range(8)]), lambda byte: F.col("mask").bitwiseAND(byte) == 0))
    wider = wide.select("id", "k", "f", "mask", more.alias("byte")).select("id", "k", "f", F.expr("mask | byte").alias("mask"))
    near, rest = _near_pairs(scratch.materialize(wider.distinct().select("id", "k", "f", "mask", at), "postings"))
    hubs = F.array_distinct(F.array(*[F.min_by("id", F.xxhash64("id", F.lit(i))) for i in range(HUBS)]))
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(HUBS))).alias("y")]
    lists = rest.groupBy("at").agg(*same, hubs.alias("hubs")).groupBy("n", "x", "y").agg(F.min(F.struct("at", "hubs")).alias("one"))
    lists = lists.select("one.at", "n", "one.hubs")
    longest = scratch.materialize(skew.join_groups(rest.select("at", "id"), lists, "at", "n", rest.count()), "members")
    own = longest.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("hubs"))).alias("hubs"))  # a hub of many lists goes to a member once
    stars = own.select(F.col("id").alias("a"), F.explode("hubs").alias("b")).filter("a <> b")
    return found.unionByName(near).unionByName(stars).distinct(), members.unionByName(longest.select("at", "id", F.lit(True).alias("large")))


def _near_pairs(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The near pairs (a, b) of lists of at most STAR members, and the postings of longer ones with their length n."""
    lists = scratch.materialize(postings.groupBy("at").agg(F.count("*").alias("n")).filter("n > 1"), "lists")
    bits = bloom.bits_for(lists.count())
    marked = bloom.probe(postings, bloom.of_keys(lists, F.col("at"), bits), F.col("at"), bits, "listed").filter("listed").drop("listed")
    marked = scratch.materialize(marked, "marked")
    long = lists.filter(F.col("n") > STAR)
    bits = bloom.bits_for(long.count())
    marked = bloom.probe(marked, bloom.of_keys(long, F.col("at"), bits), F.col("at"), bits, "long")
    perhaps = scratch.materialize(marked.filter("long").drop("long"), "perhaps")
    few = marked.filter("NOT long").drop("long").join(lists.filter(F.col("n") <= STAR), "at")  # no list of these is large
    listed = scratch.materialize(skew.join_groups(perhaps, lists, "at", "n", perhaps.count()), "listed")
    short = scratch.materialize(few.select(*listed.columns).unionByName(listed.filter(F.col("n") <= STAR)), "short")
    pairs = short.select("at", F.col("id").alias("a"), "f").join(short.select("at", F.col("id").alias("b"), F.col("f").alias("g")), "at")
    both = pairs.filter("a > b").filter(F.expr(_shared("f", "g")) >= SHARED)
    both = both.filter(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= NEAR_BITS).select("a", "b")
    return both, listed.filter(F.col("n") > STAR)


def _forest(pairs: Iterator[tuple[int, int]]) -> list[int]:
    """Which of the links connect all that any of them connects."""
    up: dict[int, int] = {}
    kept = []
    for at, ends in enumerate(pairs):
        a, b = ends
        while a in up:
            a = up[a]
        while b in up:
            b = up[b]
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(at)
    return kept


def _across(members: DataFrame, roots: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The links that reach the similarity between members of a long list in different components (roots: node, root).

    Members outside a list's largest component meet all members, in blocks of about BLOCK by BLOCK: the shingles shuffle once a block. Of
    the links of a block those are returned that connect its components, fewer than its members.
    """
    rooted = members.select("at", "id", "large").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = scratch.materialize(rooted, "rooted")
    parts = rooted.groupBy("at", "large", "root").agg(F.count("*").alias("c"))
    mixed = parts.groupBy("at", "large").agg(F.count("*").alias("parts"), F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("main")).filter("parts > 1")
    mixed = mixed.select("at", "large", "n", F.col("main.root").alias("main"), F.expr(f"ceil((n - main.c) / {BLOCK})").alias("rows"), F.expr(f"ceil(n / {BLOCK})").alias("columns"))
    large, whole = rooted.filter("large").drop("large"), mixed.filter("large").drop("large")
    large = skew.join_groups(large, whole, "at", "n", large.count())
    small = rooted.filter("NOT large").join(mixed.filter("NOT large").drop("large"), "at")  # WIDE rows of a list at most
    m = scratch.materialize(large.unionByName(small.select(*large.columns)), "mixed")
    row, column = F.expr("pmod(xxhash64(id), rows)"), F.expr("pmod(xxhash64(id), columns)")
    few = m.filter("root <> main").select("at", "id", "root", row.alias("p"), F.explode(F.expr("sequence(0L, columns - 1)")).alias("q"), F.lit(True).alias("few"))
    all_ = m.select("at", "id", "root", F.explode(F.expr("sequence(0L, rows - 1)")).alias("p"), column.alias("q"), F.lit(False).alias("few"))
    held = _held(nodes.select("id", "codes"), m.select("id").distinct())
    dealt = few.unionByName(all_).select("id", "root", "few", F.xxhash64("at", "p", "q").alias("block")).join(held, "id")

    def run(block: pa.Table) -> pa.Table:
        is_few = block.column("few").combine_chunks()
        few, every = block.filter(is_few), block.filter(pc.invert(is_few))
        x, y = ([np.frombuffer(c, "<u4") for c in side.column("codes").to_pylist()] for side in (few, every))
        codes = np.unique(np.concatenate([np.zeros(0, "<u4"), *x, *y]))
        shared = np.zeros((len(x), len(y)), np.float32)
        for lo in range(0, len(codes), 4096):  # a slice of the codes at a time, so memory is bounded
            part = codes[lo : lo + 4096]
            on = []
            for sets in (x, y):
                held = np.zeros((len(sets), len(part)), np.float32)
                for i, c in enumerate(sets):
                    held[i, np.searchsorted(part, c[np.searchsorted(c, part[0]) : np.searchsorted(c, part[-1], "right")])] = 1
                on.append(held)
            shared += on[0] @ on[1].T
        sizes = np.add.outer(np.array([len(c) for c in x], float), np.array([len(c) for c in y], float))
        p, q = few.column("root").to_numpy(), every.column("root").to_numpy()
        i, j = np.nonzero((shared >= threshold * (sizes - shared)) & (p[:, None] != q[None, :]))
        kept = _forest(zip(p[i].tolist(), q[j].tolist()))
        i, j = i[kept], j[kept]
        return pa.table({"a": few.column("id").to_numpy()[i], "b": every.column("id").to_numpy()[j]})

    return dealt.groupBy("block").applyInArrow(run, "a long, b long")


def _held(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes (id and another column) that are perhaps among ``ids``."""
    ids = scratch.materialize(ids, "ends")
    bits = bloom.bits_for(ids.count())
    words = scratch.materialize(bloom.of_keys(ids, F.xxhash64("id"), bits), "words")  # once, though the result is read twice
    marked = bloom.probe(nodes, words, F.xxhash64("id"), bits, "linked")
    return marked.filter("linked").drop("linked")


def _tested(links: DataFrame, nodes: DataFrame, column: str, shared: Callable[[bytes, bytes], tuple[int, int]], threshold: float) -> DataFrame:
    """The links whose nodes (id, ``column``) reach the Jaccard similarity by what ``shared`` tells of them.

    A hub's column is copied once for every SPLIT of its links and never broadcast.
    """
    held = _held(nodes.select("id", column), links.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    hubs = links.groupBy("b").agg(F.count("*").alias("n")).withColumn("parts", F.expr(f"(n - 1) div {SPLIT} + 1"))
    hubs = scratch.materialize(hubs, "hubs")
    dealt = skew.join_groups(links, hubs, "b", "n", links.count()).select("a", "b", F.expr("pmod(xxhash64(a), parts)").alias("part"))
    x = held.select(F.col("id").alias("a"), F.col(column).alias("x"))
    y = hubs.join(held.select(F.col("id").alias("b"), F.col(column).alias("y")), "b")
    y = y.select("b", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "y")
    both = dealt.join(x, "a").join(y, ["b", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [shared(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            at = pa.array([i for i, (n, total) in enumerate(told) if n >= threshold * (total - n)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def group_similar(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, row_hash, uid, component_id and best, for copies at ``threshold`` Jaccard similarity of their ``n``-word shingles.

    Such copies differ in more than three bits of one fingerprint, so each document has SKETCHES of them, and every document is
    compared under all: pairs that share SHARED positional bytes of one within NEAR_BITS bits go if the counts of their shingles show that
    they share too few, what is left is verified on the shingles, and long lists are linked through a few of their members and then compared across
    the components that these leave. Every link is verified, and a pair that is near under any fingerprint (so each pair within
    BITS_APART bits) and whose shingles reach the threshold is always in one component; pairs that are near under none are missed.
    Equal texts, told by SHA-256, are one node, numbered by one of its rows.
    """
    kinds = [T.StructField("fs", T.ArrayType(T.LongType())), *(T.StructField(c, T.BinaryType()) for c in ("codes", "counts"))]
    key = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("key")
    rows = docs.select("doc_id", "text", skew.row_hash(docs).alias("row_hash"), key)

    def made(batch: list[str | None]) -> list:
        codes = [shingle_codes(t, n) for t in batch]
        return [[sketches(t) for t in batch], codes, [shingle_counts(c) for c in codes]]

    rows = texts.add_columns(rows, kinds, made).drop("text").withColumn("uid", F.monotonically_increasing_id())
    with texts.small_batches(docs.sparkSession), scratch.Scope(docs.sparkSession) as scope:
        rows = scratch.materialize(rows, "similar")
        first = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
        nodes = rows.groupBy("key").agg(F.count("*").alias("copies"), F.min(first).alias("first"), F.first("fs").alias("fs"))
        nodes = scratch.materialize(nodes.withColumn("id", F.col("first.uid")), "nodes")
        held = rows.select(F.col("uid").alias("id"), "codes", "counts")
        close, members = _close(nodes.select("id", "fs"))
        close = scratch.materialize(close, "close")
        scratch.release(docs.sparkSession)
        perhaps = scratch.materialize(_tested(close, held, "counts", shared_at_most, threshold), "perhaps")
        scratch.release(docs.sparkSession)
        merged = scratch.materialize(_tested(perhaps, held, "codes", shared_codes, threshold), "verified")
        final = components.components(merged, "a", "b")
        if not members.isEmpty():
            stars = final.select(F.col("node").alias("a"), F.col("root").alias("b"))  # as connected as the links, and nearly done
            final = components.components(stars.unionByName(_across(members, final, held, threshold)), "a", "b")
        rooted = nodes.drop("fs").join(final.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        rooted = scratch.materialize(rooted, "rooted")
        best = rooted.groupBy("root").agg(F.min("first").alias("best"))
        classes = rooted.select("key", "copies", "root").join(best, "root").select("key", "copies", "best")
        grouped = skew.join_groups(rows.drop("fs", "codes", "counts"), classes, "key", "copies", rows.count()).select(
            "doc_id", "row_hash", "uid", F.col("best.doc_id").alias("component_id"), (F.col("uid") == F.col("best.uid")).alias("best")
        )
        return scope.keep(scratch.materialize(grouped, "grouped"))


def drop_similar(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each group of :func:`group_similar`, the one of the smallest doc_id, with all its columns."""
    return skew.keep_rows(docs, group_similar(docs, n, threshold).select("doc_id", "row_hash", F.col("best").alias("kept")))
