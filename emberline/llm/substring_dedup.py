"""Near-duplicate passages across documents, by compact windows over min-hashes.

A document is its sequence of word shingles (``n`` words; words are runs of letters, digits and ``_``,
lower-cased). For one hash function, all subsequences that share their smallest shingle hash and lie around
its place c form a compact window [l, r]: the Cartesian tree of the hashes has one for each node, and only nodes
at least ``width`` shingles wide are made, about 2/width of the shingles. Two passages of that width and
similarity s meet under one hash function with probability s, and surely if they are equal.

1. Equal texts become one document, with membership in the result, so copies are never compared.
2. A first pass makes the window keys (function and smallest shingle), and those that occur in two documents make a
   Bloom filter. The filter has a fixed greatest size; a full one lets more keys through and loses none.
3. A second pass makes the windows again and keeps those whose key the filter holds, as narrow rows: the key together
   with the NEXT shingles on either side of c.
4. Interval joins: windows meet by key and the NEXT shingles on one side. Every window is joined with the first one of
   its group, never with all, so a passage in n documents gives n - 1 pairs however many share it. A third pass fetches
   the shingles around c for the windows of such groups alone.
5. Verification lays the two intervals along the diagonal of their common shingle, shingles matching within
   DRIFT places, and looks for a run of ``width`` around c with Jaccard similarity ``threshold`` or more.
6. A group of which a member does not match its first is dealt again, all members of it: where the half passage before or
   after c repeats, by every whole run of ``width`` shingles around c, so that members are equal there and the first stands
   for all; and by two blocks of shingles beside c, with anything between. Runs that overlap become one passage.

So no link between equal passages is lost, whatever the first document of a group holds besides: two that share a
passage share a run of ``width`` around the same c, therefore a half of it, and therefore the NEXT shingles on that side.
Passages that differ (at 0.8 and this width by one changed, new or missing word) are found under a function whose c lies
at least NEXT shingles inside the equal part on one side, if the group's first matches or two blocks of the passage are equal
and the first of theirs matches; tests/llm measures how many are missed.
A shift of more than DRIFT places changes more shingles than the threshold allows, so none is cut off by it. Shingles
are compared by 16 bits; that 41 of 46 match by chance where 40 do has a probability below 0.002.

The result has pairs of a document and the first document that holds the passage (by doc_id), with the
words of the passage in the former: doc_id, match_doc_id, first_word, end_word, similarity; and for
copies of a whole text (white space aside) one row with similarity 1, from word 0 to its end (end_word null).
Texts without a partner have no row; empty and null texts are copies of each other. Documents of fewer than
``width`` + ``n`` - 1 words are only compared as wholes. Null doc_ids sort first. Passages repeated inside one
document alone are not reported. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm import bloom, exact_dedup, scratch, skew, texts
from emberline.llm.decontaminate import rolled

HASHES = 3
#: Shingles beside the smallest one that two windows must share on one side in order to meet.
NEXT = 6
DRIFT = 8


def compact_windows(h: np.ndarray, lo: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c and r of each subtree of the Cartesian trees over the spans [lo, end) of ``h`` with ``width`` places or more.

    All spans go down one level of their trees at a time. Among equal smallest values the middle one is the
    root, so repeated shingles keep a tree flat.
    """
    left, root, right = [], [], []
    while True:
        wide = end - lo >= width
        lo, end = lo[wide], end[wide]
        if not len(lo):
            break
        size = end - lo
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(lo - first, size)
        v = h[at]
        least = np.flatnonzero(v == np.repeat(np.minimum.reduceat(v, first), size))
        same = np.bincount(np.repeat(np.arange(len(lo)), size)[least], minlength=len(lo))
        c = at[least[np.cumsum(same) - same + same // 2]]
        left.append(lo)
        root.append(c)
        right.append(end - 1)
        lo, end = np.concatenate([lo, c + 1]), np.concatenate([c, end])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in (left, root, right))


def windows(batch: list[str | None], n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingle codes of all texts in a row, where each text begins, and the columns text, key, l, c, r, place of all windows.

    The place tells c within its text and the function.
    """
    codes, size = texts.word_codes(batch)
    begin = np.cumsum(size) - size
    if len(codes) < n:
        return np.zeros(0, np.uint64), begin, np.zeros((6, 0), np.int64)
    s = rolled(codes, n)  # those across two texts are in no span
    out = []
    for i in range(HASHES):
        x = (s ^ texts.MIX[i]) * texts.MIX[i + 1]
        x = (x ^ (x >> np.uint64(31))) * texts.MIX[4]
        l, c, r = compact_windows(x, begin, np.maximum(begin, begin + size - n + 1), width)
        of = np.searchsorted(begin, l, "right") - 1
        out.append(np.vstack([of, (x[c] ^ np.uint64(i)).view(np.int64), l, c, r, (c - begin[of]) * HASHES + i]))
    return s, begin, np.concatenate(out, axis=1)


def _window_id(uid: np.ndarray, place: np.ndarray) -> np.ndarray:
    x = uid.view(np.uint64) ^ (place.view(np.uint64) + np.uint64(1)) * texts.MIX[0]
    x = (x ^ (x >> np.uint64(31))) * texts.MIX[1]
    return (x ^ (x >> np.uint64(30))).view(np.int64)


def _keys(docs: DataFrame, n: int, width: int) -> DataFrame:
    """The distinct window keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, texts.SLICE):
                w = windows(whole.slice(lo, texts.SLICE).column(0).to_pylist(), n, width)[2]
                order = np.lexsort((w[1], w[0]))
                of, key = w[0, order], w[1, order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[new])], names=["key"])

    return docs.select("text").mapInArrow(run, "key long")


def _probe(filled: bytes, bits: int):
    """A function that tells which keys a filter of :func:`bloom.keys_as_bytes` perhaps holds."""
    octets = np.frombuffer(filled, np.uint8)

    def perhaps(keys: np.ndarray) -> np.ndarray:
        k = np.ascontiguousarray(keys).view(np.uint64)
        a, b = (((k >> np.uint64(z)) & np.uint64(bits - 1)).astype(np.int64) for z in (32, 0))
        return (octets[a >> 3] >> (a & 7).astype(np.uint8) & octets[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)

    return perhaps


def _beside(s: np.ndarray, w: np.ndarray, begin: np.ndarray, n: int, many: int) -> list[pa.Array]:
    """Hashes of a window's key with the ``many`` shingles before c, and with those after it; null where the text has fewer."""
    of, key, c = w[0], w[1].view(np.uint64), w[3]
    runs = rolled(s, many) if len(s) >= many else np.zeros(1, np.uint64)
    last = np.append(begin[1:], len(s) + n - 1)[of] - n  # last shingle of the text
    out = []
    for side, at, whole in ((1, c - many, c - many >= begin[of]), (2, c + 1, c + many <= last)):
        x = (runs[np.clip(at, 0, len(runs) - 1)] ^ key) * texts.MIX[3] + np.uint64(side)
        out.append(pa.array(((x ^ (x >> np.uint64(32))) * texts.MIX[2]).view(np.int64), mask=~whole))
    return out


def _postings(docs: DataFrame, n: int, width: int, filled: bytearray, bits: int) -> DataFrame:
    """wid, uid, doc_id, and the keys left and right of c, of windows whose key may repeat."""
    sent = docs.sparkSession.sparkContext.broadcast(bytes(filled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perhaps = _probe(sent.value, bits)
        for whole in batches:
            for lo in range(0, whole.num_rows, texts.SLICE):
                batch = whole.slice(lo, texts.SLICE)
                s, begin, w = windows(batch.column(2).to_pylist(), n, width)
                w = w[:, perhaps(w[1])]
                of, take = w[0], pa.array(w[0])
                uid = np.array(batch.column(0))[of]
                sides = _beside(s, w, begin, n, NEXT)
                yield pa.RecordBatch.from_arrays([pa.array(_window_id(uid, w[5])), pa.array(uid), batch.column(1).take(take), *sides], names=["wid", "uid", "doc_id", "left", "right"])

    return docs.select("uid", "doc_id", "text").mapInArrow(run, "wid long, uid long, doc_id long, left long, right long")


def _near(docs: DataFrame, n: int, width: int, filled: bytearray, bits: int) -> DataFrame:
    """wid, uid, place, the keys of the half passages, and the shingles around c (0 outside the window), of windows that ``filled`` perhaps holds."""
    sent = docs.sparkSession.sparkContext.broadcast(bytes(filled))
    side = width - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perhaps = _probe(sent.value, bits)
        for whole in batches:
            for lo in range(0, whole.num_rows, texts.SLICE):
                batch = whole.slice(lo, texts.SLICE)
                s, begin, w = windows(batch.column(1).to_pylist(), n, width)
                uid = np.array(batch.column(0))[w[0]]
                wid = _window_id(uid, w[5])
                wanted = perhaps(wid)
                w, uid, wid = w[:, wanted], uid[wanted], wid[wanted]
                _, _, l, c, r, place = w
                short = np.append((s >> np.uint64(48)).astype("<u2") | np.uint16(1), np.uint16(0))  # 0 stands for no shingle
                around = c[:, None] + np.arange(-side, side + 1)
                near = short[np.where((around >= l[:, None]) & (around <= r[:, None]), around, -1)]
                size = near.shape[1] * 2
                packed = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer((np.arange(len(c) + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(near.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wid), pa.array(uid), pa.array(place), *_beside(s, w, begin, n, width // 2), packed], names=["wid", "uid", "place", "left", "right", "near"]
                )

    return docs.select("uid", "text").mapInArrow(run, "wid long, uid long, place long, left long, right long, near binary")


def verify(near: np.ndarray, first: np.ndarray, width: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of aligned shingles: begin and end of the best passage around the middle, and its similarity (0: none).

    A run of ``width`` with m matching shingles has the Jaccard similarity m / (2 * width - m).
    """
    match = np.zeros(near.shape, bool)
    for d in range(-DRIFT, DRIFT + 1):
        a, b = max(0, d), near.shape[1] + min(0, d)
        match[:, a:b] |= near[:, a:b] == first[:, a - d : b - d]
    match &= near != 0
    sums = np.concatenate([np.zeros((len(near), 1), np.int64), match.cumsum(axis=1)], axis=1)
    m = sums[:, width:] - sums[:, :-width]  # runs that begin at 0 ... width - 1, all of them around the middle
    similar = m / (2 * width - m)
    full = np.concatenate([np.zeros((len(near), 1), np.int64), (near != 0).cumsum(axis=1)], axis=1)
    good = (similar >= threshold) & (full[:, width:] - full[:, :-width] == width)  # inside the interval from end to end
    begin = good.argmax(axis=1)
    end = good.shape[1] - 1 - good[:, ::-1].argmax(axis=1) + width
    return begin, end, np.where(good.any(axis=1), np.where(good, similar, 0.0).max(axis=1), 0.0)


def _members(posted: DataFrame) -> DataFrame:
    """``posted`` (wid, uid, doc_id, at) in groups that two documents share, with their size n and first window."""
    first = F.min(F.struct("doc_id", "uid", "wid"))
    groups = posted.groupBy("at").agg(F.count("*").alias("n"), first.alias("first"), (F.min("uid") != F.max("uid")).alias("shared"))
    return skew.join_groups(posted, groups.filter("shared").drop("shared"), "at", "n", posted.count())


def _pairs(members: DataFrame) -> DataFrame:
    """Each window once with each first that it has, and those of its groups that others are in too."""
    both = members.filter(F.col("uid") != F.col("first.uid")).select("wid", "uid", "doc_id", F.col("first.wid").alias("first_wid"), F.col("first.doc_id").alias("match_doc_id"), "at", "n")
    ats = F.collect_list(F.when(F.col("n") > 2, F.col("at"))).alias("ats")
    return both.groupBy("wid", "first_wid").agg(*[F.first(x).alias(x) for x in ("uid", "doc_id", "match_doc_id")], ats)


def _of(near: DataFrame, wids: DataFrame) -> DataFrame:
    """The rows of ``near`` whose wid is perhaps among ``wids``, by a filter, so that the others do not shuffle."""
    wids = scratch.materialize(wids.distinct(), "wids")
    bits = bloom.bits_for(wids.count())
    return bloom.probe(near, bloom.of_keys(wids, F.col("wid"), bits), F.col("wid"), bits, "wanted").filter("wanted").drop("wanted")


def _verified(pairs: DataFrame, near: DataFrame, n: int, width: int, threshold: float) -> DataFrame:
    """wid, uid, doc_id, match_doc_id, first_word, end_word, similarity (0: no match) and ats of the pairs."""
    side = width - 1
    near = near.select("wid", "uid", "place", "near")
    twin = near.select(F.col("wid").alias("first_wid"), F.col("near").alias("near2"))
    firsts = pairs.groupBy("first_wid").agg(F.count("*").alias("n")).join(twin, "first_wid")
    own = pairs.join(near.withColumnRenamed("uid", "own_uid"), "wid").filter("uid = own_uid")
    columns = ["wid", "uid", "doc_id", "match_doc_id", "place", "near", "near2", "ats"]
    both = skew.join_groups(own.select(*columns[:6], "first_wid", "ats"), firsts, "first_wid", "n", pairs.count()).select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                mine, first = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(b.num_rows, -1) for k in (5, 6))
                begin, end, similar = verify(mine, first, width, threshold)
                c = np.array(b.column(4)) // HASHES
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k) for k in range(4)), pa.array(c + begin - side, pa.int32()), pa.array(c + end - side + n - 1, pa.int32()), pa.array(similar), b.column(7)],
                    names=["wid", "uid", "doc_id", "match_doc_id", "first_word", "end_word", "similarity", "ats"],
                )

    return both.mapInArrow(run, "wid long, uid long, doc_id long, match_doc_id long, first_word int, end_word int, similarity double, ats array<long>")


def _posted(windows: DataFrame, *keys: str) -> DataFrame:
    """wid, uid, doc_id, at: each window under each of its keys."""
    return windows.select("wid", "uid", "doc_id", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("at"))


def _whole_runs(width: int):
    """Keys of all runs of ``width`` shingles around c that lie in the window, from ``near``."""
    there = lambda p: F.substr("near", 2 * p + 1, F.lit(2)) != F.lit(bytes(2))
    starts = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda p: there(p) & there(p + (width - 1)))
    return F.transform(starts, lambda p: F.xxhash64(F.substr("near", 2 * p + 1, F.lit(2 * width)), p))


def _two_blocks(width: int):
    """Keys of c with two blocks of a fifth of the width beside it, at most ``width`` and more than half of it apart, from ``near``.

    A run of ``width`` around c holds four whole blocks, and a changed word breaks two neighbours of them at most.
    """
    side = width - 1
    size = side // 5
    at = {b: side - size * b if b > 0 else side + 1 - size * (b + 1) for b in range(-5, 6) if b}  # 1 to 5 before c, -1 to -5 after it
    pairs = []
    for a in at:
        for b in at:
            span = max(at[a] + size - 1, at[b] + size - 1, side) - min(at[a], at[b], side) + 1
            if a < b and width // 2 + 4 < span <= width:
                pairs.append((at[a], at[b]))
    edge = lambda p: (F.substr("near", 2 * p + 1, F.lit(2)) != F.lit(bytes(2))) & (F.substr("near", 2 * (p + size) - 1, F.lit(2)) != F.lit(bytes(2)))
    known = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    cut = lambda p, many: F.substr("near", 2 * p + 1, F.lit(2 * many))
    return F.transform(F.filter(known, lambda x: edge(x["a"]) & edge(x["b"])), lambda x: F.xxhash64(x, F.col("place") % HASHES, cut(F.lit(side), 1), cut(x["a"], size), cut(x["b"], size)))


def _dealt_again(runs: DataFrame, members: DataFrame, near: DataFrame, width: int) -> DataFrame:
    """The pairs, by whole runs and by two blocks, of windows that failed in a group with any member of it.

    Members that matched are dealt under the keys of those that failed only; a group of two has nothing left to compare.
    """
    failed = runs.filter("similarity = 0 AND size(ats) > 0")
    bad = failed.select(F.explode("ats").alias("at")).distinct().join(members.groupBy("at").agg(F.count("*").alias("n")), "at")
    again = skew.join_groups(members.select("wid", "uid", "doc_id", "at"), bad, "at", "n", members.count())
    again = again.select("wid", "uid", "doc_id").distinct().join(failed.select("wid", F.lit(True).alias("failed")).distinct(), "wid", "left")
    again = scratch.materialize(again, "again")
    near = _of(near, again.select("wid")).select("wid", F.col("uid").alias("own_uid"), "place", "left", "right", "near")
    again = scratch.materialize(again.join(near, "wid").filter("uid = own_uid").drop("own_uid"), "again")
    # one function is enough for equal passages, as every run of shingles has one smallest place under each
    one = again.filter(F.col("place") % HASHES == 0)
    halves = _members(_posted(one, "left", "right")).select("wid").distinct()
    whole = one.join(halves, "wid").select("wid", "uid", "doc_id", "failed", F.explode(_whole_runs(width)).alias("at"))
    blocks = again.select("wid", "uid", "doc_id", "failed", F.explode(_two_blocks(width)).alias("at"))
    both = whole.unionByName(blocks)
    mine = scratch.materialize(both.filter("failed").drop("failed"), "failed")
    bits = bloom.bits_for(mine.count())
    others = bloom.probe(both.filter("failed IS NULL").drop("failed"), bloom.of_keys(mine, F.col("at"), bits), F.col("at"), bits, "wanted")
    return _pairs(_members(scratch.materialize(mine.unionByName(others.filter("wanted").drop("wanted")), "dealt")))


def passages(docs: DataFrame, n: int = 5, width: int = 46, threshold: float = 0.8, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """doc_id, match_doc_id, first_word, end_word and similarity for passages of ``width`` + ``n`` - 1 words or more."""
    spark = docs.sparkSession
    table = scratch.materialize

    def held(keys: DataFrame, key: str) -> tuple[bytearray, int]:
        keys = table(keys, "keys")
        bits = bloom.bits_for(keys.count(), most=max_bits)
        return bloom.keys_as_bytes(keys, F.col(key), bits), bits

    with scratch.Scope(spark) as all_:
        with scratch.Scope(spark) as scope:
            whole = exact_dedup.decide(docs.select("doc_id", "text")).select("doc_id", "row_hash", "kept", "keep_id")
            decisions = scope.keep(all_.keep(table(whole, "copies")))
        single = skew.keep_rows(docs.select("doc_id", "text"), decisions.select("doc_id", "row_hash", "kept"))
        single = single.withColumn("uid", F.xxhash64("doc_id", "text"))  # each text once, so no copy of the texts is written
        with scratch.Scope(spark) as scope:
            keys = _keys(single, n, width).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
            found = table(_postings(single, n, width, *held(keys, "key")), "postings")
            members = scope.keep(table(_members(_posted(found, "left", "right")), "members"))
        near = table(_near(single, n, width, *held(members.select("wid").distinct(), "wid")), "near")
        with scratch.Scope(spark) as scope:
            first = scope.keep(all_.keep(table(_verified(table(_pairs(members), "pairs"), near, n, width, threshold), "runs")))
        with scratch.Scope(spark) as scope:
            pairs = scope.keep(table(_dealt_again(first, members, near, width), "pairs"))
        some = _of(near, pairs.select(F.explode(F.array("wid", "first_wid")).alias("wid")))
        second = all_.keep(table(_verified(pairs, some, n, width, threshold), "runs"))
    runs = first.unionByName(second).filter("similarity > 0").drop("wid", "ats")

    by = Window.partitionBy("uid", "match_doc_id").orderBy("first_word", "end_word")
    reach = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    joined = (
        runs.distinct()
        .withColumn("new", F.coalesce(F.col("first_word") > reach, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("uid", "doc_id", "match_doc_id", "run")
        .agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.max("similarity").alias("similarity"))
        .drop("uid", "run")
    )
    copies = decisions.filter("NOT kept").select(
        "doc_id", F.col("keep_id").alias("match_doc_id"), F.lit(0).alias("first_word"), F.lit(None).cast("int").alias("end_word"), F.lit(1.0).alias("similarity")
    )
    return joined.unionByName(copies)
