"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token pieces of at most ``capacity`` tokens (only longer documents are cut), and pieces are packed
into sequences of that capacity. Packing depends on lengths alone, so what reaches the driver is the number
of pieces of each length: at most ``capacity`` numbers, whatever the input. On these counts

1. dominance fixes sequences for good, all equal ones at once: for a length taken from the largest down, a
   set that no alternative can beat - the length alone if nothing else fits; with the largest other that
   fits if that fills the sequence, if only one more piece could fit, or if at most two more could fit and
   that one is at least as long as the longest such pair;
2. the rest, a smaller instance, is packed best-fit from the largest length down, again all equal
   sequences at once.

The result is a list of patterns with multiplicities. Each piece finds its place by its rank among the pieces
of its length; a length that many pieces share is ranked in parts, a few for each task, so it does not meet in one.

A null or empty text is one piece, the end token alone. Repeated rows are packed one by one. Null doc_ids are
kept. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm import scratch

CAPACITY = 4096
END = 1
#: Pieces of one length that are ranked together at least, and parts for each shuffle partition.
PART, PARTS = 256, 4
#: Bytes of the texts that are tokenised together, but for a longer one alone.
SLICE = 8 << 20
_TOKENIZERS: dict = {}


class Chunks:
    """Token ids of texts as little-endian bytes; what stands between blanks is remembered for a while.

    This tokenizer drops white space and never joins across it, so such chunks are tokenised alone, and each distinct
    one of a batch once. Chunks of printable ASCII and Latin-1 letters, which normalising only lower-cases, are cut to
    words all together, and new words go to the tokenizer's model; any other chunk goes through the whole tokenizer.

    A table of over MOST entries becomes the older of two; what is seen again moves to the younger, so frequent entries stay.
    """

    MOST = 3 << 16
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    LINE = re.compile(r"[ -~À-ÖØ-öø-ÿ]*")
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]| |[^a-z0-9ß-öø-ÿ ]+")
    #: Between the chunks of a line; no id, and ids are below 2^16, so it is found at no other place of their bytes.
    BLANK = b"\xff\xff\xff\xff"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in [*range(0x21, 0x7F), *range(0xDF, 0x100)]}
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {" ": self.BLANK}
        self.older_chunks: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    @staticmethod
    def absent(keys: Iterable[str], table: dict[str, bytes], older: dict[str, bytes]) -> list[str]:
        """The keys that neither table holds; what the older one alone holds is copied to ``table``."""
        new = [k for k in keys if k not in table]
        table.update((k, older[k]) for k in new if k in older)
        return [k for k in new if k not in older]

    def word(self, word: str) -> bytes:
        written = word if word.isascii() else word.translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(written)])

    def add(self, new: list[str]) -> None:
        """Puts chunks into the table."""
        plain, line = new, " ".join(new)
        if "<|" in line or not self.LINE.fullmatch(line):
            plain = [c for c in new if "<|" not in c and self.PLAIN.fullmatch(c)]
            for c in {*new}.difference(plain):
                self.chunks[c] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
            line = " ".join(plain)
        if not plain:
            return
        found = self.WORDS.findall(line.lower())
        missing = self.absent(set(found), self.words, self.older_words)
        self.words.update(zip(missing, map(self.word, missing)))
        self.chunks.update(zip(plain, b"".join(map(self.words.__getitem__, found)).split(self.BLANK), strict=True))
        for w in missing:
            if len(w) > 64:
                del self.words[w]

    def of(self, batch: pa.Array | list[str | None]) -> list[bytes]:
        """Token ids of each text and the end token, 4 bytes each."""
        split = pc.ascii_split_whitespace(batch if isinstance(batch, pa.Array) else pa.array(batch, pa.string()))
        many = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(pc.list_flatten(split))
        at, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.chunks) > self.MOST:
            self.chunks, self.older_chunks = {"": b""}, self.chunks
        if len(self.words) > self.MOST:
            self.words, self.older_words = {" ": self.BLANK}, self.words
        new = self.absent(distinct, self.chunks, self.older_chunks)
        self.add(new)
        held = [*map(self.chunks.__getitem__, distinct)]
        for c in new:  # texts without blanks would fill the memory
            if len(c) > 64:
                del self.chunks[c]
        ids, size = np.frombuffer(b"".join(held), "<u4"), np.fromiter(map(len, held), np.int64, len(held)) // 4
        start, size = (np.cumsum(size) - size)[at], size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        raw = ids[np.arange(total, dtype=np.int32) + np.repeat((start - ends + size).astype(np.int32), size)].tobytes()
        edges = (4 * np.concatenate([[0], ends])[np.cumsum([0, *many])]).tolist()
        end = END.to_bytes(4, "little")
        return [raw[a:b] + end for a, b in zip(edges, edges[1:])]


def token_bytes(batch: pa.Array | list[str | None], path: str) -> list[bytes]:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Chunks(path)
    return _TOKENIZERS[path].of(batch)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about SLICE bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // SLICE
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian 32-bit numbers) of the token pieces of every document."""
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                at, piece, start, cut = [], [], [], []
                for i, ids in enumerate(token_bytes(batch.column(1), path)):
                    for k in range(0, -(-len(ids) // step)):
                        at.append(i)
                        piece.append(k)
                        start.append(k * capacity)
                        cut.append(ids[k * step : (k + 1) * step])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(c) // 4 for c in cut], pa.int64()), pa.array(cut, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], dict[int, int]]:
    """Sequences that dominance fixes, as (how many, [(length, pieces of it)]), and the counts that are left.

    Each is provably part of some packing into the fewest sequences.
    """
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left)
    fixed = []

    def fix(times: int, *members: int) -> None:
        held = sorted({m: members.count(m) for m in members}.items(), reverse=True)
        fixed.append((times, held))
        for n, k in held:
            left[n] -= k * times
            if not left[n]:
                del left[n]
                lengths.pop(bisect.bisect_left(lengths, n))

    def smallest(without: int, most: int) -> list[int]:
        out: list[int] = []
        for n in lengths:
            out += [n] * min(left[n] - (n == without), most - len(out))
            if len(out) >= most:
                break
        return out

    def largest_within(room: int, without: list[int]) -> int:
        """The largest length of at most ``room`` of which one is left besides ``without``; 0 if none."""
        i = bisect.bisect_right(lengths, room) - 1
        while i >= 0 and left[lengths[i]] <= without.count(lengths[i]):
            i -= 1
        return lengths[i] if i >= 0 else 0

    def longest_pair(room: int, without: int) -> int:
        best, i = 0, bisect.bisect_right(lengths, room) - 1
        while i >= 0 and 2 * lengths[i] > best:
            a = lengths[i]
            if left[a] > (a == without) and (b := largest_within(room - a, [without, a])):
                best = max(best, a + b)
            i -= 1
        return best

    j = capacity
    while True:
        at = bisect.bisect_right(lengths, j) - 1
        if at < 0:
            return fixed, left
        j = lengths[at]
        room = capacity - j
        while left.get(j):
            partner = largest_within(room, [j])
            times = left[j] if partner != j else left[j] // 2
            if not partner:
                fix(left[j], j)
                continue
            if partner != j:
                times = min(times, left[partner])
            few = smallest(j, 3)
            one_more = len(few) < 2 or few[0] + few[1] > room
            two_more = len(few) < 3 or sum(few) > room
            # fewer pieces only make the longest pair shorter, so what holds once holds for all these sequences
            if partner == room or one_more or (two_more and partner >= longest_pair(room, j)):
                fix(times, j, partner)
            else:
                break
        j -= 1


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit from the largest length down: (how many, [(length, pieces of it)]) for all sequences."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def put(room: int, times: int, held: list[tuple[int, int]]) -> None:
        if not room:
            done.append((times, held))
            return
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((times, held))

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                room, times, held = capacity, -(-todo // (capacity // n)), []
            else:
                room = rooms[i]
                times, held = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            each = room // n
            full = min(times, todo // each)
            if full:
                put(room - each * n, full, [*held, (n, each)])
                todo -= full * each
                times -= full
            if times and 0 < todo < each:
                put(room - todo * n, 1, [*held, (n, todo)])
                todo, times = 0, times - 1
            if times and held:
                put(room, times, held)
    return done + [x for group in open_.values() for x in group]


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """All sequences for pieces of these lengths: those that dominance fixes, then the rest by best fit."""
    fixed, rest = reduce(counts, capacity)
    return fixed + best_fit(rest, capacity)


def plan(found: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces a sequence, offset of the first) for every pattern.

    A pattern holds fewer than sqrt(2 * capacity) lengths, dominance uses up a length with two patterns at most, and a step of
    best fit makes two new patterns at most, so the list is bounded by the capacity.
    """
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for times, held in found:
        offset = 0
        for n, each in held:
            lo = rank.get(n, 0)
            rank[n] = lo + times * each
            out.append((n, lo, rank[n], sequence, each, offset))
            offset += n * each
        sequence += times
    return out


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (doc_id, piece, length and others, without ids) with sequence_id and offset."""
    spark = cut.sparkSession
    rows = scratch.materialize(cut.withColumn("__uid", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    part = max(PART, sum(counts.values()) // (PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    large = {n: -(-c // part) for n, c in counts.items() if c > part}
    parts = F.broadcast(spark.createDataFrame([*large.items()], "length long, __parts int"))
    rows = rows.join(parts, "length", "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64("__uid"), F.col("__parts")), F.lit(0)).cast("int"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        rows.filter("__parts IS NOT NULL")
        .groupBy("length", "__part")
        .agg(F.count("*").alias("__n"))
        .select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    )
    order = Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "__uid")
    ranked = rows.withColumn("__rank", F.row_number().over(order) - 1).join(F.broadcast(bases), ["length", "__part"], "left")
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.coalesce("__base", F.lit(0)))
    ranges = spark.createDataFrame(
        plan(patterns(counts, capacity)), "length long, __lo long, __hi long, __first long, __each long, __offset long"
    )
    at = F.col("__rank") - F.col("__lo")
    return ranked.join(F.broadcast(ranges), "length").filter("__rank >= __lo AND __rank < __hi").select(
        *cut.columns,
        (F.col("__first") + F.floor(at / F.col("__each"))).alias("sequence_id"),
        (F.col("__offset") + at % F.col("__each") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece of ``docs``."""
    cut = pieces(docs, path or public_tokenizers.path("word_bpe_49k.json"), capacity)
    return place(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
