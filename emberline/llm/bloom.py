"""Bloom filters as bounded tables of 64-bit words, built and probed with built-in functions only.

A filter of ``bits`` bits is a table ``(word int, mask long)`` of at most ``bits / 64`` rows, whatever
the input holds, so broadcasting it has a fixed bound (2**24 bits: 262,144 rows). A filter that is too
small for its input answers "perhaps" more often; it never loses a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 16, 1 << 26


def bits_for(rows: int, per_row: int = 16, most: int = MAX_BITS) -> int:
    """A power of two of about ``per_row`` bits a row, between MIN_BITS and ``most``."""
    return max(MIN_BITS, min(most, 1 << max(0, rows * per_row - 1).bit_length()))


def _slots(h: Column, bits: int) -> list[Column]:
    """Two bit positions from the two halves of a 64-bit hash."""
    return [F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)).cast("int"), h.bitwiseAND(F.lit(bits - 1)).cast("int")]


def _words(slots: DataFrame) -> DataFrame:
    return slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("mask")
    )


def of_keys(df: DataFrame, h: Column, bits: int) -> DataFrame:
    """The filter that holds every hash ``h`` of ``df``."""
    return _words(df.select(F.explode(F.array(*_slots(h, bits))).alias("slot")))


def _repeated_slots(df: DataFrame, h: Column, bits: int) -> DataFrame:
    hit = df.select(F.explode(F.array_distinct(F.array(*_slots(h, bits)))).alias("slot"))
    return hit.groupBy("slot").agg(F.count("*").alias("hits")).filter("hits > 1")


def of_repeats(df: DataFrame, h: Column, bits: int) -> DataFrame:
    """The filter of positions hit by two rows or more: a hash that occurs twice has both of its positions set.

    A row counts once for each position, so a hash whose two positions coincide does not repeat itself.
    The count is combined before the shuffle; a hash that fills a third of the table is one row a task.
    """
    return _words(_repeated_slots(df, h, bits))


#: Bits of a bitmap that bitmap_construct_agg makes.
BITMAP = 32768


def keys_as_bytes(df: DataFrame, h: Column, bits: int) -> bytearray:
    """The filter of :func:`of_keys` as bits / 8 bytes on the driver, for probing inside tasks.

    The bits are packed by Spark; bits / BITMAP rows of 4 kB arrive, 8 MB for the largest filter.
    """
    slots = df.select(F.explode(F.array(*_slots(h, bits))).alias("slot"))
    packed = slots.groupBy(F.expr(f"slot div {BITMAP}").alias("at")).agg(F.bitmap_construct_agg(F.col("slot") % BITMAP).alias("bits"))
    out = bytearray(bits // 8)
    for row in packed.toLocalIterator():
        at = row["at"] * BITMAP // 8
        out[at : at + len(row["bits"])] = row["bits"]
    return out


def probe(df: DataFrame, words: DataFrame, h: Column, bits: int, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: whether ``words`` perhaps holds ``h``. Nothing of ``df`` shuffles."""
    out, tests = df, []
    for i, slot in enumerate(_slots(h, bits)):
        out = out.withColumn(f"__s{i}", slot)
        side = F.broadcast(words.select(F.col("word").alias(f"__w{i}"), F.col("mask").alias(f"__m{i}")))
        out = out.join(side, F.shiftright(f"__s{i}", 6) == F.col(f"__w{i}"), "left")
        tests.append(F.expr(f"coalesce(shiftrightunsigned(__m{i}, __s{i} & 63) & 1L, 0L) = 1L"))
    return out.withColumn(flag, tests[0] & tests[1]).select(*[df[c] for c in df.columns], flag)
