"""Sharding (operator 10): a Feistel permutation of global row numbers, native DataFrame functions only.

Rows get gapless global numbers by a fixed order: a bucket from a hash of the id, then the id, then size and checksum.
The numbers of a bucket come from a window over narrow rows, its first number from the counts of the buckets before it.
A Feistel network over Z_a x Z_b (a * b just over the number of rows N) permutes the numbers; results outside 0..N-1
are put through it again until they fall inside (cycle walking). The shard is the new number modulo the number of
shards, the slot the quotient: counts differ by one at most, slots have no gap, and both are computable from the
number, N and the seed alone.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stage


#: Buckets of the global order. Part of the law: another number gives another shuffle. At 10^11 rows a bucket has 10^7.
BUCKETS = 8192
ROUNDS = 6
SEED = 20240607
#: Cycle walking ends within a*b - N + 1 <= a steps; for a above this number, so many misses in a row (each with a
#: chance below 1/a) do not happen, and a row that had them would raise an error instead of getting a wrong place.
WALK = 65
MASK = (1 << 32) - 1
#: Fixed value: multiplier of a common 32-bit integer hash.
MULTIPLIER = 0x45D9F3B


def mixed(x: Column, salt: int) -> Column:
    """A 32-bit integer hash: add, then twice shift, xor and multiply."""
    x = (x + salt).bitwiseAND(F.lit(MASK))
    for _ in range(2):
        x = (F.shiftrightunsigned(x, 16).bitwiseXOR(x) * MULTIPLIER).bitwiseAND(F.lit(MASK))
    return F.shiftrightunsigned(x, 16).bitwiseXOR(x)


def sides(rows: int) -> tuple[int, int]:
    """a and b with a * b >= rows and a * b - rows < a."""
    a = max(1, isqrt(max(rows, 1)))
    return a, -(-max(rows, 1) // a)


def round_salts(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [(seed + r * 0x9E3779B9) & MASK for r in range(1, rounds + 1)]


def feistel(number: Column, rows: int, seed: int, rounds: int = ROUNDS) -> Column:
    """One pass of the network over a number below a * b."""
    a, b = sides(rows)
    pair = F.struct(((number - number % b) / F.lit(b)).cast("long").alias("l"), (number % b).cast("long").alias("r"))
    if rows >= 1 << 52:
        raise ValueError("row numbers must fit a double exactly")

    def step(state: Column, salt: int, left: bool) -> Column:
        if left:
            return F.struct(((state["l"] + mixed(state["r"], salt)) % a).alias("l"), state["r"].alias("r"))
        return F.struct(state["l"].alias("l"), ((state["r"] + mixed(state["l"], salt)) % b).alias("r"))

    salts = F.array(*[F.lit(s).cast("long") for s in round_salts(seed, rounds)])
    out = F.aggregate(
        F.transform(salts, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), pair,
        lambda state, x: F.when(x["i"] % 2 == 0, step(state, x["s"], True)).otherwise(step(state, x["s"], False)))
    return out["l"] * b + out["r"]


def permuted(number: Column, rows: int, seed: int = SEED) -> Column:
    """The place of a row number in the shuffle of 0..rows-1."""
    walked = F.transform(F.array(feistel(number, rows, seed)), lambda once: F.when(once < rows, once).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda p, _: F.when(p < rows, p).otherwise(feistel(p, rows, seed)))))
    return F.get(walked, F.lit(0))


def row_numbers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """``key``, ``size``, ``text_crc32``, global ``row_number`` of every row, and the number of rows.

    Equal (key, size, checksum) rows are counted before they are numbered and take consecutive numbers, so that a row
    that is repeated very often is no large group.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(F.col(key).alias("key"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    groups = narrow.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("copies"))
    groups = stage(groups.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")), "shards")
    counts = groups.groupBy("bucket").agg(F.sum("copies").alias("n"))  # 8192 rows at most
    starts = stage(counts.withColumn("first", F.sum("n").over(Window.orderBy("bucket")) - F.col("n")), "starts")
    rows = starts.agg(F.sum("n")).first()[0] or 0
    order = Window.partitionBy("bucket").orderBy("key", "size", "text_crc32")
    at = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    placed = groups.withColumn("at", at).join(F.broadcast(starts.select("bucket", "first")), "bucket")  # 8192 rows at most
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    spread = placed.select("key", "size", "text_crc32", (F.col("first") + F.col("at")).alias("from"), copy.alias("copy"))
    return spread.select(F.col("key").alias(key), "size", "text_crc32", (F.col("from") + F.col("copy")).alias("row_number")), rows


def shard(docs: DataFrame, shards: int = 40, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: ``key``, ``size`` (bytes of the text plus 16), ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``rows``: counts of shards differ by one at most; ``grown_shard`` is null, as that belongs to another law.
    Null texts have size 16. Null keys are one key. Equal rows get places of their own. Other columns are not read.
    Without documents the result is empty.
    """
    numbered, rows = row_numbers(docs, key, text)
    placed = numbered.withColumn("place", permuted(F.col("row_number"), rows, seed))
    known = F.when(F.col("place") < rows, F.col("place")).otherwise(F.raise_error(F.lit("cycle walking has not ended")).cast("long"))
    placed = placed.withColumn("place", known)
    return placed.select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
