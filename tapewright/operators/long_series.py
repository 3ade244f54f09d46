"""Row-frame operators over series of any length.

A tick series has no calendar bound and one series may hold a third of all rows, so it must
not become one window partition.  The series is cut into chunks of ``rows`` consecutive
rows; each chunk also receives the few neighbouring rows that its frames can reach.  A window
partitioned by (series, chunk) then gives the same values as one over the whole series.

Positions come from ranges: rows are dealt by ranges of (series, time, tie-break), written
once, and numbered inside their range; what a series has in the ranges before is a running
sum over ranges, in two levels.  A second that is flooded with events is cut like any other
stretch, as equal times are told apart by the tie-break and then by a hash of the row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators.scans import exclusive_sums
from tapewright.operators.series import KEYS
from tapewright.session import stage

#: Ranges whose offsets are broadcast; a longer list is joined.
BROADCAST_RANGES = 200_000


def add_long_position(df: DataFrame, time: str, tiebreak: Sequence[str], keys=KEYS, bound: int = 1_000_000) -> DataFrame:
    """0-based position ``pos`` in the series; no task gets more than about ``bound`` rows."""
    ranged = stage(_ranged(df, time, tiebreak, keys, bound), "ranges")
    piece = F.shiftrightunsigned("_at", 33).alias("_piece")  # the range's part of the row number
    pieces = ranged.groupBy(*keys, piece).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offsets = stage(exclusive_sums(pieces, keys, "_piece", {"_offset": "_n"}).drop("_n"), "offsets")
    small = offsets.count() <= BROADCAST_RANGES
    placed = ranged.withColumn("_piece", piece).join(F.broadcast(offsets) if small else offsets, [*keys, "_piece"])
    return placed.withColumn("pos", (F.col("_offset") + F.col("_at") - F.col("_first")).cast("long")).select(*df.columns, "pos")


def _ranged(df: DataFrame, time: str, tiebreak: Sequence[str], keys: Sequence[str], bound: int) -> DataFrame:
    """Rows sorted within ranges of about half of ``bound``, with their number ``_at``."""
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, -(-2 * df.count() // bound))
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    order = [*keys, time, *tiebreak, "_tie"]
    sorted_ = df.withColumn("_tie", F.xxhash64(*hashed)).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return sorted_.drop("_tie").withColumn("_at", F.monotonically_increasing_id())


def with_halo(df: DataFrame, back: int, ahead: int, rows: int) -> DataFrame:
    """Chunk id per row; rows near an edge are also copied to the neighbouring chunk."""
    if max(back, ahead) > rows:
        raise ValueError("chunks must be at least as long as the reach of the frames")
    chunk, place = F.floor(F.col("pos") / rows), F.col("pos") % rows
    copies = F.array_compact(
        F.array(
            chunk,
            F.when(place >= rows - back, chunk + 1) if back else F.lit(None).cast("long"),
            F.when((place < ahead) & (chunk > 0), chunk - 1) if ahead else F.lit(None).cast("long"),
        )
    )
    return df.withColumn("_home", chunk).withColumn("_chunk", F.explode(copies))


def over_chunks(
    df: DataFrame,
    apply: Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame],
    time: str,
    tiebreak: Sequence[str],
    back: int = 0,
    ahead: int = 0,
    keys=KEYS,
    rows: int = 65_536,
) -> DataFrame:
    """Run a row-frame operator chunk by chunk.

    ``apply(df, keys, order)`` is any operator of :mod:`tapewright.operators.series` whose
    frames reach at most ``back`` rows back and ``ahead`` rows ahead.
    """
    placed = add_long_position(df, time, tiebreak, keys)
    chunked = with_halo(placed, back, ahead, rows)
    done = apply(chunked, [*keys, "_chunk"], ["pos"])
    return done.where(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")


def running_sum(df: DataFrame, value: str | Column, name: str, keys=KEYS, rows: int = 65_536) -> DataFrame:
    """Running sum along ``pos``: within chunks, plus the total of the chunks before."""
    x = F.col(value) if isinstance(value, str) else value
    tagged = df.withColumn("_x", x).withColumn("_chunk", F.floor(F.col("pos") / rows))
    totals = tagged.groupBy(*keys, "_chunk").agg(F.sum("_x").alias("_total"))
    carry = exclusive_sums(totals, keys, "_chunk", {"_carry": "_total"}).drop("_total")
    inside = W.partitionBy(*keys, "_chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return (
        tagged.withColumn("_part", F.sum("_x").over(inside))
        .join(carry, [*keys, "_chunk"])
        .withColumn(name, F.col("_part") + F.col("_carry"))
        .drop("_x", "_chunk", "_part", "_carry")
    )
