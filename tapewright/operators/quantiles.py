"""Exact quantiles of columns, whole or per series, in bounded memory.

``percentile`` keeps every distinct value of a group in one buffer, which is fine for a daily
series and fatal for a column of 10^12 rows.  Here one pass builds a mergeable sketch per
column and series; its rank bounds give a bracket around each wanted order statistic.  A
second pass counts the rows below the brackets and keeps the distinct values inside with
their counts, a share of the rows that the size of the sketch sets.  Where a bracket still
holds more distinct values than one buffer should, splitters from a sketch of these values
narrow it, reading only what the second pass kept.  A bracket that a sketch got wrong is
noticed, as its rank is not inside, and made wider.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.session import stage

#: Rows up to which the built-in aggregate is used, and distinct values of a bracket that one buffer holds.
SMALL = 200_000
#: Size of a sketch (its k), and splitters of a round that narrows a bracket.
SKETCH, SPLITTERS = 4096, 256
#: Series and columns whose brackets are broadcast; a longer list is joined.
BROADCAST_BRACKETS = 50_000


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], small: int = SMALL, buckets: int = SPLITTERS, total: int | None = None) -> dict[str, list[float | None]]:
    """{column: quantiles}, linear between neighbours; NULL and NaN are skipped.  ``total``: row count, if known."""
    found: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    if (df.count() if total is None else total) <= small:
        table = _small_quantiles(df.select(*[_known(c) for c in cols]), cols, probs)
    else:
        table = sketched_quantiles(df, cols, probs, (), small, buckets).select("column", "q").collect()
    found.update({r["column"]: list(r["q"]) for r in table})
    return found


def _known(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)


def _small_quantiles(df, cols, probs):
    """Columns with few values: the built-in aggregate, one group per column."""
    long = df.unpivot([], list(cols), "column", "value")
    return long.where(F.col("value").isNotNull()).groupBy("column").agg(F.percentile("value", list(probs)).alias("q")).collect()


def rank_error(size: int) -> float:
    """Share of the rows by which a rank of a sketch of this size may be wrong, but for one case in a hundred (fixed formula of the sketch)."""
    return 2.296 / size**0.9723


def sketched_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (), small: int = SMALL, splitters: int = SPLITTERS, size: int = SKETCH, slack: float = 3.0) -> DataFrame:
    """(keys..., column, n, q array<double>): exact quantiles per series and column, columns without values left out.

    Two passes over ``df``, whatever its size and values.  ``slack``: brackets reach so many rank errors to either side.
    """
    by, order = [*keys, "column"], sorted(range(len(probs)), key=lambda i: probs[i])
    rows = df.select(*keys, *[_known(c) for c in cols])
    sketches = rows.groupBy(*keys).agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.kll_sketch_agg_double(c, F.lit(size)).alias("sketch")).alias(c) for c in cols])
    long = sketches.select(*keys, F.inline(F.array(*cols))).where("n > 0")
    brackets = stage(long.select(*by, "n", F.array(*[_bracket(probs[i], slack * rank_error(size)) for i in order]).alias("tasks")), "brackets")

    # second pass: values inside a bracket with their counts, all by the number of brackets that begin at or below them;
    # brackets ascend, so the last of these reaches highest. No lambda looks at a row: such functions are interpreted.
    values = rows.unpivot(list(keys), list(cols), "column", "x").where(F.col("x").isNotNull())
    ends = brackets.select(*by, F.col("tasks.lo").alias("los"), F.col("tasks.hi").alias("his"))
    met = values.join(F.broadcast(ends) if brackets.count() <= BROADCAST_BRACKETS else ends, by)
    met = met.select(*by, "x", "his", _begun(F.col("los"), len(probs)).alias("begun"))
    inside = met.select(*by, "begun", F.when(F.col("x") <= F.get("his", F.col("begun") - 1), F.col("x")).alias("x"))
    cells = stage(inside.groupBy(*by, "x", "begun").agg(F.count(F.lit(1)).alias("c")), "cells")

    many = len(probs)
    wanted = brackets.select(*by, "n", F.posexplode("tasks").alias("task", "t")).select(*by, "n", "task", "t.*")
    under = cells.join(wanted.select(*by, "task"), by).where("begun <= task")
    below = under.groupBy(*by, "task").agg(F.sum("c").alias("below"))
    tasks = stage(wanted.join(below, [*by, "task"], "left").withColumn("below", F.coalesce("below", F.lit(0))), "tasks")
    tasks = _narrowed(tasks, cells, by, small, splitters)

    inner = cells.join(tasks, by).where(F.col("x").between(F.col("lo"), F.col("hi")))
    lists = inner.groupBy(*by, "task").agg(F.sort_array(F.collect_list(F.struct("x", "c"))).alias("xs"))
    state = F.struct(F.col("below").alias("at"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def step(s: Column, v: Column) -> Column:
        end = s["at"] + v["c"]
        has = lambda k: (s["at"] <= F.col(k)) & (F.col(k) < end)
        return F.struct(end.alias("at"), F.when(has("first"), v["x"]).otherwise(s["low"]).alias("low"), F.when(has("last"), v["x"]).otherwise(s["high"]).alias("high"))

    read = stage(tasks.join(lists, [*by, "task"], "left").withColumn("s", F.aggregate(F.coalesce("xs", F.array().cast("array<struct<x:double,c:bigint>>")), state, step)).select(*by, "n", "task", "part", "s.low", "s.high"), "found")
    if not read.where("low is null or high is null").isEmpty():
        return sketched_quantiles(df, cols, probs, keys, small, splitters, size, slack * 8)
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))
    back = F.array(*[F.lit(order.index(i)) for i in range(many)])
    sorted_ = read.groupBy(*by, "n").agg(F.sort_array(F.collect_list(F.struct("task", value.alias("q")))).alias("qs"))
    return sorted_.select(*by, "n", F.transform(back, lambda i: F.get(F.col("qs"), i)["q"]).alias("q"))


def _bracket(p: float, error: float) -> Column:
    """Ranks (first, last) that a quantile lies between, and values (lo, hi) that enclose them.

    Two ranks more or less count for less than the error, or else all values are enclosed.
    """
    at = F.lit(float(p)) * (F.col("n").cast("double") - 1)

    def value(share: float) -> Column:
        return F.kll_sketch_get_quantile_double("sketch", F.lit(share))

    many = F.col("n") * error >= 2
    return F.struct(
        F.floor(at).alias("first"), F.ceil(at).alias("last"), (at - F.floor(at)).alias("part"),
        F.when(many, value(max(p - 2 * error, 0.0))).otherwise(value(0.0)).alias("lo"), F.when(many, value(min(p + 2 * error, 1.0))).otherwise(value(1.0)).alias("hi"),
    )


def _begun(los: Column, many: int) -> Column:
    """How many of the ascending values ``los`` are at or below x."""
    first = lambda i: (F.col("x") < F.get(los, F.lit(i)), F.lit(i))
    case = F.when(*first(0))
    for i in range(1, many):
        case = case.when(*first(i))
    return case.otherwise(F.lit(many))


def _narrowed(tasks: DataFrame, cells: DataFrame, by: list[str], small: int, splitters: int) -> DataFrame:
    """Brackets whose distinct values fit a buffer: those of more are cut by splitters, and the parts with the ranks stay."""
    one = [*by, "task"]
    while True:
        inner = cells.join(tasks, by).where(F.col("x").between(F.col("lo"), F.col("hi")))
        sizes = inner.groupBy(*one).agg(F.count(F.lit(1)).alias("width"), F.kll_sketch_agg_double("x").alias("sketch")).where(F.col("width") > small)
        shares = F.array(*[F.lit(i / splitters) for i in range(1, splitters)])
        cuts = stage(sizes.select(*one, F.array_distinct(F.kll_sketch_get_quantile_double("sketch", shares)).alias("cuts")), "splitters")
        if cuts.isEmpty():
            return tasks
        place = F.size(F.filter("cuts", lambda s: s < F.col("x")))
        parts = inner.join(cuts, one).groupBy(*one, "below", "first", "last", place.alias("place")).agg(F.sum("c").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        listed = parts.groupBy(*one, "below", "first", "last").agg(F.sort_array(F.collect_list(F.struct("place", "c", "lo", "hi"))).alias("parts"))
        start = F.struct(F.col("below").alias("at"), F.col("below").alias("under"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

        def step(s: Column, v: Column) -> Column:
            end = s["at"] + v["c"]
            has = lambda k: (s["at"] <= F.col(k)) & (F.col(k) < end)
            return F.struct(
                end.alias("at"), F.when(has("first"), s["at"]).otherwise(s["under"]).alias("under"),
                F.when(has("first"), v["lo"]).otherwise(s["lo"]).alias("lo"), F.when(has("last"), v["hi"]).otherwise(s["hi"]).alias("hi"),
            )

        new = listed.withColumn("s", F.aggregate("parts", start, step)).select(*one, F.col("s.under").alias("_below"), F.col("s.lo").alias("_lo"), F.col("s.hi").alias("_hi"))
        moved = tasks.join(new, one, "left")
        # a rank outside its bracket empties it, which is noticed at the end
        cut, known = F.col("_below").isNotNull(), F.col("_lo").isNotNull() & F.col("_hi").isNotNull()
        moved = moved.withColumns({c: F.when(cut, F.when(known, F.col(f"_{c}"))).otherwise(F.col(c)) for c in ("below", "lo", "hi")}).drop("_below", "_lo", "_hi")
        tasks = stage(moved, "tasks")
