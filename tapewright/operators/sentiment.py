"""Headline scoring, score cache and daily sentiment."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tapewright.functions.arrays import flatten_dims
from tapewright.functions.numeric import softmax
from tapewright.functions.text import occurrences, text_key, text_or_empty
from tapewright.operators.joins import ROWS_PER_TASK, spread_join
from tapewright.operators.series import KEYS
from tapewright.schemas import SENTIMENT_COLUMNS
from tapewright.session import stage

SCORES = ("text_key", "neu", "pos", "neg", "emb")
SCORE_SCHEMA = "text_key string, neu double, pos double, neg double, emb array<float>"
FILTER_SCHEMA = "block long, blocks long, bits binary, part string"
#: Bits of a filter block (the size of Spark's bitmap aggregate) and the keys that it is meant for: 0.5 % false positives.
BLOCK_BITS, BLOCK_KEYS = 32_768, 2_048
#: Blocks of 4 KB that are broadcast, at most: 64 MB, about 33 million texts.
BROADCAST_BLOCKS = 16_384

# The terms of the built-in scorer.
POSITIVE = ("gain", "rise", "high", "great", "strong", "profit", "record", "best", "good", "beat")
NEGATIVE = ("loss", "fall", "fraud", "lawsuit", "weak", "miss", "scandal", "bad", "drop", "less")


class Scorer(Protocol):
    """Adds neu, pos, neg (probabilities) and emb (array<float>) to a table with a text column."""

    def score(self, df: DataFrame, text: str) -> DataFrame: ...


@dataclass(frozen=True)
class LexiconScorer:
    """Term counts -> logits -> softmax, all in JVM expressions; needs no model and no shuffle.

    The embedding is the vector of log term counts, cut to ``dims``.
    """

    positive: Sequence[str] = POSITIVE
    negative: Sequence[str] = NEGATIVE
    neutral_logit: float = 1.0
    dims: int = 17

    def score(self, df: DataFrame, text: str = "headline") -> DataFrame:
        terms = [*self.positive, *self.negative]
        names = [f"_c{i}" for i in range(len(terms))]
        lowered = df.withColumn("_t", F.lower(text_or_empty(text)))
        # a generator keeps the optimizer from copying the counts into every use of them
        counts = F.inline(F.array(F.struct(*[occurrences(F.col("_t"), w).alias(n) for w, n in zip(terms, names)])))
        counted = lowered.select("*", counts).drop("_t")
        cut = len(self.positive)

        def logit(part: list[str]) -> Column:
            return F.log1p(sum((F.col(n) for n in part), F.lit(0.0)))

        logits = counted.withColumns({
            "_lp": logit(names[:cut]),
            "_ln": logit(names[cut:]),
            "emb": F.array(*[F.log1p(n).cast("float") for n in names[: self.dims]]),
        }).drop(*names)
        neu, pos, neg = softmax(F.lit(self.neutral_logit), F.col("_lp"), F.col("_ln"))
        return logits.withColumns({"neu": neu, "pos": pos, "neg": neg}).drop("_lp", "_ln")


@dataclass(frozen=True)
class ModelScorer:
    """A user's model in Arrow batches, loaded once per task.

    ``load()`` returns a function list[str] -> (probabilities [neu, pos, neg] per text,
    embedding per text).  A failing batch gives NULL scores for its texts and no shift of others.
    """

    load: Callable[[], Callable[[list[str]], tuple]]
    dims: int = 17
    batch: int = 32
    columns: Sequence[str] = field(default=("text_key",))

    def score(self, df: DataFrame, text: str = "headline") -> DataFrame:
        load, dims, size, keep = self.load, self.dims, self.batch, list(self.columns)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for pdf in batches:
                for start in range(0, len(pdf), size):
                    part = pdf.iloc[start:start + size]
                    texts = part[text].fillna("").astype(str).tolist()
                    try:
                        probs, embs = model(texts)
                        rows = [(float(p[0]), float(p[1]), float(p[2]), [float(v) for v in e[:dims]]) for p, e in zip(probs, embs, strict=True)]
                    except Exception:  # noqa: BLE001 - one bad batch must not lose the others
                        rows = [(None, None, None, None)] * len(texts)
                    out = part[keep].reset_index(drop=True)
                    yield pd.concat([out, pd.DataFrame(rows, columns=["neu", "pos", "neg", "emb"])], axis=1)

        kept = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keep)
        return df.select(*keep, text).mapInPandas(run, f"{kept}, neu double, pos double, neg double, emb array<float>")


def add_polarity(df: DataFrame) -> DataFrame:
    return df.withColumn("pos_minus_neg", F.col("pos") - F.col("neg"))


def score_inline(news: DataFrame, scorer: LexiconScorer | None = None, text: str = "headline") -> DataFrame:
    """Scores next to every row, in the scan's own stage."""
    return add_polarity((scorer or LexiconScorer()).score(news, text))


class ScoreCache:
    """Content-addressed score table: Parquet, partitioned by the first ``prefix`` hex digits of the key.

    Keys are unique: a fill merges its scores into the partitions that they touch and overwrites these, so reads need no
    grouping.  A fill of few texts rewrites fewer rows the longer the prefix is.  Of two fills at the same time the later
    one wins a partition; the scores that the other loses there are made anew when they are next asked for.

    Beside the scores lies a Bloom filter for each partition: blocks of 2^15 bits for about 2,048 keys each.  A text that its
    block rules out is a miss without any join.  Filters may lag behind the scores, never the result: a false positive
    is decided by the join, a false negative scores a text twice.
    """

    def __init__(self, spark: SparkSession, path: str, prefix: int = 1):
        self.spark, self.path, self.prefix = spark, path, prefix
        self.filters = f"{path.rstrip('/')}/_filters"

    def _table(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _parted(self) -> DataFrame:
        return self._table(self.path, f"{SCORE_SCHEMA}, part string")

    def read(self) -> DataFrame:
        """One row per text; a missing folder is an empty cache."""
        return self._parted().drop("part")

    def _part(self) -> Column:
        return F.concat(F.lit("k"), F.substring("text_key", 1, self.prefix))

    def probe(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``maybe``: false where a filter rules ``text_key`` out.

        Filters are broadcast while they are small, counted first; beyond that they are joined by block.
        """
        blocks = self._table(self.filters, FILTER_SCHEMA)
        sizes = blocks.groupBy("part").agg(F.max("blocks").alias("blocks"))  # a row per partition: 16 ** prefix at most
        placed = keys.withColumn("part", self._part()).join(F.broadcast(sizes), "part", "left")
        placed = placed.withColumn("block", _block(F.col("blocks"))).drop("blocks")
        bits = blocks.select("part", "block", "bits")
        if blocks.count() <= BROADCAST_BLOCKS:
            bits = F.broadcast(bits)
        found = placed.join(bits, ["part", "block"], "left")
        maybe = F.lit(True)
        for at in _places():
            byte = F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.pmod(at, F.lit(8)) + 1).cast("int"))
            maybe = maybe & (byte.bitwiseAND(mask) != 0)
        return found.withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("part", "block", "bits")

    def looked_up(self, keyed: DataFrame, text: str = "headline") -> DataFrame:
        """Distinct texts with their scores, NULL where there is none.

        Copies collapse in the map tasks, before the exchange; the join then has unique
        keys on both sides, so a text that makes up a third of all rows is no hot spot.
        """
        distinct = keyed.select("text_key", text_or_empty(text).alias(text)).dropDuplicates(["text_key"])
        probed = self.probe(distinct)
        hits = probed.where("maybe").drop("maybe").join(self.read(), "text_key", "left")
        return hits.unionByName(probed.where("not maybe").drop("maybe"), allowMissingColumns=True)

    def misses(self, news: DataFrame, text: str = "headline") -> DataFrame:
        """Distinct texts without a score."""
        found = self.looked_up(news.withColumn("text_key", text_key(text)), text)
        return found.where("pos is null").select("text_key", text)

    def merge(self, scored: DataFrame) -> None:
        """Adds scores; where both have a text, the old score stays. Rows without a score are left out."""
        new = stage(scored.where("pos is not null").select(*SCORES).withColumn("part", self._part()), "scores-new")
        touched = [r[0] for r in new.select("part").distinct().collect()]  # 16 ** prefix at most
        if not touched:
            return
        old = self._parted().where(F.col("part").isin(touched)).withColumn("_new", F.lit(False))
        values = F.struct("_new", "neu", "pos", "neg", "emb")
        both = old.unionByName(new.withColumn("_new", F.lit(True))).groupBy("part", "text_key").agg(F.min(values).alias("_s"))
        _overwrite(both.select(*[F.col("text_key") if c == "text_key" else F.col(f"_s.{c}") for c in SCORES], "part"), self.path)
        keys = self._parted().where(F.col("part").isin(touched)).select("part", "text_key")
        sizes = keys.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_KEYS).alias("blocks"))
        placed = keys.join(F.broadcast(sizes), "part").select("part", "blocks", _block(F.col("blocks")).alias("block"), F.explode(F.array(*_places())).alias("at"))
        _overwrite(placed.groupBy("part", "blocks", "block").agg(F.bitmap_construct_agg("at").alias("bits")).select("block", "blocks", "bits", "part"), self.filters)

    def fill(self, news: DataFrame, scorer: Scorer, text: str = "headline") -> None:
        self.merge(scorer.score(self.misses(news, text), text))


def _block(blocks: Column) -> Column:
    """Block of a key in its partition's filter."""
    return F.pmod(F.xxhash64("text_key", F.lit(1)), blocks)


def _places() -> list[Column]:
    """The bits of a key in its block: three places of 15 bits of one hash."""
    return [F.shiftrightunsigned(F.xxhash64("text_key"), 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(3)]


def _overwrite(rows: DataFrame, path: str) -> None:
    """Replaces the partitions that ``rows`` has, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def score_cached(news: DataFrame, cache: ScoreCache, scorer: Scorer, text: str = "headline", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Scores through the cache: each distinct text is scored once.

    Rows are read and hashed once and written with their keys.  The result does not depend on what other writers do to
    the cache meanwhile: known scores are written to a table of this run before the cache is merged.
    """
    keyed = stage(news.withColumn("text_key", text_key(text)), "keyed")
    found = stage(cache.looked_up(keyed, text).withColumn(text, F.when(F.col("pos").isNull(), F.col(text))), "looked-up")
    fresh = stage(scorer.score(found.where("pos is null").select("text_key", text), text).select(*SCORES), "fresh")
    cache.merge(fresh)
    scores = found.where("pos is not null").select(*SCORES).unionByName(fresh)
    return add_polarity(spread_join(keyed, scores, ["text_key"], rows_per_task)).drop("text_key")


def aggregate_daily(scored: DataFrame, dims: int | None = 17, text: str = "headline", keys=KEYS) -> DataFrame:
    """Mean scores and mean embedding per date, and the number of headlines; no value is NULL.

    A plain partial aggregation: a date that holds a third of all headlines is averaged in
    the map tasks and arrives as one row per task.
    """
    have = [c for c in scored.columns if c.startswith("emb_")]
    if "emb" in scored.columns and dims:
        scored = scored.select("*", *flatten_dims("emb", dims))
        have = [f"emb_{i}" for i in range(dims)]
    means = [F.avg(c).alias(c) for c in (*SENTIMENT_COLUMNS, *have)]
    daily = scored.groupBy(*keys, "date").agg(*means, F.count(text).alias("headline_count"))
    return daily.na.fill(0.0, [*SENTIMENT_COLUMNS, *have])
