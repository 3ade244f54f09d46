"""Random search with successive halving over expanding folds.

All trials are scored on the first fold, the best third also on the following ones; the mean
over folds decides.  For the elastic net one pass gives the cross products of all folds, which
serve all trials: models are solved in parallel tasks and no rows are read again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.models.base import Forecaster, prediction_names
from tapewright.models.elastic_net import ElasticNet, solve
from tapewright.models.spaces import sample
from tapewright.operators.columns import split_types
from tapewright.operators.fold_grams import fold_grams
from tapewright.operators.metrics import is_maximise, paired, score
from tapewright.operators.prep import Inputs
from tapewright.operators.series import KEYS
from tapewright.operators.split import TRAIN, VAL, fold_states, in_fold
from tapewright.session import stage

REDUCTION = 3
GRAM_METRICS = ("rmse", "mse", "r2")


@dataclass(frozen=True)
class Tuning:
    """``trials``: (scope..., trial, fold, score); ``best``: (scope..., trial, value)."""

    params: list[dict[str, Any]]
    trials: DataFrame
    best: DataFrame
    scope: tuple[str, ...]

    def best_params(self) -> dict[str, Any]:
        """The winner where one model serves all series."""
        return self.params[self.best.first()["trial"]]

    def params_table(self) -> DataFrame:
        """(trial, key, value) of every trial."""
        rows = [(i, k, str(v)) for i, p in enumerate(self.params) for k, v in p.items()]
        return self.best.sparkSession.createDataFrame(rows, "trial int, key string, value string")

    def best_table(self) -> DataFrame:
        """(scope..., alpha, l1_ratio, max_iter) of the winner per model."""
        rows = [(i, p["alpha"], p["l1_ratio"], int(p["max_iter"])) for i, p in enumerate(self.params)]
        table = self.best.sparkSession.createDataFrame(rows, "trial int, alpha double, l1_ratio double, max_iter int")
        return self.best.join(F.broadcast(table), "trial").select(*self.scope, "alpha", "l1_ratio", "max_iter")


def _survivors(first: DataFrame, scope: Sequence[str], trials: int, metric: str) -> DataFrame:
    """The best third of the trials per model (scope..., trial)."""
    by = F.col("score").desc() if is_maximise(metric) else F.col("score").asc()
    rank = F.row_number().over(W.partitionBy(*scope, F.lit(0)).orderBy(by, "trial"))
    return first.withColumn("_rank", rank).where(F.col("_rank") <= math.ceil(trials / REDUCTION)).select(*scope, "trial")


def _pick(scores: DataFrame, scope: Sequence[str], folds: int, metric: str) -> DataFrame:
    """Least mean among the trials that reached every fold."""
    sign = -1.0 if is_maximise(metric) else 1.0
    means = scores.groupBy(*scope, "trial").agg((sign * F.avg("score")).alias("value"), F.count("score").alias("n"))
    done = means.where(F.col("n") == folds).groupBy(*scope).agg(F.min(F.struct("value", "trial")).alias("b"))
    return done.select(*scope, "b.trial", "b.value")


def _with_trials(grams: DataFrame, scope: Sequence[str], numbers: Sequence[int]) -> DataFrame:
    """Each model with the trials to solve: all in one row where there are many models, else a row per trial."""
    if scope:
        return grams.withColumn("trials", F.array(*[F.lit(i) for i in numbers]))
    return grams.withColumn("trials", F.explode(F.array(*[F.array(F.lit(i)) for i in numbers])))


def tune_elastic_net(train: DataFrame, features: Sequence[str], targets: Sequence[str], base: ElasticNet, trials: int = 30, folds: int = 2, gap: int = 0, metric: str = "rmse", keys=KEYS) -> Tuning:
    if metric not in GRAM_METRICS:
        return tune(train, features, targets, base, trials, folds, gap, metric, keys)
    params = sample(base.search_space(), trials, base.seed)
    inputs, scope = Inputs.of(*split_types(features)), list(base.scope)
    rows = train.select(*keys, "date", *features, *targets)
    grams = stage(fold_grams(rows, inputs, targets, scope, folds, gap, keys), "fold-grams")
    p, numeric = len(inputs.encoded), len(inputs.numeric)

    first = stage(solve(_with_trials(grams.where("fold = 0"), scope, range(trials)), scope + ["fold"], params, p, numeric, metric), "scores")
    scores = first
    if folds > 1:
        kept, later = _survivors(first, scope, trials, metric), grams.where("fold > 0")
        if scope:
            models = later.join(kept.groupBy(*scope).agg(F.collect_list("trial").alias("trials")), scope)
        else:  # one model: a handful of trial numbers
            models = _with_trials(later, scope, [r["trial"] for r in kept.collect()])
        scores = first.unionByName(stage(solve(models, scope + ["fold"], params, p, numeric, metric), "scores"))
    return Tuning(params, scores, stage(_pick(scores, scope, folds, metric), "best"), tuple(scope))


def certain(scores: Mapping[int, float], trials: int, keep: int) -> set[int]:
    """Trials that are among the ``keep`` best of a rung whatever the missing scores will be (less is better, ties by number)."""
    order = sorted(scores, key=lambda t: (math.isnan(scores[t]), scores[t], t))
    return {t for place, t in enumerate(order) if len(order) - 1 - place >= trials - keep}


def tune(train: DataFrame, features: Sequence[str], targets: Sequence[str], base: Forecaster, trials: int = 30, folds: int = 2, gap: int = 0, metric: str = "rmse", keys=KEYS, parallel: int = 4) -> Tuning:
    """Any forecaster and any metric: fits and scores fold by fold, ``parallel`` of them at a time.

    The first fold is the first rung.  A trial goes on to the other folds as soon as it is sure to be in the best third,
    so these fits start while slower trials of the rung still run, and the outcome does not depend on who ends first.
    The jobs share the cluster under fair scheduling (``spark.scheduler.mode``).
    """
    spark = train.sparkSession
    params = sample(base.search_space(), trials, getattr(base, "seed", 42))
    rows = stage(fold_states(train.na.drop(subset=list(targets)), folds, gap, keys), "folds")
    sign, keep = (-1.0 if is_maximise(metric) else 1.0), math.ceil(trials / REDUCTION)

    def scored(trial: int, fold: int) -> tuple[int, int, float]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{trial}")
        tr, va = (rows.where(in_fold(fold, role)).drop("states") for role in (TRAIN, VAL))
        model = base.with_params(**params[trial]).fit(tr, features, targets, va)
        pairs = paired(model.transform(va), [], targets, prediction_names(len(targets)))
        found = score(pairs, [], [metric]).first()[metric]
        return trial, fold, math.nan if found is None else float(found)

    found: dict[tuple[int, int], float] = {}
    promoted: set[int] = set()
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        waiting = {pool.submit(scored, i, 0) for i in range(trials)}
        while waiting:
            done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
            found.update({(i, fold): s for i, fold, s in (f.result() for f in done)})
            sure = certain({i: sign * s for (i, fold), s in found.items() if fold == 0}, trials, keep) - promoted
            promoted |= sure
            waiting |= {pool.submit(scored, i, fold) for i in sure for fold in range(1, folds)}
    table = spark.createDataFrame([(i, fold, s) for (i, fold), s in sorted(found.items())], "trial int, fold int, score double")
    return Tuning(params, table, _pick(table, [], folds, metric), ())


def history(trials: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Best value so far in trial order, and the share of trials at or below each value."""
    w = W.partitionBy(*by, F.lit(0))
    return trials.withColumns({
        "best_so_far": F.min(value).over(w.orderBy("trial").rowsBetween(W.unboundedPreceding, 0)),
        "edf": F.cume_dist().over(w.orderBy(value)),
    })
