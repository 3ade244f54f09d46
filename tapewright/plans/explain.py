"""Attributions of predictions to inputs, as long tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.models.base import FittedForecaster
from tapewright.models.elastic_net import FittedElasticNet
from tapewright.operators.joins import join_models
from tapewright.operators.prep import imputed, literal
from tapewright.operators.sampling import head_rows, seeded_sample

#: Rows of the background and coalitions of the design: what a row costs in predictions.
BACKGROUND, COALITIONS = 50, 48


def background(rows: DataFrame, key: Sequence[str], n: int = 100, seed: int = 42) -> DataFrame:
    return seeded_sample(rows, n, seed, key)


def linear_attribution(model: FittedElasticNet, rows: DataFrame, base: DataFrame, keep: Sequence[str]) -> DataFrame:
    """phi = weight * (x - mean of x over the background): (keep..., horizon, feature, phi, base).

    ``base`` is the mean prediction over the background, so prediction = base + sum of phi.
    Every row has every input at every horizon, with weight 0 too.  A model per series takes
    the background rows of its series.
    """
    enc, scope = model.inputs.encoded, list(model.scope)
    means = model.attach(base).select(*scope, *imputed(model.inputs)).groupBy(*scope).agg(F.array(*[F.avg(c) for c in enc]).alias("_means"))
    known = model.attach(rows)
    if scope:
        known = join_models(known, means, scope)
    else:
        known = known.withColumn("_means", literal(means.first()["_means"], "array<double>"))
    expected = F.zip_with("weights", "bias", lambda w, b: b + F.aggregate(F.zip_with(w, F.col("_means"), lambda x, m: x * m), F.lit(0.0), lambda a, v: a + v))
    centred = known.withColumn("_d", F.zip_with(F.array(*imputed(model.inputs)), "_means", lambda x, m: x - m)).withColumn("_base", expected)
    per_horizon = F.posexplode(F.arrays_zip("weights", F.col("_base").alias("base")))
    long = centred.select(*keep, "_d", per_horizon.alias("_h", "_m"))
    names = F.array(*[F.lit(n) for n in enc])
    per_input = F.inline(F.arrays_zip(names.alias("feature"), F.col("_m.weights").alias("weight"), F.col("_d").alias("gap")))
    return (
        long.select(*keep, (F.col("_h") + 1).alias("horizon"), F.col("_m.base").alias("base"), per_input)
        .select(*keep, "horizon", "feature", (F.col("weight") * F.col("gap")).alias("phi"), "base")
    )


def summarise(phi: DataFrame) -> DataFrame:
    """Mean absolute attribution per horizon and feature, and its rank."""
    means = phi.groupBy("horizon", "feature").agg(F.avg(F.abs("phi")).alias("importance"))
    order = W.partitionBy("horizon").orderBy(F.col("importance").desc(), "feature")
    return means.withColumn("rank", F.row_number().over(order))


def coalition_design(features: int, coalitions: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions (0-1 rows) and the matrix that maps their values to Shapley values.

    The first row is the empty coalition, the second the full one.  Sizes from the outside in are taken whole, each
    coalition with its complement, as long as ``coalitions`` allow; the rest is drawn, in pairs, by kernel weight.
    All coalitions give exact Shapley values, any such design gives those of an additive model.  The weighted least
    squares under the condition that attributions add up to the prediction are linear in the values of the
    coalitions, and the design is the same for all rows: so one matrix solves them all.
    """
    p = features
    ends = np.array([np.zeros(p), np.ones(p)])
    if p == 1:
        return ends, np.array([[-1.0, 1.0]])
    kernel = {k: (p - 1) / (k * (p - k)) for k in range(1, p)}  # weight of all coalitions of a size
    rows: dict[tuple[int, ...], float] = {}
    inner = list(range(1, p // 2 + 1))
    while inner:
        k = inner[0]
        sets = list(combinations(range(p), k)) if math.comb(p, k) <= coalitions else None
        members = None if sets is None else {tuple(int(j in s) for j in range(p)) for s in sets}
        both = None if members is None else members | {tuple(1 - z for z in m) for m in members}
        if both is None or (len(rows) + len(both) > coalitions and rows):
            break
        rows.update({m: kernel[k] / math.comb(p, k) for m in both})
        inner.pop(0)
    if inner:
        rng = np.random.default_rng(seed)
        shares = np.array([kernel[k] * (1 if 2 * k == p else 2) for k in inner])
        drawn: dict[tuple[int, ...], int] = {}
        for _ in range(max(0, coalitions - len(rows)) // 2):
            chosen = rng.permutation(p)[: inner[rng.choice(len(inner), p=shares / shares.sum())]]
            one = tuple(int(j in chosen) for j in range(p))
            for m in (one, tuple(1 - z for z in one)):
                drawn[m] = drawn.get(m, 0) + 1
        rows.update({m: shares.sum() * n / sum(drawn.values()) for m, n in drawn.items()})
    masks = np.array(list(rows), float)
    weight = np.array(list(rows.values()))
    a = masks[:, :-1] - masks[:, -1:]
    solver = np.linalg.solve(a.T @ (weight[:, None] * a), a.T * weight)
    last = masks[:, -1]
    values = np.column_stack([-solver @ (1 - last), -solver @ last, solver])
    rest = -values.sum(axis=0)
    rest[:2] += [-1.0, 1.0]
    return np.vstack([ends, masks]), np.vstack([values, rest])


def coalition_attribution(model: FittedForecaster, rows: DataFrame, base: DataFrame, keep: Sequence[str], coalitions: int = COALITIONS, size: int = BACKGROUND, seed: int = 42) -> DataFrame:
    """Attributions of any model to its inputs, by weighted coalitions: (keep..., horizon, feature, phi, base).

    Every row is mixed with the background, an ordered sample of ``size`` rows: inputs of the coalition from the row,
    the others from the background.  The model only predicts; attributions are sums over its predictions, so rows are
    neither solved one by one nor collected.  ``keep`` identifies a row.
    """
    names, kept, kinds = [*model.inputs.numeric, *model.inputs.categorical], list(keep), dict(rows.dtypes)
    found = head_rows(base.select(*kept, *names), kept, size).select(*names).collect()
    ground = [[None if v is None or v != v else float(v) for v in r] for r in found]
    masks, solver = coalition_design(len(names), coalitions, seed)
    empty = np.zeros((1, len(masks)))
    empty[0, 0] = 1.0
    plan = [{"z": m, "c": c} for m, c in zip(masks.astype(int).tolist(), (np.vstack([solver, empty]) / max(1, len(ground))).T.tolist(), strict=True)]
    mixed = rows.select(*kept, *names).withColumn("_d", F.explode(literal(plan, "array<struct<z:array<int>,c:array<double>>>")))
    mixed = mixed.withColumn("_b", F.explode(literal(ground, "array<array<double>>")))
    taken = [F.when(F.col("_d.z")[j] == 1, F.col(n)).otherwise(F.col("_b")[j].cast(kinds[n])).alias(n) for j, n in enumerate(names)]
    scored = model.transform(mixed.select(*kept, F.col("_d.c").alias("_c"), *taken))
    sums = [F.array(*[F.sum(F.col("_c")[j] * F.col(y)) for j in range(len(names) + 1)]).alias(y) for y in model.predictions]
    summed = scored.groupBy(*kept).agg(*sums)
    long = F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(y).alias("_s")) for h, y in enumerate(model.predictions, 1)]))
    entries = F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col("_s")[j].alias("phi")) for j, n in enumerate(names)]))
    return summed.select(*kept, long).select(*kept, "horizon", F.col("_s")[len(names)].alias("base"), entries).select(*kept, "horizon", "feature", "phi", "base")
