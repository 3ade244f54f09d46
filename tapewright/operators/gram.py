"""Cross-product (Gram) tables: all that a linear model needs to know about its rows.

Every task adds up Z'Z for its rows with numpy, where Z = [1, x, y]; the partial matrices are
summed entry by entry in a second aggregation.  Size per model: (1 + p + H)^2, whatever the
number of rows, so one pass over the data serves every penalty, every horizon and every
trial.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLUSH_GROUPS = 256


def packed_size(dim: int) -> int:
    return dim * (dim + 1) // 2


def unpack(values, dim: int) -> np.ndarray:
    """Upper triangle, row by row -> symmetric matrix."""
    out = np.zeros((dim, dim))
    out[np.triu_indices(dim)] = np.asarray(values, dtype=float)
    return out + np.triu(out, 1).T


def gram_table(rows: DataFrame, group: Sequence[str], x: Sequence[Column], y: Sequence[Column]) -> DataFrame:
    """(group..., gram array<double>): packed Z'Z per group."""
    dim = 1 + len(x) + len(y)
    tri = np.triu_indices(dim)
    vectors = rows.select(*group, F.array(F.lit(1.0), *x, *y).cast("array<double>").alias("z"))
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in group)
    names = list(group)

    def emit(sums: dict, schema: pa.Schema) -> pa.RecordBatch:
        keys = list(zip(*sums)) if names else []
        cols = [pa.array(list(k), type=schema.field(i).type) for i, k in enumerate(keys)]
        parts = pa.array([m[tri] for m in sums.values()], type=pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*cols, parts], names=[*names, "part"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            z = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            if names:
                where = pd.DataFrame({c: batch.column(i).to_pandas() for i, c in enumerate(names)}).groupby(names, sort=False, dropna=False).indices
            else:
                where = {(): slice(None)}
            for key, at in where.items():
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                sums[key] = sums.get(key, 0.0) + z[at].T @ z[at]
            if len(sums) > FLUSH_GROUPS:
                yield emit(sums, schema)
                sums = {}
        if sums:
            yield emit(sums, schema)

    head = f"{kinds}, " if kinds else ""
    partials = vectors.mapInArrow(partial, f"{head}part array<double>")
    entries = partials.select(*group, F.posexplode("part").alias("at", "value")).groupBy(*group, "at").agg(F.sum("value").alias("value"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "value")))
    return entries.groupBy(*group).agg(F.transform(ordered, lambda s: s["value"]).alias("gram"))


def gram_entries(grams: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Readable form: (group..., a, b, value) for every pair a <= b of [1, x..., y...]."""
    full = ["1", *names]
    rows, cols = np.triu_indices(len(full))
    a = F.array(*[F.lit(full[i]) for i in rows])
    b = F.array(*[F.lit(full[j]) for j in cols])
    zipped = grams.select(*group, F.posexplode("gram").alias("at", "value"))
    return zipped.select(*group, F.get(a, F.col("at")).alias("a"), F.get(b, F.col("at")).alias("b"), "value")
