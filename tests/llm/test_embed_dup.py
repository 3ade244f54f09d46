"""Embedding near-duplicates against brute force over all pairs."""

import math
import random

import numpy as np
import pytest

from tapewright.llm import embed_dup, queries


def brute(rows):
    """Rows (vec_id, n_links, component_id, kept) and the pairs of rows that are linked."""
    def good(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = [np.array(v, float) / np.max(np.abs(v)) if good(v) else None for _, v in rows]
    units = [u / np.linalg.norm(u) if u is not None else None for u in units]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = [0] * len(rows)
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or units[i] is None or units[j] is None or len(units[i]) != len(units[j]):
                continue
            if units[i] @ units[j] >= 0.9:
                n[i] += 1
                n[j] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    out = [(a, n[i], None if a is None else root(a), a is None or root(a) == a) for i, (a, _) in enumerate(rows)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def made(seed=3, dim=12):
    rng = np.random.default_rng(seed)
    pick = random.Random(seed)
    rows = [(0, None), (1, []), (2, [0.0] * dim), (3, [1.0] * (dim - 1) + [float("nan")]), (4, [1.0] * (dim - 1) + [None]), (None, [1.0] * dim),
            (5, [1e-300] * dim), (6, [1e300] * dim), (7, [1.0] * 3), (8, [2.0] * 3), (9, [float("inf")] * dim), (None, None)]
    at = 100
    for _ in range(400):
        rows.append((at, rng.standard_normal(dim).tolist()))
        at += 1
    for size in (2, 3, 3, 5, 8, 40, 300):
        centre = rng.standard_normal(dim)
        for _ in range(size):
            rows.append((at, (centre + rng.standard_normal(dim) * 0.1).tolist()))
            at += 1
    same = rng.standard_normal(dim).tolist()
    rows += [(at + i, same) for i in range(100)]
    rows += [(at, same), (at + 200, same), (at + 200, [-x for x in same])]  # repeated rows, one id with two vectors
    pick.shuffle(rows)
    return rows


SCHEMA = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("leaf, sample", [(1024, 8192), (32, 256)])
def test_equals_brute_force(spark, monkeypatch, leaf, sample):
    monkeypatch.setattr(embed_dup, "LEAF", leaf)
    monkeypatch.setattr(embed_dup, "SAMPLE", sample)
    rows = made()
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], SCHEMA + ", links int, rep binary")
    found, want = got(embed_dup.near_duplicates(df)), brute(rows)
    assert [r[0] for r in found] == [r[0] for r in want]
    if leaf == 1024:
        assert found == want
    else:  # splits and spill: few links may go, none is made up
        assert all(a[1] <= b[1] for a, b in zip(found, want, strict=True))
        assert sum(r[1] for r in found) >= 0.98 * sum(r[1] for r in want)


def test_groups_that_are_not_split_are_whole(spark, monkeypatch):
    monkeypatch.setattr(embed_dup, "LEAF", 16)
    monkeypatch.setattr(embed_dup, "SAMPLE", 128)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(12)
    rows = [(i, (centre + rng.standard_normal(12) * 0.05).tolist()) for i in range(500)]
    assert got(embed_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == [(*r,) for r in sorted(((i, 499, 0, i == 0) for i in range(500)), key=repr)]


def test_empty_tables(spark):
    assert got(embed_dup.near_duplicates(spark.createDataFrame([], SCHEMA))) == []
    assert got(embed_dup.near_duplicates(spark.createDataFrame([(1, None)], SCHEMA))) == [(1, 0, 1, True)]


def test_query_over_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(queries.op11_embedding_duplicates(spark, sf)) == brute(rows)
