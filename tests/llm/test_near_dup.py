"""Near-duplicates against brute force over all pairs."""

import random
from collections import defaultdict

import pytest

from tapewright.llm import graph, near_dup, queries
from tapewright.llm.shingles import plain_shingles


def brute(rows):
    """Rows of (doc_id, n_shingles, component_id, kept)."""
    sets = [plain_shingles((t or "").encode()) for _, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for g in s:
                holders[g].append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        common = defaultdict(int)
        for g in s:
            for j in holders[g]:
                if j < i:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                a, b = root(rows[i][0]), root(rows[j][0])
                parent[max(a, b)] = min(a, b)
    out = []
    for (d, _), s in zip(rows, sets, strict=True):
        c = None if d is None else root(d)
        out.append((d, len(s), c, d is None or c == d))
    return sorted(out, key=repr)


def made(seed=4):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one TWO"), (5, "one two three four five"), (6, "a " * 60000), (7, "A " * 500), (None, "one two"), (None, None)]
    n = 10
    for _ in range(12):
        base = say(rng.randrange(20, 300))
        for _ in range(rng.randrange(2, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = "new"
            n += rng.randrange(1, 5)
            rows.append((n, " ".join(copy)))
    chain = say(100)
    for k in range(30):  # each like its neighbours only
        rows.append((1000 - k, " ".join(chain[4 * k:] + [f"x{i}" for i in range(4 * k)])))
    rows += [rows[20], rows[20], (rows[25][0], rows[60][1])]
    rng.shuffle(rows)
    return rows


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_equals_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    assert got(near_dup.near_duplicates(docs)) == brute(rows)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op5_near_duplicates(spark, sf)) == brute(rows)


@pytest.mark.parametrize("block", [7, 512])
def test_pairs_of_middling_similarity_meet_in_blocks(spark, monkeypatch, block):
    """Many texts share 60 % of their words and few are linked: no pair may be lost."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(40):
        own = [f"o{i}_{j}" for j in range(40)]
        rows.append((2 * i, " ".join(common + own)))
        if i % 4 == 0:
            rows.append((2 * i + 1, " ".join(common + own[:36] + ["z"] * 4)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dup.near_duplicates(docs)) == brute(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100 + i, 60) for i in range(40)] + [(7, 7), (3, 2)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = dict(tuple(r) for r in graph.components(frame).collect())
    assert found == {**{i: 0 for i in range(51)}, **{100 + i: 60 for i in range(40)}, 60: 60}
    assert graph.components(frame.limit(0)).count() == 0
