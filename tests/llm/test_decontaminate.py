"""Containment search against brute force."""

import random

from tapewright.llm import decontaminate, queries
from tapewright.llm.shingles import plain_shingles


def brute(docs, items):
    sets = [(i, plain_shingles((t or "").encode())) for i, t in items]
    out = set()
    for d, text in docs:
        own = plain_shingles((text or "").encode())
        out |= {(d, i, len(s), len(s & own)) for i, s in sets if s and 100 * len(s & own) >= 75 * len(s)}
    return out


def found(frame):
    return {(r.doc_id, x.item, x.n_shingles, x.n_common) for r in frame.collect() for x in r.leaks}


def made(seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "x.", "Z"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 3, 4, 5, 6, 8, 9, 12, 20, 40, 60])] + [(20, ""), (21, None), (3, "the same key"), (22, " \t\n")]
    docs = [(0, None), (1, ""), (2, say(30000))]
    for n in range(60):
        item = (items[rng.randrange(11)][1] or "").split()
        for _ in range(rng.randrange(4)):
            item[rng.randrange(len(item))] = "changed"
        docs.append((10 + n, f"{say(rng.randrange(200))}\n{' '.join(item).upper()}\t{say(rng.randrange(5))}"))
    docs += [(10 + n, items[n][1]) for n in range(11)] + [(500, "the same key"), (None, items[8][1])] + [docs[30]] * 3
    return docs, items


def test_equals_brute_force(spark):
    docs, items = made()
    left = spark.createDataFrame([(d, t, "n") for d, t in docs], "doc_id long, text string, item string")
    right = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 20
    got = decontaminate.contained(left, right)
    assert got.count() == len(docs) and got.columns == ["doc_id", "text", "item", "leaks"]
    assert found(got) == want
    assert found(decontaminate.contained(left, right, block_words=30)) == want  # many blocks
    assert found(decontaminate.contained(left, right.limit(0))) == set()
    assert decontaminate.contained(left.limit(0), right).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_common) for r in queries.op1_decontamination(spark, sf).collect()}
    assert got == brute(docs, items) and got
