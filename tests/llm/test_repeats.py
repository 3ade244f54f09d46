"""Suffix dedup against brute force over all 50-byte strings."""

import hashlib
import random

import numpy as np

from tapewright.llm import queries, repeats


def brute(rows):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        if d is not None:
            for i in range(len(raw) - 49):
                g = raw[i:i + 50]
                first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if d is not None:
            for i in range(len(raw) - 49):
                if first[raw[i:i + 50]] < d:
                    gone[i:i + 50] = b"\x01" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "é中", "alpha", "be", "\n", "x", "\x00", "zeta-eta"]
    say = lambda n: " ".join(rng.choice(words) + (str(rng.randrange(99)) if rng.random() < 0.5 else "") for _ in range(n))
    passages = [say(rng.randrange(5, 60)) for _ in range(12)]
    rows = [(3, None), (4, ""), (5, "short"), (6, "a" * 700), (7, "a" * 49), (2, "a" * 60), (8, "ab" * 300), (9, "ab" * 40), (None, passages[0] * 3)]
    for i in range(80):
        text = say(rng.randrange(0, 80))
        for _ in range(rng.randrange(4)):
            p = passages[rng.randrange(12)]
            a = rng.randrange(len(p) // 2)
            text += p[a:a + rng.randrange(10, 200)] + say(rng.randrange(3))
        rows.append((rng.randrange(10, 90), text))
    rows += [rows[20], rows[21], (500, rows[22][1]), (501, rows[22][1]), (1, say(20000)), (600, passages[3])]
    rng.shuffle(rows)
    return rows


def test_merge_of_front_coded_runs():
    rng = np.random.default_rng(3)
    runs = []
    for n in [0, 1, 300, 40, 5, 120, 77]:
        rows = np.zeros((n, repeats.WIDTH), np.uint8)
        rows[:, rng.integers(0, repeats.WIDTH, 6)] = rng.integers(0, 3, (n, 6))
        rows = np.unique(rows, axis=0) if n else rows
        if len(rows):
            back = repeats.decoded(repeats.front_coded(rows, np.arange(len(rows))))
            assert back[0] == [r.tobytes() for r in rows]
            runs.append((back[0], back[1]))
    run, place, shared = repeats.merge_runs(runs)
    merged = [runs[r][0][p] for r, p in zip(run, place, strict=True)]
    assert merged == sorted(x for rows, _ in runs for x in rows)
    for a, b, s in zip(merged, merged[1:], shared[1:], strict=False):
        assert a[:s] == b[:s] and (s == repeats.WIDTH or a[s] != b[s])


def test_blocks_do_not_matter(monkeypatch):
    raw = np.frombuffer("".join(t or "" for _, t in made(9)).encode(), np.uint8)
    offsets = np.array([0, 10, 10, 700, 3000, 3049, len(raw) - 5, len(raw)])
    want = repeats.Anchors(raw, offsets)
    for block in (64, 1000, 4096):
        monkeypatch.setattr(repeats, "BLOCK", block)
        got = repeats.Anchors(raw, offsets)
        for name in ("at", "first", "last", "keys", "text"):
            assert np.array_equal(getattr(got, name), getattr(want, name)), (block, name)


def test_equals_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string").repartition(6)
    got = repeats.remove_repeats(docs, digest=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
    texts = repeats.remove_repeats(docs).collect()
    assert sorted(hashlib.sha256(bytes(r.kept)).hexdigest() for r in texts) == sorted(r[4] for r in brute(rows))
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op8_suffix_dedup(spark, sf).collect()), key=repr) == brute(rows)
