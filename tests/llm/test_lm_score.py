"""Backoff scoring against a plain Python model."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tapewright.llm import census, lm_score, queries

HELD = "pmod(crc32(cast(cast(doc_id as string) as binary)), 7) <> 2"


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def brute(rows, order, mu):
    train = [["<s>", *words(t), "</s>"] for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    counts = [Counter(tuple(s[i - k:i + 1]) for s in train for i in range(k, len(s))) for k in range(order)]
    tokens = {w: c for (w,), c in counts[0].items() if w != "<s>"}
    n, v = sum(tokens.values()), len(tokens)

    def chance(gram):
        if len(gram) == 1:
            return (counts[0][gram] + 1) / (n + v + 1)
        return (counts[len(gram) - 1][gram] + mu * chance(gram[1:])) / (counts[len(gram) - 2][gram[:-1]] + mu)

    out = []
    for d, t in rows:
        s = ["<s>", *words(t), "</s>"]
        base = sum(math.log10((tokens.get(w, 0) + 1) / (n + v + 1)) for w in s[1:])
        model = sum(math.log10(chance(tuple(s[max(0, i - order + 1):i + 1]))) for i in range(1, len(s)))
        held = d is None or zlib.crc32(str(d).encode()) % 7 == 2
        out.append((d, held, len(s) - 1, sum(w in tokens for w in s[1:]), n, base, model))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, round(r[6], 5))
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert tuple(a[:5]) == tuple(b[:5])
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(spark, order, tmp_path):
    text = "the cat sat on the mat and the cat ran off the mat of The Dog\n"
    rows = [(i, text[i % 9: 40 + i] * (1 + i % 3)) for i in range(60)] + [(60, None), (61, ""), (62, " \t"), (63, "one"), (5, "again the cat"), (5, "again the cat"), (None, "the cat"), (64, "w x " * 20000)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, train string").repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    same(lm_score.score(docs, HELD, order, 1.5).collect(), brute(rows, order, 1.5))
    assert lm_score.score(docs.limit(0), HELD, order).count() == 0


@pytest.mark.parametrize("bits", [[1, 1], [2, 1, 3]])
def test_levels_of_buckets_give_the_same_counts(spark, bits, monkeypatch):
    monkeypatch.setattr(census, "CHUNK_BYTES", 200)
    monkeypatch.setattr(census, "levels", lambda *_: bits)
    text = "the cat sat on the mat and the cat ran off the mat of The Dog\n"
    rows = [(i, text[i % 9: 40 + i] * (1 + i % 3)) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.where("doc_id < 60").unionByName(docs.where("doc_id >= 60"))  # a chunk without longer n-grams
    same(lm_score.score(docs, HELD, 3, 1.5).collect(), brute(rows, 3, 1.5))


def test_rows_exchanged_grow_with_the_input():
    assert census.levels(0, 11, 16 << 20) == census.levels(32 << 30, 11, 16 << 20) == [11]
    assert census.levels(33 << 30, 11, 16 << 20) == [11, 1] and census.levels(100 << 40, 11, 16 << 20) == [11, 11, 1]
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 10_000, np.uint64))
    for total in (1 << 20, 300 << 30, 100 << 40):  # a chunk sends as many rows however large the input is
        rows = census.request(5, 0, keys, np.ones(len(keys), np.int64), census.levels(total, 7, 64 << 20))
        assert rows.num_rows == 128
        assert np.array_equal(np.concatenate([census.unpacked_keys(k.as_py()) for k in rows.column(4)]), keys)


def test_stretches_are_read_as_one_text():
    words = np.random.default_rng(3).choice(["a", "b", "c", "d"], 3000)
    texts = pa.array([" ".join(words).encode(), b"", b"a b a"], pa.large_binary())
    grams = lm_score.Grams(texts, 4)
    totals = [grams.counts(k, np.array([True, False, True])) for k in range(4)]
    totals = [np.where(np.arange(len(t)) % 5 == 2, 0, t) if k == 3 else t for k, t in enumerate(totals)]
    model = lm_score.Automaton(grams, totals, 3000, 5, 2.0)
    want = []
    for a, b in zip(grams.starts, grams.starts[1:]):
        state, total = np.zeros(1, np.int64), 0.0
        for i in range(a, b):
            state, weight = model.step(state, grams.place[0][i:i + 1])
            total += weight[0] * (i > a)
        want.append(total)
    assert model.run(grams) == pytest.approx(want, rel=1e-12)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op3_lm_score(spark, sf).collect()
    same(got, brute(rows, queries.LM_ORDER, lm_score.MU))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
