"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tapewright.llm import queries, spelling


def words_of(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    n = words_of(docs)
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    forms, out = {}, {}
    for w in n:
        others = [o for k in (len(w) - 1, len(w), len(w) + 1) for o in by_length.get(k, ()) if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        forms[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = len(others)
    rows = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n[w], out[w], n[forms[w]] if forms[w] else None))
    return sorted(rows)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def made(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(6, 10))) for _ in range(120)] + ["lettered", "÷×ÿÀàé"]
    for w in list(words):
        for _ in range(4):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1:], w.upper()]))
    docs = [(0, None), (1, ""), (2, "12 34"), (None, "abcdef " * 9), (3, "Common " * 5000), (4, "z" * 3000 + " " + "z" * 3001), (4, "z" * 3000)]
    docs += [(5 + i, "z" * 3000 + "-" + "z" * 3001) for i in range(7)]
    docs += [(15, "chaina " * 6 + "chainab " * 30 + "chainabc " * 150 + "chainabcd " * 749)]
    for d in range(20, 300):
        docs.append((d, " ".join(words[min(int(rng.expovariate(0.01)), len(words) - 1)] for _ in range(60))))
    return docs


@pytest.mark.parametrize("bucket, window", [(64, 1 << 20), (2, 50)])
def test_equals_brute_force(spark, monkeypatch, bucket, window):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    monkeypatch.setattr(spelling, "WINDOW_BYTES", window)
    docs = made()
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, n int, word string")
    want = brute(docs)
    assert want and any(r[1] for r in want) and any(r[1] != r[2] for r in want if r[1])
    assert got(spelling.spelling_variants(df)) == want


def test_empty_tables(spark):
    assert got(spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string"))) == []
    assert got(spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "few words")], "doc_id long, text string"))) == []


def test_near_words_share_a_signature():
    rng = random.Random(4)
    for _ in range(2000):
        a = "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(6, 14)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + a[i + 1:], a[:i] + "q" + a[i:], a[:i] + "r" + a[i + 1:], a[:i] + a[i] + a[i:]])
        x, y = spelling.signatures([a, b])
        assert set(x) & set(y)


def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op12_spelling(spark, sf)) == brute(docs)
