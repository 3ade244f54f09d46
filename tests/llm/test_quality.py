"""Quality rules against a brute-force version in plain Python."""

import math
import re
from collections import Counter

import pytest

from tapewright.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    found = Counter(windows)
    covered = {j for i, w in enumerate(windows) if found[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup,
            "n_repeat_words": len(covered), "base_failed": n < 20 or 100 * len(covered) > 30 * n}


def histograms(text):
    text = text or ""
    words = WORD.findall(text)
    classes = [len(re.findall(p.replace("\\\\", "\\"), text)) for p in quality.CLASSES.values()]
    blank = len(text) - sum(map(len, words))
    classes += [blank, len(text) - blank - sum(classes)]
    low = Counter(w.lower() for w in words)
    common = [low[w] for w in quality.vocabulary()]
    bare = sum(not re.search(r"[A-Za-z0-9]|[^\x00-\x7F]", w) for w in words)
    return len(text), len(words), classes, [*common, bare, len(words) - sum(common) - bare]


def distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    return math.sqrt(sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q, strict=True)) / 2)


def brute(rows):
    refs = {}
    for _, text, lang in rows:
        if not base(text)["base_failed"]:
            _, _, c, w = histograms(text)
            old = refs.setdefault(lang or "", ([0] * len(c), [0] * len(w)))
            refs[lang or ""] = ([a + b for a, b in zip(old[0], c, strict=True)], [a + b for a, b in zip(old[1], w, strict=True)])
    out = []
    for i, text, lang in rows:
        b, (chars, n, c, w) = base(text), histograms(text)
        ok = not b["base_failed"]
        if lang in refs or (lang or "") in refs:
            ref = refs[lang or ""]
            ok = ok and not (chars >= quality.MIN_CHARS and distance(c, ref[0]) > quality.CLASS_LIMIT)
            ok = ok and not (n >= quality.MIN_WORDS and distance(w, ref[1]) > quality.WORD_LIMIT)
        out.append((i, *b.values(), ok))
    return out


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_equals_brute_force(spark, source):
    if source == "documents":
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
        rows = [tuple(r) for r in docs.collect()]
    else:
        eight = "a b c d e f g h"
        rows = [(1, None, "en"), (2, "", None), (3, " \t\x0b\x0c\r\n ", "en"), (4, f"{eight} {eight} {eight}", "en"), (5, f"{eight} x {eight} y\n\n{eight}\n \n{eight}", None),
                (5, "Same\nSame\nsame\n \n\x0b\n", "xx"), (None, "w " * 30000, "en"), (6, "the of and é中 {x} " * 40 + "q w e", "en"), (6, "the of and é中 {x} " * 40 + "q w e", "en"),
                (7, "\x85a b c " * 30, "zz"), (8, "x" * 5000, "en")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    columns = ["row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = [tuple(r) for r in quality.quality(docs).select(columns).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_junk_goes_and_clean_stays(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op6_quality(spark, sf).join(labels, "doc_id").where("not base_failed")
    kept = {r.quality: r.share for r in got.selectExpr("quality", "cast(kept as int) k").groupBy("quality").avg("k").toDF("quality", "share").collect()}
    assert kept[1] == 1.0 and kept[0] < 0.1


def test_empty_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b " * 40, "en", "w")], "doc_id long, text string, lang string, words string")
    assert quality.quality(docs).count() == 1
    assert quality.quality(docs.limit(0)).count() == 0
