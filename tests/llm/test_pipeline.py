"""The pipeline against the brute-force versions of its operators."""

import hashlib

import test_decontaminate
import test_near_dup
import test_quality
import test_secrets

import corpus_pipeline
from tapewright.llm import queries


def masked(text):
    out, at = "", 0
    for start, _, end in test_secrets.brute(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def brute(docs, items):
    """(doc_id, text) of the rows that reach the last stage, text masked."""
    kept = {r[:-1] for r in test_quality.brute([(d, t, x) for d, t, x in docs]) if r[-1]}
    rows = [(d, t) for (d, t, _), r in zip(docs, test_quality.brute(docs), strict=True) if r[-1]]
    assert len(kept) <= len(rows)
    alive = {d for d, _, _, ok in test_near_dup.brute(rows) if ok}
    one = {d: t for d, t in sorted(rows, key=repr, reverse=True) if d in alive and d is not None}
    rows = list(one.items()) + [(d, t) for d, t in rows if d is None]
    leaked = {d for d, _, _, _ in test_decontaminate.brute(rows, items)}
    return [(d, masked(t)) for d, t in rows if d not in leaked]


def digests(rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    out = []
    for d, t in rows:
        ids = library.encode(t)
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr)
    want = digests(brute(docs, items))
    assert got == want
    assert 100 < len(got) < len(docs)


def test_stages_with_odd_rows(spark):
    """Null ids, repeated rows, one id with two texts, empty input and an extra column."""
    text = lambda k: " ".join(f"the{k} of and word{k}_{i} to" for i in range(30))
    rows = [(1, text(1), "en", "s", 5, "a"), (1, text(1), "en", "s", 5, "a"), (2, text(1), None, None, None, "b"), (3, text(3) + " token=abcdefgh", "en", "s", None, None),
            (3, text(4), "en", "s", 1, None), (None, text(5), "en", "s", 2, "c"), (6, None, "en", "s", 0, "d"), (7, "", None, "s", 0, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    out = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
        out = function(spark, out, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
    final = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert final == sorted([(1, text(1)), (3, min(text(3) + " [SECRET]", text(4))), (None, text(5))], key=repr)
    assert corpus_pipeline.STAGES[-1][1](spark, out, "").count() == 3


def test_columns_with_clashing_names_and_maps(spark):
    """Columns named like those that the stages add, and a map, come through every stage but the last."""
    text = lambda k: " ".join(f"the{k} of and word{k}_{i} to" for i in range(30))
    rows = [(1, text(1) + " token=abcdefgh", "en", 5, "l", "s", "m", {"k": 1}), (1, text(1) + " token=abcdefgh", "en", 5, "l", "s", "m", {"k": 0}), (2, text(2), "en", 6, None, None, None, None)]
    schema = "doc_id long, text string, lang string, n_chars long, leaks string, SECRETS string, masked string, tags map<string,int>"
    docs = spark.createDataFrame(rows, schema)
    sf = "/root/testdata/sf0.001"
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, sf)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        got = sorted(docs.collect(), key=lambda r: r.doc_id)
        assert [r.doc_id for r in got] == ([1, 1, 2] if name == "quality rules" else [1, 2])
    assert got[0].masked == "m" and got[0].leaks == "l" and got[0].SECRETS == "s" and got[0].tags == {"k": 0}
    assert "token=" not in got[0].text or "abcdefgh" not in got[0].text
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 2
