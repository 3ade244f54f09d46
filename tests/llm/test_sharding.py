"""Sharding against a brute-force shuffle in plain Python."""

import zlib
from collections import Counter

import pytest

from tapewright.llm import sharding
from tapewright.llm.sharding import MASK, MULTIPLIER, round_salts, sides


def mixed(x, salt):
    x = (x + salt) & MASK
    for _ in range(2):
        x = ((x >> 16 ^ x) * MULTIPLIER) & MASK
    return x >> 16 ^ x


def place(number, rows, seed):
    a, b = sides(rows)
    while True:
        left, right = divmod(number, b)
        for i, salt in enumerate(round_salts(seed)):
            if i % 2 == 0:
                left = (left + mixed(right, salt)) % a
            else:
                right = (right + mixed(left, salt)) % b
        number = left * b + right
        if number < rows:
            return number


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 100, 1009])
def test_permutation(spark, rows):
    df = spark.range(rows)
    got = {r.id: r.p for r in df.withColumn("p", sharding.permuted(df.id, rows)).collect()}
    assert got == {i: place(i, rows, sharding.SEED) for i in range(rows)}
    assert sorted(got.values()) == list(range(rows))


def test_shards(spark):
    rows = [(i, f"text {i % 17}", "x") for i in range(523)] + [(7, "same", "y")] * 40 + [(None, None, "z"), (None, None, "z"), (8, "", "é"), (9, "é" * 50000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string")
    got = sharding.shard(docs, 40).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, count in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(count))
    again = sharding.shard(docs.repartition(5), 40).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_numbers_follow_the_stated_order(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(300)], "doc_id long, text string")
    numbered, rows = sharding.row_numbers(docs)
    assert rows == 300
    buckets = {r.id: r.b for r in spark.range(300).selectExpr("id", "pmod(xxhash64(id), 8192) b").collect()}
    order = sorted(range(300), key=lambda i: (buckets[i], i))
    assert {r.doc_id: r.row_number for r in numbered.collect()} == {d: n for n, d in enumerate(order)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(docs).count() == 0


def test_query_over_documents(spark):
    """The law of the rows, sizes and checksums of every document."""
    import zlib

    from tapewright.llm import queries

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]))
        assert r.law == "rows" and 0 <= r.shard < 40 and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, ())) for i in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert {(r.doc_id, r.shard, r.slot) for r in queries.op10_sharding(spark, sf).collect()} == {(r.doc_id, r.shard, r.slot) for r in rows}
