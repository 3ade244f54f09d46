"""Spelling variant grouping (operator 12): words that differ by one code point, found by PartEnum signatures.

A word's letters as a multiset are a binary vector: one dimension for each letter and number of its occurrence. An
inserted, deleted or replaced code point changes two dimensions at most. The dimensions are dealt over ``PARTS``
partitions; of two vectors at distance two or less, all partitions but two are equal. So each word has a signature for
every pair of partitions left out, near words share one of them for certain, and an equi-join of signatures with an
edit distance of exactly one gives all pairs. Buckets of many words are joined by signature and one-deletion variant
instead, which near words share as well.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import text_column
from .shingles import mix
from .stored import stage

#: Runs of letters: A-Z, a-z and U+00C0 to U+00FF, as UTF-8 with A-Z lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
BREAK = re.compile(rb"[^a-z\x80-\xff]")
MIN_LENGTH, MIN_COUNT = 6, 5
#: One form in so many (document, run) pairs loses a code point.
DAMAGE = 199
#: A form occurs so many times as often as its variant at least.
RATIO = 5
#: Partitions of the dimensions; a signature leaves two of them out.
PARTS = 8
#: Words of a signature that are held against each other; larger buckets are joined by variant too.
BUCKET = 64
#: Bytes of a text that are cut into runs at a time, and distinct words of a task before they are passed on.
WINDOW_BYTES, HELD_WORDS = 1 << 20, 200_000


def _windows(text: bytes) -> Iterator[bytes]:
    """Parts of a text, cut between runs."""
    at = 0
    while at < len(text):
        cut = BREAK.search(text, at + WINDOW_BYTES)
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def passed_on() -> pa.RecordBatch:
        return pa.record_batch([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = text_column(batch, "text")
        for doc, text in zip(ids, texts, strict=True):
            prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            runs: Counter[bytes] = Counter()
            for part in _windows(text.as_py().lower()):
                runs.update(RUN.findall(part))
            for run, n in runs.items():
                h = zlib.crc32(run, prefix)
                if not h % DAMAGE:
                    word = run.decode()
                    run = (word[:h % len(word)] + word[h % len(word) + 1:]).encode()
                # every letter has one byte or two
                if len(run) >= 2 * MIN_LENGTH or (len(run) >= MIN_LENGTH and len(run.decode()) >= MIN_LENGTH):
                    held[run] = held.get(run, 0) + n
            if len(held) >= HELD_WORDS:
                yield passed_on()
                held = {}
    yield passed_on()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of all words of six code points and five occurrences or more."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    parts = rows.mapInArrow(_counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def signatures(words: list[str]) -> np.ndarray:
    """64-bit signatures (words x pairs of partitions left out)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(codes))
    turn = at - np.maximum.accumulate(np.where(fresh, at, 0))  # number of this occurrence of the letter
    with np.errstate(over="ignore"):
        part = (codes * 5 + turn) % PARTS
        value = mix((codes.astype(np.uint64) << np.uint64(32)) | turn.astype(np.uint64))
        sums = np.zeros(len(words) * PARTS, np.uint64)
        np.add.at(sums, owner * PARTS + part, value)
        sums = sums.reshape(-1, PARTS)
        whole = sums.sum(1, dtype=np.uint64)
        pairs = [(i, j) for i in range(PARTS) for j in range(i + 1, PARTS)]
        return np.stack([mix(whole - sums[:, i] - sums[:, j] + np.uint64(1 + i * PARTS + j)) for i, j in pairs], 1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            found = signatures(part.column(0).to_pylist())
            ends = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
            listed = pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1).view(np.int64)))
            yield pa.record_batch([part.column(0), listed], ["word", "signs"])


def variants(word: str):
    """The word, and the word without each of its code points."""
    return F.expr(f"array_distinct(concat(array({word}), transform(sequence(1, char_length({word})), i -> concat(substring({word}, 1, i - 1), substring({word}, i + 1)))))")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, b), a before b, of distinct words that differ by one inserted, deleted or replaced code point."""
    signs = words.select("word").mapInArrow(_signed, "word string, signs array<long>")
    spread = stage(signs.select("word", F.explode("signs").alias("sign")), "signatures")
    sizes = spread.groupBy("sign").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(spread.join(sizes, "sign"), "buckets")

    def met(rows: DataFrame, on: list[str]) -> DataFrame:
        a, b = rows.withColumnRenamed("word", "a"), rows.withColumnRenamed("word", "b")
        verified = (F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
        return a.join(b, on).where(verified).select("a", "b")

    few = members.where(F.col("size") <= BUCKET).select("sign", "word")
    many = members.where(F.col("size") > BUCKET).select("sign", "word", F.explode(variants("word")).alias("variant"))
    many = many.select(F.xxhash64("sign", "variant").alias("sign"), "word")
    return met(few, ["sign"]).union(met(many, ["sign"])).distinct()


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``.

    Words are the maximal runs of letters of whole texts, A-Z lower-cased (a run loses a code point where the checksum
    of id and run asks for it), of six code points and five occurrences or more over all texts. ``n_near`` counts the
    words that differ by exactly one inserted, deleted or replaced code point. ``form`` is the most frequent of these
    (ties: the first in code-point order) if it occurs five times as often, else null; ``root`` follows forms to the last.

    Null and empty texts have no words. A null id is taken as empty text. Repeated rows count each. Other columns are
    not read. Without words the result is empty.
    """
    words = stage(word_counts(docs, key, text), "words")
    pairs = stage(near_pairs(words), "near")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    others = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    near = others.groupBy("word").agg(F.count("*").alias("n_near"), best)
    known = words.join(near, "word", "left")
    formed = -F.col("best.minus") >= RATIO * F.col("n")
    known = stage(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.minus")).alias("form_n"),
    ), "forms")
    return known.join(_roots(known), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(forms: DataFrame) -> DataFrame:
    """Last word of each chain of forms, by doubling steps. Counts rise five times a step, so chains are short."""
    step = stage(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = stage(step.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return step
