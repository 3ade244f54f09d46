"""MinHash near-duplicates (operator 5): circulant MinHash, banding, exact verification, connected components.

Shingles are placed on a circle of 2^32 by a first permutation; coordinate k of a signature is the least value of a
second permutation, shifted by k places along the circle. Two permutations thus give all 128 coordinates. 32 bands of
4 make two sets of similarity 0.75 meet in a bucket but for a chance of 5 in a million.

Documents with equal sets are one node. Within a bucket, members are compared with one pivot, the member that shares
most buckets. Only where a bucket's members are not one component by then, those in different components are held
against each other in blocks, so that no link is lost; pairs come out only where components are joined. Every link is
confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import buffers, slices
from .graph import components
from .shingles import SHINGLE, mix, shingle_hashes, word_hashes
from .stored import stage

BANDS, ROWS = 32, 4
THRESHOLD = 75  # per cent
#: Members that are verified against one copy of their pivot; more are dealt over several copies.
MEMBERS = 64
#: Members of a bucket that a task holds against each other; larger buckets are cut into blocks, taken by twos.
BLOCK = 512
_STEP, _SPREAD, _LAST = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_CELL = 1 << 15


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Coordinates (texts x 128) of the sets of shingle hashes; texts must have shingles."""
    out = np.empty((BANDS * ROWS, len(at) - 1), np.uint32)
    circle = (hashes >> np.uint64(32)).astype(np.uint32) * _STEP
    low = 0
    while low < len(at) - 1:  # cells of about 32,768 shingles stay in the cache
        high = max(low + 1, int(np.searchsorted(at, at[low] + _CELL, "right")) - 1)
        cell, starts = circle[at[low]:at[high]], at[low:high] - at[low]
        work, shift = np.empty_like(cell), np.empty_like(cell)
        for k in range(BANDS * ROWS):
            np.add(cell, np.uint32((k * int(_STEP)) & 0xFFFFFFFF), out=work)
            np.right_shift(work, np.uint32(16), out=shift)
            np.bitwise_xor(work, shift, out=work)
            np.multiply(work, _SPREAD, out=work)
            np.right_shift(work, np.uint32(13), out=shift)
            np.bitwise_xor(work, shift, out=work)
            np.multiply(work, _LAST, out=work)
            out[k, low:high] = np.minimum.reduceat(work, starts)
        low = high
    return out.T


def band_hashes(coordinates: np.ndarray) -> np.ndarray:
    """64-bit bucket of each text in each band."""
    parts = coordinates.reshape(len(coordinates), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j] + np.uint64(1))
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "text"):
            hashes, at = shingle_hashes(*word_hashes(*buffers(texts)))
            full = np.flatnonzero(np.diff(at))
            sizes, keys = np.zeros(len(texts), np.int64), [None] * len(texts)
            for row in full.tolist():
                own = np.unique(hashes[at[row]:at[row + 1]])
                sizes[row], keys[row] = len(own), hashlib.md5(own.tobytes()).digest()
            counts = np.zeros(len(texts) + 1, np.int32)
            counts[1:][full] = BANDS
            bands = band_hashes(signatures(hashes, np.append(at[full], at[-1]))) if len(full) else np.zeros(0, np.uint64)
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.record_batch([part.column(0), pa.array(sizes), pa.array(keys, pa.binary()), listed], ["doc_id", "n_shingles", "set_key", "bands"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by pivot and copy, the pivot's texts first: confirmed links (a, b)."""
    group, pivots = None, []
    for batch in batches:
        for part, texts in slices(batch, "text"):
            hashes, at = shingle_hashes(*word_hashes(*buffers(texts)))
            rows = zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("pivot", "copy", "member", "doc")), strict=True)
            links = []
            for i, (pivot, copy, member, doc) in enumerate(rows):
                if (pivot, copy) != group:
                    group, pivots = (pivot, copy), []
                own = np.unique(hashes[at[i]:at[i + 1]])
                if not member:
                    pivots.append(own)
                    continue
                for other in pivots:
                    place = np.minimum(np.searchsorted(other, own), len(other) - 1)
                    common = int((other[place] == own).sum())
                    if 100 * common >= THRESHOLD * (len(own) + len(other) - common):
                        links.append((doc, pivot))
                        break
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (node, pivot), those whose texts (doc, text) have a similarity of 0.75 or more."""
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / MEMBERS).alias("copies"))
    dealt = pairs.join(sizes, "pivot").withColumn("copy", F.pmod(F.xxhash64("node"), F.col("copies")))
    members = dealt.select(F.col("node").alias("doc"), "pivot", "copy", F.lit(1).alias("member"))
    heads = dealt.select(F.col("pivot").alias("doc"), "pivot", "copy", F.lit(0).alias("member")).distinct()
    rows = members.union(heads).join(texts, "doc").repartition("pivot", "copy").sortWithinPartitions("pivot", "copy", "member")
    return rows.select("pivot", "copy", "member", "doc", "text").mapInArrow(_verified, "a long, b long")


def _short_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lower 32 bits of the shingle hashes of each text, and how many hashes fell together."""
    for batch in batches:
        for part, texts in slices(batch, "text"):
            hashes, at = shingle_hashes(*word_hashes(*buffers(texts)))
            full = [np.unique(hashes[a:b]) for a, b in zip(at, at[1:], strict=False)]
            short = [np.unique(f.astype(np.uint32)) for f in full]
            yield pa.record_batch([part.column(0), pa.array([x.tobytes() for x in short], pa.binary()), pa.array([len(f) for f in full], pa.int64())], ["doc", "short", "n"])


def shared_counts(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of the common shingles of all pairs of a block: common short hashes, and what may hide in equal ones."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    both = times[place] > 1
    owner, column = owner[both], column[place[both]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((len(sets), step), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    hidden = sizes - np.array([len(s) for s in sets])
    return np.round(out).astype(np.int64) + np.minimum(hidden[:, None], hidden[None, :])


def _block_links(sparing: bool):
    """Pairs (node, pivot) of a block that seem linked and are in different components.

    ``sparing``: only as many as join the components that they join.
    """
    def found(rows: list[tuple]) -> list[tuple[int, int]]:
        nodes, labels = [r[1] for r in rows], [r[2] for r in rows]
        if len(set(labels)) < 2:
            return []
        sizes = np.array([r[4] for r in rows], np.int64)
        common = shared_counts([np.frombuffer(r[3], np.uint32) for r in rows], sizes)
        label, side = np.unique(labels, return_inverse=True)[1], np.array([r[5] for r in rows])
        near = (100 * common >= THRESHOLD * (sizes[:, None] + sizes[None, :] - common)) & (label[:, None] != label[None, :])
        if side.max() > 0:
            near &= side[:, None] != side[None, :]
        out, parent = [], list(range(len(rows)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in np.argwhere(np.triu(near)).tolist():
            a, b = root(label[i]), root(label[j])
            if a != b or not sparing:
                parent[a] = b
                out.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            out = []
            for block, *row in zip(*columns, strict=True):
                if block != group:
                    out += found(rows) if len(rows) > 1 else []
                    group, rows = block, []
                rows.append((block, *row))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "pivot"])
        a, b = zip(*out, strict=True) if (out := found(rows) if len(rows) > 1 else []) else ((), ())
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "pivot"])

    return run


def unresolved(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets in which, besides the pivot, texts of different components meet."""
    labelled = members.where("size > 2").join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("bucket")
    return stage(labelled.join(mixed, "bucket").select("bucket", "node", "label", "size"), "open")


def linked_in_buckets(open_: DataFrame, texts: DataFrame, sparing: bool) -> DataFrame:
    """Pairs of members of a bucket that seem linked and are in different components.

    A bucket is cut into blocks of at most about ``BLOCK`` members; a task gets one block, or two to hold against each
    other, and counts what their sets have in common by products of 0-1 matrices. Pairs are not made but where linked.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = open_.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cut = cut.withColumn("other", other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    key = F.when(low == high, F.xxhash64("bucket", low)).otherwise(F.xxhash64("bucket", low, high))
    cut = cut.select(F.col("node").alias("doc"), "label", key.alias("block"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") == low, 1).otherwise(2).alias("side"))
    short = stage(texts.select("doc", "text").mapInArrow(_short_sets, "doc long, short binary, n long"), "short")
    rows = cut.join(short, "doc").select("block", "doc", "label", "short", "n", "side")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_block_links(sparing), "node long, pivot long")


def _even(a: str, b: str):
    """Sizes allow the similarity: the smaller set has 75 % of the larger one at least."""
    return 100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: ``key``, ``n_shingles``, ``component_id`` (least id that it reaches by links) and ``kept`` (it is that).

    Two documents are linked if their sets of 5-word shingles have a similarity of 0.75 or more; a text of fewer words
    has one shingle; null and empty texts have none and are linked with nothing. Rows with the same id are one document
    with all their links, and each gives a row. Rows without an id are linked with nothing, have no component and are
    kept. Ids are integers. Other columns are not read. Without documents the result is empty.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches = stage(rows.mapInArrow(_sketched, "doc_id long, n_shingles long, set_key binary, bands array<long>"), "sketches")
    known = sketches.where("doc_id is not null and n_shingles > 0")
    sets = known.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    placed = stage(known.select("doc_id", "n_shingles", "set_key").join(sets, "set_key").select("doc_id", "n_shingles", "node"), "placed")

    firsts = known.join(stage(sets, "sets").withColumnRenamed("node", "doc_id"), ["set_key", "doc_id"])
    spread = firsts.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(spread.join(shared, "bucket"), "members")
    texts = stage(rows.withColumnRenamed("doc_id", "doc").join(members.select(F.col("node").alias("doc")).distinct(), "doc", "left_semi"), "texts")

    own = placed.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").select("doc_id", "b")
    links = stage(placed.join(own, "doc_id").select(F.col("node").alias("a"), "b"), "links")

    central = members.groupBy("node").agg(F.sum("size").alias("score"))
    heads = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"), "n")).alias("head"))
    pairs = members.join(heads, "bucket").select("node", (-F.col("head.minus")).alias("pivot"), "n", F.col("head.n").alias("pivot_n"))
    pairs = stage(pairs.where("node <> pivot").where(_even("n", "pivot_n")).select("node", "pivot").distinct(), "pairs")
    links = links.union(stage(confirmed(pairs, texts), "links"))

    found = components(links)
    for sparing in (True, False):
        open_ = unresolved(members, found)
        if open_.isEmpty():
            break
        pairs = stage(linked_in_buckets(open_, texts, sparing).distinct(), "pairs")
        fresh = stage(confirmed(pairs, texts).distinct(), "links")
        links = links.union(fresh)
        found = components(links)
        if pairs.count() == fresh.count():  # a refuted pair may have stood in for another one: then all are tried
            break

    whole = placed.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    single = sketches.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = whole.union(single).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return out.withColumnRenamed("doc_id", key)
