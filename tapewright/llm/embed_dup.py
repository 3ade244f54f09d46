"""Embedding near-duplicates (operator 11): a forest of random-projection trees with spill overlap.

Each of ``TREES`` trees splits the vectors recursively along random directions at the median; vectors close to a split
go to both sides. All vectors of a leaf are compared, cosine in double precision. Splits are learned from a sample of
``SAMPLE`` vectors per node that is still too large, the vectors that reach it by their hash; every vector is then sent
down the trees. A node whose sampled vectors are mostly linked with each other isn't split further: its vectors are
compared block by block instead, so that no link of a large group is lost.

Equal vectors are one node with a number of copies. A pair that shares several leaves counts in the least of them, so
links are counted without writing pairs; of a leaf's links only those that join its components come out.

With the threshold of 0.9 a split separates a pair at the threshold with a chance of about 0.065, so that a path of
d levels in all of T trees loses it with (1 - 0.935^d)^T: below 0.001 for 10^5 vectors, 0.07 for 10^9.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shingles import mix
from .stored import stage

COSINE = 0.9
TREES = 8
#: Vectors of a leaf; nodes of more are split.
LEAF = 1024
#: Vectors from which the splits of a node and of those below it are learned; the least share of a split's sample.
SAMPLE, LEAST = 8192, 64
#: Share of the vectors on either side of a split that go to both.
SPILL = 0.05
#: Directions that are tried for a split; sampled vectors that are compared to judge them.
TRIED, JUDGED = 4, 512
#: Numbers of directions that a task keeps between batches.
HELD_NUMBERS = 4_000_000
#: Large leaves whose list is broadcast; a longer one is joined.
BROADCAST_LEAVES = 100_000
#: Bytes of learned splits that are broadcast at a time.
SPLITS_BYTES = 64 << 20


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes; null where a vector links with nothing."""
    for batch in batches:
        column = batch.column(1)
        values = column.flatten().cast(pa.float64())
        lengths = np.where(column.is_valid().to_numpy(False), column.value_lengths().fill_null(0).to_numpy(False), 0)
        flat = values.to_numpy(False)  # null as nan
        ends = np.cumsum(lengths)
        out: list[bytes | None] = [None] * len(lengths)
        for n in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == n)
            part = flat[(ends[rows] - n)[:, None] + np.arange(n)]
            most = np.abs(part).max(1)
            good = np.isfinite(part).all(1) & (most > 0)
            part = part[good] / most[good, None]
            part = part / np.sqrt((part * part).sum(1))[:, None] + 0.0
            for row, vector in zip(rows[good].tolist(), part, strict=True):
                out[row] = vector.tobytes()
        keys = [None if v is None else hashlib.md5(v).digest() for v in out]
        yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["vec_id", "rep", "unit"])


def _mixed(*parts: int) -> int:
    with np.errstate(over="ignore"):
        out = np.uint64(0)
        for p in parts:
            out = mix(np.array([out * np.uint64(0x9E3779B97F4A7C15) + np.uint64(p & 0xFFFFFFFFFFFFFFFF)], np.uint64))[0]
    return int(out >> np.uint64(1))


def child_of(node: int, side: int) -> int:
    return _mixed(node, side) | 1


def dense_of(node: int) -> int:
    """Leaf of a node that isn't split though it is large: even numbers."""
    return node & ~1


def direction(node: int, attempt: int, dim: int) -> np.ndarray:
    return np.random.default_rng([node, attempt]).standard_normal(dim)


def learn(vectors: np.ndarray, node: int, size: int) -> list[tuple[int, int, float, float]]:
    """Splits (node, attempt, low, high) for a node of ``size`` vectors, from a sample of them.

    Vectors up to ``high`` go left, from ``low`` on right. An attempt of -1 marks a node that stays whole.
    """
    share, dim = size / len(vectors), vectors.shape[1]
    out, left = [], [(node, np.arange(len(vectors)))]
    while left:
        node, rows = left.pop()
        if len(rows) * share <= LEAF or len(rows) < LEAST:
            continue
        judged = vectors[rows[:JUDGED]]
        linked = np.argwhere(np.triu(judged @ judged.T >= COSINE, 1))
        if 2 * len(linked) / len(judged) ** 2 * len(rows) * share >= LEAF / 4:  # links of a vector within the node
            out.append((node, -1, 0.0, 0.0))
            continue
        best = None
        for attempt in range(TRIED):
            places = vectors[rows] @ direction(node, attempt, dim)
            low, high = np.quantile(places, [0.5 - SPILL, 0.5 + SPILL])
            if not places.min() < low <= high < places.max():
                continue
            a, b = places[linked[:, 0]], places[linked[:, 1]]
            cut = int(((np.minimum(a, b) < low) & (np.maximum(a, b) > high)).sum())
            if best is None or cut < best[0]:
                best = (cut, attempt, float(low), float(high), places)
            if not cut:
                break
        if best is None:
            out.append((node, -1, 0.0, 0.0))
            continue
        _, attempt, low, high, places = best
        out.append((node, attempt, low, high))
        left += [(child_of(node, 0), rows[places <= high]), (child_of(node, 1), rows[places >= low])]
    return out


def _learned(frame: pd.DataFrame) -> pd.DataFrame:
    vectors = np.stack([np.frombuffer(v) for v in frame.sort_values("rep")["unit"]])
    leaf = int(frame["leaf"].iloc[0])
    splits = learn(vectors, leaf, int(frame["size"].iloc[0]))
    return pd.DataFrame([(leaf, *s) for s in splits], columns=["leaf", "node", "attempt", "low", "high"])


def descend(vectors: np.ndarray, rows: np.ndarray, node: int, splits: dict[int, tuple[int, float, float]], kept: dict[int, np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Leaves below a node, each with its rows of ``vectors``."""
    out, left = [], [(node, rows)]
    while left:
        node, rows = left.pop()
        if not len(rows):
            continue
        split = splits.get(node)
        if split is None or split[0] < 0:
            out.append((node if split is None else dense_of(node), rows))
            continue
        attempt, low, high = split
        if node not in kept:
            kept[node] = direction(node, attempt, vectors.shape[1])
        places = vectors[rows] @ kept[node]
        left += [(child_of(node, 0), rows[places <= high]), (child_of(node, 1), rows[places >= low])]
    return out


def _sent_down(splits):
    """The leaves of every vector after the splits of a broadcast table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept = splits.value, {}
        for batch in batches:
            units, before = batch.column(batch.schema.get_field_index("unit")), batch.column(batch.schema.get_field_index("leaves"))
            at: dict[tuple[int, int], list[int]] = {}
            lists: list[list[int]] = [[] for _ in range(batch.num_rows)]
            sizes = [len(u.as_buffer()) // 8 for u in units]
            for row, (dim, leaves) in enumerate(zip(sizes, before.to_pylist(), strict=True)):
                for leaf in leaves:
                    if leaf in known:
                        at.setdefault((dim, leaf), []).append(row)
                    else:
                        lists[row].append(leaf)
            stacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for dim in {d for d, _ in at}:
                rows = np.flatnonzero(np.array(sizes) == dim)
                place = np.zeros(batch.num_rows, np.int64)
                place[rows] = np.arange(len(rows))
                stacked[dim] = (np.stack([np.frombuffer(units[i].as_buffer()) for i in rows.tolist()]), place, rows)
            for (dim, leaf), rows in at.items():
                vectors, place, back = stacked[dim]
                for found, members in descend(vectors, place[np.array(rows)], leaf, known, kept):
                    for row in back[members].tolist():
                        lists[row].append(found)
            if sum(map(len, kept.values())) > HELD_NUMBERS:
                kept.clear()
            out = batch.columns[:-1] + [pa.array([sorted(set(x)) for x in lists], pa.list_(pa.int64()))]
            yield pa.record_batch(out, batch.schema.names)

    return run


def leaves_of(vectors: DataFrame) -> DataFrame:
    """``vectors`` (rep, node, copies, unit) with ``leaves``: the numbers of all leaves of all trees that hold them."""
    spark = vectors.sparkSession
    schema = "rep binary, node long, copies long, unit binary, leaves array<long>"
    # a vector starts at the root of each tree for its length; numbers of nodes are odd
    root = lambda tree: F.xxhash64(tree, F.octet_length("unit")).bitwiseAND(F.lit((1 << 63) - 1)).bitwiseOR(F.lit(1))
    rows = stage(vectors.withColumn("leaves", F.transform(F.sequence(F.lit(1), F.lit(TREES)), root)), "vectors")
    while True:
        spread = rows.select("rep", F.explode("leaves").alias("leaf"))
        large = spread.groupBy("leaf").agg(F.count("*").alias("size")).where((F.col("size") > 2 * LEAF) & (F.col("leaf") % 2 != 0))
        large = stage(large, "large")
        if large.isEmpty():
            return rows
        # the least hashes of a node are its sample; their number over all nodes follows the number of nodes
        bound = F.lit(float(2 * SAMPLE)) / F.col("size")
        place = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / float(1 << 30)
        picked = rows.select("rep", "unit", F.explode("leaves").alias("leaf")).join(large, "leaf").where(place < bound)
        picked = picked.withColumn("of", F.row_number().over(_by_hash())).where(F.col("of") <= SAMPLE).select("leaf", "size", "rep", "unit")
        splits = stage(picked.groupBy("leaf").applyInPandas(_learned, "leaf long, node long, attempt int, low double, high double"), "splits")
        number = splits.count()
        blocks = -(-number * 64 // SPLITS_BYTES)
        if not number:
            return rows
        for block in range(blocks):
            # all that was learned below some of the large nodes at a time
            part = splits if blocks == 1 else splits.where(F.pmod(F.xxhash64("leaf"), F.lit(blocks)) == block)
            known = {n: (a, low, high) for _, n, a, low, high in part.collect()}
            held = spark.sparkContext.broadcast(known)
            rows = stage(rows.select("rep", "node", "copies", "unit", "leaves").mapInArrow(_sent_down(held), schema), "vectors")
            held.unpersist()


def _by_hash():
    from pyspark.sql import Window

    return Window.partitionBy("leaf").orderBy(F.xxhash64("rep"), "rep")


def _components(linked: np.ndarray) -> np.ndarray:
    """Least row that each row reaches."""
    label = np.full(len(linked), -1, np.int64)
    for i in range(len(linked)):
        if label[i] < 0:
            reached = np.zeros(len(linked), bool)
            reached[i] = True
            front = reached.copy()
            while front.any():
                front = linked[front].any(0) & ~reached
                reached |= front
            label[reached] = i
    return label


def _earlier(leaves: list[list[int]], leaf: int) -> np.ndarray:
    """Pairs of rows that share a leaf with a smaller number than this one."""
    out = np.zeros((len(leaves), len(leaves)), bool)
    flat = np.array([x for own in leaves for x in own], np.int64)
    owner = np.repeat(np.arange(len(leaves)), [len(own) for own in leaves])
    less = flat < leaf
    flat, owner = flat[less], owner[less]
    if not len(flat):
        return out
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    both = times[column] > 1
    column, owner = np.unique(column[both], return_inverse=True)[1], owner[both]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
        a, b = np.searchsorted(column, [low, low + 1024])
        part = np.zeros((len(leaves), 1024), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out |= part @ part.T > 0
    return out


def links_in(vectors: np.ndarray, leaf: int, leaves, nodes: list[int], copies: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Rows with links, the number of vectors that each is linked with and not counted in another leaf, and edges.

    ``side``: 0 for rows that are compared with each other, 1 and 2 for rows that are compared across.
    """
    crossed = bool(side.any())
    linked = np.zeros((len(vectors), len(vectors)), bool)
    for low in range(0, len(vectors), 512):
        linked[low:low + 512] = vectors[low:low + 512] @ vectors.T >= COSINE
    if crossed:
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    rows = np.flatnonzero(linked.any(1))
    linked = linked[np.ix_(rows, rows)]
    linked |= linked.T
    if not len(rows):
        return rows, np.zeros(0, np.int64), []
    counted = linked & ~_earlier([leaves(i) for i in rows.tolist()], leaf)
    label = _components(linked)
    edges = [(nodes[i], nodes[rows[k]]) for i, k in zip(rows.tolist(), label.tolist(), strict=True) if rows[k] != i]
    return rows, counted @ copies[rows], edges


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block: the links (rep, links) and edges (a, b) of every block."""
    key, held = None, []

    def done() -> pa.RecordBatch:
        links, edges = [], []
        if len(held) > 1:
            at: dict[int, list[int]] = {}
            for i, row in enumerate(held):
                at.setdefault(len(row[4]), []).append(i)
            for rows in at.values():
                own = [held[i] for i in rows]
                vectors = np.stack([np.frombuffer(r[4]) for r in own])
                found, counts, joins = links_in(vectors, own[0][0], lambda i, own=own: own[i][5], [r[2] for r in own], np.array([r[3] for r in own]), np.array([r[6] for r in own]))
                links += [(own[i][1], n) for i, n in zip(found.tolist(), counts.tolist(), strict=True) if n]
                edges += joins
        rows = [(r, n, None, None) for r, n in links] + [(None, None, a, b) for a, b in edges]
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["rep", "links", "a", "b"])

    for batch in batches:
        for block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != key:
                if held:
                    yield done()
                key, held = block, []
            held.append(row)
    if held:
        yield done()


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per vector: ``key``, ``n_links``, ``component_id`` (least id that it reaches by links) and ``kept`` (it is that).

    Vectors are linked if their cosine, in double precision, is 0.9 or more. Null or empty vectors, those of zeros only
    and those with null or non-finite components are linked with nothing, and so are vectors of different lengths.
    ``n_links`` counts other rows, equal vectors included. Rows with the same id are joined in one component. Rows
    without an id are linked with nothing, have no component and are kept. Ids are integers. Other columns are not
    read. Without vectors the result is empty.
    """
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    packed = stage(rows.mapInArrow(_packed, "vec_id long, rep binary, unit binary"), "units")
    valid = packed.where("rep is not null and vec_id is not null")
    reps = valid.groupBy("rep").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    placed = leaves_of(reps.select("rep", "node", "copies", "unit"))

    spread = placed.select(F.explode("leaves").alias("leaf"), "rep", "node", "copies", "unit", "leaves")
    # a leaf that was not split though it is large is cut into blocks, taken by twos
    sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("size"))
    large = stage(sizes.where(F.col("size") > 4 * LEAF).select("leaf", F.ceil(F.col("size") / LEAF).cast("int").alias("blocks")), "large")
    number = large.count()
    if number:
        dealt = spread.join(F.broadcast(large) if number <= BROADCAST_LEAVES else large, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        dealt = spread.withColumn("blocks", F.lit(1))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") == low, 1).otherwise(2)
    dealt = dealt.select(F.xxhash64("leaf", low, high).alias("block"), "leaf", "rep", "node", "copies", "unit", "leaves", side.alias("side"))
    found = stage(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_compared, "rep binary, links long, a long, b long"), "found")

    links = found.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    same = valid.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").join(valid, "vec_id").join(reps.select("rep", "node"), "rep")
    joined = found.where("a is not null").select("a", "b").union(same.select(F.col("vec_id").alias("a"), F.col("node").alias("b")).where("a <> b"))
    labels = components(joined)
    whole = reps.select("rep", "node", "copies").join(links, "rep", "left").join(labels, "node", "left")
    whole = whole.select("rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    alone = packed.where("rep is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = valid.select("vec_id", "rep").join(whole, "rep").select("vec_id", "n_links", "component_id").union(alone)
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return out.withColumnRenamed("vec_id", key)
