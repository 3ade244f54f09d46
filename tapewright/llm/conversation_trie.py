"""Conversation prefix trie (operator 13): ternary search trees per range shard, merged at their boundaries.

Turns are dictionary-encoded: each distinct (role, text) has a number, so a conversation is an array of numbers. The
conversations are dealt by ranges of these arrays (then of their id), so equal beginnings lie next to each other and a
hot beginning, or a conversation with very many copies, is spread over as many shards as its rows ask for. A task cuts
its shard into blocks of bounded size and builds a ternary search tree of each, whose insertions start at the median of
the sorted conversations, so that siblings are balanced. One pass over the tree, children before parents, sums members,
leaves and savings.

Only nodes on the first and the last path of a block can go on in another one. These boundary nodes are merged in
block order with a stack as deep as a conversation is long, by rounds of ``FAN`` shards, until one group is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stage

#: Turns of a block: one tree in memory at a time.
BLOCK_TURNS = 100_000
#: Shards whose boundary nodes a task merges in a round.
FAN = 256
#: Conversations of a family start alike; turns that may be taken from its first one.
FAMILY, HEAD = 20, 4

CLOSED, OPEN, ENDS = 0, 1, 2
NODE = "kind int, place long, key binary, parent_key binary, parent long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved long, words long, ends binary"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in NODE.split(", ")])
ROOT = hashlib.md5(b"").digest()
NO_ENDS = hashlib.sha256(b"").digest()


def _below(key: bytes, code: int) -> bytes:
    """Key of the node that a turn leads to."""
    return hashlib.md5(key + code.to_bytes(8, "little", signed=True)).digest()


def _joined(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


class TernaryTree:
    """Trie of arrays of numbers; siblings are binary trees (``low``, ``high``), ``first`` leads to the next turn."""

    def __init__(self):
        self.code, self.words, self.low, self.high, self.first, self.up = [0], [0], [-1], [-1], [-1], [-1]
        self.depth, self.ends = [0], [None]

    def _made(self, code: int, words: int, up: int) -> int:
        for column, value in ((self.code, code), (self.words, words), (self.low, -1), (self.high, -1), (self.first, -1), (self.up, up), (self.depth, self.depth[up] + 1), (self.ends, None)):
            column.append(value)
        return len(self.code) - 1

    def path(self, codes: list[int], words: list[int]) -> list[int]:
        """Nodes of a conversation from the root on; those that are missing are inserted."""
        node, out = 0, [0]
        for code, n in zip(codes, words, strict=True):
            up, links, at = node, self.first, node
            node = links[at]
            while node >= 0 and self.code[node] != code:
                links, at = (self.low if code < self.code[node] else self.high), node
                node = links[at]
            if node < 0:
                links[at] = node = self._made(code, n, up)
            out.append(node)
        return out

    def insert_sorted(self, rows: list[tuple[list[int], list[int], list[int]]]) -> None:
        """Distinct conversations (codes, words, ids that end there) in order: medians first."""
        spans = [(0, len(rows))]
        while spans:
            a, b = spans.pop()
            if a < b:
                mid = (a + b) // 2
                codes, words, ids = rows[mid]
                self.ends[self.path(codes, words)[-1]] = ids
                spans += [(a, mid), (mid + 1, b)]

    def summed(self, open_: set[int]) -> dict[str, list[int]]:
        """Figures of every node; those of ``open_`` nodes leave out their open children, which are not known yet."""
        n = len(self.code)
        convs = [len(e) if e else 0 for e in self.ends]
        least = [e[0] if e else None for e in self.ends]
        children, leaves, saved = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):  # nodes come after the node they hang from
            if i in open_:
                continue
            leaves[i] += not children[i]
            saved[i] += (convs[i] - 1) * self.words[i]
            up = self.up[i]
            convs[up] += convs[i]
            children[up] += 1
            leaves[up] += leaves[i]
            saved[up] += saved[i]
            if least[up] is None or least[i] < least[up]:
                least[up] = least[i]
        return {"n_convs": convs, "conv_id": least, "n_children": children, "n_leaves": leaves, "saved": saved}


def _block(rows: list[tuple[list[int], list[int], list[int]]], order: int) -> list[tuple]:
    """Nodes of a block (distinct conversations in order): closed ones, boundary ones in preorder, their ends."""
    tree = TernaryTree()
    tree.insert_sorted(rows)
    first, last = tree.path(*rows[0][:2]), tree.path(*rows[-1][:2])
    shared = set(first)
    border = first + [i for i in last if i not in shared]
    keys = {0: ROOT}
    for i in border[1:]:
        keys[i] = _below(keys[tree.up[i]], tree.code[i])
    found = tree.summed(set(border))
    columns = [found[c] for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved")]
    out = []
    for i in range(len(tree.code)):
        least, convs, children, leaves, saved = (c[i] for c in columns)
        if i not in keys:
            up = tree.up[i]
            ends = hashlib.sha256(_joined(tree.ends[i])).digest() if tree.ends[i] else NO_ENDS
            parent = (keys[up], None) if up in keys else (None, columns[0][up])
            out.append((CLOSED, None, None, *parent, least, tree.depth[i], convs, children, leaves, saved, None, ends))
    for place, i in enumerate(border):
        least, convs, children, leaves, saved = (c[i] for c in columns)
        out.append((OPEN, order + place, keys[i], keys.get(tree.up[i]), None, least, tree.depth[i], convs, children, leaves, saved, tree.words[i], None))
        if tree.ends[i]:
            out.append((ENDS, order, keys[i], None, None, None, None, None, None, None, None, None, _joined(tree.ends[i])))
    return out


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(rows), 20_000):
        columns = zip(*rows[low:low + 20_000], strict=True)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (codes, words, conv_id) in order: the nodes of block after block."""
    number = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            for codes, words, conv in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if size >= BLOCK_TURNS:
                    yield from _batches(_block(rows, number))
                    number += 2 * max(len(rows[0][0]), len(rows[-1][0])) + 2
                    rows, size = [], 0
                if rows and rows[-1][0] == codes:
                    rows[-1][2].append(conv)
                    size += 1
                else:
                    rows.append((codes, words, [conv]))
                    size += len(codes) + 1
    if rows:
        yield from _batches(_block(rows, number))


def _merged(last: bool):
    """Boundary nodes in order, group after group: closed nodes, and boundary nodes of the group unless it is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack, out = None, [], []
        # a node: place, key, parent_key, conv_id, depth, n_convs, n_children, n_leaves, saved, words, on the first path

        def popped(keep: bool) -> None:
            place, key, parent, least, depth, convs, children, leaves, saved, words, pinned = stack.pop()
            if pinned or keep:
                out.append((OPEN, place, key, parent, None, least, depth, convs, children, leaves, saved, words, None))
                return
            leaves += not children
            saved += (convs - 1) * words
            out.append((CLOSED, None, key, parent, None, least, depth, convs, children, leaves, saved, None, None))
            if stack:
                up = stack[-1]
                up[3] = least if up[3] is None else min(up[3], least)
                up[5] += convs
                up[6] += 1
                up[7] += leaves
                up[8] += saved

        def ended() -> None:
            while stack:
                popped(not last)

        for batch in batches:
            for of, place, key, parent, least, depth, convs, children, leaves, saved, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != group:
                    ended()
                    group, rising = of, True
                if depth < len(stack) and stack[depth][1] == key:
                    node = stack[depth]
                    if least is not None:
                        node[3] = least if node[3] is None else min(node[3], least)
                    for i, n in ((5, convs), (6, children), (7, leaves), (8, saved)):
                        node[i] += n
                    rising = False
                    continue
                while len(stack) > depth:
                    rising = False
                    popped(False)
                stack.append([place, key, parent, least, depth, convs, children, leaves, saved, words, rising and not last])
            yield from _batches(out)
            out.clear()
        ended()
        yield from _batches(out)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (key, ids) in order: the digest of all ids of a key. A piece is forgotten once it is hashed."""
    key, state = None, None
    out: list[tuple[bytes, bytes]] = []
    for batch in batches:
        for of, ids in zip(batch.column(0), batch.column(1), strict=True):
            if of.as_py() != key:
                if state:
                    out.append((key, state.digest()))
                key, state = of.as_py(), hashlib.sha256(ids.as_py())
            else:
                state.update(b",")
                state.update(ids.as_py())
        yield pa.record_batch([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.binary())], ["key", "digest"])
        out = []
    if state:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.digest()], pa.binary())], ["key", "digest"])


def _turns(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), words.alias("words"))
    return turns.where("conv_id is not null")


def _head(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEAD)).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``codes`` and ``words`` of every conversation with the first turns of its family's first one."""
    turns = stage(_turns(conversations), "turns")
    dictionary = stage(turns.groupBy("digest").agg(F.max("words").alias("words")).withColumn("code", F.monotonically_increasing_id()), "dictionary")
    coded = turns.drop("words").join(dictionary, "digest")
    in_order = F.sort_array(F.collect_list(F.struct("turn", "digest", "code", "words")))
    own = stage(coded.groupBy("conv_id").agg(in_order.alias("t")).select("conv_id", F.col("t.code").alias("codes"), F.col("t.words").alias("words")), "coded")
    first = own.where(F.col("conv_id") % FAMILY == 0)
    first = first.select(F.col("conv_id").alias("family"), *[F.slice(c, 1, HEAD - 1).alias(f"first_{c}") for c in ("codes", "words")])
    both = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", _head(F.col("conv_id"))).join(first, "family", "left")
    none = F.array().cast("array<long>")
    return both.select("conv_id", *[F.concat(F.slice(F.coalesce(f"first_{c}", none), F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.size(c))).alias(c) for c in ("codes", "words")])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of all rebuilt conversations (columns of ``COLUMNS``).

    Turns are ordered by ``turn``, null first, turns of equal number by a digest of role and text; null role or text is
    empty. A node is a distinct sequence of first turns (role, text); its members are the conversations that start with
    it, ``conv_id`` is the least of them. Rows without a conv_id belong to no conversation. Repeated rows are turns of
    their own. Other columns are not read. Without conversations there is no node, not even a root.
    """
    spark = conversations.sparkSession
    paths = stage(rebuilt(conversations), "paths")
    turns = paths.agg(F.sum(F.size("codes") + 1)).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-turns // BLOCK_TURNS))
    dealt = paths.select("codes", "words", "conv_id").repartitionByRange(parts, "codes", "conv_id").sortWithinPartitions("codes", "conv_id")
    nodes = stage(dealt.mapInArrow(_shard, NODE), "nodes")
    border = nodes.where(F.col("kind") == OPEN)
    merged = _boundaries(border, parts)

    pieces = nodes.where(F.col("kind") == ENDS).select("key", "ends", "place")
    pieces = pieces.repartition("key").sortWithinPartitions("key", "place").select("key", "ends")
    digests = pieces.mapInArrow(_digests, "key binary, digest binary")
    whole = stage(merged.drop("ends").join(digests.withColumnRenamed("digest", "ends"), "key", "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS))), "border")

    root = whole.where("depth = 0").select("conv_id").first()
    rows = nodes.where(F.col("kind") == CLOSED).unionByName(whole)
    known = rows.where("depth = 0 or parent is not null")
    top = rows.where("depth = 1 and parent is null").withColumn("parent", F.lit(root[0] if root else None).cast("long"))
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    deep = rows.where("depth > 1 and parent is null").join(parents, "parent_key").withColumn("parent", F.col("found")).drop("found")
    out = known.unionByName(top).unionByName(deep)
    return out.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.lower(F.hex("ends")).alias("ends_sha256"),
    )


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_SPINE = ["place", "key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "words"]


def _boundaries(border: DataFrame, shards: int) -> DataFrame:
    """All boundary nodes with their final figures: rounds over runs of ``FAN`` shards, then of groups, until one is left."""
    done, width = [], 1
    while True:
        width *= FAN
        last = width >= shards
        dealt = border.withColumn("of", F.floor(F.shiftright("place", 32) / width)).repartition("of").sortWithinPartitions("of", "place")
        result = stage(dealt.select("of", *_SPINE).mapInArrow(_merged(last), NODE), "merged")
        done.append(result.where(F.col("kind") == CLOSED))
        if last:
            break
        border = result.where(F.col("kind") == OPEN)
    return reduce(DataFrame.unionByName, done)
