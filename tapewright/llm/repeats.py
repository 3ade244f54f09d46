"""Suffix-array dedup (operator 8): removes 50-byte strings that start in a document with a smaller id.

Every window of 50 bytes has an anchor: the place of its least hash of 16 bytes, leftmost if equal. Equal windows have
their anchors at equal places, so only suffixes that start at anchors are sorted, about one in 17, and of them only
those whose 16 bytes start in two documents or more (``census``). Such a suffix has up to 50 bytes to its right and 34
to its left, as far as the windows of its anchor reach.

Each chunk of documents sorts its suffixes and sends a sorted run to each bucket, front-coded: the length of the prefix
shared with the suffix before it, and the rest. A bucket merges its runs with a loser tree that keeps, for each waiting
suffix, how much of it is known to agree with the last winner: bytes in common are not compared again. In merged order
the windows with l bytes left of the anchor are groups of equal prefixes and equal l bytes; the least id of each group
goes back to the chunks, which cut what a smaller id has as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import census
from .batches import buffers, text_column
from .shingles import _VALUES, BLOCK, mix, power_tables
from .stored import stage

LENGTH, GRAM = 50, 16
WINDOWS = LENGTH - GRAM + 1  # starts of 16 bytes in a window
LEFT = WINDOWS - 1
WIDTH = LENGTH + 1 + LEFT + 1  # right part, its length, left part from the anchor backwards, its length
#: Bits of a level of anchor keys, and bytes of text per bucket of them (``census``); bytes of text per bucket of suffixes.
BITS, BUCKET_BYTES, RUN_BYTES = 9, 64 << 20, 4 << 20
NOBODY = np.iinfo(np.int64).max


class Anchors:
    """Anchors of all windows of a chunk: place, text, and the first and last window that each serves."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        blocks = [self._of_block(low, min(low + BLOCK, len(raw))) for low in range(0, len(raw) - LENGTH + 1, BLOCK)]
        at, first, last, keys = (np.concatenate(c) for c in zip((np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),), *blocks, strict=True))
        again = np.zeros(len(at), bool)  # windows of one anchor on both sides of a block's edge
        again[1:] = (at[1:] == at[:-1]) & (first[1:] == last[:-1] + 1)
        ends = np.flatnonzero(~np.append(again[1:], False))
        self.at, self.first, self.last, self.keys = at[~again], first[~again], last[ends], keys[~again]
        self.text = np.searchsorted(offsets, self.at, "right") - 1

    def _of_block(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of the windows that start in a block of bytes: place, first and last window, key."""
        raw, offsets = self.raw[low:high + LENGTH - 1], self.offsets
        none = np.zeros(0, np.int64)
        if len(raw) < LENGTH:
            return none, none, none, np.zeros(0, np.uint64)
        powers, inverse = power_tables(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUES[raw] * powers[: len(raw)], out=sums[1:])
        hashes = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(raw) - GRAM + 1])
        least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while 2 * span <= WINDOWS:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < WINDOWS:
            least = np.minimum(least[: len(least) - (WINDOWS - span)], least[WINDOWS - span:])
        one, two = np.searchsorted(offsets, [low, low + len(least) - 1], "right") - 1
        bounds = np.clip(offsets[one:two + 2], low, low + len(least)) - low
        ends = np.repeat(offsets[one + 1:two + 2] - low, np.diff(bounds))
        starts = np.flatnonzero(np.arange(LENGTH, LENGTH + len(least)) <= ends)
        if not len(starts):
            return none, none, none, np.zeros(0, np.uint64)
        place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(new)
        last = starts[np.append(begin[1:], len(starts)) - 1]
        # hashed once more: least hashes are small, and buckets are equal ranges of keys
        return place[begin] + low, starts[begin] + low, last + low, mix(hashes[place[begin]] + np.uint64(1))

    def documents_per_key(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, whether one or more ids hold them (1 or 2), and the key of every anchor."""
        distinct, place = np.unique(self.keys, return_inverse=True)
        own = ids[self.text]
        low, high = np.full(len(distinct), NOBODY), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, place, own)
        np.maximum.at(high, place, own)
        return distinct, 1 + (low < high).astype(np.int64), place


class Suffixes:
    """The suffixes of chosen anchors as sorted distinct rows per bucket, with the least id of each."""

    def __init__(self, anchors: Anchors, chosen: np.ndarray, ids: np.ndarray, buckets: int):
        at, first, last = anchors.at[chosen], anchors.first[chosen], anchors.last[chosen]
        rows = np.zeros((len(chosen), 4 + WIDTH), np.uint8)
        bucket = ((anchors.keys[chosen] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        rows[:, :4] = bucket.astype(">u4").view(np.uint8).reshape(-1, 4)
        limit = len(anchors.raw) - 1
        for low in range(0, len(chosen), 1 << 15):
            part = slice(low, low + (1 << 15))
            right, left = (last[part] + LENGTH - at[part])[:, None], (at[part] - first[part])[:, None]
            step = np.arange(LENGTH)
            rows[part, 4:4 + LENGTH] = np.where(step < right, anchors.raw[np.minimum(at[part][:, None] + step, limit)], 0)
            step = np.arange(LEFT)
            rows[part, 5 + LENGTH:5 + LENGTH + LEFT] = np.where(step < left, anchors.raw[np.maximum(at[part][:, None] - 1 - step, 0)], 0)
            rows[part, 4 + LENGTH], rows[part, -1] = right[:, 0], left[:, 0]
        distinct, self.place = np.unique(rows.view(f"S{4 + WIDTH}").reshape(-1), return_inverse=True)
        self.rows = distinct.view(np.uint8).reshape(-1, 4 + WIDTH) if len(distinct) else np.zeros((0, 4 + WIDTH), np.uint8)
        self.bucket = self.rows[:, :4].copy().view(">u4").reshape(-1).astype(np.int64)
        self.least = np.full(len(distinct), NOBODY)
        np.minimum.at(self.least, self.place, ids[anchors.text[chosen]])

    def runs(self) -> Iterator[tuple[int, bytes]]:
        """Front-coded run of each bucket."""
        if not len(self.rows):
            return
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for low, high in zip(cuts, np.append(cuts[1:], len(self.rows)), strict=True):
            yield int(self.bucket[low]), front_coded(self.rows[low:high, 4:], self.least[low:high])


def front_coded(rows: np.ndarray, least: np.ndarray) -> bytes:
    """Sorted rows as lengths of prefixes shared with the row before, remaining bytes and ids."""
    shared = np.zeros(len(rows), np.uint8)
    shared[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
    rest = rows[np.arange(WIDTH) >= shared[:, None]]
    body = len(rows).to_bytes(8, "little") + shared.tobytes() + rest.tobytes()
    coded = zstandard.ZstdCompressor(level=3).compress(body)
    return len(coded).to_bytes(8, "little") + coded + census.packed(least)


def decoded(data: bytes) -> tuple[list[bytes], list[int], np.ndarray]:
    """Rows, shared prefixes and ids of a front-coded run."""
    size = int.from_bytes(data[:8], "little")
    body = zstandard.ZstdDecompressor().decompress(data[8:8 + size])
    count = int.from_bytes(body[:8], "little")
    shared = list(body[8:8 + count])
    rows, at, row = [], 8 + count, b""
    for keep in shared:
        row = row[:keep] + body[at:at + WIDTH - keep]
        at += WIDTH - keep
        rows.append(row)
    return rows, shared, census.unpacked(data[8 + size:]).astype(np.int64)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted runs as one: run and place of each row, and the length of its prefix shared with the row before it.

    A loser tree. A waiting head has the length that it shares with the last winner of its match; the longer one comes
    first, and only heads with equal lengths are compared, from that length on.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    rows = [r for r, _ in runs] + [[]] * (leaves - len(runs))
    prefixes = [s for _, s in runs] + [[]] * (leaves - len(runs))
    next_ = [0] * leaves
    head = [r[0] if r else None for r in rows]
    known = [0 if r else -1 for r in rows]
    loser = [0] * leaves

    def wins(a: int, b: int) -> bool:
        """Whether the head of a comes before that of b; sets what the loser shares with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return y is None
        if known[a] != known[b]:
            return known[a] > known[b]
        at = known[a]
        left, right = int.from_bytes(x[at:], "big"), int.from_bytes(y[at:], "big")
        same = at + (8 * (WIDTH - at) - (left ^ right).bit_length()) // 8
        if left <= right:
            known[b] = same
            return True
        known[a] = same
        return False

    winner = list(range(leaves)) * 2
    for node in range(leaves - 1, 0, -1):
        a, b = winner[2 * node] if 2 * node < leaves else 2 * node - leaves, winner[2 * node + 1] if 2 * node + 1 < leaves else 2 * node + 1 - leaves
        winner[node], loser[node] = (a, b) if wins(a, b) else (b, a)
    best = winner[1] if leaves > 1 else 0
    total = sum(len(r) for r, _ in runs)
    run_of, place_of, shared = [], [], []
    for _ in range(total):
        at = next_[best]
        run_of.append(best)
        place_of.append(at)
        shared.append(known[best])
        at += 1
        next_[best] = at
        if at < len(rows[best]):
            head[best], known[best] = rows[best][at], prefixes[best][at]
        else:
            head[best], known[best] = None, -1  # comes after all others
        node = (best + leaves) // 2
        while node:
            other = loser[node]
            if known[best] < known[other] or known[best] == known[other] >= 0 and not wins(best, other):
                best, loser[node] = other, best
            node //= 2
    return np.array(run_of, np.int32), np.array(place_of, np.int32), np.array(shared, np.int64)


def least_ids(rows: np.ndarray, shared: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each number of bytes left of the anchor: the least id that has that window of each row, NOBODY where there is none."""
    right, left = rows[:, LENGTH].astype(np.int64), rows[:, -1].astype(np.int64)
    lefts, of_row = np.unique(np.ascontiguousarray(rows[:, LENGTH + 1:-1]).view(f"S{LEFT}").reshape(-1), return_inverse=True)
    table = lefts.view(np.uint8).reshape(-1, LEFT)
    differ = np.concatenate([[0], (table[1:] != table[:-1]).argmax(axis=1)]) if len(table) else np.zeros(0, np.int64)
    for l in range(LEFT + 1):  # noqa: E741
        out = np.full(len(rows), NOBODY)
        ok = np.flatnonzero((left >= l) & (right >= LENGTH - l))
        if not len(ok):
            yield l, out
            continue
        block = np.cumsum(shared < LENGTH - l)[ok]
        group = np.cumsum(differ < l)[of_row[ok]] if l else np.zeros(len(ok), np.int64)
        _, place = np.unique(block * (len(table) + 1) + group, return_inverse=True)
        low = np.full(place.max() + 1, NOBODY)
        np.minimum.at(low, place, least[ok])
        out[ok] = low[place]
        yield l, out


def _merged(table: pa.Table) -> pa.Table:
    """Runs of a bucket to the least ids of their rows' windows, per chunk."""
    chunks, bucket = table["chunk"].to_pylist(), table["bucket"][0].as_py()
    parts = [decoded(data.as_py()) for data in table["data"]]
    run_of, place_of, shared = merge_runs([(rows, prefixes) for rows, prefixes, _ in parts])
    flat = np.frombuffer(b"".join(b"".join(rows) for rows, _, _ in parts), np.uint8).reshape(-1, WIDTH)
    starts = np.cumsum([0] + [len(rows) for rows, _, _ in parts])
    least = np.concatenate([ids for _, _, ids in parts])
    del parts  # rows as Python objects, larger than all arrays below
    order = starts[run_of] + place_of
    distinct, place = np.unique(least, return_inverse=True)
    found = np.empty((LEFT + 1, len(flat)), np.int32)  # places in distinct
    for l, low in least_ids(flat[order], shared, place[order]):  # noqa: E741
        found[l, order] = np.minimum(low, len(distinct))
    distinct = np.append(distinct, NOBODY)
    answers = [packed_windows(distinct[found[:, a:b]]) for a, b in zip(starts, starts[1:], strict=False)]
    n = len(chunks)
    return pa.table([pa.array(chunks, pa.int64()), pa.array([1] * n, pa.int32()), pa.array([bucket] * n, pa.int32()),
                     pa.array(answers, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["chunk", "kind", "bucket", "totals", "distinct", "total"])


def packed_windows(found: np.ndarray) -> bytes:
    """Rows of ids, each as difference from the one before: windows of a suffix mostly have the same least id."""
    return census.packed(np.diff(found.view(np.uint64), axis=0, prepend=np.uint64(0)).reshape(-1))


def unpacked_windows(data: bytes) -> np.ndarray:
    return np.cumsum(census.unpacked(data).reshape(LEFT + 1, -1), axis=0, dtype=np.uint64).view(np.int64)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([NOBODY if i is None else i for i in batch.column(0).to_pylist()], np.int64)


def _chosen(batch: pa.RecordBatch, parts: dict, buckets: int) -> tuple[Anchors, np.ndarray, Suffixes, np.ndarray]:
    ids = _ids(batch)
    anchors = Anchors(*buffers(text_column(batch, "text")))
    distinct, _, place = anchors.documents_per_key(ids)
    totals = census.joined(parts.get(0, []), distinct)
    chosen = np.flatnonzero((totals[place] > 1) & (ids[anchors.text] != NOBODY))
    return anchors, chosen, Suffixes(anchors, chosen, ids, buckets), ids


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per row: ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the remaining bytes (or ``kept_sha256`` of them).

    A byte is removed if a 50-byte string of the text covers it that also starts in a document with a smaller id, in the
    text as it was. Strings never cross documents; texts are UTF-8, so that what is kept may not be. Null and empty
    texts have no bytes. Rows with equal ids take nothing from each other; rows without an id neither lose bytes nor
    take any. Ids are integers. Other columns are not read. Without documents the result is empty.
    """
    total = census.text_bytes(docs, text)
    buckets, bits = max(1, -(-total // RUN_BYTES)), census.levels(total, BITS, BUCKET_BYTES)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    chunks = census.stored_chunks(rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in census.each_chunk(batches):
            keys, counts, _ = Anchors(*buffers(text_column(batch, "text"))).documents_per_key(_ids(batch))
            yield census.request(chunk, 0, keys, counts, bits)

    found = stage(census.answers(chunks.mapInArrow(ask, census.REQUEST), bits), "shared", large_rows=True)

    def send(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        batch, parts = census.chunk_of(table)
        runs = list(_chosen(batch, parts, buckets)[2].runs())
        return pa.table([pa.array([b for b, _ in runs], pa.int32()), pa.array([chunk] * len(runs), pa.int64()), pa.array([d for _, d in runs], pa.binary())], ["bucket", "chunk", "data"])

    runs = stage(census.with_payload(found, chunks).groupBy("chunk").applyInArrow(send, "bucket int, chunk long, data binary"), "runs", large_rows=True)
    cuts = stage(runs.groupBy("bucket").applyInArrow(_merged, census.ANSWER), "cuts", large_rows=True)
    out = "kept_sha256 string" if digest else "kept binary"

    def cut(table: pa.Table) -> pa.Table:
        batch, parts = census.chunk_of(table)
        anchors, chosen, suffixes, ids = _chosen(batch, parts, buckets)
        raw, offsets = anchors.raw, anchors.offsets
        edge = np.zeros(len(raw) + 1, np.int64)
        own, by_place = ids[anchors.text[chosen]], np.argsort(suffixes.place, kind="stable")
        places, done = suffixes.place[by_place], 0
        for _, data in sorted(parts.get(1, [])):  # buckets in the order of the suffixes
            least = unpacked_windows(data)
            members = by_place[slice(*np.searchsorted(places, [done, done + least.shape[1]]))]
            column = suffixes.place[members] - done
            done += least.shape[1]
            for l in range(LEFT + 1):  # noqa: E741
                starts = anchors.at[chosen[members[least[l, column] < own[members]]]] - l
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + LENGTH, -1)
        if done != len(suffixes.rows):
            raise ValueError("answers do not fit the suffixes of their chunk")
        gone = np.cumsum(edge[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(raw)]
        begins[inner] = gone[inner]
        removed, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(begins))
        kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
        last = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()) if digest else pa.array(kept, pa.binary())
        return pa.table([batch.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(removed[offsets])), pa.array(np.diff(spans[offsets])), last],
                        ["key", "n_bytes", "n_removed", "n_spans", out.split()[0]])

    both = census.with_payload(found.unionByName(cuts), chunks)
    done = both.groupBy("chunk").applyInArrow(cut, f"key long, n_bytes long, n_removed long, n_spans long, {out}")
    return done.withColumnRenamed("key", key)
