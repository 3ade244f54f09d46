"""Totals of hashed keys over all documents, for chunks of documents that ask for the keys they hold.

A chunk is a slice of documents of bounded bytes. It sends each of its distinct keys once, with its own count, to the
bucket of the key: sorted keys as differences, so that a key costs about six bytes. A bucket adds up the counts of all
chunks and answers each chunk with the totals in the order of its keys, about a byte each. No key is a large group: a
chunk sends it once, however often it occurs.

Buckets take a level of some bits of the keys at a time, so that a chunk sends 2^bits rows however large the input is.
Where one level is not enough, a node for a group of about 2^bits chunks and a prefix of keys merges their runs into one,
sends it on by the next bits, and hands the answers back. Rows exchanged grow with the input times its levels. A node
holds about as many keys as a chunk. A further level exchanges all keys once more on either way, so callers choose bits
for one level up to some 32 GB of text; the next ends at some 60 TB.

Chunks are written to the shared folder first, so that every pass sees the same ones whatever happens to executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .shingles import mix
from .stored import stage

#: Bytes of text per chunk; a task holds the keys of one chunk at a time.
CHUNK_BYTES = 5 << 20
REQUEST = "grp long, bucket int, sender long, kind int, keys binary, counts binary"
ANSWER = "chunk long, kind int, bucket int, totals binary, distinct long, total long"


_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()  # one thread a worker


def next_chunk(number: int) -> int:
    """Id of the chunk of this place in this task."""
    return (TaskContext.get().partitionId() << 24) | number


def packed(values: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return _COMPRESSOR.compress(len(values).to_bytes(8, "little") + wide.T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = _DECOMPRESSOR.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view("<u8").reshape(n)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0


def levels(total: int, bits: int, bucket: int) -> list[int]:
    """Bits of each level for so many bytes of text: ``bits`` a level, and as many levels as leave ``bucket`` bytes to a bucket at most."""
    needed = max(bits, (max(1, -(-total // bucket)) - 1).bit_length())
    return [bits] * (needed // bits) + ([needed % bits] if needed % bits else [])


def _runs(grp: int, sender: int, kind: int, keys: np.ndarray, counts: np.ndarray, used: int) -> list[tuple]:
    """Sorted distinct keys as rows of a request, cut by their first ``used`` bits."""
    if not len(keys):
        return []
    bucket = keys >> np.uint64(64 - used)
    cuts = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1])).tolist()
    return [(grp, int(bucket[a]), sender, kind, packed_keys(keys[a:b]), packed(counts[a:b])) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> list[pa.Array]:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]


_REQUEST = ["grp", "bucket", "sender", "kind", "keys", "counts"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
_ANSWER = ["chunk", "kind", "bucket", "totals", "distinct", "total"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]


def request(chunk: int, kind: int, keys: np.ndarray, counts: np.ndarray, bits: list[int]) -> pa.RecordBatch:
    """Rows that ask for the totals of sorted distinct keys, and add ``counts`` to them."""
    group = int(mix(np.array([chunk], np.uint64))[0]) & ((1 << sum(bits[1:])) - 1)
    return pa.record_batch(_columns(_runs(group, chunk, kind, keys, counts, bits[0]), *_REQUEST), _REQUEST[0])


def _by_kind(table: pa.Table) -> Iterator[tuple[int, list[int], list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Requests of a node by kind: senders, lengths of their runs, distinct keys, place of every key sent, summed counts."""
    kinds, senders = table["kind"].to_pylist(), table["sender"].to_pylist()
    asked = [i for i in range(table.num_rows) if table["keys"][i].is_valid]
    for kind in sorted({kinds[i] for i in asked}):
        own = [i for i in asked if kinds[i] == kind]
        keys = [unpacked_keys(table["keys"][i].as_py()) for i in own]
        counts = np.concatenate([unpacked(table["counts"][i].as_py()) for i in own]).astype(np.int64)
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
        yield kind, [senders[i] for i in own], [len(k) for k in keys], distinct, place, totals


def _replies(senders: list[int], lengths: list[int], kind: int, bucket: int, totals: np.ndarray) -> list[tuple]:
    ends = np.cumsum([0, *lengths]).tolist()
    return [(sender, kind, bucket, packed(totals[a:b]), None, None) for sender, a, b in zip(senders, ends, ends[1:], strict=False)]


def _answered(table: pa.Table) -> pa.Table:
    """The last level: totals for every sender, and sums over the bucket."""
    bucket, rows = table["bucket"][0].as_py(), []
    for kind, senders, lengths, _, place, totals in _by_kind(table):
        rows += _replies(senders, lengths, kind, bucket, totals[place])
        rows.append((-1, kind, bucket, None, int((totals > 0).sum()), int(totals.sum())))
    return pa.table(_columns(rows, *_ANSWER), _ANSWER[0])


def _passed_on(used: int, left: int):
    """A level before the last: the merged run of a group, to its group of the next level."""
    def run(table: pa.Table) -> pa.Table:
        group, rows = table["grp"][0].as_py(), []
        for kind, _, _, distinct, _, totals in _by_kind(table):
            rows += _runs(group & ((1 << left) - 1), group, kind, distinct, totals, used)
        return pa.table(_columns(rows, *_REQUEST), _REQUEST[0])

    return run


def _handed_back(table: pa.Table) -> pa.Table:
    """Answers to the merged run of a group, for each of its senders. Rows without keys are answers, by bucket."""
    bucket, rows = table["bucket"][0].as_py(), []
    parts: dict[int, list[tuple[int, bytes]]] = {}
    for kind, sender, keys, data in zip(table["kind"].to_pylist(), table["sender"].to_pylist(), table["keys"], table["counts"], strict=True):
        if not keys.is_valid:
            parts.setdefault(kind, []).append((sender, data.as_py()))
    for kind, senders, lengths, distinct, place, _ in _by_kind(table):
        rows += _replies(senders, lengths, kind, bucket, joined(parts.get(kind, []), distinct)[place])
    return pa.table(_columns(rows, *_ANSWER), _ANSWER[0])


def answers(requests: DataFrame, bits: list[int]) -> DataFrame:
    """Totals for every request, and per bucket and kind a row of chunk -1 with the number of keys counted and their sum."""
    sent = [requests if len(bits) == 1 else stage(requests, "keys", large_rows=True)]
    for level in range(1, len(bits)):
        passed = _passed_on(sum(bits[:level + 1]), sum(bits[level + 1:]))
        sent.append(stage(sent[-1].groupBy("grp", "bucket").applyInArrow(passed, REQUEST), "keys", large_rows=True))
    found = sent.pop().groupBy("bucket").applyInArrow(_answered, ANSWER)
    if not sent:
        return found
    found = stage(found, "totals", large_rows=True)
    sums = found.where("chunk = -1")
    for level in range(len(bits) - 1, 0, -1):
        back = found.where("chunk >= 0").select(
            F.col("chunk").alias("grp"), F.shiftright("bucket", bits[level]).alias("bucket"), F.col("bucket").cast("long").alias("sender"),
            "kind", F.lit(None).cast("binary").alias("keys"), F.col("totals").alias("counts"))
        found = stage(sent.pop().unionByName(back).groupBy("grp", "bucket").applyInArrow(_handed_back, ANSWER), "totals", large_rows=True)
    return found.unionByName(sums)


def joined(parts: list[tuple[int, bytes]], keys: np.ndarray) -> np.ndarray:
    """Totals of a chunk's sorted keys from its answers (bucket, totals)."""
    out = np.concatenate([unpacked(data) for _, data in sorted(parts)]) if parts else np.zeros(0, np.uint64)
    if len(out) != len(keys):
        raise ValueError("an answer does not fit the keys of its chunk")
    return out.astype(np.int64)


def payload(batch: pa.RecordBatch) -> bytes:
    """Rows of a chunk, compressed."""
    own = pa.record_batch([pa.concat_arrays([c]) for c in batch.columns], batch.schema.names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, own.schema) as writer:
        writer.write_batch(own)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def unpayload(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()
    return table.combine_chunks().to_batches()[0]


def stored_chunks(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows as chunks (chunk, payload), written to the shared folder: what a chunk holds is settled once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for part, _ in slices(batch, text, CHUNK_BYTES):
                yield pa.record_batch([pa.array([next_chunk(number)], pa.int64()), pa.array([payload(part)], pa.binary())], ["chunk", "payload"])
                number += 1

    return stage(rows.mapInArrow(run, "chunk long, payload binary"), "chunks", large_rows=True)


def each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Id and rows of every chunk."""
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield chunk, unpayload(data.as_py())


PAYLOAD_KIND = -1


def with_payload(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Answers and the chunks themselves (kind -1, payload as totals), to be grouped by chunk."""
    none = F.lit(None).cast("long")
    own = chunks.select("chunk", F.lit(PAYLOAD_KIND).alias("kind"), F.lit(0).alias("bucket"), F.col("payload").alias("totals"), none.alias("distinct"), none.alias("total"))
    return found.where("chunk >= 0").unionByName(own)


def chunk_of(table: pa.Table) -> tuple[pa.RecordBatch, dict[int, list[tuple[int, bytes]]]]:
    """Rows of a group of ``with_payload``, and its answers (bucket, totals) by kind."""
    rows, parts = None, {}
    for kind, bucket, data in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["totals"], strict=True):
        if kind == PAYLOAD_KIND:
            rows = unpayload(data.as_py())
        else:
            parts.setdefault(kind, []).append((bucket, data.as_py()))
    return rows, parts
