"""Helpers for Arrow tasks: slices of bounded bytes, text buffers, whole columns by name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task turns into numpy arrays at a time; one longer text is a slice of its own.
SLICE_BYTES = 8 << 20


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text column as large binary (UTF-8), null as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()), b"")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large binary array; offsets start at 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch with at most ``limit`` bytes of text each (or one row), and their texts."""
    if not batch.num_rows:
        return
    texts = text_column(batch, name)
    ends = buffers(texts)[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def strings(texts: pa.Array) -> list[str]:
    return texts.cast(pa.large_string()).to_pylist()


def ragged(lengths: np.ndarray) -> np.ndarray:
    """Offsets for lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no column has it (Spark ignores case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
