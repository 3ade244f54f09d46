"""Benchmark decontamination (operator 1): size-partitioned MinHash containment search.

Test items are partitioned by the size n of their shingle set. An item's sketch is its k smallest shingle hashes, with
k = n - ceil(0.75 n) + 1 at the least: a document that contains 75 % of the item misses fewer than k shingles, so it
holds one of the sketch at least, however long it is. Documents are read once: those of their shingles that lie in a
partition's range of sketch values are looked up, and every candidate is verified on the shingles themselves.

Items are the query set: they are searched in blocks of a bounded number of shingles, each block against all documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import buffers, free_name, slices
from .shingles import SHINGLE, plain_shingles, shingle_hashes, word_hashes

THRESHOLD = 75  # per cent
#: Words of test items that one block may hold; a block goes to all tasks and lies in their memory.
BLOCK_WORDS = 2_000_000


class Block:
    """Sketches of the items of one block, by size class."""

    def __init__(self, ids: list, texts: list[bytes], size: int, per_cent: int):
        self.ids, self.size, self.per_cent = ids, size, per_cent
        self.sets = [plain_shingles(t, size) for t in texts]
        column = pa.array(texts, pa.large_binary())
        hashes, at = shingle_hashes(*word_hashes(*buffers(column)), size)
        classes = defaultdict(lambda: ([], []))
        for item in range(len(texts)):
            own = np.unique(hashes[at[item]:at[item + 1]])
            if not len(own):
                continue
            least = -(-len(own) * per_cent // 100)
            keep = len(own) - least + 1
            values, items = classes[len(own).bit_length()]
            values.append(own[:keep])
            items.append(np.full(keep, item))
        self.classes = []
        for values, items in classes.values():
            flat, owner = np.concatenate(values), np.concatenate(items)
            order = np.argsort(flat, kind="stable")
            self.classes.append((flat[order], owner[order], flat.max()))
        self.bits = np.zeros(1 << 20, bool)  # first look: most shingles are in no sketch
        for flat, _, _ in self.classes:
            self.bits[flat & np.uint64((1 << 20) - 1)] = True

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> dict[int, set[int]]:
        """Items by text that share a value of a sketch with it."""
        seen = np.flatnonzero(self.bits[hashes & np.uint64((1 << 20) - 1)])
        found = defaultdict(set)
        for flat, owner, highest in self.classes:
            near = seen[hashes[seen] <= highest]
            low, high = np.searchsorted(flat, hashes[near]), np.searchsorted(flat, hashes[near], "right")
            hit = high > low
            texts = np.searchsorted(at, near[hit], "right") - 1
            for text, a, b in zip(texts.tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                found[text].update(owner[a:b].tolist())
        return found

    def verified(self, text: bytes, items: set[int]) -> list[tuple]:
        own, out = plain_shingles(text, self.size), []
        for item in sorted(items):
            common = len(self.sets[item] & own)
            if 100 * common >= self.per_cent * len(self.sets[item]):
                out.append((self.ids[item], len(self.sets[item]), common))
        return out


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
              item_text: str = "text", size: int = SHINGLE, per_cent: int = THRESHOLD, block_words: int = BLOCK_WORDS, name: str = "leaks") -> DataFrame:
    """Every row of ``docs`` with a last column ``leaks``: array of (item, n_shingles, n_common), items contained in it.

    An item is contained if ``per_cent`` of its distinct word shingles are among those of the document's whole text. A
    text of fewer words than a shingle has one shingle, the whole sequence; null or empty texts have none and neither
    contain nor are contained. Repeated rows are searched each; items with the same key are told apart by their text.
    Columns of ``docs`` are carried along, whatever their names: where one is called like the new column, that gets
    underscores behind its ``name``. Without documents or items there are no leaks.
    """
    kept = items.select(F.col(item_key).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    words = F.length("text") - F.length(F.regexp_replace("text", "\\s+", "")) + 1
    blocks = max(1, -(-(kept.agg(F.sum(words)).first()[0] or 0) // block_words))
    item_type = kept.schema["item"].dataType
    leak = f"array<struct<item:{item_type.simpleString()},n_shingles:int,n_common:int>>"
    out = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"), F.array().cast(leak).alias("leaks"))
    for block in range(blocks):  # one block, unless the items are more than BLOCK_WORDS
        part = kept.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        out = _searched(out, [r.item for r in part], [r.text.encode() for r in part], size, per_cent)
    return out.select("row.*", F.col("leaks").alias(free_name(name, docs.columns)))


def _searched(rows: DataFrame, ids: list, texts: list[bytes], size: int, per_cent: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((ids, texts))  # one block: BLOCK_WORDS at most
    leak_type = rows.schema["leaks"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(*shared.value, size, per_cent)
        for batch in batches:
            for part, column in slices(batch, "text"):
                found = block.candidates(*shingle_hashes(*word_hashes(*buffers(column)), size))
                old = part.schema.get_field_index("leaks")
                leaks = part.column(old)
                if found:
                    new = leaks.to_pylist()
                    for at, items in found.items():
                        new[at] = new[at] + [dict(zip(("item", "n_shingles", "n_common"), x, strict=True)) for x in block.verified(column[at].as_py(), items)]
                    leaks = pa.array(new, leaks.type)
                yield pa.record_batch([leaks if i == old else part.column(i) for i in range(part.num_columns)], part.schema.names)

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("leaks", leak_type)])
    return rows.mapInArrow(run, schema)
