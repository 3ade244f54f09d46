"""Token counts by byte-level BPE (operator 4): rank-synchronous merging of the distinct pre-tokens of a batch.

The tokenizer file gives the vocabulary, the merges and the special strings. Pre-tokens are held as ragged numpy arrays
of byte symbols; each round applies every sequence's lowest-ranked pair (``merges.merge_words``), and the symbols that
survive are counted. Distinct pre-tokens are merged once per task while a bounded cache has room. Nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices, strings
from .merges import PairTable, merge_words

#: Fixed value: the pattern by which byte-level BPE splits texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 600_000
CACHE_CHARS = 16_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class ByteModel:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = not (spec["normalizer"] or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or not plain:
            raise ValueError("only plain byte-level BPE files are supported")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take spaces are not supported")
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in byte_symbols()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], range(len(pairs)), [vocab[a + b] for a, b in pairs], max(vocab.values()) + 1)
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, int] = {}
        self.cached = 0

    def count_words(self, words: list[str]) -> list[int]:
        raw = [w.encode() for w in words]
        sym = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return merge_words(sym, np.fromiter(map(len, raw), np.int64, len(raw)), self.pairs)[1].tolist()

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special string inside a text is one token and ends what stands before it."""
        extra, cut = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            cut.append([w for p in parts for w in self.pattern.findall(p)] if len(parts) > 1 else self.pattern.findall(text))
        new = list({w for words in cut for w in words} - self.cache.keys())
        if new:
            self.cache.update(zip(new, self.count_words(new), strict=True))
            self.cached += sum(map(len, new))
        get = self.cache.__getitem__
        out = [n + sum(map(get, words)) for n, words in zip(extra, cut, strict=True)]
        if len(self.cache) > CACHE_WORDS or self.cached > CACHE_CHARS:
            self.cache, self.cached = {}, 0
        return out


def _load(path: str, known={}) -> ByteModel:  # noqa: B006 - one model per worker process
    if path not in known:
        known[path] = ByteModel(path)
    return known[path]


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: ``key``, ``n_bytes`` of the text in UTF-8, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``model`` is the path of a byte-level BPE tokenizer file on every executor. Null and empty texts have no bytes and
    no tokens. Rows are independent: repeated rows and null keys give a row each, other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _load(model)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                counts = pa.array(tokens.counts(strings(texts)), pa.int64())
                yield pa.record_batch([part.column(0), part.column(1), counts], ["key", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("key"), size.alias("n_bytes"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
