"""SentencePiece BPE encoding and decoding (operator 2): segmented merge rounds over the distinct words of a batch.

The model file gives pieces and scores; the merging is ``merges.merge_words``. A text is cut into words where no piece
of the model can cross, each distinct word is merged once per task (kept while a bounded cache has room), and the ids
of a text are those of its words. Nothing is shuffled.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices, strings
from .merges import PairTable, merge_words

SPACE = "▁"
#: Bytes of text that are cut into words at a time; words are Python strings of many times that size.
SLICE_BYTES = 1 << 20
#: Memory of the words that a worker keeps between slices, with what dictionary and objects take.
CACHE_BYTES = 24 << 20
ENTRY_BYTES = 180


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """One replacement character for each byte that is no UTF-8, as the library decodes."""
    return "�", error.start + 1


codecs.register_error("tapewright-each-byte", _each_byte)


class PieceModel:
    """Pieces of a BPE model with byte fallback, an identity normalizer and a dummy prefix."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = proto.ModelProto.SentencePiece
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models without normalization are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = spec.add_dummy_prefix
        self.size = len(model.pieces)
        self.unk = model.trainer_spec.unk_id
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.bytes = [b""] * self.size
        self.byte_ids = np.full(256, self.unk, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                self.bytes[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kinds.BYTE:
                self.bytes[i] = bytes([int(p.piece[3:5], 16)])
                self.byte_ids[self.bytes[i][0]] = i
            elif p.type == kinds.UNKNOWN:
                self.bytes[i] = model.trainer_spec.unk_surface.encode()
        self.opens = [p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in model.pieces]
        self.char_ids = np.arange(self.size, self.size + 0x110000, dtype=np.int32)  # unknown characters keep their code
        for piece, (i, _) in normal.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
        self.space = normal[SPACE][0] if SPACE in normal else -1
        self.runs = self._space_runs(normal)
        self.known_runs: dict[int, np.ndarray] = {}
        joined = set(self.runs.values())
        scores = sorted({-s for _, s in normal.values()})
        ranks = {s: r for r, s in enumerate(scores)}
        rows = []
        for piece, (i, score) in normal.items():
            for cut in range(1, len(piece) if i not in joined or i == self.space else 1):
                a, b = normal.get(piece[:cut]), normal.get(piece[cut:])
                if a and b:
                    rows.append((a[0], b[0], ranks[-score], i))
        left, right, rank, merged = zip(*rows, strict=True) if rows else ((), (), (), ())
        self.pairs = PairTable(left, right, rank, merged, self.size + 0x110000)
        inside = any(SPACE in p.lstrip(SPACE) for p in normal)
        alone = "" if inside or any("\n" in p for p in normal) else "\n"
        self.cut = None if inside else re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}" if alone else ""))
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def _space_runs(self, normal) -> dict[int, int]:
        """Ids of the pieces of 1, 2, ... spaces, if these merge after all else and by one score; else none."""
        pieces = {len(p): v for p, v in normal.items() if not p.strip(SPACE)}
        rest = [s for p, (_, s) in normal.items() if p.strip(SPACE) and len(p) > 1]
        even = len({s for n, (_, s) in pieces.items() if n > 1}) == 1
        other = any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in normal)
        if not {1, 2} <= set(pieces) or not even or other or pieces[2][1] >= min(rest, default=np.inf):
            return {}
        return {n: i for n, (i, _) in pieces.items()}

    def run_ids(self, length: int) -> np.ndarray:
        """Ids of a run of single spaces: as all scores are equal, the leftmost pair that makes a piece merges first."""
        if length not in self.known_runs:
            parts: list[int] = []
            for _ in range(length):
                parts.append(1)
                while len(parts) > 1 and parts[-2] + parts[-1] in self.runs:
                    parts[-2:] = [parts[-2] + parts[-1]]
            if len(self.known_runs) >= 4096:
                self.known_runs.clear()
            self.known_runs[length] = np.array([self.runs[n] for n in parts], np.int32)
        return self.known_runs[length]

    def words(self, text: str) -> list[str]:
        text = ((SPACE if self.prefix else "") + text).replace(" ", SPACE) if text else ""
        return self.cut.findall(text) if self.cut else [text] * bool(text)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as bytes of int32."""
        sym = self.char_ids[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        ids, lengths = merge_words(sym, np.fromiter(map(len, words), np.int64, len(words)), self.pairs)
        if self.runs:
            ids, lengths = self._join_spaces(ids, lengths)
        ids, lengths = self._fall_back(ids, lengths)
        raw, ends = ids.astype("<i4").tobytes(), (np.cumsum(lengths) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _join_spaces(self, ids, lengths):
        word = np.repeat(np.arange(len(lengths)), lengths)
        blank = ids == self.space
        head = np.ones(len(ids), bool)
        head[1:] = ~(blank[1:] & blank[:-1] & (word[:-1] == word[1:]))
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(ids)))
        kept, times = ids[first].copy(), np.ones(len(first), np.int64)
        for n in np.unique(size[size > 1]).tolist():
            times[size == n] = len(self.run_ids(n))
        out = np.repeat(kept, times)
        starts = np.cumsum(times) - times
        for n in np.unique(size[size > 1]).tolist():
            run = self.run_ids(n)
            out[starts[size == n][:, None] + np.arange(len(run))] = run
        return out, np.bincount(np.repeat(word[first], times), minlength=len(lengths))

    def _fall_back(self, ids, lengths):
        odd = np.flatnonzero(ids >= self.size)
        if not len(odd):
            return ids, lengths
        raw = [self.byte_ids[list(chr(c).encode())] for c in (ids[odd] - self.size).tolist()]
        times = np.ones(len(ids), np.int64)
        times[odd] = [len(r) for r in raw]
        out = np.repeat(ids, times)
        out[np.repeat(ids >= self.size, times)] = np.concatenate(raw)
        word = np.repeat(np.repeat(np.arange(len(lengths)), lengths), times)
        return out, np.bincount(word, minlength=len(lengths))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and their number per text."""
        cut = [self.words(t) for t in texts]
        new = list({w for words in cut for w in words} - self.cache.keys())
        if new:
            self.cache.update(zip(new, self.encode_words(new), strict=True))
            self.cached += sum(8 * len(w) + ENTRY_BYTES for w in new)  # ids of four bytes, characters of up to four
        get = self.cache.__getitem__
        joined = [b"".join(map(get, words)) for words in cut]
        if self.cached > CACHE_BYTES:
            self.cache, self.cached = {}, 0
        return np.frombuffer(b"".join(joined), "<i4"), np.fromiter(map(len, joined), np.int64, len(joined)) // 4

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, spaces restored, the dummy prefix dropped, bytes decoded together."""
        if self.prefix:
            for at, i in enumerate(ids):
                if self.bytes[i]:
                    if self.opens[i]:
                        head = b"".join(map(self.bytes.__getitem__, ids[at:]))[1:]
                        return head.decode("utf-8", "tapewright-each-byte")
                    break
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "tapewright-each-byte")


def _load(path: str, known={}) -> PieceModel:  # noqa: B006 - one model per worker process
    if path not in known:
        known[path] = PieceModel(path)
    return known[path]


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``ids`` array<int> of the whole text and ``decoded``, the text that these ids give back.

    ``model`` is the path of the model file on every executor. Null and empty texts have no ids and an empty
    ``decoded``. Rows are independent: repeated rows and null keys give a row each, other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(model)
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE_BYTES):
                ids, counts = pieces.encode(strings(texts))
                ends = np.append(0, np.cumsum(counts)).tolist()
                decoded = [pieces.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([part.column(0), listed, pa.array(decoded, pa.string())], ["key", "ids", "decoded"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("key", key)
