"""LM scoring (operator 3): a weighted backoff automaton over word n-grams, learned from and applied to all documents.

States are the n-grams of fewer than ``order`` tokens. From the state of a context h goes an arc for each token w seen
after it, with weight log10 of the smoothed probability, and a failure arc to the context without its first token. The
smoothing is a Dirichlet prior: p(w | h) = (c(hw) + mu p(w | h')) / (c(h) + mu), with h' the shorter context; so the
failure arc weighs mu / (c(h) + mu) and the probabilities of a context add up to one. At the root p is add-one,
(c + 1) / (N + V + 1), as in the base score.

The automaton of all documents is never in one place. Each chunk of documents asks for the counts of its own n-grams
(``census``), builds the part of the automaton that its texts run through, and runs them through it from left to right:
the state before a token is the longest state that the tokens before it end in; from there the token's arc is taken, or
failure arcs until a state has one, the weights add up and the arc leads to the next state.

All texts of a chunk go through it in step, a token a round. Long ones are cut into stretches; a stretch starts at the
root ``order - 1`` tokens early, and as states are prefix-closed and no longer than that, it is in the same state as one
run from the start of the text when its own tokens begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import census
from .batches import buffers, ragged, text_column
from .shingles import mix, word_hashes
from .stored import stage

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)  # outside of words: their hashes are these with a chance of 2^-63
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
MU = 4.0
#: Bits of a level of n-gram keys, and bytes of text per bucket of them (``census``).
BITS, BUCKET_BYTES = 11, 16 << 20
#: Tokens of a text that are read one after another; its stretches are read side by side.
STRETCH = 256


class Grams:
    """n-grams of a chunk: per order the sorted distinct keys, where each first ends, and the key at every place."""

    def __init__(self, texts: pa.Array, order: int):
        words, at = word_hashes(*buffers(texts))
        counts = np.diff(at)
        self.starts = ragged(counts + 2)
        tokens = np.empty(self.starts[-1], np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[self.starts[:-1]] = inner[self.starts[1:] - 1] = False
        tokens[inner] = words
        tokens[self.starts[:-1]], tokens[self.starts[1:] - 1] = START, END
        self.text = np.repeat(np.arange(len(counts)), counts + 2)
        self.depth = np.arange(len(tokens)) - self.starts[self.text]  # tokens before, the start included
        self.keys, self.first, self.place = [], [], []
        key = tokens
        for k in range(order):
            if k:
                key = np.concatenate([[np.uint64(0)], mix(key[:-1] * _LEFT + tokens[1:] * _RIGHT + np.uint64(k))])
            known = np.flatnonzero(self.depth >= k)
            distinct, first, place = np.unique(key[known], return_index=True, return_inverse=True)
            full = np.full(len(tokens), -1, np.int64)
            full[known] = place
            self.keys.append(distinct)
            self.first.append(known[first])
            self.place.append(full)

    def counts(self, k: int, train: np.ndarray) -> np.ndarray:
        """How often each key of order k + 1 ends in a training text."""
        own = train[self.text] & (self.place[k] >= 0)
        return np.bincount(self.place[k][own], minlength=len(self.keys[k]))


class Automaton:
    """The states, arcs and failure arcs that a chunk's texts run through, from counts in all training documents.

    State 0 is the root; the others are the n-grams of 1 to ``order - 1`` tokens that training documents hold. The root
    has an arc for every token. Arcs of the others lie sorted by state and token.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], tokens: int, distinct: int, mu: float):
        order, self.symbols = len(totals), max(1, len(grams.keys[0]))
        states, count = [], 1
        for total in totals[:-1]:
            seen = total > 0
            states.append(np.where(seen, count + np.cumsum(seen) - 1, 0))
            count += int(seen.sum())
        self.fail_to, self.fail_weight = np.zeros(count, np.int64), np.zeros(count)
        chance = (totals[0] + 1) / (tokens + distinct + 1)
        self.root_weight = np.log10(chance)
        self.root_to = states[0] if order > 1 else np.zeros(self.symbols, np.int64)
        arcs, weights, to = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for k in range(1, order):
            last = grams.first[k]
            context, shorter = grams.place[k - 1][last - 1], grams.place[k - 1][last]
            chance = (totals[k] + mu * chance[shorter]) / (totals[k - 1][context] + mu)
            seen = np.flatnonzero(totals[k] > 0)
            arcs.append(states[k - 1][context[seen]] * self.symbols + grams.place[0][last[seen]])
            weights.append(np.log10(chance[seen]))
            to.append(states[k][seen] if k < order - 1 else states[k - 1][shorter[seen]])
            own = np.flatnonzero(totals[k - 1] > 0)
            self.fail_weight[states[k - 1][own]] = np.log10(mu / (totals[k - 1][own] + mu))
            if k < order - 1:
                self.fail_to[states[k][seen]] = states[k - 1][shorter[seen]]
        by = np.argsort(np.concatenate(arcs))
        self.arcs, self.weights, self.to = (np.concatenate(c)[by] for c in (arcs, weights, to))
        self.reach = order - 1

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and weights of tokens read in states."""
        weight = np.zeros(len(state))
        following = np.empty(len(state), np.int64)
        here = np.arange(len(state))
        while len(here):
            at_root = state[here] == 0
            done = here[at_root]
            weight[done] += self.root_weight[token[done]]
            following[done] = self.root_to[token[done]]
            here = here[~at_root]
            if not len(here):
                break
            wanted = state[here] * self.symbols + token[here]
            arc = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1) if len(self.arcs) else np.zeros(len(here), np.int64)
            found = self.arcs[arc] == wanted if len(self.arcs) else np.zeros(len(here), bool)
            weight[here[found]] += self.weights[arc[found]]
            following[here[found]] = self.to[arc[found]]
            here = here[~found]
            weight[here] += self.fail_weight[state[here]]
            state[here] = self.fail_to[state[here]]
        return following, weight

    def run(self, grams: Grams) -> np.ndarray:
        """log10 probability of every text."""
        token, starts = grams.place[0], grams.starts
        stretches = -(-np.diff(starts) // STRETCH)
        text = np.repeat(np.arange(len(stretches)), stretches)
        own = starts[text] + STRETCH * (np.arange(len(text)) - ragged(stretches)[text])
        at, end = np.maximum(own - self.reach, starts[text]), np.minimum(own + STRETCH, starts[text + 1])
        own = np.maximum(own, starts[text] + 1)  # the start mark is read, but not scored
        by = np.argsort(at - end, kind="stable")  # longest first: those still running are a prefix
        at, end, own, text = at[by], end[by], own[by], text[by]
        running = np.searchsorted(at - end, -np.arange(STRETCH + self.reach), "left")
        state, out = np.zeros(len(at), np.int64), np.zeros(len(at))
        for t, n in enumerate(running.tolist()):
            if not n:
                break
            place = at[:n] + t
            state[:n], weight = self.step(state[:n], token[place])
            out[:n] += np.where(place >= own[:n], weight, 0.0)
        return np.bincount(text, weights=out, minlength=len(stretches))


def score(docs: DataFrame, train: str, order: int = 2, mu: float = MU, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``train`` is an SQL condition on the columns of ``docs``: rows for which it is true are learned from, null counts as
    false. Words are runs of other than ASCII white space, A-Z in lower case; each text ends with one end token, null
    and empty texts have that only. Repeated rows are learned from and scored each. Counts are of 64-bit hashes of
    n-grams: two of D distinct n-grams share one with a chance of D^2 / 2^65. Without documents the result is empty; without training documents N = V = 0.
    """
    bits = census.levels(census.text_bytes(docs, text), BITS, BUCKET_BYTES)
    learned = F.coalesce(F.expr(train).cast("boolean"), F.lit(False))
    rows = docs.select(F.col(key).alias("key"), learned.alias("train"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in census.each_chunk(batches):
            grams, own = Grams(text_column(part, "text"), order), np.asarray(part.column(1).to_pylist(), bool)
            for k in range(order):
                yield census.request(chunk, k, grams.keys[k], grams.counts(k, own), bits)

    chunks = census.stored_chunks(rows)
    found = stage(census.answers(chunks.mapInArrow(ask, census.REQUEST), bits), "counts", large_rows=True)
    sums = found.where("chunk = -1 and kind = 0").agg(F.sum("distinct"), F.sum("total")).first()
    starts = rows.where("train").count()  # the start mark is counted as a key, but is no token
    distinct, tokens = (sums[0] or 0) - (starts > 0), (sums[1] or 0) - starts

    def scored(table: pa.Table) -> pa.Table:
        batch, parts = census.chunk_of(table)
        grams = Grams(text_column(batch, "text"), order)
        totals = [census.joined(parts.get(k, []), grams.keys[k]) for k in range(order)]
        count = np.where(grams.depth > 0, totals[0][grams.place[0]], 0)
        base = np.where(grams.depth > 0, np.log10((count + 1) / (tokens + distinct + 1)), 0.0)
        model = Automaton(grams, totals, tokens, distinct, mu).run(grams)
        at = grams.starts[:-1]
        return pa.table([
            batch.column(0), pa.array([not x for x in batch.column(1).to_pylist()], pa.bool_()), pa.array(np.diff(grams.starts) - 1),
            pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(np.full(len(at), tokens, np.int64)),
            pa.array(np.add.reduceat(base, at)), pa.array(model),
        ], ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return census.with_payload(found, chunks).groupBy("chunk").applyInArrow(scored, schema).withColumnRenamed("key", key)
