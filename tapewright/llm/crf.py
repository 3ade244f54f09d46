"""A linear-chain conditional random field with two labels: trained by gradient on whole sequences, decoded by Viterbi."""

from __future__ import annotations

import numpy as np


class Crf:
    """Weights of features per label, and of pairs of neighbouring labels."""

    def __init__(self, index: dict[str, int], unary: np.ndarray, pair: np.ndarray, edge: np.ndarray):
        self.index, self.unary, self.pair, self.edge = index, unary, pair, edge

    def potentials(self, sequence: list[list[str]]) -> np.ndarray:
        get = self.index.get
        out = np.zeros((len(sequence), 2))
        for at, names in enumerate(sequence):
            ids = [i for i in map(get, names) if i is not None]
            if ids:
                out[at] = self.unary[ids].sum(axis=0)
        return out

    def decode(self, sequence: list[list[str]]) -> list[int]:
        """The most probable labels."""
        if not sequence:
            return []
        scores = self.potentials(sequence).tolist()
        (a, b), (c, d) = self.pair.tolist()
        zero, one = (s + e for s, e in zip(scores[0], self.edge.tolist(), strict=True))
        back = []
        for x, y in scores[1:]:
            from_zero, from_one = zero + a >= one + c, zero + b > one + d
            back.append((0 if from_zero else 1, 0 if from_one else 1))
            zero, one = x + (zero + a if from_zero else one + c), y + (zero + b if from_one else one + d)
        label = int(one > zero)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]


def train(sequences: list[list[list[str]]], labels: list[list[int]], rounds: int = 120, rate: float = 0.15, penalty: float = 1e-3) -> Crf:
    """Maximum likelihood with a quadratic penalty, by Adam over all sequences at once."""
    kept = [(s, y) for s, y in zip(sequences, labels, strict=True) if s]
    index: dict[str, int] = {}
    for sequence, _ in kept:
        for names in sequence:
            for n in names:
                index.setdefault(n, len(index))
    count, longest = len(kept), max((len(s) for s, _ in kept), default=0)
    feature, place = [], []
    mask, truth = np.zeros((count, longest), bool), np.zeros((count, longest), np.int64)
    for i, (sequence, y) in enumerate(kept):
        mask[i, : len(y)], truth[i, : len(y)] = True, y
        for t, names in enumerate(sequence):
            ids = sorted({index[n] for n in names})
            feature += ids
            place += [i * longest + t] * len(ids)
    feature, place = np.array(feature, np.int64), np.array(place, np.int64)
    sizes = (len(index), 2), (2, 2), (2,)
    weights = [np.zeros(s) for s in sizes]
    first, second = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
    gold = np.eye(2)[truth] * mask[..., None]
    both = mask[:, 1:] if longest else mask
    gold_pairs = np.einsum("itx,ity->xy", gold[:, :-1], gold[:, 1:] * both[..., None]) if longest else np.zeros((2, 2))
    lengths = mask.sum(axis=1) - 1
    for step in range(1, rounds + 1 if count else 1):
        unary, pair, edge = weights
        score = np.stack([np.bincount(place, weights=unary[feature, k], minlength=count * longest).reshape(count, longest) for k in (0, 1)], axis=-1)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0] + edge
        for t in range(1, longest):
            into = alpha[:, t - 1, :, None] + pair
            alpha[:, t] = np.where(mask[:, t, None], np.logaddexp(into[:, 0], into[:, 1]) + score[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            out = pair + (score[:, t + 1] + beta[:, t + 1])[:, None, :]
            beta[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(out[..., 0], out[..., 1]), 0.0)
        whole = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None, None]
        chance = np.exp(alpha + beta - whole) * mask[..., None]
        pairs = np.exp(alpha[:, :-1, :, None] + pair + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - whole[..., None]) * both[..., None, None]
        wrong = (gold - chance).reshape(-1, 2)
        slopes = [
            np.stack([np.bincount(feature, weights=wrong[place, k], minlength=len(index)) for k in (0, 1)], axis=-1),
            gold_pairs - pairs.sum(axis=(0, 1)), (gold[:, 0] - chance[:, 0]).sum(axis=0),
        ]
        for w, g, m, v in zip(weights, slopes, first, second, strict=True):
            g = g / max(1, lengths.sum() + count) - penalty * w / max(1, count)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(index, *weights)
