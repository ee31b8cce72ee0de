"""All segmentations of words into the pieces of an existing vocabulary, weighted by the pieces' log probabilities.

A word is a path from its start to its end whose edges are pieces. Every byte is
a piece too, so each word has a path. ``forward`` adds up all paths in log space;
``expected`` gives how often each piece is expected on them. Both work on many
words at once: edges are found by running hashes of all windows of one length,
and the recursion takes one place of all words at a time.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 22
#: Bytes of words that are taken together; one longer word is taken alone.
_BATCH = 1 << 20


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces, log probabilities) of a sentencepiece model: first the end of a text, then the 256 bytes, then all others that lower-case text can hold.

    Scores of a unigram model are log probabilities. Those of a merge model are
    ranks, which become probabilities by Zipf's law. A space stands for the mark
    of a word's start.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    scores = np.array([model.get_score(i) for i in range(model.get_piece_size())])
    ranked = scores.min() < -1000  # log probabilities are not that low
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        raw = piece.replace("▁", " ").encode()
        if raw != raw.lower() or b" " in raw[1:]:
            continue
        found.setdefault(raw, -float(np.log(1 - scores[i])) if ranked else float(scores[i]))
    least = min(found.values(), default=0.0)
    pieces, weights = [b""], [least]
    for b in range(256):
        pieces.append(bytes([b]))
        weights.append(found.pop(bytes([b]), least))
    pieces += found
    weights = np.array([*weights, *found.values()])
    return pieces, weights - np.log(np.exp(weights - weights.max()).sum()) - weights.max()


class Lattice:
    """Edges of many words, and sums over all their paths."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        self.bytes_first = 1  # pieces[1:257] are the single bytes
        keys, owners, self.lengths = [], [], sorted({len(x) for x in pieces[257:]})
        with np.errstate(over="ignore"):
            for i, piece in enumerate(pieces[257:], 257):
                h = np.uint64(0)
                for b in piece:
                    h = h * _BASE + np.uint64(b + 1)
                keys.append(h + np.uint64(len(piece)))
                owners.append(i)
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys, self.owners = np.array(keys, np.uint64)[order], np.array(owners, np.int64)[order]
        self.slots = np.zeros(1 << _SLOTS, bool)
        with np.errstate(over="ignore"):
            self.slots[(self.keys * _BASE) >> np.uint64(64 - _SLOTS)] = True

    def batches(self, words: list[bytes]):
        """(indexes, bytes end to end, starts with one entry more) of words of like lengths, each with a leading space."""
        sizes = np.array([len(x) + 1 for x in words], np.int64)
        order, at = np.argsort(sizes, kind="stable"), 0
        while at < len(order):
            total = np.cumsum(sizes[order[at : at + _BATCH]])
            end = at + max(1, int(np.searchsorted(total, _BATCH, "right")))
            own = order[at:end]
            data = np.frombuffer(b"".join(b" " + words[i] for i in own.tolist()), np.uint8)
            yield own, data, np.concatenate([[0], np.cumsum(sizes[own])])
            at = end

    def edges(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start byte, end byte, piece) of every piece within a word."""
        sizes = np.diff(starts)
        ends = np.repeat(starts[1:], sizes)
        found = [(np.arange(len(data)), np.arange(1, len(data) + 1), data.astype(np.int64) + self.bytes_first)]
        alive, h = np.arange(len(data)), np.zeros(len(data), np.uint64)
        with np.errstate(over="ignore"):
            for length in range(1, (self.lengths[-1] if self.lengths else 0) + 1):
                left = ends[alive] - alive >= length
                if not left.all():
                    alive, h = alive[left], h[left]
                if not len(alive):
                    break
                h = h * _BASE + (data[alive + length - 1].astype(np.uint64) + np.uint64(1))
                key = h + np.uint64(length)
                may = np.flatnonzero(self.slots[(key * _BASE) >> np.uint64(64 - _SLOTS)])
                at = np.minimum(np.searchsorted(self.keys, key[may]), len(self.keys) - 1)
                hit = self.keys[at] == key[may]
                s = alive[may[hit]]
                found.append((s, s + length, self.owners[at[hit]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _steps(self, data: np.ndarray, starts: np.ndarray):
        """The edges as (source node, target node, piece), and the bounds of groups in which no two have the same source or target, by ascending source place."""
        s, t, piece = self.edges(data, starts)
        word = np.searchsorted(starts, s, "right") - 1
        place, size = s - starts[word], t - s
        order = np.lexsort((size, place))
        s, t, piece, word, place, size = (x[order] for x in (s, t, piece, word, place, size))
        new = np.flatnonzero((np.diff(place) != 0) | (np.diff(size) != 0)) + 1
        return s + word, t + word, piece, np.concatenate([[0], new, [len(s)]])  # a word of n bytes has n + 1 nodes

    @staticmethod
    def _sums(source, target, weight, bounds, at, n: int) -> np.ndarray:
        out = np.full(n, -np.inf)
        out[at] = 0.0
        for a, b in bounds:
            out[target[a:b]] = np.logaddexp(out[target[a:b]], out[source[a:b]] + weight[a:b])
        return out

    def forward(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        """The natural log of each word's probability: of all its segmentations together."""
        out = np.zeros(len(words))
        for own, data, starts in self.batches(words):
            source, target, piece, cuts = self._steps(data, starts)
            nodes = np.arange(len(own))
            alpha = self._sums(source, target, logp[piece], zip(cuts[:-1], cuts[1:], strict=True), starts[:-1] + nodes, len(data) + len(own))
            out[own] = alpha[starts[1:] + nodes]
        return out

    def expected(self, words: list[bytes], weights: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the segmentations of the words, of which there are ``weights``."""
        out = np.zeros(self.n)
        for own, data, starts in self.batches(words):
            source, target, piece, cuts = self._steps(data, starts)
            nodes, n, w = np.arange(len(own)), len(data) + len(own), logp[piece]
            bounds = list(zip(cuts[:-1], cuts[1:], strict=True))
            alpha = self._sums(source, target, w, bounds, starts[:-1] + nodes, n)
            beta = self._sums(target, source, w, bounds[::-1], starts[1:] + nodes, n)
            word = np.searchsorted(starts + np.arange(len(starts)), source, "right") - 1
            total = alpha[starts[1:] + nodes]
            out += np.bincount(piece, np.exp(alpha[source] + w + beta[target] - total[word]) * weights[own][word], self.n)
        return out
