"""Unigram lattices over words: every segmentation into vocabulary pieces, vectorised over many words.

A word is laid out as one space byte and its own bytes; a piece that starts a
word starts with that space.  Single bytes are pieces too, so that each word
has a segmentation.
"""

from __future__ import annotations

import numpy as np
import sentencepiece

from furrow.llm import textcore as tc

_MARK = "▁"
_BASE = np.uint64(int(tc._GRAM[0]) ^ 0x5DEECE66D) | np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_FLAGS = 1 << 20


class Pieces:
    """The pieces of a vocabulary file and their weights before training."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        texts: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i):
                continue
            piece = sp.id_to_piece(i)
            body = piece.removeprefix(_MARK)
            if _MARK not in body and not any(c.isspace() for c in body):
                texts[(b" " if piece != body else b"") + body.encode()] = sp.get_score(i)
        worst = min(texts.values(), default=0.0)
        for b in range(256):
            texts.setdefault(bytes([b]), worst)
        self.texts = list(texts)
        # The file's scores are the negated ranks of its merges; a Zipf law turns ranks into weights to start from.
        weight = 1.0 / (10.0 - np.array(list(texts.values())))
        #: Log weights of the pieces, then of the end of a text.
        self.start = np.log(np.append(weight, weight.mean()) / (weight.sum() + weight.mean()))

    @property
    def end(self) -> int:
        return len(self.texts)


class Lattice:
    """Finds pieces in words and sums over segmentations in log space."""

    def __init__(self, texts: list[bytes]):
        flat = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts])
        at = np.concatenate(([0], np.cumsum(size)))
        hashes = _prefix(flat)
        hashes = (hashes[at[1:]] - hashes[at[:-1]]) * _powers(_INVERSE, len(flat))[at[:-1]]
        key = tc.mix(hashes + size.astype(np.uint64) * tc._LEN)
        self.order = np.argsort(key)
        self.key = key[self.order]
        self.flag = np.zeros(_FLAGS, bool)
        self.flag[(key & np.uint64(_FLAGS - 1)).astype(np.int64)] = True
        self.lengths = np.unique(size)

    def edges(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of all pieces in the laid-out words; ``stop``: the end of the word of each byte."""
        prefix, inverse = _prefix(data), _powers(_INVERSE, len(data))
        a, b, c = [], [], []
        for n in self.lengths:
            at = np.flatnonzero(np.arange(len(data)) + n <= stop)
            if not len(at):
                break
            key = tc.mix((prefix[at + n] - prefix[at]) * inverse[at] + np.uint64(int(n) * int(tc._LEN) % 2**64))
            ok = self.flag[(key & np.uint64(_FLAGS - 1)).astype(np.int64)]
            at, key = at[ok], key[ok]
            slot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[slot] == key
            a.append(at[ok])
            b.append(at[ok] + n)
            c.append(self.order[slot[ok]])
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b, c))

    def run(self, words: list[bytes], log_weight: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural-log probabilities of the words; with counts also the expected uses of each piece."""
        if not words:
            return np.empty(0), None if counts is None else np.zeros(len(log_weight))
        size = np.array([len(w) + 1 for w in words])
        data = np.frombuffer(b" " + b" ".join(words), np.uint8)
        first = np.concatenate(([0], np.cumsum(size)))
        word = np.repeat(np.arange(len(words)), size)
        start, to, piece = self.edges(data, first[1:][word])
        # Nodes: one before each byte and one after each word's last byte.
        shift = word[start]
        place = start - first[shift]
        a, b, lw = start + shift, to + shift, log_weight[piece]
        order = np.lexsort((to - start, place))
        a, b, lw, piece, owner = a[order], b[order], lw[order], piece[order], shift[order]
        # Edges of one place and length meet no node twice.
        group = place[order] * (int(self.lengths[-1]) + 1) + (to - start)[order]
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        cuts = list(zip(cuts, [*cuts[1:], len(group)], strict=True))
        alpha = np.full(len(data) + len(words), -np.inf)
        alpha[first[:-1] + np.arange(len(words))] = 0.0
        for i, j in cuts:
            alpha[b[i:j]] = np.logaddexp(alpha[b[i:j]], alpha[a[i:j]] + lw[i:j])
        total = alpha[first[1:] + np.arange(len(words))]
        if counts is None:
            return total, None
        beta = np.full(len(alpha), -np.inf)
        beta[first[1:] + np.arange(len(words))] = 0.0
        for i, j in reversed(cuts):
            beta[a[i:j]] = np.logaddexp(beta[a[i:j]], beta[b[i:j]] + lw[i:j])
        used = np.exp(alpha[a] + lw + beta[b] - total[owner]) * counts[owner]
        return total, np.bincount(piece, weights=used, minlength=len(log_weight))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tc._BYTE[1][data] * _powers(_BASE, len(data))[:-1], out=out[1:])
    return out
