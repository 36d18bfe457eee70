"""Piece lattices of many words at once.

A rolling hash of every substring of every word, one length after another, is looked up in the
vocabulary's table of hashes; the arcs of all words come out as flat arrays, sorted by end.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.vocab import Vocabulary

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
#: A hash's bits below its slot: 2 ** 17 slots.
_SLOTS = 47


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Lattices:
    """The vocabulary's hash tables, by piece length."""

    def __init__(self, vocab: Vocabulary):
        if vocab.longest > 30:
            raise ValueError("pieces of at most 30 characters")
        self.tables: dict[int, tuple] = {}
        by: dict[int, list[tuple[str, int]]] = {}
        for p, k in vocab.ids.items():
            by.setdefault(len(p), []).append((p, k))
        for n, own in by.items():
            t = mix(_codes("".join(p for p, _ in own)).astype(np.uint64) + np.uint64(1)).reshape(-1, n)
            h = np.zeros(len(own), dtype=np.uint64)
            for c in range(n):
                h = h * _P + t[:, c]
            order = np.argsort(h)
            h = h[order]
            slot = h >> np.uint64(_SLOTS)
            seen, first = np.zeros(1 << (64 - _SLOTS), dtype=bool), np.zeros(1 << (64 - _SLOTS), dtype=np.int32)
            seen[slot], first[slot[::-1]] = True, np.arange(len(h))[::-1]
            crowd = int(np.unique(slot, return_counts=True)[1].max())
            self.tables[n] = h, np.array([k for _, k in own], dtype=np.int64)[order], seen, first, crowd

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lengths of the words; start node, end node, piece of each arc, by end and then longest first).
        Word w's nodes are numbered on from sum(lengths + 1) of the words before; a character that no piece
        covers has an arc with piece -1 - code point."""
        code = _codes("".join(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters to the word's end
        t = mix(code.astype(np.uint64) + np.uint64(1))
        h, found = np.zeros(len(code), dtype=np.uint64), []
        bare = np.ones(len(code), dtype=bool)
        live = np.arange(len(code))
        for n in range(1, max(self.tables, default=0) + 1):
            if n > 1:
                fits = np.flatnonzero(left[live] >= n)
                live, h = live[fits], h[fits]
                if not len(live):
                    break
            h = h * _P + t[live + n - 1]
            if n not in self.tables:
                continue
            keys, ids, seen, first, crowd = self.tables[n]
            top = h >> np.uint64(_SLOTS)
            maybe = np.flatnonzero(seen[top])
            slot, want = first[top[maybe]], h[maybe]
            for _ in range(crowd - 1):
                slot += (keys[slot] < want) & (slot < len(keys) - 1)
            hit = keys[slot] == want
            who = live[maybe[hit]]
            if n == 1:
                bare[who] = False
            found.append(_packed(who + n, n, ids[slot[hit]]))
        none = np.flatnonzero(bare)
        found.append(_packed(none + 1, 1, -1 - code[none].astype(np.int64)))
        packed = np.sort(np.concatenate(found))
        end = packed >> 26
        node = end + np.repeat(np.arange(len(words)), size)[end - 1]  # one more node than characters for each word before
        return size, node - (31 - (packed >> 21 & 31)), node, (packed & (1 << 21) - 1) - _LOW


#: Added to piece numbers, so that they are positive however large the code point.
_LOW = 0x110000


def _packed(end: np.ndarray, n: int, k: np.ndarray) -> np.ndarray:
    """End, 31 less the length, and piece in one number that sorts as they do."""
    return end << 26 | (31 - n) << 21 | k + _LOW


def by_step(size: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """Arc numbers by the end's distance from its word's start, in order: sums can run through them."""
    if not len(node):
        return []
    first = np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    key = np.sort((node - first[node]) << 40 | np.arange(len(node)))
    return np.split(key & (1 << 40) - 1, np.flatnonzero(np.diff(key >> 40)) + 1)


def heads(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
