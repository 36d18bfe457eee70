"""Word shingles and their MinHash values, for whole Arrow batches of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.llm.lattice import mix

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 2**64))
#: Bytes hashed at once; one longer text is hashed alone.
BLOCK = 1 << 21
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word with A-Z lower-cased; the number of words of each text) of texts that follow each
    other in ``data`` and end at ``ends``."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[0] = True
    edge[ends] = True
    start = np.flatnonzero(word & (np.concatenate([[False], ~word[:-1]]) | edge[:-1]))
    stop = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | edge[1:])) + 1
    run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * _powers(len(data), _BASE))])
    h = mix((run[stop] - run[start]) * _powers(len(data) + 1, _BACK)[start] + (stop - start).astype(np.uint64))
    return h, np.diff(np.searchsorted(start, np.concatenate([[0], ends])))


def _of_block(data: np.ndarray, ends: np.ndarray, k: int) -> list[np.ndarray]:
    h, n = word_hashes(data, ends)
    upto = np.cumsum(n)
    rolled = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for i in range(k):
        rolled = rolled * _BASE + h[i : i + len(rolled)]
    rolled = mix(rolled)
    out = []
    for b, m in zip((upto - n).tolist(), n.tolist(), strict=True):
        if m >= k:
            out.append(np.unique(rolled[b : b + m - k + 1]))
        else:  # the whole sequence, told from longer ones by its length
            x = np.uint64(m)
            for v in h[b : b + m]:
                x = x * _BASE + v
            out.append(mix(np.array([x], dtype=np.uint64)) if m else np.empty(0, dtype=np.uint64))
    return out


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; of all its words if there are fewer than k;
    none for a null text or one without words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    out, first = [], 0
    with np.errstate(over="ignore"):
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(off, off[first] + BLOCK, side="right")) - 1)
            out += _of_block(raw[off[first] : off[last]], off[first + 1 : last + 1] - off[first], k)
            first = last
    return out


def min_hashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """[sets, n] 32-bit MinHash values; the sets must not be empty."""
    if not sets:
        return np.empty((0, n), dtype=np.uint32)
    out = np.empty((len(sets), n), dtype=np.uint32)
    sizes = np.array([len(s) for s in sets])
    at = 0
    while at < len(sets):  # blocks that stay in cache
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 15)))
        flat, starts = np.concatenate(sets[at:to]), np.concatenate([[0], np.cumsum(sizes[at : to - 1])])
        with np.errstate(over="ignore"):
            for i in range(n):
                a, c = _SEEDS[2 * i], _SEEDS[2 * i + 1]
                out[at:to, i] = np.minimum.reduceat((flat ^ c) * a, starts) >> np.uint64(32)
        at = to
    return out


_SEEDS = mix(np.arange(1, 2049, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
