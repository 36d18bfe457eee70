"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an arc for each vocabulary piece that matches, and byte pieces for each character
that no piece covers (and for a literal space mark, so that decoding is exact). Forward filtering gives
every node the weights of its incoming arcs; backward sampling draws one arc a node from the end, with
random numbers made from the row key, the place and the step: the same row gives the same pieces wherever
and whenever it runs. No piece spans two words, so the lattice of a text is the chain of its words'
lattices; a batch's distinct words are filtered once, and all their occurrences are sampled together.

Null texts encode to null, empty ones to no pieces. Rows with equal key and text get equal pieces; a null
key is a key of its own. Texts of any length are handled whole.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hidden, slices
from tidemark.llm.lattice import Lattices, by_step, heads, mix
from tidemark.llm.vocab import SPACE_MARK, Vocabulary

#: A piece of rank r has weight (r + 1) ** -POWER; a character no piece covers has e ** BYTE_LOGW.
POWER, BYTE_LOGW = 1.0, -14.0
#: Added to the log weight of each character, so that words of usual length stay in a double's range.
SCALE = 4.0
#: Words sampled at once.
BLOCK = 1 << 18
#: Cuts before a word's space marks; the finer one also after a Latin letter that something else follows.
_CHUNK = re.compile(rf"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
_FINE = re.compile(rf"{SPACE_MARK}*[^A-Za-zÀ-ɏ{SPACE_MARK}]*[A-Za-zÀ-ɏ]+|{SPACE_MARK}*[^A-Za-zÀ-ɏ{SPACE_MARK}]+|{SPACE_MARK}+")
#: Stands for a literal space mark while spaces are written as marks; a lone surrogate, so in no text.
_LITERAL = "\udc81"


class Sampler:
    """Encodes and decodes with one vocabulary; holds no state between calls."""

    def __init__(self, vocab: Vocabulary):
        self.v, self.lattices = vocab, Lattices(vocab)
        size = np.array([len(p) for p in vocab.pieces])
        self.w = np.append((np.arange(len(size)) + 1.0) ** -POWER * np.exp(SCALE * size), np.exp(BYTE_LOGW + SCALE))
        self.cut = _FINE if all(len(_FINE.findall(p)) == 1 for p in vocab.ids) else _CHUNK  # no piece may span a cut
        self.text = [vocab_bytes(vocab, i) for i in range(len(vocab.pieces))]

    def filtered(self, words: list[str]):
        """(end node of each word; arcs from and up to of each node; start, piece and cumulated share of each arc)."""
        size, start, end, k = self.lattices.arcs(words)
        w = self.w[np.maximum(k, -1)]
        last = np.cumsum(size + 1) - 1
        nodes = int(last[-1]) + 1 if len(last) else 0
        alpha, mass = np.zeros(nodes), np.empty(len(w))
        alpha[last - size] = 1.0
        for on in by_step(size, end):
            at = heads(to := end[on])
            mass[on] = got = alpha[start[on]] * w[on]
            to, total = to[at], np.add.reduceat(got, at)
            alpha[to] = total
            if len(odd := to[~((total > 1e-250) & (total < 1e250))]):
                self._rescale(alpha, mass, odd, size, start, end, w, last)
        arc = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=nodes))])
        run = np.concatenate([[0.0], np.cumsum(mass / np.maximum(alpha[end], 1e-300))])
        cum = run[1:] - run[arc[end]]
        cum[arc[1:][arc[1:] > arc[:-1]] - 1] = 2.0  # the last arc takes what rounding leaves
        return last, arc, start, k, cum

    @staticmethod
    def _rescale(alpha, mass, odd, size, start, end, w, last):
        """Brings words about to leave a double's range back to 1: shares are ratios within a node, so a common
        factor over the nodes that later arcs can start from changes none."""
        first = last - size
        for node in odd.tolist():
            x = int(np.searchsorted(last, node))
            lo = max(int(first[x]), node - 32)
            own = slice(int(np.searchsorted(end, node)), int(np.searchsorted(end, node + 1)))
            live = alpha[lo:node].copy()
            live /= live.max() if live.max() > 0 else 1.0
            alpha[lo:node] = live
            got = alpha[start[own]] * w[own]
            mass[own], alpha[node] = got, got.sum()

    def encode(self, texts: list[str | None], keys: np.ndarray) -> list[np.ndarray | None]:
        """Piece ids of each text; null for a null text."""
        out: list[np.ndarray | None] = []
        ids: dict[str, int] = defaultdict(count().__next__)
        flat: list[int] = []
        sizes: list[int] = []

        def flush():
            first, upto = len(out), len(out) + len(sizes)
            got, ends = self._block(list(ids), np.array(flat, dtype=np.int64), np.array(sizes, dtype=np.int64), keys[first:upto])
            out.extend(None if texts[d] is None else got[ends[d - first] : ends[d - first + 1]] for d in range(first, upto))
            ids.clear(), flat.clear(), sizes.clear()
            ids.default_factory = count().__next__

        for t in texts:
            own = self.chunks(t) if t else []
            flat.extend(map(ids.__getitem__, own))
            sizes.append(len(own))
            if len(flat) >= BLOCK:
                flush()
        flush()
        return out

    def _block(self, words, flat, n, keys) -> tuple[np.ndarray, np.ndarray]:
        """(the pieces of all texts, the places where texts begin and end)."""
        last, arc, start, piece, cum = self.filtered(words)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        seed = mix(np.repeat(keys, n) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        live, node, steps = np.arange(len(flat)), last[flat] if len(flat) else flat, []
        counts, step = np.zeros(len(flat), dtype=np.int64), 0
        while True:
            on = arc[node + 1] > arc[node]
            live, node = live[on], node[on]
            if not len(live):
                break
            u = (mix(seed[live] + np.uint64((0x9E3779B97F4A7C15 * (step + 1)) & (2**64 - 1))) >> np.uint64(11)).astype(float) * 2.0**-53
            at = arc[node]
            more = np.flatnonzero(cum[at] <= u)
            while len(more):  # nodes have a few arcs, the likelier ones mostly first
                at[more] += 1
                more = more[cum[at[more]] <= u[more]]
            steps.append((live, piece[at]))
            counts[live] += 1
            node, step = start[at], step + 1
        upto = np.cumsum(counts)
        ids = np.empty(int(upto[-1]) if len(upto) else 0, dtype=np.int64)
        for s, (who, what) in enumerate(steps):
            ids[upto[who] - 1 - s] = what
        ends = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(n)])]
        if (ids < 0).any():
            ids, ends = self._bytes(ids, ends)
        return ids.astype(np.int32), ends

    def _bytes(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that no piece covers, written as byte pieces."""
        of = {}
        for k in np.unique(ids[ids < 0]).tolist():
            c = chr(-1 - k)
            of[k] = [self.v.bytes_[x] for x in (SPACE_MARK if c == _LITERAL else c).encode("utf-8", "surrogatepass")]
        size = np.ones(len(ids), dtype=np.int64)
        for k, b in of.items():
            size[ids == k] = len(b)
        place = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(ids, size)
        for k, b in of.items():
            where = place[:-1][ids == k]
            for i, x in enumerate(b):
                out[where + i] = x
        return out, place[ends]

    def chunks(self, text: str) -> list[str]:
        """The text cut where no piece can span, with its spaces written as marks."""
        if SPACE_MARK in text:
            text = text.replace(SPACE_MARK, _LITERAL)
        return self.cut.findall(text.replace(" ", SPACE_MARK))

    def decode(self, ids) -> str:
        text = self.text
        return b"".join([text[i] for i in ids]).decode("utf-8", "surrogatepass")


def vocab_bytes(v: Vocabulary, i: int) -> bytes:
    p = v.pieces[i]
    return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else b"" if v.special[i] else p.replace(SPACE_MARK, " ").encode()


def row_keys(keys: list, seed: int) -> np.ndarray:
    raw = [zlib.crc32(repr(k).encode()) | zlib.adler32(repr(k).encode()) << 32 for k in keys]
    return mix(np.array(raw, dtype=np.uint64) + np.uint64(seed * 2 + 1))


def encode(df: DataFrame, vocab: Vocabulary, key: str = "doc_id", seed: int = 0, keep_ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all but the text, by default) with pieces (array of ids, if ``keep_ids``), n_pieces, ids_crc32
    (of the ids as little-endian 32-bit), text_crc32, decoded_crc32 and lossless: decoding gave the text."""
    made = ("n_pieces", "ids_crc32", "text_crc32", "decoded_crc32", "lossless", *["pieces"] * keep_ids)
    keep = [c for c in df.columns if c not in ("text", *made)] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(vocab)
    extra = "n_pieces long, ids_crc32 long, text_crc32 long, decoded_crc32 long, lossless boolean" + ", pieces array<int>" * keep_ids
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", " + extra
    names = [*keep, *made]
    held: list[Sampler] = []

    def run(batches):
        if not held:
            held.append(Sampler(shared.value))
        s = held[0]
        for b in slices(batches):
            texts = b.column("_tm_text").to_pylist()
            got = s.encode(texts, row_keys(b.column("_tm_key").to_pylist(), seed))
            rows = []
            for t, ids in zip(texts, got, strict=True):
                if t is None:
                    rows.append((None,) * 5)
                    continue
                raw, back = t.encode("utf-8", "surrogatepass"), s.decode(ids.tolist())
                rows.append((len(ids), zlib.crc32(ids.astype("<i4").tobytes()), zlib.crc32(raw), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == t))
            n, crc, tc, dc, ok = zip(*rows, strict=True) if rows else ([],) * 5
            cols = b.columns[: len(keep)] + [pa.array(list(x), pa.int64()) for x in (n, crc, tc, dc)] + [pa.array(list(ok), pa.bool_())]
            if keep_ids:
                flat = np.concatenate([np.empty(0, np.int32), *[i for i in got if i is not None]])
                ends = np.cumsum([0] + [0 if i is None else len(i) for i in got]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([i is None for i in got])) if got else pa.array([], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(*hidden(df.select(*[f"`{c}`" for c in keep])), F.col(f"`{key}`").alias("_tm_key"), F.col("text").alias("_tm_text")).mapInArrow(run, schema)
