"""Language identification by segmentation-marginalised unigrams.

Each language has its own probabilities for the pieces of a fixed public vocabulary. A word's likelihood is
the sum over all its segmentations, by the forward algorithm; a text's is the product over its words (no
piece spans two words, so this equals the sum over segmentations of the whole text). The probabilities
come from EM on all words of a sample bounded by documents a language. The distinct words of a
block of texts are scored together, so a text costs a lookup for each of its words.

A null text, or one without a letter, is ``und`` with score 0; ties go to the first language by name. A
model learned from no rows calls everything ``und``. Repeated rows are each judged; no row is dropped. Extra
columns pass through, but for columns of the results' names, which they replace.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, hidden, slices
from tidemark.llm.lattice import Lattices, by_step, heads
from tidemark.llm.vocab import SPACE_MARK, Vocabulary

#: Distinct texts of the sample the model is fitted on, for each language.
SAMPLE_DOCS = 1000
#: Longer words are fitted in parts of so many characters, to stay in a double's range; words are scored whole.
FIT_CHARS = 40
#: Characters of the words that a worker fits at once.
FIT_BLOCK = 1 << 16
#: Words scored at once, and distinct words whose scores a worker remembers.
BLOCK, MEMORY = 1 << 18, 200_000
EM_ROUNDS, SMOOTH = 4, 0.02
#: Added to the log probability of each character, so that words of usual length stay in a double's range.
SCALE = 4.0
#: Log probability of each UTF-8 byte of a character that no piece covers, in any language.
BYTE_LOGP = -16.0
UND = "und"


class Model:
    """Piece probabilities [pieces, languages]."""

    def __init__(self, vocab: Vocabulary, langs: list[str], p: np.ndarray):
        self.vocab, self.langs, self.p = vocab, langs, p
        self.lattices = Lattices(vocab)
        self.row: dict[str, int] = defaultdict(count().__next__)
        self.table = np.empty((0, len(langs)))

    def __getstate__(self):
        return self.vocab, self.langs, self.p

    def __setstate__(self, state):
        self.__init__(*state)

    def weights(self, k: np.ndarray) -> np.ndarray:
        """Probability by language of each arc, scaled by e ** SCALE a character so that words stay in range."""
        size = np.array([len(x) for x in self.vocab.pieces])
        bare = np.exp(BYTE_LOGP * np.arange(1, 5) + SCALE)[:, None].repeat(len(self.langs), 1)
        table = np.concatenate([self.p * np.exp(SCALE * size)[:, None], bare])
        if len(none := np.flatnonzero(k < 0)):
            k = k.copy()
            k[none] = len(size) + np.searchsorted([0x80, 0x800, 0x10000], -1 - k[none], side="right")
        return table[k]

    def slow(self, word: str) -> np.ndarray:
        """The forward sum in logarithms, for words whose sum leaves the range of a double."""
        size, start, end, k = self.lattices.arcs([word])
        logw = np.log(np.maximum(self.weights(k), 1e-300)) - SCALE * (end - start)[:, None]
        alpha = np.full((int(size[0]) + 1, len(self.langs)), -np.inf)
        alpha[0] = 0.0
        for s, e, w in zip(start.tolist(), end.tolist(), logw, strict=True):
            alpha[e] = np.logaddexp(alpha[e], alpha[s] + w)
        return alpha[-1]

    def score(self, words: list[str]) -> np.ndarray:
        """[words, languages]: log of the sum over all segmentations."""
        size, start, end, k = self.lattices.arcs(words)
        w, alpha = self.weights(k), np.zeros((int((size + 1).sum()), len(self.langs)))
        last = np.cumsum(size + 1) - 1
        alpha[last - size] = 1.0
        for on in by_step(size, end):
            at = heads(to := end[on])
            alpha[to[at]] = np.add.reduceat(alpha[start[on]] * w[on], at)
        with np.errstate(divide="ignore", over="ignore"):
            out = np.log(alpha[last]) - SCALE * size[:, None]
        for i in np.flatnonzero(~np.isfinite(out).all(1)):
            out[i] = self.slow(words[i])
        return out

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        said: list[tuple[str, float]] = [(UND, 0.0)] * len(texts)
        flat, sizes, whose = [], [], []

        def settle():
            if whose:
                new = list(islice(self.row, len(self.table), None))
                self.table = np.concatenate([self.table, self.score([SPACE_MARK + w for w in new])]) if new else self.table
                ends = np.cumsum(sizes)
                runs = np.cumsum(np.concatenate([np.zeros((1, len(self.langs))), self.table[flat]]), axis=0)
                total = runs[ends] - runs[ends - sizes]
                best = total.argmax(1)
                share = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for d, g, x in zip(whose, best.tolist(), share.tolist(), strict=True):
                    said[d] = self.langs[g], x
            flat.clear(), sizes.clear(), whose.clear()
            if len(self.row) > MEMORY:
                self.row.clear()
                self.row.default_factory = count().__next__
                self.table = self.table[:0]

        for d, t in enumerate(texts):
            if t and self.langs and any(map(str.isalpha, t)):
                flat.extend(map(self.row.__getitem__, own := t.split()))
                sizes.append(len(own)), whose.append(d)
                if len(flat) >= BLOCK:
                    settle()
        settle()
        return said


def _parts(word: str) -> list[str]:
    """The word with its space mark, cut every FIT_CHARS characters."""
    return [SPACE_MARK * (not at) + word[at : at + FIT_CHARS] for at in range(0, len(word), FIT_CHARS)]


def expected(m: Model, words: list[str], n: np.ndarray) -> np.ndarray:
    """[pieces, languages]: how often each piece is used by the words, which occur n [words, languages] times, over
    all segmentations."""
    size, start, end, k = m.lattices.arcs(words)
    steps, last = by_step(size, end), np.cumsum(size + 1) - 1
    word, w = np.repeat(np.arange(len(words)), size + 1)[end], m.weights(k)
    alpha, beta = np.zeros((2, int(last[-1]) + 1, len(m.langs)))
    alpha[last - size], beta[last] = 1.0, 1.0
    for on in steps:
        np.add.at(alpha, end[on], alpha[start[on]] * w[on])
    for on in reversed(steps):
        np.add.at(beta, start[on], beta[end[on]] * w[on])
    share = alpha[start] * w * beta[end] * (n / np.maximum(alpha[last], 1e-300))[word]
    c, real = np.zeros_like(m.p), k >= 0
    np.add.at(c, k[real], share[real])
    return c


def _even(vocab: Vocabulary, langs: list[str]) -> Model:
    m = Model(vocab, langs, np.zeros((len(vocab.pieces), len(langs))))
    m.p[list(vocab.ids.values())] = 1.0 / max(1, len(vocab.ids))
    return m


def _em(m: Model, used: Callable[[], np.ndarray]) -> Model:
    """EM_ROUNDS over what ``used`` tells by m's probabilities; pieces a language lacks are smoothed by all."""
    for _ in range(EM_ROUNDS):
        c = used()
        back = c.sum(1, keepdims=True) + 1e-2 * (m.p > 0).any(1, keepdims=True)
        back /= back.sum()
        each = c.sum(0, keepdims=True)
        m.p = (c + SMOOTH * each * back) / np.maximum((1 + SMOOTH) * each, 1e-300)
    return m


def fit(vocab: Vocabulary, counts: dict[str, dict[str, int]]) -> Model:
    """A model from word counts by language, in memory."""
    m = _even(vocab, sorted(counts))
    parts = [(p, [counts[g].get(w, 0) for g in m.langs]) for w in sorted({w for c in counts.values() for w in c}) for p in _parts(w)]
    return _em(m, lambda: expected(m, [p for p, _ in parts], np.array([n for _, n in parts], dtype=float))) if parts else m


def _round(m: Model, words: DataFrame) -> np.ndarray:
    """expected over the table of words (w, n), summed by Spark."""
    shared, kinds = words.sparkSession.sparkContext.broadcast(m), len(m.langs)

    def run(batches):
        own, c = shared.value, 0.0
        for b in batches:
            parts, rows = [], []
            for w, n in zip(b.column("w").to_pylist(), b.column("n").to_pylist(), strict=True):
                cut = _parts(w)
                parts.extend(cut), rows.extend([n] * len(cut))
            ends = np.cumsum([len(p) for p in parts]) // FIT_BLOCK
            for x in np.unique(ends):
                at, to = np.searchsorted(ends, x), np.searchsorted(ends, x, side="right")
                c = c + expected(own, parts[at:to], np.array(rows[at:to]))
        if not np.isscalar(c):
            k = np.flatnonzero(c.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(k), *(pa.array(c[k, g]) for g in range(kinds))], names=["k", *(f"c{g}" for g in range(kinds))])

    sums = [F.sum(f"c{g}").alias(f"c{g}") for g in range(kinds)]
    got = words.mapInArrow(run, "k long" + "".join(f", c{g} double" for g in range(kinds))).groupBy("k").agg(*sums).toArrow()
    c = np.zeros_like(m.p)
    c[np.asarray(got.column("k"))] = np.stack([np.asarray(got.column(f"c{g}")) for g in range(kinds)], axis=1)
    return c


def learn(df: DataFrame, vocab: Vocabulary, docs: int = SAMPLE_DOCS) -> Model:
    """A model from df's text and lang, by EM over all words of about ``docs`` distinct texts a language, the least by
    a hash of the text, or of all if there are fewer. Words stay in Spark; the driver gets sums by piece."""
    labelled = df.where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    texts = labelled.select("lang", "h").distinct().groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in texts)
    m = _even(vocab, langs)
    if not langs:
        return m
    # Hashes are uniform: below this one lie about ``docs`` of a language's distinct texts.
    bounds = {r["lang"]: min(2**63 - 1, -(2**63) + 2**64 * docs // r["count"]) for r in texts}
    at = F.element_at(F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for pair in bounds.items() for x in pair]), F.col("lang"))
    sample = labelled.where(F.col("h") <= at).groupBy("lang", "h").agg(F.first("text").alias("text"))
    each = sample.select("lang", F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''")
    count = F.array(*[F.sum((F.col("lang") == g).cast("double")) for g in langs])
    scratch = Scratch(df.sparkSession, "language")
    words = scratch.keep(each.groupBy("w").agg(count.alias("n")), "words")
    if not words.isEmpty():
        _em(m, lambda: _round(m, words))
    scratch.drop(words)
    return m


def identify(df: DataFrame, model: Model, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` (all but the text, by default) with lang_pred and score (their names after ``prefix``, in place of columns of
    those names)."""
    made = (f"{prefix}lang_pred", f"{prefix}score")
    keep = [c for c in df.columns if c not in ("text", *made)] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", {prefix}lang_pred string, {prefix}score double"

    def run(batches):
        m = shared.value
        for b in slices(batches):
            said = m.judge(b.column("_tm_text").to_pylist())
            cols = b.columns[: len(keep)] + [pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *made])

    return df.select(*hidden(df.select(*[f"`{c}`" for c in keep])), F.col("text").alias("_tm_text")).mapInArrow(run, schema)
