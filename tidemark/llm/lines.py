"""Line dedup by content-defined chunks. [native]

A text's lines are hashed; a rolling hash over two line hashes ends a chunk wherever it is less than at the lines
beside, so boundaries depend on a few lines around them, an insertion moves no others, and every chunk but a
text's last has two lines or more. Chunks alone leave the edges of a passage, and short passages between other
lines; so content also bounds windows: for each line with words the least run of two lines or more that begins
with it and has WORDS words, and the least that ends with it. Whatever stands around it, every line of a passage
of WORDS words and two lines or more, but for lines without words at its edges, is in such a window inside it.

A chunk or window that holds a word and occurs anywhere else is kept at its first place (least doc_id, then key,
then line) and removed elsewhere, once its bytes have been compared with the first place's; occurrences that
overlap the first place itself stay. So each line removed stays somewhere: its copies lead to ever earlier places.

Hashes are counted and joined without text; windows that a document shares with one first place at one distance
are merged into runs, and only those are cut out of their texts for the comparison. Hot chunks are counted by
partial sums, and joins can be split. Joins are merges of shuffled sides at every size, so that disk use grows as
the input does. All work on a text is linear in its length.

Null texts stay null; an empty text is one empty line. Rows alike in doc_id and text are one document: all
keep or lose the same lines. Extra columns pass through, but for columns of the results' names, which they replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, Scratch, hidden, once

#: The modulus of the rolling hash; words of a window.
MODULUS, WORDS = 2_147_483_647, 50
_LINES = 1 << 31


def row_key() -> Column:
    return F.unhex(F.md5(F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")))


def _chunks() -> tuple[Column, Column]:
    """(ends of the chunks, given r; chunks of two lines or more that hold a word, given ends and w)."""
    least = lambda i: (F.get("r", i - 1) < F.get("r", i - 2)) & (F.get("r", i - 1) <= F.get("r", i))
    last = F.size("r")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | F.coalesce(least(i), F.lit(False)))
    before = lambda k: F.coalesce(F.get("ends", k - 1), F.lit(0))
    spans = F.transform("ends", lambda e, k: F.struct((before(k) + 1).alias("start"), (e - before(k)).alias("size")))
    wordy = lambda s: F.exists(F.slice("w", s["start"], s["size"]), lambda n: n > 0)
    return ends, F.filter(spans, lambda s: (s["size"] >= 2) & wordy(s))


def _windows() -> tuple[Column, Column]:
    """(for each word 4 * its line from 0, + 1 if it is the line's first, + 2 if it is its last; the windows, given
    these as m, and w)."""
    mark = lambda n, i: F.transform(F.sequence(F.lit(1), n), lambda k: i * 4 + (k == 1).cast("int") + (k == n).cast("int") * 2)
    marks = F.flatten(F.transform("w", lambda n, i: F.when(n > 0, mark(n, i)).otherwise(F.array().cast("array<int>"))))
    line = lambda v: F.shiftright(v, 2) + 1
    span = lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("size"))
    ahead = lambda v, p: F.when(v.bitwiseAND(1) == 1, span(line(v), F.greatest(line(F.get("m", p + WORDS - 1)), line(v) + 1)))
    back = lambda v, p: F.when(v.bitwiseAND(2) == 2, span(F.least(line(F.get("m", p - WORDS + 1)), line(v) - 1), line(v)))
    reached = lambda f, p: F.transform("m", lambda v, i: F.when(F.get("m", p(i)).isNotNull(), f(v, i)))
    both = F.concat(reached(ahead, lambda i: i + WORDS - 1), reached(back, lambda i: i - WORDS + 1))
    return marks, F.filter(both, lambda s: s.isNotNull() & (s["start"] >= 1) & (s["start"] + s["size"] - 1 <= F.size("w")))


def line_chunks(df: DataFrame) -> DataFrame:
    """(doc_id, rk, start, size, h) for each chunk and window of doc_id and text; start counts lines from 1."""
    ends, chunks = _chunks()
    marks, windows = _windows()
    split = df.where("text is not null").select("doc_id", row_key().alias("rk"), once(F.split("text", "\n", -1), "lines"))
    hashed = split.select("*", once(F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")), "g"))
    counted = hashed.select("doc_id", "rk", "g", once(F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD))), "w"))
    line = lambda i: F.coalesce(F.get("g", i), F.lit(0).cast("long")) % MODULUS
    roll = F.transform(F.sequence(F.lit(0), F.size("g") - 1), lambda i: (line(i) * 31 + line(i - 1)) % MODULUS)
    cut = counted.select("*", once(roll, "r")).select("doc_id", "rk", "g", "w", once(ends, "ends"))
    told = cut.select("*", once(marks, "m")).select("doc_id", "rk", "g", once(F.concat(chunks, windows), "spans"))
    # As numbers, since Spark compares structs pair by pair to tell them apart.
    told = told.select("doc_id", "rk", "g", once(F.array_distinct(F.transform("spans", lambda s: s["start"].cast("long") * _LINES + s["size"])), "codes"))
    start, size = lambda c: F.shiftright(c, 31).cast("int"), lambda c: (c % _LINES).cast("int")
    whole = F.transform("codes", lambda c: F.struct(start(c).alias("start"), size(c).alias("size"), F.xxhash64(F.slice("g", start(c), size(c))).alias("h")))
    return told.select("doc_id", "rk", F.inline(whole))


def repeated_spans(df: DataFrame, scratch: Scratch) -> DataFrame:
    """(rk, cut: array of (start, size)): the runs of lines each document loses."""
    df = df.select("doc_id", "text")
    found = scratch.keep(line_chunks(df), "found")
    place = F.struct("doc_id", "rk", "start")
    many = found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "first")
    again = found.join(many.hint("merge"), "h").select("rk", F.col("first.rk").alias("frk"), (F.col("start") - F.col("first.start")).alias("shift"), "start", "size")
    again = again.where((F.col("rk") != F.col("frk")) | (F.col("shift") >= F.col("size")))
    by = Window.partitionBy("rk", "frk", "shift").orderBy("start", "size")
    after = F.col("start") + F.col("size")
    upto = F.max(after).over(by.rowsBetween(Window.unboundedPreceding, -1))
    again = again.withColumn("new", (upto.isNull() | (F.col("start") > upto)).cast("int")).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = again.groupBy("rk", "frk", "shift", "run").agg(F.min("start").alias("start"), F.max(after).alias("after"))
    runs = scratch.keep(runs.select("rk", "frk", (F.col("start") - F.col("shift")).alias("fstart"), "start", (F.col("after") - F.col("start")).alias("size")), "runs")
    scratch.drop(found)
    own = runs.select("rk", "start", "size").union(runs.select("frk", "fstart", "size")).groupBy("rk").agg(F.collect_set(F.struct("start", "size")).alias("own"))
    texts = df.withColumn("rk", row_key()).join(own.hint("merge"), "rk").select("rk", "own", once(F.split("text", "\n", -1), "lines"))
    chunk = lambda o: F.array_join(F.slice("lines", o["start"], o["size"]), "\n")
    texts = texts.select("rk", F.inline(F.transform("own", lambda o: F.struct(o["start"].alias("start"), o["size"].alias("size"), chunk(o).alias("chunk")))))
    texts = scratch.keep(texts.dropDuplicates(["rk", "start", "size"]), "texts")
    first = texts.select(F.col("rk").alias("frk"), F.col("start").alias("fstart"), "size", F.col("chunk").alias("kept"))
    same = runs.hint("merge").join(texts, ["rk", "start", "size"]).hint("merge").join(first, ["frk", "fstart", "size"]).where("chunk = kept")
    return same.groupBy("rk").agg(F.collect_set(F.struct("start", "size")).alias("cut"))


def dedup_lines(df: DataFrame, prefix: str = "") -> DataFrame:
    """df with its text less the repeated chunks, and n_lines and n_removed (their names after ``prefix``)."""
    scratch = Scratch(df.sparkSession, "lines")
    cuts = scratch.keep(repeated_spans(df, scratch), "cuts")
    rows = df.select(*hidden(df), F.col("text").alias("_tm_text"), row_key().alias("rk")).join(cuts.hint("merge"), "rk", "left")
    text, own = F.col("_tm_text"), [f"_tm_c{i}" for i, c in enumerate(df.columns) if c != "text"]
    split = rows.select(*own, "_tm_text", "cut", once(F.split(text, "\n", -1), "lines"))
    gone = F.flatten(F.transform("cut", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    stay = F.array_except(F.sequence(F.lit(1), F.size("lines")), gone)
    left = once(F.when(F.col("cut").isNotNull(), F.transform(stay, lambda i: F.get("lines", i - 1))), "left")
    told = split.select(*own, "_tm_text", "lines", left)
    lines = F.when(text.isNull(), 0).otherwise(F.size("lines"))
    removed = F.when(F.col("left").isNull(), 0).otherwise(lines - F.size("left"))
    new = F.when(F.col("left").isNull(), text).otherwise(F.array_join("left", "\n"))
    made = (f"{prefix}n_lines", f"{prefix}n_removed")
    cols = [new.alias("text") if c == "text" else F.col(f"_tm_c{i}").alias(c) for i, c in enumerate(df.columns) if c not in made]
    return told.select(*cols, lines.cast("long").alias(f"{prefix}n_lines"), removed.cast("long").alias(f"{prefix}n_removed"))
