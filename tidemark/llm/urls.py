"""URL filters: suffix rules first, then a path-template tree judged by labelled purity. [native]

Per host, digits in path segments become ``#`` and a segment with nearly as many values as pages becomes ``*``,
from the root down. A template that no other one follows any further ends there. From the leaves up, a template
whose labelled bad share does not differ from that of its siblings (two-proportion chi-square) merges into their
parent; one that differs stands alone. A group is blocked if its bad share, smoothed towards the global share,
passes a half. Only template counts are joined and grouped, never pages; pages get their verdict by a join on
(host, template). Levels go on until no two templates of a host share a longer prefix; each is summed by groups
and written, so neither a host nor a plan grows beyond a task.

A null url, or one without ``://``, has empty host and path and is judged as that host's one template.
Repeated urls are judged alike. Without labels everything that no rule blocks is allowed. Extra columns pass
through; columns named host, path, rule, template or verdict are replaced.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, hidden, shown

MANY = 20
ALPHA = 4
#: 95 % point of chi-square with one degree of freedom, times 100.
CHI2 = 384


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda rx: F.coalesce(F.regexp_extract(url, rx, 1), F.lit(""))
    host = F.translate(part(r"(?s)^.*?://([^/?#]*)"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, part(r"(?s)^.*?://[^/?#]*([^?#]*)")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits. ``rules``: (verdict, host, path); the longest that fits wins."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical_template(path: Column) -> Column:
    """Array of segments."""
    return F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "#"), "/", -1)


def _head(k: int) -> Column:
    return F.slice("g", 1, k)


_all = functools.partial(functools.reduce, DataFrame.unionAll)


def _generalised(scratch: Scratch, counts: DataFrame) -> tuple[DataFrame, int]:
    """((host, t, g, lab, bad): t with wildcards, as far as another template follows it; the most segments of g)."""
    live, ended, k = counts.withColumn("g", F.col("t")), [], 0
    while not k or not live.isEmpty():
        k += 1
        values = live.groupBy("host", _head(k - 1).alias("p"), F.get("g", F.lit(k - 1)).alias("v")).agg(F.sum("n").alias("n"))
        wild = values.groupBy("host", "p").agg(F.count("*").alias("d"), F.sum("n").alias("n")).where((F.col("d") > MANY) & (2 * F.col("d") > F.col("n")))
        here = live.withColumn("p", _head(k - 1)).join(wild.select("host", "p", F.lit(True).alias("wild")), ["host", "p"], "left")
        star = F.concat("p", F.array(F.lit("*")), F.slice("g", k + 1, F.size("g")))
        here = here.withColumn("g", F.when(F.col("wild"), star).otherwise(F.col("g"))).withColumn("p", _head(k)).drop("wild")
        here = scratch.keep(here, "level")
        alone = here.groupBy("host", "p").agg(F.count("*").alias("c"))
        told = scratch.keep(here.join(alone, ["host", "p"]).withColumn("ends", (F.col("c") == 1) | (F.size("g") == k)).drop("p", "c"), "level")
        ended.append(told.where("ends").select("host", "t", _head(k).alias("g"), "lab", "bad"))
        live = told.where("not ends").drop("ends")
    return _all(ended), k


def template_groups(scratch: Scratch, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of counts (host, t array, n, lab, bad; one row each): ((host, t, g): the group each template belongs to;
    (host, g, lab, bad) of each group)."""
    tree, depth = _generalised(scratch, counts)
    tree, kept, up = scratch.keep(tree, "tree"), [], None
    for k in range(depth, 0, -1):
        own = tree.where(F.size("g") == k).select("host", "g", "lab", "bad")
        own = (own if up is None else own.unionAll(up)).groupBy("host", "g").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
        own = scratch.keep(own.withColumn("p", _head(k - 1)), "own")
        whole = own.groupBy("host", "p").agg(F.sum("lab").cast("double").alias("nn"), F.sum("bad").cast("double").alias("bb"))
        n1, b1 = F.col("lab").cast("double"), F.col("bad").cast("double")
        n2, b2 = F.col("nn") - n1, F.col("bb") - b1
        gap = b1 * n2 - b2 * n1
        differs = 100 * gap * gap * F.col("nn") > CHI2 * n1 * n2 * F.col("bb") * (F.col("nn") - F.col("bb"))
        judged = own.join(whole, ["host", "p"]).withColumn("differs", differs)
        kept.append(judged.where("differs").select("host", "g", "lab", "bad"))
        up = judged.where("not differs").select("host", F.col("p").alias("g"), "lab", "bad")
    root = up.groupBy("host", "g").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    alone = scratch.keep(_all(kept), "kept")
    heads = tree.select("host", "t", "g", F.explode(F.sequence(F.lit(1), F.size("g"))).alias("k")).select("host", "t", "k", F.slice("g", F.lit(1), F.col("k")).alias("g"))
    deepest = heads.join(alone.select("host", "g"), ["host", "g"]).groupBy("host", "t").agg(F.max_by("g", "k").alias("g"))
    of = tree.select("host", "t").join(deepest, ["host", "t"], "left").withColumn("g", F.coalesce("g", F.array().cast("array<string>")))
    return of, alone.unionAll(root)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages (url and a nullable boolean ``bad`` label) with host, path, rule, template and verdict."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(*hidden(pages), F.col("bad").alias("_bad"), host.alias("host"), path.alias("path")).withColumn("t", lexical_template(F.col("path")))
    lab = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0).cast("long")))
    counts = scratch.keep(rows.groupBy("host", "t").agg(F.count("*").alias("n"), F.count("_bad").alias("lab"), lab(F.col("_bad")).alias("bad")), "counts")
    of, groups = template_groups(scratch, counts)
    all_lab, all_bad = (x or 0 for x in counts.agg(F.sum("lab"), F.sum("bad")).first())
    block = 2 * (F.col("bad") * all_lab + ALPHA * all_bad) > (F.col("lab") + ALPHA) * all_lab
    verdicts = of.join(groups.select("host", "g", block.alias("block")), ["host", "g"])
    verdicts = scratch.keep(verdicts.select("host", "t", F.concat(F.lit("/"), F.array_join("g", "/")).alias("template"), "block"), "verdicts")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.join(verdicts, ["host", "t"], "left").withColumn("rule", rule)
    out = out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("block"), "block").otherwise("allow")))
    made = ("host", "path", "rule", "template", "verdict")
    return out.select(*shown(pages, made), *made)
