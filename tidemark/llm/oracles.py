"""DuckDB SQL for the queries that SQL can express.

Not here: op1 (a keyed permutation and CRC-32), op3 and op4 (models), op5 (approximate): tests hold these
against brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

from tidemark.llm import licenses, lines, urls

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

_OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(text, '{_UP}', '{_LOW}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
r(doc_id, dst) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.dst),
m AS (SELECT doc_id, min(dst) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)
"""

_OP7 = rf"""
WITH d AS (SELECT doc_id, text, source, len({_WORDS.format("text")})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS i FROM w),
a AS (SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce((sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS lft,
      sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wt FROM o),
k AS (SELECT min_by(lft / wt, i) AS rate FROM a WHERE lft / wt <= cap / w),
t AS (SELECT source, source_size, CASE WHEN rate IS NULL THEN cap ELSE least(cap, w * rate) END AS target FROM a, k),
f AS (SELECT *, floor(target)::BIGINT // greatest(1, source_size) AS whole, floor(target)::BIGINT % greatest(1, source_size) AS rest FROM t),
u AS (SELECT d.*, f.source_size, f.target, f.whole, f.rest,
      sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat('0|', coalesce(doc_id::VARCHAR, ''), '|', coalesce(text, ''))), size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN 2 * upto - size <= 2 * rest AND rest > 0 THEN 1 ELSE 0 END))::BIGINT AS taken FROM u
"""

_OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS MATERIALIZED (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, dst) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.dst),
m AS (SELECT vec_id, min(dst) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, m.vec_id = m.component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""

_M = lines.MODULUS
_OP9 = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
h AS (SELECT doc_id, l, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT % {_M}) AS h FROM d WHERE text IS NOT NULL),
r AS (SELECT doc_id, l, list_transform(range(1, len(l) + 1), lambda i: (h[i] * 31 + coalesce(h[i - 1], 0)) % {_M}) AS r FROM h),
e AS (SELECT doc_id, l, unnest(list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR coalesce(i > 1 AND r[i] < r[i - 1] AND r[i] <= r[i + 1], false))) AS e FROM r),
b AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY e), 0) AS b FROM e),
t0 AS (SELECT doc_id, len(l) AS n, unnest(range(1, len(l) + 1)) AS i, unnest(list_transform(l, lambda x: len({_WORDS.format("x")}))) AS w FROM h),
t AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM t0),
s AS (SELECT doc_id, b + 1 AS start, e AS stop FROM b WHERE e - b >= 2 AND regexp_matches(array_to_string(l[b + 1:e], ' '), '[^\x20\x09-\x0D]')
      UNION SELECT x.doc_id, x.i, greatest(min(y.i), x.i + 1) FROM t x JOIN t y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.c >= x.c - x.w + {lines.WORDS}
            WHERE x.w > 0 GROUP BY x.doc_id, x.i, x.n HAVING greatest(min(y.i), x.i + 1) <= x.n
      UNION SELECT x.doc_id, least(max(y.i), x.i - 1), x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND y.i <= x.i AND y.c - y.w <= x.c - {lines.WORDS}
            WHERE x.w > 0 AND x.i > 1 GROUP BY x.doc_id, x.i),
c AS (SELECT s.doc_id, start, stop, array_to_string(l[start:stop], chr(10)) AS c FROM s JOIN d ON s.doc_id = d.doc_id),
p AS (SELECT doc_id, start, stop, first_value(doc_id) OVER f AS fd, first_value(start) OVER f AS fs FROM c WINDOW f AS (PARTITION BY c ORDER BY doc_id, start)),
g AS (SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS i FROM p WHERE NOT (doc_id = fd AND start <= fs + stop - start)),
x AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  md5(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(l, lambda y, i: NOT list_contains(gone, i)), chr(10)), '') END) AS text_md5
FROM d LEFT JOIN x USING (doc_id)
"""


def _op6(rules: list[tuple[str, str, str]]) -> str:
    cases = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fit = lambda r: f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    rule, verdict = (" ".join(f"{fit(r)} THEN '{f(r)}'" for r in cases) for f in (lambda r: r[1] + r[2], lambda r: r[0]))
    depth, ctes, at = 8, [], "t0"  # more segments than any path of the test tables has; the operator has no such bound
    for k in range(1, depth + 1):
        by = f"PARTITION BY host, g[1:{k - 1}], len(g) >= {k}"
        many = f"len(list(DISTINCT g[{k}]) OVER ({by}))"
        ctes.append(f"w{k} AS (SELECT *, len(g) >= {k} AND {many} > {urls.MANY} AND 2 * {many} > sum(n) OVER ({by}) AS w FROM {at})")
        ctes.append(f"v{k} AS (SELECT host, t, n, lab, bad, CASE WHEN w THEN g[1:{k - 1}] || ['*'] || g[{k + 1}:] ELSE g END AS g FROM w{k})")
        at = f"v{k}"
    ctes.append(f"m0 AS (SELECT *, false AS kept FROM {at})")
    at = "m0"
    for k in range(depth, 0, -1):
        level = f"(NOT kept AND len(g) = {k})"
        own, whole = "PARTITION BY host, g, kept", f"PARTITION BY host, g[1:{k - 1}], {level}"
        sums = ", ".join(f"(sum({c}) OVER ({o}))::DOUBLE AS {x}" for c, o, x in (("lab", own, "n1"), ("bad", own, "b1"), ("lab", whole, "nn"), ("bad", whole, "bb")))
        gap = "(b1 * (nn - n1) - (bb - b1) * n1)"
        ctes.append(f"s{k} AS (SELECT *, {sums} FROM {at})")
        ctes.append(f"q{k} AS (SELECT * EXCLUDE (kept), {level} AS lv, kept OR ({level} AND 100 * {gap} * {gap} * nn > {urls.CHI2} * n1 * (nn - n1) * bb * (nn - bb)) AS kept FROM s{k})")
        ctes.append(f"m{k} AS (SELECT host, t, n, lab, bad, kept, CASE WHEN NOT kept AND len(g) = {k} THEN g[1:{k - 1}] ELSE g END AS g FROM q{k})")
        at = f"m{k}"
    part = lambda rx: f"coalesce(regexp_extract(url, '{rx}', 1), '')"
    segs = "string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '#', 'g'), '/')"
    return f"""
WITH lab0 AS (SELECT doc_id, bool_or(toxic = 1 OR quality = 0) AS bad FROM labels GROUP BY doc_id),
p0 AS (SELECT page_id, translate({part("(?s)^.*?://([^/?#]*)")}, '{_UP}', '{_LOW}') AS host, {part("(?s)^.*?://[^/?#]*([^?#]*)")} AS path FROM pages),
p AS (SELECT p0.*, lab0.bad, {segs} AS t
      FROM p0 LEFT JOIN lab0 ON lab0.doc_id = try_cast(nullif(regexp_extract(path, '([0-9]+)', 1), '') AS BIGINT)),
t0 AS (SELECT host, t, t AS g, count(*) AS n, count(bad) AS lab, coalesce(sum(bad::BIGINT), 0) AS bad FROM p GROUP BY host, t),
{", ".join(ctes)},
a AS (SELECT sum(lab) AS alllab, sum(bad) AS allbad FROM t0),
z AS (SELECT host, g, 2 * (sum(bad) * any_value(alllab) + {urls.ALPHA} * any_value(allbad)) > (sum(lab) + {urls.ALPHA}) * any_value(alllab) AS block FROM {at}, a GROUP BY host, g),
y AS (SELECT m.host, m.t, m.g, z.block FROM {at} m JOIN z ON m.host = z.host AND m.g = z.g)
SELECT page_id, p.host, path, CASE {rule} END AS rule, coalesce(CASE {verdict} END, CASE WHEN block THEN 'block' ELSE 'allow' END) AS verdict,
  '/' || array_to_string(y.g, '/') AS template
FROM (SELECT * FROM p) p JOIN y ON p.host = y.host AND p.t = y.t
""".replace("CASE WHEN (host", "CASE WHEN (p.host").replace("OR ends_with(host", "OR ends_with(p.host").replace("WHEN (host", "WHEN (p.host")


def _op10() -> str:
    words = lambda x: rf"list_filter(string_split_regex(translate({x}, '{_UP}', '{_LOW}'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    k = licenses.SHINGLE
    cut = f"CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) ELSE [] END"
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.TEMPLATES.items())
    return f"""
WITH lib0 AS (SELECT name, {words("t")} AS w FROM (VALUES {values}) v(name, t)),
lib AS (SELECT name, list_distinct({cut}) AS ts FROM lib0),
c AS MATERIALIZED (SELECT name, ts, greatest(4, CASE WHEN len(ts) <= 1 THEN 1 ELSE (2 ** ceil(log2(len(ts))))::BIGINT END) AS c FROM lib WHERE len(ts) > 0),
d0 AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
d AS (SELECT doc_id, {cut} AS hs FROM d0),
o AS MATERIALIZED (SELECT * FROM d WHERE list_has_any(hs, (SELECT flatten(list(ts)) FROM c))),
win AS (SELECT doc_id, k.c, hs, unnest(range(1, len(hs) + 1, k.c)) AS s FROM o, (SELECT DISTINCT c FROM c) k),
hit AS (SELECT DISTINCT doc_id, name FROM win JOIN c ON win.c = c.c WHERE 100 * len(list_intersect(hs[s:s + 2 * win.c - 1], ts)) >= {licenses.SHARE} * len(ts)),
g AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM hit GROUP BY doc_id)
SELECT documents.doc_id, coalesce(g.n, 0)::BIGINT AS n_licenses, coalesce(g.names, '') AS licenses FROM documents LEFT JOIN g USING (doc_id)
"""


def sql(rules: list[tuple[str, str, str]]) -> dict[str, str]:
    return {"op2_minhash_dedup": _OP2, "op6_url_filter": _op6(rules), "op7_mixing": _OP7, "op8_embedding_dedup": _OP8, "op9_line_dedup": _OP9, "op10_license_scan": _op10()}
