"""One query for each operator over pairs of the test tables, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import addresses, align, attribute, chunks, lookup, maps, match, predict, reloc, runs, vote
from tidemark.plans import strategies, versions
from tidemark.plans.pairs import CELLS, MAPS, MARKS, NEW, OLD, POINTS, PROBES, RANGES, RUNS, UNITS, VOTES, frame, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
S = ["section"]


def query(*inputs: str, oracle: str | None = None):
    """Registers a function of frames under its name; ``inputs`` are their SQL."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[frame(spark, sf_dir, i) for i in inputs])
        if oracle:
            SQL[f.__name__] = sql(oracle)
        return f

    return put


_NAMES = "select p_partkey, concat(p_name, '.func', p_partkey % 7, '.deferwrap', p_size) as name from {part}"


@query(_NAMES, oracle=f"select p_partkey, regexp_replace(regexp_replace(name, '\\.func[0-9]+', '.func#', 'g'), '\\.deferwrap[0-9]+', '.deferwrap#', 'g') as key from ({_NAMES})")
def normalize_key(names):
    return names.select("p_partkey", keys.normalize_key(F.col("name")).alias("key"))


@query("select doc_id, text from {documents}", oracle="select doc_id, md5(regexp_replace(text, '[0-9]+', '#', 'g')) as hash from {documents}")
def masked_content_hash(docs):
    return docs.select("doc_id", keys.masked_hash(F.col("text")).alias("hash"))


_STAGES = """with d as (select doc_id as id, doc_id as ord, md5(text) as k1, md5(regexp_replace(text, '[^A-Za-z]+', '', 'g')) as k2, md5(regexp_replace(text, '[0-9]+', '#', 'g')) as k3 from {documents}),
o0 as (select * from d where id % 2 = 0), n0 as (select * from d where id % 2 = 1),
m1 as (select n.id as new_id, o.id as old_id, 'exact' as stage from (select *, row_number() over (partition by k1 order by ord) r from o0) o join (select *, row_number() over (partition by k1 order by ord) r from n0) n on o.k1 = n.k1 and o.r = n.r),
o1 as (select * from o0 where id not in (select old_id from m1)), n1 as (select * from n0 where id not in (select new_id from m1)),
m2 as (select n.id as new_id, o.id as old_id, 'normalised' as stage from (select *, row_number() over (partition by k2 order by ord) r from o1) o join (select *, row_number() over (partition by k2 order by ord) r from n1) n on o.k2 = n.k2 and o.r = n.r),
o2 as (select * from o1 where id not in (select old_id from m2)), n2 as (select * from n1 where id not in (select new_id from m2)),
m3 as (select n.id as new_id, o.id as old_id, 'content' as stage from (select *, row_number() over (partition by k3 order by ord) r from o2) o join (select *, row_number() over (partition by k3 order by ord) r from n2) n on o.k3 = n.k3 and o.r = n.r)
select * from m1 union all select * from m2 union all select * from m3"""


@query("select doc_id, text from {documents}", oracle=_STAGES)
def staged_match(docs):
    text = F.col("text")
    d = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.md5(text).alias("k1"), F.md5(F.regexp_replace(text, "[^A-Za-z]+", "")).alias("k2"), keys.masked_hash(text).alias("k3"))
    return match.staged_match(d.where("id % 2 = 0"), d.where("id % 2 = 1"), [("exact", "k1"), ("normalised", "k2"), ("content", "k3")])


_PART = "select p_partkey, p_name, p_brand, p_type, p_size from {part}"
_BEST = f"""with p as ({_PART}), n as (select *, unnest([p_name, p_brand]) as name, unnest([0, 1]) as name_ord from p where p_partkey % 2 = 1),
o as (select *, unnest([p_name, p_brand]) as name from p where p_partkey % 2 = 0),
c as (select n.p_partkey as new_id, o.p_partkey as old_id, name_ord, case when n.p_name = o.p_name and n.p_brand = o.p_brand and n.p_size = o.p_size then 3 when n.p_type = o.p_type and n.p_size = o.p_size then 2 when n.p_size = o.p_size then 1 else 0 end as score, abs(n.p_partkey - o.p_partkey) as near from n join o using (name)),
r as (select *, row_number() over (partition by new_id order by score desc, near, name_ord, old_id) as r from c)
select new_id, old_id, score, score >= 2 as copy from r where r = 1"""


@query(_PART, oracle=_BEST)
def best_candidate_match(part):
    side = lambda r: part.where(f"p_partkey % 2 = {r}").select(F.col("p_partkey").alias("id"), *[F.col(f"p_{c}").alias(c) for c in ("brand", "type", "size")], F.col("p_name").alias("pname"), F.array("p_name", "p_brand").alias("names"))
    return match.best_candidate_match(side(0), side(1), [(3, ["pname", "brand", "size"]), (2, ["type", "size"]), (1, ["size"]), (0, [])])


@query("select l_orderkey as o, l_suppkey as n from {lineitem}", oracle="select l_orderkey as o, min(l_suppkey) as n from {lineitem} group by 1 having min(l_suppkey) = max(l_suppkey)")
def unambiguous_pairs(pairs):
    return match.unambiguous_pairs(pairs)


_PROJ = f"select section, ord, case when ord % 4 = 0 then src else dst end as slot, src_size * 10 as addend from ({UNITS}) u"
_SLOTS = f"select section, ord, dst as slot from ({UNITS}) u"


@query(_PROJ, _SLOTS, oracle=f"with p as ({_PROJ}), k as (select section, slot, min_by(addend, ord) as a from p group by 1, 2) select s.section, s.ord, s.slot, coalesce(k.a, p.addend, 0) as addend from ({_SLOTS}) s left join k on k.section = s.section and k.slot = s.slot left join p on p.section = s.section and p.ord = s.ord")
def join_with_positional_fallback(projected, slots):
    return match.join_with_positional_fallback(projected, slots, S)


_PAIRS = f"select section, id as ord, cents % 1000 as j from ({OLD}) o"


@query(_PAIRS, oracle=f"select section, ord, j from (select *, max(j) over (partition by section order by ord rows between unbounded preceding and 1 preceding) as m from ({_PAIRS})) where j > coalesce(m, -1)")
def monotone_pair_filter(pairs):
    return match.monotone_pairs(pairs, S)


_DERIVED, _TRUE = "select o_orderkey as v from {orders}", "select case when o_orderkey % 7 = 0 then -o_orderkey else o_orderkey end as v from {orders}"


@query(_DERIVED, _TRUE, oracle=f"select distinct v, 'missing' as kind from ({_TRUE}) where v not in ({_DERIVED}) union all select distinct v, 'suppressed' from ({_DERIVED}) where v not in ({_TRUE})")
def enumeration_repair(derived, true):
    return match.enumeration_repair(derived, true)


@query(_DERIVED, _TRUE, oracle=f"select (select count(distinct v) from ({_TRUE})) as n_true, (select count(distinct v) from ({_DERIVED})) as n_derived, (select count(distinct v) from ({_TRUE}) where v in ({_DERIVED})) as n_both")
def enumeration_coverage(derived, true):
    return match.enumeration_coverage(derived, true)


@query("select l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity from {lineitem}", oracle="select l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, rank from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity) as rank from (select l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity from {lineitem})) where rank <= 8")
def capped_candidates(rows):
    return match.capped_candidates(rows, ["l_partkey"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")], 8)


_LOOK = "left join m on m.section = p.section and p.addr >= m.src and p.addr < m.src + m.src_size"


@query(PROBES, MAPS, oracle=f"with p as ({PROBES}), m as ({MAPS}) select p.*, case when addr - src < dst_size then dst + addr - src end as target from p {_LOOK}")
def interval_lookup(probes, maps):
    return lookup.interval_lookup(probes, maps, S)


@query(PROBES, POINTS, MAPS, RANGES, oracle=f"""with p as ({PROBES}), m as ({MAPS}), t as ({POINTS}), g as ({RANGES}),
x as (select p.*, t.new as a, case when p.addr - m.src < m.dst_size then m.dst + p.addr - m.src end as b, g.new + p.addr - g.old as c from p
 left join t on t.section = p.section and t.old = p.addr {_LOOK} left join g on g.section = p.section and p.addr >= g.old and p.addr < g.old + g.size)
select section, event_id, addr, coalesce(a, b, c) as target, case when a is not null then 'point' when b is not null then 'map' when c is not null then 'range' else 'none' end as via from x""")
def lookup_cascade(probes, points, maps, ranges):
    return lookup.lookup_cascade(probes, points, maps, ranges, S)


@query(PROBES, MARKS, oracle=f"with p as ({PROBES}), m as ({MARKS}) select p.*, p.addr + coalesce(m.delta, 0) as mapped from p asof left join m on m.section = p.section and p.addr >= m.off")
def asof_shift(probes, marks):
    return lookup.asof_shift(probes, marks, S)


_PROJECT = f"select p.*, cast(30000 as bigint) as old_len, cast(29000 as bigint) as new_len from ({PROBES}) p"


@query(_PROJECT, RUNS, oracle=f"""with p as ({_PROJECT}), r as ({RUNS}),
b as (select p.*, r.src as bs, r.dst as bd, r.n as bn from p asof left join r on r.section = p.section and p.addr >= r.src),
f as (select b.*, r.src as fs, r.dst as fd from b asof left join r on r.section = b.section and b.addr < r.src)
select section, event_id, addr, old_len, new_len, case when addr < old_len then greatest(0, least(new_len - 1, addr + case when bs is not null and (addr < bs + bn or fs is null or addr - bs - bn < fs - addr) then bd - bs else fd - fs end)) end as projected from f""")
def nearest_run_project(probes, runs_):
    return lookup.nearest_run_project(probes, runs_, S)


_SECTIONS = "select i as section, concat('s', j) as name, j * 10000 + 50 as old_lo, (j + 1) * 10000 - 70 as old_hi, j * 10000 as new_lo, (j + 1) * 10000 - 10 as new_hi from (select distinct cast(o_custkey % 16 as bigint) as i from {orders}) a, (select distinct cast(o_custkey % 4 as bigint) as j from {orders}) b"


@query(RUNS, _SECTIONS, oracle=f"""with r as ({RUNS}), s as ({_SECTIONS}), x as (select r.section, name, src, dst, greatest(src, old_lo, new_lo - dst + src) as lo, least(src + n, old_hi, new_hi - dst + src) as hi from r join s on r.section = s.section)
select section, name, lo as src, dst + lo - src as dst, hi - lo as n from x where hi > lo""")
def clip_runs(runs_, sections):
    return lookup.clip_runs(runs_, sections, S)


_BODIES = f"select section, src as start, case when id % 4 = 0 then src_size else src_size - 3 end as size from ({UNITS}) u"
_TOTALS = f"select section, cast(max(src + src_size) as bigint) as total from ({UNITS}) u group by section"


@query(_BODIES, _TOTALS, oracle=f"""with b as ({_BODIES}), e as (select * from b union all select section, total, 0 from ({_TOTALS})),
g as (select *, coalesce(lag(start + size) over (partition by section order by start), 0) as f from e)
select section, start, size, 'body' as kind from b union all select section, f, start - f, 'gap' from g where start > f""")
def gap_fill_spans(bodies, sizes):
    return lookup.gap_fill_spans(bodies, sizes, S)


_REFS = "select user_id % 16 as section, event_id as ref_id, (event_id * 101) % 30000 as start, (event_id * 101) % 30000 + event_id % 9 as field, cast(4 as bigint) as width, (event_id * 211) % 30000 as target from {events}"


@query(_REFS, RUNS, POINTS, MAPS, RANGES, oracle=f"""with p as ({_REFS}), r as ({RUNS}), m as ({MAPS}), t as ({POINTS}), g as ({RANGES}),
k as (select p.section, ref_id, start, field, width, target as addr, r.dst + start - r.src as new_start from p join r on r.section = p.section and start >= r.src and field + width - 1 < r.src + r.n),
x as (select p.*, t.new as a, case when p.addr - m.src < m.dst_size then m.dst + p.addr - m.src end as b, g.new + p.addr - g.old as c from k p
 left join t on t.section = p.section and t.old = p.addr {_LOOK} left join g on g.section = p.section and p.addr >= g.old and p.addr < g.old + g.size)
select section, ref_id, start, field, width, addr as old_target, new_start, coalesce(a, b, c) as new_target, case when a is not null then 'point' when b is not null then 'map' when c is not null then 'range' else 'none' end as via from x""")
def reference_retarget(refs, runs_, points, maps, ranges):
    return lookup.reference_retarget(refs, runs_, points, maps, ranges, S)


_MAJ = f"v as ({VOTES}), c as (select o, n, count(*) as c from v group by 1, 2), w as (select *, row_number() over (partition by o order by c desc, n) as r, cast(sum(c) over (partition by o) as bigint) as total from c)"


@query(VOTES, oracle=f"with {_MAJ} select o, n, c as count, total from w where r = 1")
def majority_vote(votes):
    return vote.majority_vote(votes)


@query(VOTES, "select p_partkey as o, p_partkey % 7 as pred from {part}", oracle=f"with {_MAJ} select o, n from w join {{part}} on p_partkey = o where r = 1 and n <> p_partkey % 7 and c >= 2 and 2 * c > total")
def vote_overrides(votes, predicted):
    return vote.vote_overrides(votes, predicted)


_MODES = "(select {0} from {{part}} group by 1 order by count(*) desc, 1 limit 1) as {0}"


@query("select p_brand, p_type, p_size from {part}", oracle="select " + ", ".join(_MODES.format(c) for c in ("p_brand", "p_type", "p_size")))
def modal_template(part):
    return vote.modal_template(part, ["p_brand", "p_type", "p_size"])


_LEARN, _WANT = "select case when p_partkey % 3 = 0 then p_name else p_brand end as k, p_size as v from {part}", "select p_partkey, case when p_partkey % 5 = 0 then 'other' else p_name end as k from {part}"


@query(_LEARN, _WANT, oracle=f"with l as ({_LEARN}), m as (select k, v from (select k, v, row_number() over (partition by k order by count(*) desc, v) as r from l group by 1, 2) where r = 1) select w.p_partkey, w.k, coalesce(m.v, (select v from l group by 1 order by count(*) desc, v limit 1)) as v from ({_WANT}) w left join m on m.k = w.k")
def modal_by_key_with_default(rows, wanted):
    return vote.modal_by_key_with_default(rows, wanted, "k", "v").select("p_partkey", "k", "v")


_SYMBOLS = "select o_custkey % 16 as section, o_orderkey div 3 * 8 as addr, 4 + o_orderkey % 9 as size, o_orderpriority as name from {orders}"
_SYMBOLS = _SYMBOLS.replace("o_orderkey div 3", "(o_orderkey - o_orderkey % 3)")


@query(_SYMBOLS, oracle=f"with u as (select section, addr, max(size) as size, string_agg(distinct name, ',' order by name) as names from ({_SYMBOLS}) group by 1, 2), c as (select section, addr, least(size, coalesce(lead(addr) over (partition by section order by addr) - addr, size)) as size, names from u) select * from c where size > 0")
def group_and_clip(symbols):
    return vote.group_and_clip(symbols, S)


@query("select l_shipdate, l_returnflag, l_linestatus, l_quantity, l_discount, l_tax from {lineitem}", oracle="select l_returnflag, l_linestatus, cast(count(*) filter (l_quantity > 20) as bigint) as first_wrong, cast(count(*) filter (l_discount > 0.05) as bigint) as second_wrong, case when count(*) filter (l_discount > 0.05) < count(*) filter (l_quantity > 20) then 'second' else 'first' end as chosen from {lineitem} group by 1, 2")
def argmin_choice(rows):
    return vote.argmin_choice(rows, ["l_returnflag", "l_linestatus"], F.col("l_quantity") > 20, F.col("l_discount") > 0.05)


#: Old and new units of a map: new ones lie at multiples of 16 but for some, some have no source, some another's.
_OLD_UNITS = f"select section, ord, src_size as size from ({UNITS}) u"
_NEW_UNITS = f"""select section, ord, cast(sum(wide) over (partition by section order by ord rows between unbounded preceding and current row) - wide + case when id % 23 = 0 then 4 else 0 end as bigint) as off, dst_size as size,
  case when id % 31 = 0 then null when id % 37 = 0 then ord - least(ord, 3) when id % 41 = 0 then ord - least(ord, 1) else ord end as src
  from (select *, dst_size + (16 - dst_size % 16) % 16 + 16 as wide from ({UNITS}) u) w"""
_END = "coalesce(lag(off + size) over (partition by section order by ord), 0)"
_HITS = ", ".join(f"sum(case when off = e + ({a} - e % {a}) % {a} then 1 else 0 end) as h{a}" for a in (1, 2, 4, 8, 16, 32, 64))
_ARMS = " union all ".join(f"select section, h{a} as h, {a} as a from w" for a in (1, 2, 4, 8, 16, 32, 64))
_TIGHT = f"select section, ord, cast(off - 16 * ord as bigint) as off, size from ({_NEW_UNITS}) n"
_ALIGN = "with w as (select section, {h} from (select *, {e} as e from ({u}) u) x group by section), x as ({arms}), y as (select *, row_number() over (partition by section order by h desc, a) as r from x) select section, cast(a as bigint) as alignment, cast(h as bigint) as hits from y where r = 1"


@query(_TIGHT, oracle=_ALIGN.format(h=_HITS, e=_END, u=_TIGHT, arms=_ARMS))
def best_alignment(units):
    return maps.best_alignment(units, S)


_CODED = f"""with o as ({_OLD_UNITS}), n as ({_NEW_UNITS}), al as ({_ALIGN.format(h=_HITS, e=_END, u=_NEW_UNITS, arms=_ARMS)}),
k as (select section, src as ord, row_number() over (partition by section order by src) - 1 as rank from (select distinct section, src from n where src is not null) d),
c as (select section, count(*) as total from o group by 1),
d as (select o.section, o.ord, o.ord - row_number() over (partition by o.section order by o.ord) as g from o left join k on k.section = o.section and k.ord = o.ord where k.ord is null),
m as (select n.*, o.size as was, coalesce(lag(k.rank) over (partition by n.section order by n.ord) + 1, 0) as nxt from n join k on k.section = n.section and k.ord = n.src join o on o.section = n.section and o.ord = n.src),
x as (select m.*, coalesce(k.ord, c.total) as cursor from m join c on c.section = m.section left join k on k.section = m.section and k.rank = m.nxt),
f as (select z.section, ord, off - (e + (alignment - e % alignment) % alignment) as v from (select *, {_END} as e from n) z join al on al.section = z.section)
select section, 'units' as part, cast(0 as bigint) as ord, count(*) as value from n group by 1
union all select section, 'align', 0, alignment from al
union all select section, 'drop', min(ord), count(*) from d group by section, g
union all select section, 'insert', ord, size from n where src is null
union all select section, 'order', ord, src - cursor from x where src <> cursor
union all select section, 'size', ord, size - was from x where size <> was
union all select section, 'fix', ord, v from f where v <> 0"""


@query(_OLD_UNITS, _NEW_UNITS, oracle=_CODED)
def join_delta_encode(old, new):
    return maps.encode(old, new, S)


@query(_OLD_UNITS, _NEW_UNITS, oracle=_NEW_UNITS)
def correspondence_roundtrip(old, new):
    """The coded form replayed: offsets, sizes and sources of all new units."""
    return maps.replay(old, maps.encode(old, new, S), S)


_SITES = "select l_suppkey % 50 as pred, case when l_partkey % 3 = 0 then l_suppkey % 50 when l_partkey % 3 = 1 then l_suppkey % 50 * (l_suppkey % 2) else l_partkey % 20 end as want from {lineitem}"


@query(_SITES, oracle=f"with c as (select pred, want, count(*) as c from ({_SITES}) group by 1, 2), w as (select *, row_number() over (partition by pred order by c desc, want) as r from c where want <> pred), k as (select pred, c from c where want = pred) select w.pred, w.want as to, w.c as votes, coalesce(k.c, 0) as correct from w left join k using (pred) where r = 1 and w.c > coalesce(k.c, 0)".replace(" as to,", ' as "to",'))
def remap_by_vote(sites):
    return vote.remap_by_vote(sites)


_SHIFTS = f"select section, src as off, cast(case when id % 10 < 6 then 0 when id % 10 < 8 then 16 else -8 end as bigint) as delta from ({UNITS}) u"


@query(_SHIFTS, oracle=f"select section, off, delta from (select *, lag(delta, 1, 0) over (partition by section order by off, delta) as b from ({_SHIFTS})) where delta <> b")
def shift_breakpoints(shifts):
    return runs.shift_breakpoints(shifts, S)


_BLOCKS = f"select section, ord, (dst - src) - (dst - src) % 64 as delta, id % 3 <> 0 as matched from ({UNITS}) u"


@query(_BLOCKS, oracle=f"""with b as ({_BLOCKS}), x as (select *, last_value(case when matched then delta end ignore nulls) over (partition by section order by ord rows between unbounded preceding and 1 preceding) as p, first_value(case when matched then delta end ignore nulls) over (partition by section order by ord rows between 1 following and unbounded following) as q from b)
select section, ord, delta, matched, matched or coalesce(p = q, false) as reliable from x""")
def reliable_blocks(blocks):
    return runs.reliable_blocks(blocks, S)


_KEPT = f"select section, ord, cast(id % 7 < 5 as boolean) as kept from ({UNITS}) u"
_ISLE = "sum(case when {1} is distinct from lag({1}) over (partition by section order by ord) then 1 else 0 end) over (partition by section order by ord)"
_ISLE = "(select *, sum(c) over (partition by section order by ord) as run from (select *, case when {1} is distinct from lag({1}) over (partition by section order by ord) then 1 else 0 end as c from ({0})))"


@query(_KEPT, oracle=f"select section, cast(run as bigint) as run, any_value(kept) as kept, count(*) as n from {_ISLE.format(_KEPT, 'kept')} group by section, run")
def keep_drop_runs(rows):
    return runs.keep_drop_runs(rows, S)


_ORDV = f"select section, ord, src_size * (1 - 2 * (id % 2)) as v from ({UNITS}) u"


@query(_ORDV, oracle=f"select *, v - lag(v, 1, 0) over (partition by section order by ord) as gap from ({_ORDV})")
def gap_encode(rows):
    return runs.gap_encode(rows, S, "v")


@query(_ORDV, oracle=_ORDV)
def gap_decode(rows):
    return runs.gap_decode(runs.gap_encode(rows, S, "v").drop("v"), S, "v").select("section", "ord", "v")


_STEPS = f"select section, ord, cast(case when ord % 50 < 20 then 0 when ord % 50 < 45 then 16 else -8 end as bigint) as v from ({UNITS}) u"


@query(_STEPS, oracle=_STEPS)
def rle_roundtrip(rows):
    return runs.rle_decode(runs.rle_encode(rows, S, "v"), S, "v")


_DIFFS = f"select section, pos from ({CELLS}) c where pred <> want"


@query(_DIFFS, oracle=f"with d as (select *, case when pos - lag(pos) over (partition by section order by pos) - 1 < 6 then 0 else 1 end as c from ({_DIFFS})), r as (select *, sum(c) over (partition by section order by pos) as r from d) select section, min(pos) as start, max(pos) + 1 as \"end\", count(*) as n from r group by section, r")
def merged_regions(diffs):
    return runs.merged_regions(diffs, S, 6)


@query(CELLS, oracle=f"select section, pos, want as got from ({CELLS})")
def columnar_residual(cells):
    """The residual encoded and applied again: the wanted values."""
    return runs.columnar_apply(cells.select("section", "pos", "pred"), runs.columnar_encode(cells, S), S)


_SIZE = "ceil(case when {0} = 0 then 0 else length(bin({0})) end / 8)"


@query(CELLS, oracle=f"with x as (select section, cast(sum({_SIZE.format('want')}) as bigint) as literal, cast(sum({_SIZE.format('abs(want - pred)')}) as bigint) as difference, cast(sum({_SIZE.format('xor(want, pred)')}) as bigint) as exclusive from ({CELLS}) group by 1) select *, case when literal <= difference and literal <= exclusive then 'literal' when difference <= exclusive then 'difference' else 'exclusive' end as mode from x")
def residual_mode_choice(cells):
    return runs.residual_mode_choice(cells, S)


_USES = f"select section, ord, cents % 40 as content, 8 + cents % 40 as len from (select section, id, cents, cast(row_number() over (partition by section order by id) - 1 as bigint) as ord from ({OLD}) o) u"


@query(_USES, oracle=f"with u as ({_USES}), f as (select section, content, min(ord) as o, any_value(len) as l from u group by 1, 2), p as (select *, cast(sum(l) over (partition by section order by o) - l + 1 as bigint) as \"offset\" from f) select u.section, u.content, u.ord, u.len, p.offset from u join p using (section, content)")
def first_use_layout(uses):
    return runs.first_use_layout(uses, S)


_RUN_ROWS = f"select section, cents % 9 + 1 as n from ({OLD}) o"


@query(_RUN_ROWS, oracle=f"select section, least(n, 5) as bucket, count(*) as runs, cast(sum(n) as bigint) as cells from ({_RUN_ROWS}) group by 1, 2")
def run_histogram(rows):
    return runs.run_histogram(rows, S)


_ENTRIES = f"select section, id as ord, cents % 500 as loc from ({OLD}) o"


@query(_ENTRIES, oracle=f"select section, loc, min(ord) as ord, row_number() over (partition by section order by loc) - 1 as rank from ({_ENTRIES}) group by section, loc")
def sorted_unique_index(entries):
    return runs.sorted_unique_index(entries, S)


_WORDS = f"select section, id as ord, case when id % 3 = 0 then cents * 2 else cents * 2 + 1 end as word from ({OLD}) o"


@query(_WORDS, oracle=f"""with w as ({_WORDS}), g as (select *, last_value(case when word % 2 = 0 then word end ignore nulls) over (partition by section order by ord) as a, sum(case when word % 2 = 0 then 1 else 0 end) over (partition by section order by ord) as g from w),
n as (select *, sum(case when word % 2 = 1 then 1 else 0 end) over (partition by section, g order by ord) as n from g)
select section, word as slot from n where word % 2 = 0 union all select section, cast(a + 8 + 504 * (n - 1) + 8 * (i - 1) as bigint) from n, (select unnest(range(1, 64)) as i) where word % 2 = 1 and a is not null and (word >> i) & 1 = 1""")
def bitmap_expand(words):
    return runs.bitmap_expand(words, S)


_OPS = f"select section, ord, case when id % 6 = 0 then null else ord - ord % 3 + (ord * 2) % 3 end as old_ord, src_size as size, case when id % 6 = 0 then null when id % 4 = 0 then dst_size else src_size end as old_size from ({UNITS}) u"


@query(_OPS, oracle=f"""with x as (select *, coalesce(last_value(old_ord ignore nulls) over (partition by section order by ord rows between unbounded preceding and 1 preceding) + 1, 0) as e from ({_OPS}))
select section, ord, old_ord, size, old_size, cast(case when old_ord is null then 2 when old_ord = e and size = old_size then 3 when old_ord = e then 0 else 1 end as bigint) as op, size - coalesce(old_size, 0) as size_delta from x""")
def op_list_encode(units):
    return runs.op_list_encode(units, S)


_INDEXED = f"select section, ord as idx, src as start, src_size as size from ({UNITS}) u"


@query(_INDEXED, oracle=f"with t as (select section, idx, unnest(range(start // 256, (start + size - 1) // 256 + 1)) as sub_bucket from ({_INDEXED})), f as (select section, sub_bucket, min(idx) as first from t group by 1, 2) select *, first - min(first) over (partition by section, sub_bucket // 16) as rel from f")
def bucket_min_index(bodies):
    return runs.bucket_min_index(bodies, S)


_OLDORD, _NEWORD = (f"select section, cast(row_number() over (partition by section order by id) as bigint) as ord, cents from ({x}) o" for x in (OLD, NEW))


@query(_OLDORD, _NEWORD, oracle=f"select coalesce(a.section, b.section) as section, count(*) filter (a.cents is distinct from b.cents) as wrong from ({_OLDORD}) a full join ({_NEWORD}) b on a.section = b.section and a.ord = b.ord group by 1")
def positional_diff_count(old, new):
    return attribute.positional_diff_count(old, new, S, "cents")


_SEGMENTS = "select i as section, concat('part', j) as name, j * 150 as lo, j * 150 + 140 as hi from (select distinct cast(o_custkey % 16 as bigint) as i from {orders}) a, (select distinct cast(o_custkey % 9 as bigint) as j from {orders}) b"


@query(_DIFFS, _SEGMENTS, oracle=f"select d.section, s.name, count(*) as wrong from ({_DIFFS}) d join ({_SEGMENTS}) s on s.section = d.section and pos >= lo and pos < hi group by 1, 2")
def error_by_segment(diffs, segments):
    return attribute.error_by_segment(diffs, segments, S)


_VALUES = "select user_id % 16 as section, event_type as v from {events}"


@query(_VALUES, oracle=f"with c as (select section, v, count(*) as n from ({_VALUES}) group by 1, 2) select section, v, n, rank, total from (select *, row_number() over (partition by section order by n desc, v) as rank, cast(sum(n) over (partition by section) as bigint) as total from c) where rank <= 3")
def top_share(values):
    return attribute.top_share(values, S, "v")


@query(_VALUES, oracle=f"with c as (select section, v, count(*) as c from ({_VALUES}) group by 1, 2) select section, cast(sum(c) as bigint) as n, round(sum(c) * log2(sum(c)) - sum(c * log2(c)), 6) as bits from c group by 1")
def entropy_by_group(values):
    return attribute.entropy_by_group(values, S, "v").withColumn("bits", F.round("bits", 6))


_FIT = "select cast(l_quantity as bigint) as a, cast(l_linenumber as bigint) as b, cast(l_quantity as bigint) * 3 + l_linenumber * 5 + l_orderkey % 4 as y from {lineitem}"


@query(_FIT, oracle=f"with s as (select sum(a * a)::double aa, sum(a * b)::double ab, sum(b * b)::double bb, sum(a * y)::double ay, sum(b * y)::double yb from ({_FIT})) select round((ay * bb - yb * ab) / (aa * bb - ab * ab), 6) as coef_a, round((yb * aa - ay * ab) / (aa * bb - ab * ab), 6) as coef_b from s")
def yardstick_fit(rows):
    return attribute.yardstick_fit(rows, "y", "a", "b").select(*[F.round(c, 6).alias(c) for c in ("coef_a", "coef_b")])


_SAME = f"select section, pos as ord, pred = want as same from ({CELLS}) c"


@query(_SAME, oracle=f"""with i as {_ISLE.format(_SAME, 'same')}, r as (select section, run, any_value(same) as same, count(*) as n from i group by 1, 2), e as (select *, run > min(run) over (partition by section) and run < max(run) over (partition by section) as inner_ from r)
select section, cast(sum(n) as bigint) as cells, cast(coalesce(sum(n) filter (not same), 0) as bigint) as differing, count(*) filter (not same) as runs, count(*) filter (not same) - count(*) filter (same and inner_ and n <= 8) as merged, coalesce(max(n) filter (same), 0) as longest_same, cast(coalesce(sum(n) filter (same and n >= 16), 0) as bigint) as in_long_same, quantile_cont(n, 0.5) filter (not same) as median_run from e group by 1""")
def churn_summary(cells):
    return attribute.churn_summary(cells, S)


_DATA = "select doc_id, encode({0}) as data from {{documents}}"
_CHUNKS = "select doc_id, chunk_no, n, hash from (select doc_id, i as chunk_no, least(1024, octet_length(data) - i * 1024) as n, sha256(data[i * 1024 + 1:i * 1024 + 1024]) as hash from (select doc_id, encode(text) as data, unnest(range(0, (octet_length(encode(text)) + 1023) // 1024)) as i from {documents}))"


@query("select doc_id, encode(text, 'UTF-8') as data from {documents}", oracle=_CHUNKS)
def fixed_chunks(docs):
    return chunks.fixed_chunks(docs, 1024, ["doc_id"])


@query("select doc_id, encode(text, 'UTF-8') as data from {documents}", oracle=f"with c as ({_CHUNKS}), n as (select hash, any_value(n) as n from c where doc_id % 2 = 1 group by 1), o as (select distinct hash from c where doc_id % 2 = 0) select count(*) as chunks, count(*) filter (o.hash is null) as novel, cast(coalesce(sum(n) filter (o.hash is null), 0) as bigint) as novel_bytes from n left join o on o.hash = n.hash")
def chunk_novelty(docs):
    c = chunks.fixed_chunks(docs, 1024, ["doc_id"])
    return chunks.chunk_novelty(c.where("doc_id % 2 = 0"), c.where("doc_id % 2 = 1"))


@query("select doc_id, encode(text, 'UTF-8') as data from {documents}", oracle=f"select doc_id, sha256(string_agg(hash, '' order by chunk_no)) as tree from ({_CHUNKS}) group by 1")
def chunk_tree_hash(docs):
    return chunks.chunk_tree_hash(chunks.fixed_chunks(docs, 1024, ["doc_id"]), ["doc_id"])


@query("select doc_id, encode(text, 'UTF-8') as data from {documents}")
def fastcdc_novelty(docs):
    c = chunks.content_chunks(docs, 1024, ["doc_id"])
    return chunks.chunk_novelty(c.where("doc_id % 2 = 0"), c.where("doc_id % 2 = 1"))


@query(f"select section, 'old' as side, cast(row_number() over (partition by section order by id) - 1 as bigint) as ord, cents % 400 as key from ({OLD}) o union all select section, 'new' as side, cast(row_number() over (partition by section order by id) - 1 as bigint) as ord, cents % 400 as key from ({NEW}) n")
def anchored_diff(rows):
    return align.anchored_diff(rows, "section")


@query("select doc_id - doc_id % 2 as pair, encode(max(case when doc_id % 2 = 0 then text else '' end), 'UTF-8') as old, encode(max(case when doc_id % 2 = 1 then text else '' end), 'UTF-8') as new from {documents} group by 1")
def seed_runs(rows):
    return align.seed_runs(rows, "pair")


@query(f"select section, 'old' as side, cast(row_number() over (partition by section order by id) - 1 as bigint) as block, cast(cast(cents as string) as binary) as bytes from ({OLD}) o union all select section, 'new' as side, cast(row_number() over (partition by section order by id) - 1 as bigint) as block, cast(cast(cents as string) as binary) as bytes from ({NEW}) n")
def block_shift_islands(rows):
    return align.block_shift_islands(rows, "section")


_GO = "select p_partkey, case p_size % 4 when 0 then concat('a/b.(*T).M', p_partkey) when 1 then concat('a/b.Bucket[x.y].F', p_partkey) when 2 then concat('a/b.T.M-f', 'm') else concat('plain', p_partkey) end as name from {part}"


@query(_GO, oracle=f"with n as (select *, regexp_replace(name, '\\[.*\\]', '') as bare from ({_GO})), l as (select *, regexp_replace(regexp_extract(bare, '([^.]*)$', 1), '[0-9]+$', '') as last from n) select p_partkey, case when ends_with(name, '-fm') then 'fm' when regexp_matches(bare, '\\(\\*[^()]*\\)\\.[^.]*$') then 'P|' || last else last end as key from l")
def name_key(names):
    return names.select("p_partkey", keys.name_key(F.col("name")).alias("key"))


_MAG = "select l_orderkey, l_partkey, l_suppkey, l_orderkey - l_partkey as v from {lineitem}"


@query(_MAG, oracle=f"select case when v = 0 then 0 else length(bin(abs(v))) end as class, count(*) as n from ({_MAG}) group by 1")
def magnitude_histogram(rows):
    return rows.groupBy(keys.magnitude(F.col("v")).cast("long").alias("class")).agg(F.count("*").alias("n"))


_SEC_OLD, _SEC_NEW = (f"select concat('s', o_custkey - o_custkey % 8 + o_custkey % {m}) as name, cast(min(o_orderkey) as bigint) as off, cast(sum(1 + o_orderkey % {m}) as bigint) as size from {{orders}} group by 1" for m in (3, 2))


@query(_SEC_OLD, _SEC_NEW, oracle=f"select a.name, a.off as old_off, b.off as new_off, least(a.size, b.size) as size from ({_SEC_OLD}) a join ({_SEC_NEW}) b on a.name = b.name")
def section_pairing(old, new):
    return predict.section_pairing(old, new)


_STARTS = "select o_custkey % 16 as section, o_orderkey % 500 * 16 as start from {orders}"


@query(_STARTS, oracle=f"select section, start, lead(start) over (partition by section order by start) as \"end\" from (select distinct * from ({_STARTS}))")
def source_extents(starts):
    return predict.source_extents(starts, S)


_SET_A, _SET_B = "select o_custkey % 16 as section, o_orderkey % 700 * 8 as v from {orders}", "select user_id % 16 as section, event_id % 900 * 12 as v from {events}"
_ENUM = f"select section, v, row_number() over (partition by section order by v) - 1 as idx from (select * from ({_SET_A}) union select * from ({_SET_B}))"


@query(_SET_A, _SET_B, oracle=_ENUM)
def derive_enumeration(a, b):
    return predict.derive_enumeration([a, b], S)


@query(PROBES, _SET_A, _SET_B, oracle=f"select p.*, coalesce(e.idx, -1) as idx from ({PROBES}) p asof left join ({_ENUM}) e on e.section = p.section and p.addr >= e.v")
def target_index(probes, a, b):
    return predict.target_index(probes, predict.derive_enumeration([a, b], S), S)


_FILE_REFS = "select l_orderkey * 10 + l_linenumber as id, case when l_partkey % 9 = 0 then 4294967295 else l_suppkey * 8 end as off from {lineitem}"
_FILES_OLD = "select s_suppkey as ord, s_suppkey * 8 as off, concat('f', s_suppkey % 60) as name from {supplier}"
_FILES_NEW = "select s_suppkey as ord, (s_suppkey * 7919) % 100003 * 24 as off, concat('f', s_suppkey % 50) as name from {supplier}"


@query(_FILE_REFS, _FILES_OLD, _FILES_NEW, oracle=f"with o as (select off, arg_min(name, ord) as name from ({_FILES_OLD}) group by 1), n as (select name, arg_min(off, ord) as new from ({_FILES_NEW}) group by 1) select r.id, r.off, case when r.off = 4294967295 then r.off else coalesce(n.new, r.off) end as new_off from ({_FILE_REFS}) r left join o on o.off = r.off left join n on n.name = o.name")
def file_offset_remap(refs, old, new):
    return predict.file_offset_remap(refs, old, new)


_ALIGNED = f"select section, id as ord, case cents % 3 when 0 then cast(4 as bigint) when 1 then cast(16 as bigint) else cast(64 as bigint) end as align, cents % 30 as content, 5 + cents % 30 as len from ({OLD}) o"


@query(_ALIGNED, oracle=f"""with u as ({_ALIGNED}), f as (select section, align, content, min(ord) as o, any_value(len) as l from u group by 1, 2, 3), p as (select *, sum(l) over (partition by section, align order by o) - l as i from f),
z as (select section, coalesce(sum(l) filter (align = 4), 0) as a, coalesce(sum(l) filter (align = 16), 0) as b from f group by 1),
s as (select section, a, b, a + (16 - a % 16) % 16 as s16 from z), t as (select *, s16 + b + (64 - (s16 + b) % 64) % 64 as s64 from s)
select p.section, p.align, p.content, cast(i + case p.align when 4 then 0 when 16 then s16 else s64 end as bigint) as "offset" from p join t on t.section = p.section""")
def grouped_first_use(uses):
    return predict.grouped_first_use(uses, S)


_FIXABLE = f"select section, ord, (dst - src) - (dst - src) % 64 as delta, id % 3 = 1 as matched, id % 10 = 5 as ambiguous from ({UNITS}) u"
_BALLOTS = f"select section, ord, (ord % 4) * 16 as shift, cast(1 as bigint) as weight from ({UNITS}) u where id % 4 <> 0 union all select section, ord, (ord % 3) * 16 as shift, cast(2 as bigint) as weight from ({UNITS}) u where id % 5 = 0 and section % 2 = 0"


@query(_FIXABLE, _BALLOTS, oracle=f"""with v as (select section, ord, shift, sum(weight) as w from ({_BALLOTS}) group by 1, 2, 3), m as (select section, ord, max_by(shift, w * 1000 + shift) as s, max(w) as w, sum(w) as a from v group by 1, 2),
x as (select b.*, case when not matched and 2 * m.w > m.a then m.s end as won from ({_FIXABLE}) b left join m on m.section = b.section and m.ord = b.ord),
y as (select *, last_value(case when matched then delta else won end ignore nulls) over (partition by section order by ord) as l, count(won) over (partition by section) > 0 as any_ from x)
select section, ord, delta, matched, ambiguous, case when won is not null then won when any_ and not matched and not ambiguous then coalesce(l, delta) else delta end as fixed from y""")
def fix_blocks(blocks, votes):
    return predict.fix_blocks(blocks, votes, S)


_IMAGE_RUNS = f"select section, pos as src, pos + 3 as dst, cast(7 as bigint) as n from ({CELLS}) c where pos % 10 = 0"


@query(f"select section, pos from ({CELLS}) c", _IMAGE_RUNS, f"select section, pos, pred as value from ({CELLS}) c", oracle=f"select c.section, c.pos, coalesce(o.pred, 204) as got from ({CELLS}) c left join ({_IMAGE_RUNS}) r on r.section = c.section and c.pos >= r.dst and c.pos < r.dst + r.n left join ({CELLS}) o on o.section = c.section and o.pos = r.src + c.pos - r.dst")
def lay_image(cells, runs_, old):
    return predict.lay_image(cells, runs_, old, S)


_MULTI_A, _MULTI_B = "select l_partkey % 100 as a, l_suppkey % 10 as b from {lineitem}", "select l_partkey % 100 as a, l_suppkey % 9 as b from {lineitem}"


@query(_MULTI_A, _MULTI_B, oracle=f"select (select count(*) from (select * from ({_MULTI_A}) except all select * from ({_MULTI_B}))) as only_a, (select count(*) from (select * from ({_MULTI_B}) except all select * from ({_MULTI_A}))) as only_b")
def multiset_difference(a, b):
    return predict.multiset_difference(a, b)


@query(f"select section, id % 5000 as src, id * 3 as dst, 20 + cents % 300 as n from ({OLD}) o")
def disjoint_runs(rows):
    return predict.disjoint_runs(rows, "section")


@query("select l_shipmode_ as class, l_orderkey * 10 + l_linenumber as ord, l_partkey as v from (select concat(l_returnflag, l_linestatus) as l_shipmode_, * from {lineitem}) x".replace("l_shipmode_", "kind"))
def marginal_price(rows):
    return predict.marginal_price(rows, "class", "v")


_BY_CLASS = f"select section, case when id % 2 = 0 then 'even' else 'odd' end as class, pos from ({CELLS}) c where pred <> want"


@query(_BY_CLASS, oracle=f"select section, class, count(*) as wrong from ({_BY_CLASS}) group by rollup (section, class)")
def class_rollup(rows):
    return rows.rollup("section", "class").agg(F.count("*").alias("wrong"))


@query(OLD, NEW, oracle=f"select (select count(*) from ({NEW})) as n_rows, cast(0 as bigint) as mismatches")
def diff_patch_roundtrip(old, new):
    got = versions.patch(old, versions.diff(old, new, ["id"]), ["id"])
    both = got.withColumn("_s", F.lit(1)).unionByName(new.withColumn("_s", F.lit(-1))).groupBy(*new.columns).agg(F.sum("_s").alias("d"), F.count_if(F.col("_s") < 0).alias("n"))
    return both.agg(F.sum("n").alias("n_rows"), F.sum(F.abs("d")).cast("long").alias("mismatches"))


@query(OLD, oracle="select cast(0 as bigint) as changes")
def self_prediction(old):
    return versions.diff(old, old, ["id"]).agg(F.count("*").alias("changes"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the two versions paired in stages: pairs by stage."""
    return QUERIES["staged_match"](spark, sf_dir).groupBy("stage").count()


#: Relocation tables: every ninth entry has a symbol, as have the first two.
_INFO = "case when id % 9 = 0 or ord < 2 then 6 + id * 4294967296 else cast(8 as bigint) end as info"
_RELA_OLD = f"select section, ord, src as slot, {_INFO}, case when id % 12 = 0 then cast(0 as bigint) else src + src_size end as addend from ({UNITS}) u"
_RELA_NEW = f"""select section, cast(row_number() over (partition by section order by ord) - 1 as bigint) as ord, dst as slot, {_INFO}, case when id % 12 = 0 then cast(0 as bigint) else dst + dst_size end as addend
  from ({UNITS}) u where id % 23 <> 0"""


def _split(table: str) -> str:
    return f"""select *, case when rel then 'rel' when ord > first then 'tail' else 'head' end as kind, row_number() over (partition by section, rel order by ord) - 1 as idx
  from (select *, info & 4294967295 = 8 as rel, min(case when info & 4294967295 = 8 then ord end) over (partition by section) as first from ({table}) t) s"""


@query(_RELA_OLD, oracle=f"select section, ord, slot, info, addend, kind, idx from ({_split(_RELA_OLD)}) x")
def rela_split(entries):
    return reloc.rela_split(entries, S)


_TAIL = " union all ".join(f"select w.section, 'tail_{c}' as part, w.idx, coalesce(o.{c}, 0) as pred, w.{c} as want from n w left join o on o.section = w.section and o.idx = w.idx and o.kind <> 'rel' where w.kind <> 'rel'" for c in ("slot", "info", "addend"))
_PLAN = f"""with m as ({MAPS}), t as ({POINTS}), g as ({RANGES}), o0 as ({_split(_RELA_OLD)}), n as ({_split(_RELA_NEW)}),
p as (select distinct section, addr from (select section, slot as addr from o0 union all select section, addend from o0) z where addr <> 0),
x as (select p.section, p.addr, coalesce(t.new, case when p.addr - m.src < m.dst_size then m.dst + p.addr - m.src end, g.new + p.addr - g.old) as target from p
 left join t on t.section = p.section and t.old = p.addr {_LOOK} left join g on g.section = p.section and p.addr >= g.old and p.addr < g.old + g.size),
o as (select o0.section, o0.idx, o0.kind, o0.info, coalesce(a.target, o0.slot) as slot, coalesce(b.target, o0.addend) as addend from o0
 left join x a on a.section = o0.section and a.addr = o0.slot left join x b on b.section = o0.section and b.addr = o0.addend),
og as (select section, idx, coalesce(slot - lag(slot) over (partition by section order by idx), 0) as gap from o where kind = 'rel'),
ng as (select section, idx, coalesce(slot - lag(slot) over (partition by section order by idx), 0) as gap from n where kind = 'rel'),
f as (select section, slot, arg_min(addend, idx) as addend from o where kind = 'rel' group by 1, 2),
cells as (select ng.section, 'gap' as part, ng.idx, coalesce(og.gap, 0) as pred, ng.gap as want from ng left join og on og.section = ng.section and og.idx = ng.idx
 union all select w.section, 'addend', w.idx, coalesce(f.addend, q.addend, 0), w.addend from n w left join f on f.section = w.section and f.slot = w.slot left join o q on q.section = w.section and q.idx = w.idx and q.kind = 'rel' where w.kind = 'rel'
 union all {_TAIL})
select section, part, idx, pred, want from cells where pred <> want"""


@query(_RELA_OLD, _RELA_NEW, POINTS, MAPS, RANGES, oracle=_PLAN)
def reloc_plan(old, new, points, maps_, ranges):
    return reloc.reloc_plan(reloc.predicted_columns(old, new, points, maps_, ranges, S))


@query(_RELA_OLD, _RELA_NEW, POINTS, MAPS, RANGES, oracle=f"select section, row_number() over (partition by section order by case kind when 'head' then 0 when 'rel' then 1 else 2 end, ord) - 1 as ord, slot, info, addend from ({_split(_RELA_NEW)}) x")
def assemble_rela(old, new, points, maps_, ranges):
    """The new table from the old one's projection and the plan's corrections."""
    cells = reloc.predicted_columns(old, new, points, maps_, ranges, S)
    shipped = F.when(F.col("pred") != F.col("want"), F.col("want"))  # what reloc_plan lists
    fixed = cells.select("section", "part", "idx", F.coalesce(shipped, "pred").alias("value"))
    split = reloc.rela_split(new, S)
    anchors = split.groupBy("section").agg(F.min_by("slot", F.when(F.col("kind") == "rel", F.col("idx"))).alias("anchor"), F.count_if(F.col("kind") == "head").alias("head"))
    return reloc.assemble_rela(fixed, anchors, S)


_GENERIC = "select p_partkey, case p_size % 4 when 0 then concat('a.F[int,', p_name, '].func', p_size) when 1 then concat('a.G[m[k]', p_brand, '].H[x]') when 2 then concat('plain.func', p_size) else concat('.text.', p_brand) end as name from {part}"


@query(_GENERIC, oracle=f"select p_partkey, regexp_replace(regexp_replace(name, '\\.func[0-9]+', '.func#', 'g'), '\\[([^\\[\\]]|\\[[^\\[\\]]*\\])*\\]', '[#]', 'g') as key, list_contains(string_split(name, '.'), 'text') as code from ({_GENERIC})")
def renumber_key(names):
    return names.select("p_partkey", keys.renumber_key(F.col("name")).alias("key"), keys.is_code_window(F.col("name")).alias("code"))


_PRICED = f"select section, ord, cents - 20000000 as price, src_size as n, dst as pos from (select u.*, o.cents from ({UNITS}) u join ({OLD}) o on o.id = u.id) x"


@query(_PRICED, oracle=f"select section, ord, case when price <= 0 then 0 else least(price, 16777216) * n // 1048576 end as worth, (pos + 15) // 16 * 16 as aligned from ({_PRICED})")
def worth_and_alignment(rows):
    return rows.select("section", "ord", keys.worth_of(F.col("price"), F.col("n"), F.lit(1 << 20).cast("long")).alias("worth"), keys.align_up(F.col("pos"), 16).alias("aligned"))


@query(_ORDV, oracle=f"select section, ord, v, case when gap < 0 then -2 * gap - 1 else 2 * gap end as coded, v as back from (select *, v - lag(v, 1, 0) over (partition by section order by ord) as gap from ({_ORDV}))")
def zigzag_gaps(rows):
    """Gaps as unsigned numbers, and the values again."""
    told = runs.gap_encode(rows, S, "v").withColumn("coded", keys.zigzag(F.col("gap")))
    back = runs.gap_decode(told.select("section", "ord", keys.unzigzag(F.col("coded")).alias("gap")), S, "v").withColumnRenamed("v", "back")
    return told.select("section", "ord", "v", "coded").join(back.select("section", "ord", "back"), ["section", "ord"])


_POINTER_WORDS = f"select section, ord, src * 8 + id % 8 as value from ({UNITS}) u"


@query(_POINTER_WORDS, oracle=f"select section, ord, case when value >= 4000 and value < 90000 then 0 else value end as value, value >= 4000 and value < 90000 as is_pointer from ({_POINTER_WORDS})")
def mask_pointers(words):
    return addresses.mask_pointers(words, 4000, 90000)


_SHAPES = "select l_linenumber as a, cast(l_quantity as int) % 5 as b from {lineitem}"


@query(_SHAPES, oracle=f"select a, b, count(*) as n from ({_SHAPES}) group by 1, 2 order by n desc, a, b limit 1")
def modal_shape(rows):
    return vote.modal_shape(rows, ["a", "b"])


_SHIPPED = f"select section, cast(row_number() over (partition by section order by l_orderkey, l_linenumber, l_partkey, pred, want) - 1 as bigint) as idx, pred, want from (select *, l_suppkey % 16 as section, {_SITES[7 : _SITES.index(' from')]} from {{lineitem}}) s"
_REMAP = SQL["remap_by_vote"]


@query(_SHIPPED, oracle=f"""with m as ({_REMAP}), f as (select s.section, s.idx, s.want - coalesce(m."to", s.pred) as value from ({_SHIPPED}) s left join m on m.pred = s.pred),
w as (select * from f where value <> 0)
select section, row_number() over (partition by section order by idx) as ord, idx - lag(idx, 1, 0) over (partition by section order by idx) as gap, value from w""")
def vote_residual(sites):
    """What the voted remap leaves wrong, as a sparse column."""
    left = vote.field_residuals(sites, vote.remap_by_vote(sites), S)
    return runs.sparse_encode(left.withColumnRenamed("delta", "value"), S)


@query(CELLS, oracle=f"select section, pos as idx, want - pred as value from ({CELLS}) where pred <> want")
def sparse_column(cells):
    """The sparse column of all corrections, read back."""
    coded = runs.sparse_encode(cells.where("pred <> want").select("section", F.col("pos").alias("idx"), (F.col("want") - F.col("pred")).alias("value")), S)
    return runs.sparse_decode(coded, cells.groupBy("section").agg((F.max("pos") + 1).alias("n")), S)


_VARIANTS = "select l_orderkey as span, l_linenumber as variant, l_suppkey % 40 - 25 as gain from {lineitem}"


@query(_VARIANTS, oracle=f"select span, variant, gain from (select *, row_number() over (partition by span order by gain desc, variant) as r from (select distinct * from ({_VARIANTS})) where gain > 0) where r = 1")
def best_variant(candidates):
    return vote.best_variant(candidates, ["span"])


@query(_VALUES, oracle=f"with c as (select section, v, count(*) as c from ({_VALUES}) group by 1, 2), t as (select section, sum(c) as n from c group by 1) select c.section, cast(any_value(n) as bigint) as n, round(sum(-c * log2((c + 0.5) / (n + 128))), 4) as bits from c join t on t.section = c.section group by 1")
def adaptive_bits(values):
    return attribute.adaptive_bits(values, S, "v").withColumn("bits", F.round("bits", 4))


_WRONG = f"select d.section, s.name, count(*) as wrong from ({_DIFFS}) d join ({_SEGMENTS}) s on s.section = d.section and pos >= lo and pos < hi group by 1, 2"


@query(_DIFFS, _SEGMENTS, oracle=f"select *, row_number() over (order by wrong desc, section, name) as rank from ({_WRONG}) order by wrong desc, section, name limit 10")
def largest_errors(diffs, segments):
    """The ten segments with the most errors."""
    return attribute.largest_first(attribute.error_by_segment(diffs, segments, S), "wrong", ["section", "name"], 10)


_OLD_TEXTS, _NEW_TEXTS = (f"select doc_id as id, doc_id * {m} as off, length(text) as size, md5(regexp_replace(text, '[0-9]+', '#'{{g}})) as hash from {{{{documents}}}} where doc_id % 2 = {r}" for m, r in ((3, 0), (4, 1)))
_NAMED = "select doc_id as new_id from {documents} where lang is null or doc_id % 14 = 1"


@query(_OLD_TEXTS.format(g=""), _NEW_TEXTS.format(g=""), _NAMED, oracle=f"""with o as ({_OLD_TEXTS.format(g=", 'g'")}), n as ({_NEW_TEXTS.format(g=", 'g'")}),
c as (select n.id as new_id, o.id as old_id, row_number() over (partition by n.id order by abs(n.off - o.off), o.id) as r from n join o on o.size = n.size and o.hash = n.hash where n.id not in ({_NAMED}))
select new_id, old_id from c where r = 1""")
def content_match(old, new, named):
    return match.content_match(old, new, named, ["size", "hash"])


_PIECES = " union all ".join(f"select section, src as body, cast({o} as bigint) as old, cast({n} as bigint) as new, cast({k} as bigint) as n from ({UNITS}) u where src_size <> dst_size" for o, n, k in ((1, 0, 5), (8, 10, 4)))
_OFFSETS = f"select section, id, src as body, (id * 7) % src_size as o, dst_size as new_size from ({UNITS}) u"


def _moved(probes: str) -> str:
    return f"""select p.section, p.id, p.o, p.new_size, coalesce(max(case when o >= s.old and o < s.old + s.n then s.new + o - s.old end), case when o < new_size and not coalesce(bool_or(o >= s.new and o < s.new + s.n), false) then o
  else greatest(0, least(new_size, o + coalesce(arg_max(s.new - s.old, case when s.old + s.n <= o then s.old end), 0))) end) as mapped
  from ({probes}) p left join ({_PIECES}) s on s.section = p.section and s.body = p.body group by p.section, p.id, p.o, p.new_size"""


@query(_OFFSETS, _PIECES, oracle=_moved(_OFFSETS))
def segment_offset(probes, pieces):
    return addresses.segment_offset(probes, pieces, S).drop("body")


_EACH = "select distinct cast(o_custkey % 16 as bigint) as section from {orders}"
_REFERRED = f"select section, id, src as self, src + id % 60 + case when id % 7 = 0 then 30000 else 0 end as addr from ({UNITS}) u"
_TEXT = f"select section, cast(100 as bigint) as text_lo, cast(25000 as bigint) as text_hi, cast(120 as bigint) as text_new from ({_EACH}) e"
_BODIED = f"select section, src, src_size - 3 as src_size, case when id % 11 <> 0 then dst end as dst, dst_size from ({UNITS}) u"
_DATA = " union all ".join(f"select section, '{n}' as name, cast({lo} as bigint) as lo, cast({hi} as bigint) as hi, cast({to} as bigint) as {{q}}to{{q}} from ({_EACH.replace('{orders}', '{{orders}}')}) e" for n, lo, hi, to in (("rodata", 25000, 30000, 26000), ("data", 30000, 40000, 33000), ("lost", 41000, 42000, "null")))
_MOVES = " union all ".join(f"select section, 'data' as name, cast({o} as bigint) as off, cast({d} as bigint) as delta from ({_EACH}) e" for o, d in ((0, 0), (500, 16), (6000, -8)))
_FORCED = f"select distinct section, addr, addr + 7 as {{q}}to{{q}} from ({_REFERRED.replace('{orders}', '{{orders}}')}) r where addr % 50 = 0"


@query(_REFERRED, _TEXT, _BODIED, _PIECES, _DATA.format(q="`"), _MOVES, _FORCED.format(q="`"), oracle=f"""with r as ({_REFERRED}), t as ({_TEXT}), d as ({_DATA.format(q='"')}), f as ({_FORCED.format(q='"')}), cut as (select distinct section, body from ({_PIECES}) c),
b as (select r.section, r.id, r.self, r.addr, b.src as body, b.dst, r.addr - b.src as o, b.dst_size as new_size from r left join ({_BODIED}) b on b.section = r.section and r.addr >= b.src and r.addr < b.src + b.src_size),
g as ({_moved('select section, id, body, o, new_size from b where body is not null')}),
x as (select b.*, t.text_lo, t.text_new, b.addr >= t.text_lo and b.addr < t.text_hi as intext, case when cut.body is not null then g.mapped else b.o end as place,
  case when a.name is not null then a.name else z.name end as name, case when a.name is not null then a.lo else z.lo end as lo, case when a.name is not null then a."to" else z."to" end as base
  from b join t on t.section = b.section left join g on g.section = b.section and g.id = b.id left join cut on cut.section = b.section and cut.body = b.body
  left join d a on a.section = b.section and b.addr >= a.lo and b.addr < a.hi left join d z on z.section = b.section and b.addr - 1 >= z.lo and b.addr - 1 < z.hi),
y as (select x.*, case when intext and body is null then 'none' when intext and dst is null then 'unmatched' when intext and body = self then 'self' when intext then 'matched' when base is null then 'outside' else 'data' end as class,
  coalesce((select arg_max(delta, m.off) from ({_MOVES}) m where m.section = x.section and m.name = x.name and m.off <= x.addr - x.lo), 0) as delta from x)
select y.section, y.id, y.self, y.addr, class, coalesce(f."to", case class when 'none' then text_new + y.addr - text_lo when 'self' then dst + place when 'matched' then dst + place when 'data' then base + y.addr - lo + delta end) as target
from y left join f on f.section = y.section and f.addr = y.addr""")
def address_map(refs, text, bodies, pieces, data, shifts, overrides):
    return addresses.address_map(refs, text, bodies, pieces, data, shifts, overrides, S)


#: Two windows of code and one of data, in memory 1,000 past their place in the file.
_SPANS = " union all ".join(
    f"select section, cast({lo + 1000} as bigint) as old_addr, cast({n} as bigint) as old_size, cast({lo} as bigint) as old_off, cast({to + 2000} as bigint) as new_addr, cast({m} as bigint) as new_size, cast({to} as bigint) as new_off, {code} as code from ({_EACH}) e"
    for lo, n, to, m, code in ((0, 1200, 0, 1150, "true"), (1300, 1500, 1250, 1600, "true"), (2900, 20000, 2900, 19000, "false"))
)
_ASKED = f"select p.*, cast(30000 as bigint) as old_len, cast(29000 as bigint) as new_len from ({PROBES}) p"


def _bytes(table: str, at: str, also: str) -> str:
    """Named parts of a WITH for the place of each probe's bytes: l has file, new and the landing span."""
    return f"""s as ({_SPANS}), r as ({RUNS}), q as (select a.*, s.code as oldcode, s.old_off + a.{at} - s.old_addr as file from ({table}) a left join s on s.section = a.section and a.{at} >= s.old_addr and a.{at} < s.old_addr + s.old_size),
b1 as (select q.*, r.src as bs, r.dst as bd, r.n as bn from q asof left join r on r.section = q.section and q.file >= r.src),
f1 as (select b1.*, r.src as fs, r.dst as fd from b1 asof left join r on r.section = b1.section and b1.file < r.src),
n1 as (select section, {also}, file, oldcode, old_len, new_len, case when file < old_len then greatest(0, least(new_len - 1, file + case when bs is not null and (file < bs + bn or fs is null or file - bs - bn < fs - file) then bd - bs else fd - fs end)) end as new from f1),
l as (select n1.*, s.new_addr + n1.new - s.new_off as anyw, case when s.code then s.new_addr + n1.new - s.new_off end as into_ from n1 left join s on s.section = n1.section and n1.new >= s.new_off and n1.new < s.new_off + s.new_size)"""


def _evidence(at: str) -> str:
    """Points, maps and ranges beside l."""
    return f"""m as ({MAPS}), t as ({POINTS}), g as ({RANGES}), x as (select l.*, t.new as a, case when l.{at} - m.src < m.dst_size then m.dst + l.{at} - m.src end as b, g.new + l.{at} - g.old as c from l
 left join t on t.section = l.section and t.old = l.{at} left join m on m.section = l.section and l.{at} >= m.src and l.{at} < m.src + m.src_size left join g on g.section = l.section and l.{at} >= g.old and l.{at} < g.old + g.size)"""


@query(_ASKED, _SPANS, RUNS, POINTS, MAPS, RANGES, oracle=f"""with {_bytes(_ASKED, "addr", "event_id, addr")}, {_evidence("addr")}
select section, event_id, addr, old_len, new_len, case when oldcode then coalesce(into_, a, b, c) else coalesce(a, anyw, b, c) end as displacement, coalesce(a, b, anyw, c) as pointer from x""")
def reference_targets(probes, spans, runs_, points, maps_, ranges):
    return addresses.reference_targets(probes, spans, runs_, points, maps_, ranges, S)


_HELD = f"select section, id, src + 1000 as slot, dst + id % 3 * 20000 as value, cast(30000 as bigint) as old_len, cast(29000 as bigint) as new_len from ({UNITS}) u"


@query(_HELD, _SPANS, RUNS, POINTS, MAPS, RANGES, oracle=f"""with placed as (with {_bytes(_HELD, "slot", "id, slot, value")} select section, id, slot, value, old_len, new_len, case when file + 8 <= old_len and new + 8 <= new_len then new end as new_off from l),
{_bytes("select * from placed", "value", "id, slot, value, new_off")}, {_evidence("value")}
select section, id, slot, value, old_len, new_len, new_off, case when new_off is not null then coalesce(a, b, anyw, c) end as target, case when new_off is null then 'unplaced' when coalesce(a, b, anyw, c) is null then 'unknown' else 'retargeted' end as status from x""")
def pointer_slots(slots, spans, runs_, points, maps_, ranges):
    return addresses.pointer_slots(slots, spans, runs_, points, maps_, ranges, S)


_RECORDS = f"select section, ord, id % 3 <> 0 as matched, id % 3 * 100 + id % 11 as cu, src_size % 5 as a, dst_size % 3 as b, dst_size as len from ({UNITS}) u"


@query(_RECORDS, oracle=f"""with u as ({_RECORDS}), {", ".join(f"m{f} as (select section, {f}, row_number() over (partition by section order by count(*) desc, {f}) as r from u where matched group by 1, 2)" for f in "ab")}
select u.section, u.ord, matched, coalesce(last_value(case when matched then cu end ignore nulls) over (partition by u.section order by u.ord), 0) as cu, case when matched then u.a else ma.a end as a, case when matched then u.b else mb.b end as b, len,
 cast(sum((len + 7) // 8 * 8) over (partition by u.section order by u.ord) - (len + 7) // 8 * 8 as bigint) as "offset" from u left join ma on ma.section = u.section and ma.r = 1 left join mb on mb.section = u.section and mb.r = 1""")
def predict_records(units):
    return addresses.predict_records(units, S, ["a", "b"])


_REGIONED = f"""with c as ({CELLS}), n as (select section, max(pos) + 1 as n from c group by 1), d as (select section, pos, case when pos - lag(pos) over (partition by section order by pos) - 1 < 32 then 0 else 1 end as b from c where pred <> want),
g as (select *, sum(b) over (partition by section order by pos) as g from d), w as (select g.section, min(pos) // 8 * 8 as start, least((max(pos) + 8) // 8 * 8, any_value(n)) as stop from g join n on n.section = g.section group by g.section, g.g),
f as (select w.section, w.start, c.pred, c.want from w join c on c.section = w.section and c.pos >= w.start and c.pos < w.stop),
e as (select section, start, 0 as mode, want as byte from f union all select section, start, 1, xor(want, pred) from f union all select section, start, 2, (want - pred + 256) % 256 from f),
k as (select section, start, mode, byte, count(*) as n from e group by 1, 2, 3, 4), p0 as (select distinct section, start, 0 as mode from k)"""
_PASS = """, h{1} as (select k.section, k.mode, byte, sum(n) as c from k join p{0} p on p.section = k.section and p.start = k.start and p.mode = k.mode group by 1, 2, 3), t{1} as (select section, mode, sum(c) as t from h{1} group by 1, 2),
q{1} as (select k.section, k.start, k.mode, round(sum(n * (log2(coalesce(t, 0) + 128) - log2(coalesce(c, 0) + 0.5))), 6) as bits from k left join h{1} h on h.section = k.section and h.mode = k.mode and h.byte = k.byte left join t{1} t on t.section = k.section and t.mode = k.mode group by 1, 2, 3),
p{1} as (select section, start, mode, bits from (select *, row_number() over (partition by section, start order by bits, mode) as r from q{1}) where r = 1)"""


@query(CELLS, oracle=f"{_REGIONED}{''.join(_PASS.format(i, i + 1) for i in range(3))} select section, start, mode, round(bits, 4) as bits from p3")
def region_modes(cells):
    return runs.region_modes(cells, S).withColumn("bits", F.round("bits", 4))


_CODE = f"select section, pos, case when pos % 24 > 17 or pos % 9 = 0 then 204 else pred end as value from ({CELLS}) c"
_NEXTS = f"select section, pos as start, pos + pos % 29 as next from ({CELLS}) c"


@query(_CODE, oracle=f"select section, pos from (select *, lag(value) over (partition by section order by pos) as b from ({_CODE})) where pos = 0 or (pos % 8 = 0 and value <> 204 and b = 204)")
def boundaries(cells):
    return runs.boundaries(cells, S)


@query(_NEXTS, _CODE, oracle=f"select e.section, e.start, e.next, coalesce(max(c.pos) + 1 - e.start, 0) as size from ({_NEXTS}) e left join ({_CODE}) c on c.section = e.section and c.pos >= e.start and c.pos < e.next and c.value <> 204 group by 1, 2, 3")
def padding_extent(spans, cells):
    return runs.padding_extent(spans, cells, S)


_CROWDED = f"select section, id as idx, (id * 37) % 9000 as dst, 5 + cents % 60 as size from ({OLD}) o"


@query(_CROWDED, oracle=f"""with recursive u as (select *, row_number() over (partition by section order by dst, idx) as r from ({_CROWDED})), k as (select section, r, idx, dst, size, true as kept, dst + size as e from u where r = 1
 union all select u.section, u.r, u.idx, u.dst, u.size, u.dst >= k.e, case when u.dst >= k.e then u.dst + u.size else k.e end from k join u on u.section = k.section and u.r = k.r + 1) select section, idx, dst, size from k where kept""")
def drop_overlaps(bodies):
    return predict.drop_overlaps(bodies, "section")


@query(f"select section, ord, src_size * 997 as incumbent, dst_size * 800 as coded from ({UNITS}) u", oracle=f"select section, ord, coded + greatest(2048, incumbent // 10) < incumbent as pays from (select section, ord, src_size * 997 as incumbent, dst_size * 800 as coded from ({UNITS}) u)")
def coder_pays(sizes):
    return sizes.select("section", "ord", keys.coder_pays(F.col("coded"), F.col("incumbent")).alias("pays"))


@query("select doc_id, encode(text, 'UTF-8') as data from {documents}", oracle="select doc_id, octet_length(encode(text)) as n, md5(text) as hash, true as smaller from {documents}")
def smallest_form(rows):
    """Texts packed in their smallest form and restored: the digests of the texts, and whether none grew."""
    packed = rows.withColumn("form", chunks.smallest_form("data"))
    back = packed.select("doc_id", F.octet_length("form.packed").alias("_p"), F.octet_length("data").alias("_n"), chunks.restored("form.codec", "form.packed").alias("back"))
    return back.select("doc_id", F.octet_length("back").alias("n"), F.md5("back").alias("hash"), (F.col("_p") <= F.col("_n")).alias("smaller"))


@query(OLD, NEW, oracle=f"select 'changes' as pair, 0 as strategy, (select count(*) from ({NEW})) as n_rows union all select 'same', 1, (select count(*) from ({OLD})) union all select 'appended', 2, (select 2 * count(*) from ({OLD}))")
def strategy_choice(old, new):
    """The strategy taken for three pairs of versions, and the rows of the table it makes again."""
    registry, out = strategies.Registry(), None
    more = old.unionByName(old.withColumn("id", -F.col("id") - 1))
    for name, b in (("changes", new), ("same", old), ("appended", more)):
        patch = strategies.encode(old, b, ["id"], registry)
        made = strategies.apply(old, patch, registry).agg(F.lit(name).alias("pair"), F.lit(patch.strategy).alias("strategy"), F.count("*").alias("n_rows"))
        out = made if out is None else out.unionAll(made)
    return out


_FRAMES = f"select section, id, src as entry, src + 8 as loc, src - src % 400 as cie, src as addr, src_size - case when id % 3 = 0 then 1 else 0 end as size, cast(30000 as bigint) as old_len, cast(29000 as bigint) as new_len from ({UNITS}) u"
_PLACES = f"select section, cast(40 as bigint) as {{q}}at{{q}}, cast(25000 as bigint) as n, cast(700000 as bigint) as address from ({_EACH.replace('{orders}', '{{orders}}')}) e"


def _projected(at: str) -> str:
    """The projection of a column of the frames, as named parts of a WITH ending in j_<column>."""
    return f"""b_{at} as (select q.section, q.id, q.{at}, q.old_len, q.new_len, r.src as bs, r.dst as bd, r.n as bn from q asof left join r on r.section = q.section and q.{at} >= r.src),
f_{at} as (select b.*, r.src as fs, r.dst as fd from b_{at} b asof left join r on r.section = b.section and b.{at} < r.src),
j_{at} as (select section, id, case when {at} < old_len then greatest(0, least(new_len - 1, {at} + case when bs is not null and ({at} < bs + bn or fs is null or {at} - bs - bn < fs - {at}) then bd - bs else fd - fs end)) end as v from f_{at})"""


@query(_FRAMES, _PLACES.format(q="`"), RUNS, POINTS, MAPS, RANGES, oracle=f"""with q as ({_FRAMES}), r as ({RUNS}), l as (select section, id, addr from q), {_evidence("addr")}, {_projected("entry")}, {_projected("loc")}, {_projected("cie")},
y as (select q.*, e.v as ne, o.v as nl, c.v as nc, coalesce(x.a, x.b, x.c) as t, w.src_size as was, w.dst_size as now from q join j_entry e on e.section = q.section and e.id = q.id join j_loc o on o.section = q.section and o.id = q.id
 join j_cie c on c.section = q.section and c.id = q.id join x on x.section = q.section and x.id = q.id left join m w on w.section = q.section and w.src = q.addr),
z as (select *, ne is not null and nl is not null and nl >= 40 and nl + 4 <= 25040 as placed from y)
select section, id, entry, loc, cie, addr, size, old_len, new_len, case when placed and ne >= 40 and ne + 8 <= 25040 and nc >= 40 and nc < ne + 4 then ne + 4 - nc end as cie_back, case when placed then t - (700000 + nl - 40) end as location,
 case when placed and t is not null and nl + 8 <= 25040 and was = size and now <> size then now else size end as new_size, placed and t is not null as known from z""")
def unwind_rewrite(frames, places, runs_, points, maps_, ranges):
    return addresses.unwind_rewrite(frames, places, runs_, points, maps_, ranges, S)
