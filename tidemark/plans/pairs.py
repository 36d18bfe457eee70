"""Version pairs and positioned data derived from the test tables, in SQL that Spark and DuckDB both read.

Tables are written in braces. ``section`` splits each into 16 parts that operators treat apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_CENTS = "cast(round(o_totalprice * 100) as bigint)"
#: Orders: some keys only on one side, none on neither, some totals a cent higher.
OLD = f"select o_custkey % 16 as section, o_orderkey as id, {_CENTS} as cents from {{orders}} where o_orderkey % 17 <> 0"
NEW = f"select o_custkey % 16 as section, o_orderkey as id, {_CENTS} + case when o_orderkey % 13 = 0 then 1 else 0 end as cents from {{orders}} where o_orderkey % 19 <> 0 or o_orderkey % 17 = 0"
#: Old orders laid out one after another in both versions, with sizes made of their totals.
_UPTO = "over (partition by section order by id rows between unbounded preceding and current row)"
UNITS = f"""select section, id, cast(sum(sz) {_UPTO} - sz as bigint) as src, sz as src_size, cast(sum(dz) {_UPTO} - dz as bigint) as dst, dz as dst_size,
  cast(row_number() over (partition by section order by id) - 1 as bigint) as ord from (select section, id, 16 + cents % 48 as sz, 16 + (cents * 7) % 48 as dz from ({OLD}) a) b"""
#: Every unit; a fifth of them are mapped by their first 8 positions only.
MAPS = f"select section, src, case when id % 5 = 0 then cast(8 as bigint) else src_size end as src_size, dst, dst_size from ({UNITS}) u"
RUNS = f"select section, src, dst, case when id % 3 = 0 then cast(4 as bigint) else least(src_size, dst_size) end as n from ({UNITS}) u"
POINTS = f"select section, src + id % 7 as old, dst + 1 as new from ({UNITS}) u"
RANGES = f"select section, src as old, dst as new, src_size as size from ({UNITS}) u"
PROBES = "select user_id % 16 as section, event_id, (event_id * 101) % 45000 as addr from {events}"
#: Shifts over positions.
MARKS = f"select section, src as off, dst - src as delta from ({UNITS}) u"
#: Order positions in their section, with the same order's value in both versions.
CELLS = f"""select a.section, a.ord as pos, a.cents % 251 as pred, case when a.id % 13 = 0 or a.id % 29 = 1 then (a.cents * 3 + 1) % 251 else a.cents % 251 end as want, a.id
  from (select section, id, cents, cast(row_number() over (partition by section order by id) - 1 as bigint) as ord from ({OLD}) o) a"""
VOTES = "select l_partkey as o, case when l_linenumber % 3 <> 0 then (l_partkey * 3) % 7 else l_suppkey % 7 end as n from {lineitem}"


def sql(text: str) -> str:
    """For DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **tables)
