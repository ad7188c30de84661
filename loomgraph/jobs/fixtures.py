"""A code graph derived from the star-schema tables, in SQL that Spark and DuckDB both run.

The tables hold no source code, so suppliers stand for classes, their line numbers for methods, and lines of one order
that follow each other for calls. `ord` is a text that sorts as (phase, file, place in the file).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

from ..shared import stage

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

SUP = """
sup as (
  select s_suppkey as sk, s_nationkey as nk, 'com.acme.n' || cast(s_nationkey as string) as pkg,
         'Supplier' || cast(s_suppkey as string) as cls,
         'src/n' || cast(s_nationkey as string) || '/Supplier' || cast(s_suppkey as string) || '.java' as path
  from supplier
),
meth as (
  select distinct s.sk, s.pkg, s.cls, s.path, l.l_linenumber as ln
  from lineitem l join sup s on l.l_suppkey = s.sk
),
fld as (
  select distinct s.sk, s.pkg, s.cls, s.path, p.p_brand as brand
  from lineitem l join sup s on l.l_suppkey = s.sk join part p on l.l_partkey = p.p_partkey
)"""

NODES = (
    SUP
    + """,
nodes as (
  select 'tpch' as repo, 'project:tpch' as id, 'Project' as label, 'tpch' as name, 'tpch' as qualified_name, cast(null as string) as package_name,
         cast(null as string) as class_name, '' as file_path, cast(null as string) as return_type, cast(null as string) as type, '0||000' as ord
  union all
  select 'tpch', 'package:com.acme.n' || cast(n_nationkey as string), 'Package', 'com.acme.n' || cast(n_nationkey as string), 'com.acme.n' || cast(n_nationkey as string),
         null, null, '', null, null, '1|src/n' || cast(n_nationkey as string) || '|000' from nation
  union all
  select 'tpch', 'interface:com.acme.Region' || cast(r_regionkey as string), 'Interface', 'Region' || cast(r_regionkey as string), 'com.acme.Region' || cast(r_regionkey as string),
         'com.acme', null, 'src/Region' || cast(r_regionkey as string) || '.java', null, null, '1|src/Region' || cast(r_regionkey as string) || '.java|002' from region
  union all
  select 'tpch', 'file:' || path, 'File', cls || '.java', path, pkg, null, path, null, null, '1|' || path || '|001' from sup
  union all
  select 'tpch', 'class:' || pkg || '.' || cls, 'Class', cls, pkg || '.' || cls, pkg, null, path, null, null, '1|' || path || '|002' from sup
  union all
  select 'tpch', 'method:' || pkg || '.' || cls || '.' || cls || '()', 'Constructor', cls, pkg || '.' || cls || '.' || cls || '()', pkg, cls, path, null, null, '1|' || path || '|003' from sup
  union all
  select 'tpch', 'method:' || pkg || '.' || cls || '.handle' || cast(ln as string) || '()', 'Method', 'handle' || cast(ln as string), pkg || '.' || cls || '.handle' || cast(ln as string) || '()',
         pkg, cls, path, 'void', null, '1|' || path || '|1' || lpad(cast(ln as string), 3, '0') from meth
  union all
  select 'tpch', 'field:' || pkg || '.' || cls || '.' || brand, 'Field', brand, pkg || '.' || cls || '.' || brand, pkg, cls, path, null, 'String', '1|' || path || '|2' || brand from fld
)"""
)

CALLED = """
called as (
  select distinct a.l_suppkey as s1, a.l_linenumber as n1, b.l_suppkey as s2, b.l_linenumber as n2
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
  where a.l_suppkey <> b.l_suppkey
)"""

EDGES = (
    NODES
    + ","
    + CALLED
    + """,
raw_edges as (
  select 'project:tpch' as source_id, 'package:com.acme.n' || cast(n_nationkey as string) as target_id, 'CONTAINS' as type, cast(null as bigint) as line, '1|src/n' || cast(n_nationkey as string) || '|000' as ord from nation
  union all select 'package:' || pkg, 'file:' || path, 'CONTAINS', null, '1|' || path || '|001' from sup
  union all select 'file:' || path, 'class:' || pkg || '.' || cls, 'CONTAINS', null, '1|' || path || '|002' from sup
  union all select 'class:' || pkg || '.' || cls, 'method:' || pkg || '.' || cls || '.' || cls || '()', 'CONTAINS', null, '1|' || path || '|003' from sup
  union all select 'class:' || pkg || '.' || cls, 'method:' || pkg || '.' || cls || '.handle' || cast(ln as string) || '()', 'CONTAINS', null, '1|' || path || '|1' || lpad(cast(ln as string), 3, '0') from meth
  union all select 'class:' || pkg || '.' || cls, 'field:' || pkg || '.' || cls || '.' || brand, 'CONTAINS', null, '1|' || path || '|2' || brand from fld
  union all select 'class:' || s.pkg || '.' || s.cls, 'interface:com.acme.Region' || cast(n.n_regionkey as string), 'IMPLEMENTS', null, '3|' || s.path || '|002' from sup s join nation n on s.nk = n.n_nationkey
  union all select 'class:' || a.pkg || '.' || a.cls, 'class:' || b.pkg || '.' || b.cls, 'EXTENDS', null, '3|' || a.path || '|001' from sup a join sup b on b.sk = cast(floor(a.sk / 2) as bigint) where a.sk > 0
  union all select 'method:' || a.pkg || '.' || a.cls || '.handle' || cast(c.n1 as string) || '()', 'method:' || b.pkg || '.' || b.cls || '.handle' || cast(c.n2 as string) || '()', 'CALLS', cast(c.n1 as bigint),
            '4|' || a.path || '|' || lpad(cast(c.n1 as string), 3, '0') || '|' || b.path || lpad(cast(c.n2 as string), 3, '0')
            from called c join sup a on c.s1 = a.sk join sup b on c.s2 = b.sk
),
edges as (
  select 'tpch' as repo, source_id || '->' || target_id || ':' || type || coalesce(':' || cast(line as string), '') as id, source_id, target_id, type, cast(1.0 as double) as confidence, lower(type) as reason, line, ord from raw_edges
)"""
)

RESOLVER = """
rsup as (
  select s_suppkey as sk, 'com.acme.n' || cast(s_nationkey % 5 as string) as pkg, 'Supplier' || cast(s_suppkey as string) as cls,
         cast(floor(s_suppkey / 2) as bigint) as g, 'src/F' || lpad(cast(cast(floor(s_suppkey / 2) as bigint) as string), 6, '0') || '.java' as path,
         s_nationkey % 5 as nk5
  from supplier
),
places as (select cast(l_linenumber as bigint) as v from lineitem group by l_linenumber),
twenty as (select distinct l_orderkey % 20 as i from lineitem),
arities as (select distinct l_linenumber % 3 as a from lineitem),
method_refs as (
  select 'tpch' as repo, 'method:' || pkg || '.' || cls || '.m' || cast(i as string) || '/' || cast(a as string) as id, 'm' || cast(i as string) as name, cls as class_name, path as file_path,
         pkg as package_name, pkg || '.' || cls || '.m' || cast(i as string) as qualified_name, cast(a as int) as parameter_count,
         path || '|' || lpad(cast(sk as string), 9, '0') || lpad(cast(i as string), 3, '0') || cast(a as string) as ord
  from rsup cross join twenty cross join arities
  where (sk * 7 + i * 5 + a * 3) % 13 = 0 and not (i = 19 and a > 0)
),
first_method as (select class_name, min(id) as mid from method_refs group by class_name),
nsup as (select count(*) as n from supplier),
call_sites as (
  select 'tpch' as repo, coalesce(f.mid, 'method:' || c.pkg || '.' || c.cls || '.none') as caller_method_id, c.cls as caller_class, c.path as caller_file, c.pkg as caller_pkg,
         'm' || cast(l.l_orderkey % 20 as string) as simple_name,
         case when l.l_returnflag = 'R' then h.pkg || '.' || h.cls || '.m' || cast(l.l_orderkey % 20 as string) end as hint,
         cast(l.l_linenumber % 3 as int) as arg_count, l.l_orderkey as line, 'regex' as source, cast(null as string) as unsupported_reason
  from lineitem l join rsup c on l.l_suppkey = c.sk cross join nsup join rsup h on h.sk = l.l_partkey % nsup.n left join first_method f on f.class_name = c.cls
),
files as (select distinct g, path from rsup),
steps as (select distinct cast(l_linenumber as bigint) as d from lineitem),
imports as (
  select 'tpch' as repo, f.path as file_path, s.pkg || '.' || s.cls as import from files f cross join steps join rsup s on s.sk = f.g + 3 * steps.d where f.g % 4 = 1
  union all select 'tpch', path, 'com.acme.n' || cast((g + 1) % 5 as string) || '.*' from files where g % 4 = 2
  union all select 'tpch', f.path, 'static ' || s.pkg || '.' || s.cls || '.*' from files f cross join steps join rsup s on s.sk = f.g + steps.d - 1 where f.g % 8 = 7 and steps.d <= 5
  union all select 'tpch', f.path, 'static ' || s.pkg || '.' || s.cls || '.*' from files f cross join steps join rsup s on s.sk = f.g + (steps.d - 1) * 13 where f.g % 8 = 3 and steps.d <= 2
  union all select 'tpch', f.path, 'static ' || s.pkg || '.' || s.cls || '.m7' from files f join rsup s on s.sk = f.g + 1 where f.g % 4 = 0
)"""

CHANGES = """
changes as (
  select case event_type when 'click' then 'M' when 'view' then 'A' when 'purchase' then 'D' else 'R100' end as status,
         'src/U' || cast(user_id as string) || (case when user_id % 5 = 0 then '.JAVA' when user_id % 5 = 1 then '.txt' else '.java' end) as path,
         case when event_type not in ('click', 'view', 'purchase') then 'src/V' || cast(user_id % 97 as string) || '.java' end as new_path
  from events
)"""


class Tables:
    """The derived tables over one directory of source tables, as DataFrames. Nodes and edges are written once for a
    session and state of the directory, in the shared folder, and read from there by every query."""

    _staged: ClassVar[dict[tuple, DataFrame]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)

    def get(self, parts: str, name: str) -> DataFrame:
        return self.spark.sql(f"with {parts} select * from {name}")

    def _changed(self) -> tuple[int, ...]:
        """When each table was last written."""
        at = [self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{t}.parquet") for t in TABLES]
        return tuple(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime() for p in at)

    def staged(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self._changed(), name)
        if key not in self._staged:
            self._staged[key] = stage(make(), name)
        return self._staged[key]

    @property
    def nodes(self) -> DataFrame:
        return self.staged("nodes", lambda: self.get(NODES, "nodes"))

    @property
    def edges(self) -> DataFrame:
        return self.staged("edges", lambda: self.get(EDGES, "edges"))

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)
