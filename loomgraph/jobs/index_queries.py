"""Queries over the parser, the projections and whole indexes, on Java files derived from the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import build as B
from ..sources.javaparse import parse_sources
from . import fixtures as T
from . import index as I
from . import javatext as J
from .registry import query

JAVA = f"with {J.FILES}"
REGIONS = "(select r_regionkey as r, 'Region' || cast(r_regionkey as string) as cls, 'src/Region' || cast(r_regionkey as string) || '.java' as path from region)"


def sources(t: T.Tables) -> DataFrame:
    return t.staged("sources", lambda: J.sources(t.spark))


def parsed(t: T.Tables, mode: str = "fallback") -> DataFrame:
    return t.staged(f"parsed-{mode}", lambda: parse_sources(sources(t), mode))


def types(t: T.Tables, mode: str = "fallback") -> DataFrame:
    return B.explode_types(parsed(t, mode))


def joined(*columns: str):
    """The columns, arrays of them as their members joined by commas."""
    return [F.array_join(c, ",").alias(c) for c in columns]


# --- parsing -----------------------------------------------------------------------------------------------------

SUPER = "case when sk > 0 then 'Supplier' || cast(up as string) end"
PATHS = f"select path, pkg, cls from j_sup union all select path, 'com.acme', cls from {REGIONS}"
IMPORTS = """imp as (select path, 0 as pos, 'com.acme.Region' || cast(region as string) as import from j_sup union all select path, 1, 'java.util.*' from j_sup union all select path, 2, 'static ' || before_pkg || '.' || before_cls || '.handle1' from j_sup where before_cls is not null)"""
QN = "pkg || '.' || cls"
SIG = f"'handle' || cast(ln as string) || '(' || {J.TYPES_OF.format('ln')} || ')'"


def type_rows(with_region: bool = True) -> str:
    return f"select path as file_path, 'Class' as kind, cls as name, {QN} as qualified_name, {SUPER} as super_class, 'Region' || cast(region as string) || ',Runnable' as interfaces, 'public' as modifiers, 5 as start_line, cast(last as int) as end_line from j_sup join j_end using (sk) union all select path, 'Interface', cls, 'com.acme.' || cls, null, '', 'public', 3, 5 from {REGIONS}"


TYPES = f"{JAVA} {type_rows()}"
FIELDS = f"{JAVA} select path as file_path, {QN} as type_qn, name, 'String' as type, 'private,static' as modifiers, cast(5 + k as int) as line from j_fld join j_sup using (sk)"
CTOR = f"select path as file_path, {QN} as type_qn, cls as name, cls || '(int)' as signature, cast(null as varchar) as return_type, true as is_constructor, 'public' as modifiers, cast(6 + nf as int) as start_line, cast(7 + nf as int) as end_line from j_sup join j_nf using (sk)"
PLAIN = f"select path as file_path, {QN} as type_qn, 'handle' || cast(ln as string) as name, {SIG} as signature, 'void' as return_type, false as is_constructor, 'public' as modifiers, cast(first as int) as start_line, cast(first + nc + 1 as int) as end_line from j_meth join j_sup using (sk)"
PING = f"select path as file_path, 'com.acme.' || cls as type_qn, 'ping' as name, 'ping(int)' as signature, 'void' as return_type, false as is_constructor, '' as modifiers, 4 as start_line, 4 as end_line from {REGIONS}"
CALLS = f"{JAVA} select s.path as file_path, 'method:' || s.pkg || '.' || s.cls || '.' || {SIG.replace('ln', 'c.n1')} as method_id, 'handle' || cast(c.n2 as string) as simple_name, case when qualified then t.pkg || '.' || t.cls end as qualifier, cast(c.n2 % 3 as int) as arg_count, cast(m.first + c.k as int) as line from j_call c join j_sup s on s.sk = c.s1 join sup t on t.sk = c.s2 join j_meth m on m.sk = c.s1 and m.ln = c.n1"

METHOD_COLUMNS = ("file_path", "type_qn", "name", "signature", "return_type", "is_constructor")


def type_columns(df: DataFrame) -> DataFrame:
    return df.select("file_path", "kind", "name", "qualified_name", "super_class", *joined("interfaces", "modifiers"), "start_line", "end_line")


def method_columns(df: DataFrame) -> DataFrame:
    return df.select(*METHOD_COLUMNS, *joined("modifiers"), "start_line", "end_line")


def call_columns(df: DataFrame) -> DataFrame:
    return df.select("file_path", "method_id", "simple_name", "qualifier", "arg_count", "line")


query("parsed_files", f"{JAVA}, f as ({PATHS}), {IMPORTS} select f.path as file_path, pkg as package_name, (select count(*) from imp where imp.path = f.path)::int as imports, 1 as types, 'tree-sitter' as parser_source from f")(
    lambda t: parsed(t).select("file_path", "package_name", F.size("imports").alias("imports"), F.size("types").alias("types"), "parser_source")
)
query("explode_imports", f"{JAVA}, {IMPORTS} select path as file_path, pos, import from imp")(lambda t: B.explode_imports(parsed(t)).select("file_path", "pos", "import"))
query("explode_types", TYPES)(lambda t: type_columns(types(t)))
query("explode_fields", FIELDS)(lambda t: B.explode_fields(types(t)).select("file_path", "type_qn", "name", "type", *joined("modifiers"), "line"))
query("explode_methods", f"{JAVA} {CTOR} union all {PLAIN} union all {PING}")(lambda t: method_columns(B.explode_methods(types(t))))
query("explode_calls", CALLS)(lambda t: call_columns(B.explode_calls(B.explode_methods(types(t)))))
query("structural_types", TYPES)(lambda t: type_columns(types(t, "structural")))
query("structural_calls", CALLS)(lambda t: call_columns(B.explode_calls(B.explode_methods(types(t, "structural")))))
query("regex_types", TYPES)(lambda t: type_columns(types(t, "regex")))
query("regex_fields", FIELDS)(lambda t: B.explode_fields(types(t, "regex")).select("file_path", "type_qn", "name", "type", *joined("modifiers"), "line"))
query("regex_methods", f"{JAVA} {CTOR} union all {PLAIN}")(lambda t: method_columns(B.explode_methods(types(t, "regex"))))
query("regex_calls", CALLS)(lambda t: call_columns(B.explode_calls(B.explode_methods(types(t, "regex")))))
query("parser_fallback", f"select path as file_path, case when r % 2 = 0 then 'tree-sitter' else 'regex-fallback' end as parser_source, 1 as types from {REGIONS}")(
    lambda t: parse_sources(t.sql(f"select 'tpch' as repo, path as file_path, 'class ' || cls || case when r % 2 = 0 then ' {{ }}' else ' {{ void x() {{' end as source from {REGIONS}")).select("file_path", "parser_source", F.size("types").alias("types"))
)

# --- projections -------------------------------------------------------------------------------------------------

FILE_ROWS = f"files as ({PATHS})"


def files(t: T.Tables) -> DataFrame:
    return parsed(t).select("repo", "file_path", "package_name")


EDGE = "{0} || '->' || {1} || ':CONTAINS' as id"
TYPE_ID = "case kind when 'Class' then 'class:' else 'interface:' end || qualified_name"
query("project_nodes", "select 'project:tpch' as id, 'Project' as label, 'tpch' as name, '' as file_path")(lambda t: B.project_nodes(files(t).select("repo").distinct()).select("id", "label", "name", "file_path"))
query("package_nodes", f"{JAVA}, {FILE_ROWS} select 'package:' || pkg as id, pkg as name, count(*) as files from files group by pkg")(lambda t: B.package_nodes(files(t))[0].groupBy("id", "name").agg(F.count("*").alias("files")))
query("package_edges", f"{JAVA}, {FILE_ROWS} select distinct 'project:tpch->package:' || pkg || ':CONTAINS' as id, 'file-package' as reason from files")(lambda t: B.package_nodes(files(t))[1].select("id", "reason").distinct())
query("file_nodes", f"{JAVA}, {FILE_ROWS} select 'file:' || path as id, cls || '.java' as name, path as qualified_name, pkg as package_name from files")(lambda t: B.file_nodes(files(t))[0].select("id", "name", "qualified_name", "package_name"))
query("file_edges", f"{JAVA}, {FILE_ROWS} select {EDGE.format(chr(39) + 'package:' + chr(39) + ' || pkg', chr(39) + 'file:' + chr(39) + ' || path')}, 'package-file' as reason from files")(lambda t: B.file_nodes(files(t))[1].select("id", "reason"))
query("type_nodes", f"{JAVA}, t as ({type_rows()}) select {TYPE_ID} as id, kind as label, name, qualified_name, file_path, start_line, end_line, super_class, interfaces from t")(
    lambda t: B.type_nodes(types(t))[0].select("id", "label", "name", "qualified_name", "file_path", "start_line", "end_line", "super_class", *joined("interfaces"))
)
query("type_edges", f"{JAVA}, t as ({type_rows()}) select 'file:' || file_path || '->' || {TYPE_ID} || ':CONTAINS' as id, 'file:' || file_path as source_id, {TYPE_ID} as target_id from t")(lambda t: B.type_nodes(types(t))[1].select("id", "source_id", "target_id"))
query("field_nodes", f"with f as ({FIELDS}) select 'field:' || type_qn || '.' || name as id, name, type_qn || '.' || name as qualified_name, regexp_extract(type_qn, '[^.]*$') as class_name, type, true as is_static, line as start_line from f")(
    lambda t: B.field_nodes(B.explode_fields(types(t)))[0].select("id", "name", "qualified_name", "class_name", "type", "is_static", "start_line")
)
query("field_edges", f"with f as ({FIELDS}) select 'class:' || type_qn || '->field:' || type_qn || '.' || name || ':CONTAINS' as id, 'type-field' as reason from f")(lambda t: B.field_nodes(B.explode_fields(types(t)))[1].select("id", "reason"))
ALL_METHODS = f"with m as ({JAVA} {CTOR} union all {PLAIN} union all {PING})"
query("method_nodes", f"{ALL_METHODS} select 'method:' || type_qn || '.' || signature as id, case when is_constructor then 'Constructor' else 'Method' end as label, name, type_qn || '.' || signature as qualified_name, return_type, false as is_static, start_line, end_line from m")(
    lambda t: B.method_nodes(B.explode_methods(types(t)))[0].select("id", "label", "name", "qualified_name", "return_type", "is_static", "start_line", "end_line")
)
query("method_edges", f"{ALL_METHODS} select case name when 'ping' then 'interface:' else 'class:' end || type_qn || '->method:' || type_qn || '.' || signature || ':CONTAINS' as id, 'type-method' as reason from m")(lambda t: B.method_nodes(B.explode_methods(types(t)))[1].select("id", "reason"))
query("method_refs", f"{ALL_METHODS} select 'method:' || type_qn || '.' || signature as id, type_qn || '.' || name as qualified_name, case when signature like '%()' then 0 when signature like '%,%' then 2 else 1 end as parameter_count from m")(
    lambda t: B.method_refs(B.explode_methods(types(t))).select("id", "qualified_name", "parameter_count")
)
query("pending_calls", f"with c as ({CALLS}) select method_id as caller_method_id, simple_name, qualifier || '.' || simple_name as hint, arg_count, line, 'tree-sitter' as source from c")(
    lambda t: B.pending_calls(B.explode_calls(B.explode_methods(types(t)))).select("caller_method_id", "simple_name", "hint", "arg_count", "line", "source")
)
query("pending_inheritance", f"{JAVA}, t as ({type_rows()}) select {TYPE_ID} as source_type_id, super_class, interfaces from t")(lambda t: B.pending_inheritance(types(t)).select("source_type_id", "super_class", *joined("interfaces")))
PACKAGE = "case pos when 0 then 'com.acme' when 1 then 'java.util' else substr(import, 8) end"
query("import_edges", f"{JAVA}, {IMPORTS} select 'file:' || path || '->package:' || {PACKAGE} || ':IMPORTS' as id, import as reason from imp")(lambda t: B.import_edges(B.explode_imports(parsed(t)))[1].select("id", "reason"))
query("import_nodes", f"{JAVA}, {IMPORTS} select {PACKAGE} as name, count(*) as n from imp group by 1")(lambda t: B.import_edges(B.explode_imports(parsed(t)))[0].groupBy("name").agg(F.count("*").alias("n")))

# --- functions of names, over the same files -----------------------------------------------------------------------

WRITTEN = "select p_partkey as k, case p_partkey % 6 when 0 then 'java.util.List<String>[]' when 1 then 'List<x.Y>' when 2 then '? extends a.B' when 3 then 'int[][]' when 4 then ' Map<K, List<V>> ' else 'a.b.C' || cast(p_partkey as string) end as written from part"
CLEANED = f"w as ({WRITTEN}), c as (select k, case k % 6 when 0 then 'java.util.List' when 1 then 'List' when 2 then '' when 3 then 'int[]' when 4 then 'Map<K, List>' else 'a.b.C' || cast(k as string) end as clean from w)"
query("type_names", f"with {CLEANED} select k, clean, case when clean like '%.%' then regexp_extract(clean, '[^.]*$') else clean end as simple, case when clean like '%.%' then clean end as qualified from c")(
    lambda t: t.sql(WRITTEN).select("k", X.clean_type_name(F.col("written")).alias("clean"), X.simple_type_name(F.col("written")).alias("simple"), X.qualified_type_name(F.col("written")).alias("qualified"))
)
MODS = "select p_partkey as k, case p_partkey % 3 when 0 then ' public  static ' when 1 then '' else 'final' end as text from part"
query("split_modifiers", "select p_partkey as k, case p_partkey % 3 when 0 then 'public,static' when 1 then '' else 'final' end as modifiers from part")(lambda t: t.sql(MODS).select("k", F.array_join(X.split_modifiers(F.col("text")), ",").alias("modifiers")))
query("owner_type", f"{ALL_METHODS} select type_qn || '.' || name as name, type_qn as owner from m")(lambda t: B.method_refs(B.explode_methods(types(t))).select(F.col("qualified_name").alias("name"), X.owner_type(F.col("qualified_name")).alias("owner")))
query("import_package", f"{JAVA}, {IMPORTS} select distinct import, {PACKAGE} as package from imp")(lambda t: B.explode_imports(parsed(t)).select("import", X.import_package(F.col("import")).alias("package")).distinct())
query("relative_path", f"{JAVA}, {FILE_ROWS} select path, case when pkg like '%1' then cls || '.java' else path end as relative from files")(
    lambda t: files(t).select(F.col("file_path").alias("path"), X.relative_path(F.when(F.col("package_name").endswith("1"), F.concat(F.lit("/r/"), X.base_name(F.col("file_path")))).otherwise(F.col("file_path")), F.lit("/r")).alias("relative"))
)

# --- whole indexes -----------------------------------------------------------------------------------------------


def graph_sql(p: str, known: str, parts: str, region_types: bool, type_known: str) -> str:
    """CTEs p_nodes and p_edges of the files of p's suppliers (and of the regions), calls and supertypes resolved among the
    methods and types of the suppliers that `known` and `type_known` hold (SQL conditions on sk)."""
    region = region_types
    sig = lambda n: f"'handle' || cast({n} as string) || '(' || {J.TYPES_OF.format(n)} || ')'"
    regions = lambda text: f" union all {text}" if region else ""
    up_known = f"({type_known.replace('sk', 'up')})"
    face = "'interface:com.acme.Region' || cast(region as string)" if region else "'interface:external.Region' || cast(region as string)"
    return f"""{parts},
{p}_imp as (select path, 'com.acme' as pkg, 'com.acme.Region' || cast(region as string) as import from {p}_sup union all select path, 'java.util', 'java.util.*' from {p}_sup union all select path, before_pkg || '.' || before_cls || '.handle1', 'static ' || before_pkg || '.' || before_cls || '.handle1' from {p}_sup where before_cls is not null),
{p}_files as (select path, pkg, cls from {p}_sup{regions(f"select path, 'com.acme', cls from {REGIONS}")}),
{p}_nodes as (
  select 'project:tpch' as id, 'Project' as label, 'tpch' as name, '' as file_path, cast(null as int) as start_line
  union all select distinct 'package:' || pkg, 'Package', pkg, '', null::int from (select pkg from {p}_files union select pkg from {p}_imp)
  union all select 'file:' || path, 'File', cls || '.java', path, null from {p}_files
  union all select 'class:' || {QN}, 'Class', cls, path, 5 from {p}_sup
  {regions(f"select 'interface:com.acme.' || cls, 'Interface', cls, path, 3 from {REGIONS}")}
  {regions(f"select 'method:com.acme.' || cls || '.ping(int)', 'Method', 'ping', path, 4 from {REGIONS}")}
  union all select 'field:' || {QN} || '.' || name, 'Field', name, path, cast(5 + k as int) from {p}_fld join {p}_sup using (sk)
  union all select 'method:' || {QN} || '.' || cls || '(int)', 'Constructor', cls, path, cast(6 + nf as int) from {p}_sup join {p}_nf using (sk)
  union all select 'method:' || {QN} || '.' || {sig("ln")}, 'Method', 'handle' || cast(ln as string), path, cast(first as int) from {p}_meth join {p}_sup using (sk)
  union all select distinct 'class:external.Supplier' || cast(up as string), 'Class', 'Supplier' || cast(up as string), '', null::int from {p}_sup where sk > 0 and not {up_known}
  union all select 'interface:external.Runnable', 'Interface', 'Runnable', '', null
  {"" if region else f"union all select distinct {face}, 'Interface', 'Region' || cast(region as string), '', null::int from {p}_sup"}
),
{p}_asked as (select c.*, s.pkg, s.cls, m.first + c.k as line, s.before_pkg, s.before_cls, t.pkg as pkg2, t.cls as cls2, {known.replace("sk", "c.s2")} as hits, s.before_cls is not null and c.n2 = 1 and not qualified and {known.replace("sk", "(c.s1 - 1)")} as static
  from {p}_call c join {p}_sup s on s.sk = c.s1 join sup t on t.sk = c.s2 join {p}_meth m on m.sk = c.s1 and m.ln = c.n1),
{p}_found as (select 'method:' || pkg || '.' || cls || '.' || {sig("n1")} as source_id, case when static then 'method:' || before_pkg || '.' || before_cls when qualified and hits then 'method:' || pkg2 || '.' || cls2 else 'method:' || pkg || '.' || cls end || '.' || {sig("n2")} as target_id,
  'CALLS' as type, case when static then 'static-import-owner-arity-exact' when qualified and hits then 'qualifiedName-exact' else 'name-arity-same-class' end as strategy, case when static then 0.9 when qualified and hits then 0.95 else 0.85 end::double as confidence, n2, line from {p}_asked),
{p}_edges as (
  select distinct 'project:tpch->package:' || pkg || ':CONTAINS' as id, 'project:tpch' as source_id, 'package:' || pkg as target_id, 'CONTAINS' as type, 'file-package' as reason, 1.0::double as confidence from {p}_files
  union all select 'package:' || pkg || '->file:' || path || ':CONTAINS', 'package:' || pkg, 'file:' || path, 'CONTAINS', 'package-file', 1.0 from {p}_files
  union all select 'file:' || path || '->class:' || {QN} || ':CONTAINS', 'file:' || path, 'class:' || {QN}, 'CONTAINS', 'file-type', 1.0 from {p}_sup
  {regions(f"select 'file:' || path || '->interface:com.acme.' || cls || ':CONTAINS', 'file:' || path, 'interface:com.acme.' || cls, 'CONTAINS', 'file-type', 1.0 from {REGIONS}")}
  {regions(f"select 'interface:com.acme.' || cls || '->method:com.acme.' || cls || '.ping(int):CONTAINS', 'interface:com.acme.' || cls, 'method:com.acme.' || cls || '.ping(int)', 'CONTAINS', 'type-method', 1.0 from {REGIONS}")}
  union all select 'class:' || {QN} || '->field:' || {QN} || '.' || name || ':CONTAINS', 'class:' || {QN}, 'field:' || {QN} || '.' || name, 'CONTAINS', 'type-field', 1.0 from {p}_fld join {p}_sup using (sk)
  union all select 'class:' || {QN} || '->method:' || {QN} || '.' || cls || '(int):CONTAINS', 'class:' || {QN}, 'method:' || {QN} || '.' || cls || '(int)', 'CONTAINS', 'type-method', 1.0 from {p}_sup
  union all select 'class:' || {QN} || '->method:' || {QN} || '.' || {sig("ln")} || ':CONTAINS', 'class:' || {QN}, 'method:' || {QN} || '.' || {sig("ln")}, 'CONTAINS', 'type-method', 1.0 from {p}_meth join {p}_sup using (sk)
  union all select 'file:' || path || '->package:' || pkg || ':IMPORTS', 'file:' || path, 'package:' || pkg, 'IMPORTS', import, 1.0 from {p}_imp
  union all select 'class:' || s.pkg || '.' || s.cls || '->' || x.target || ':EXTENDS', 'class:' || s.pkg || '.' || s.cls, x.target, 'EXTENDS', 'class-extends', 1.0 from {p}_sup s join sup u on u.sk = s.up, lateral (select case when {up_known.replace("up", "s.up")} then 'class:' || u.pkg || '.' || u.cls else 'class:external.' || u.cls end as target) x where s.sk > 0
  union all select 'class:' || {QN} || '->' || {face} || ':IMPLEMENTS:Region' || cast(region as string), 'class:' || {QN}, {face}, 'IMPLEMENTS', 'class-implements', 1.0 from {p}_sup
  union all select 'class:' || {QN} || '->interface:external.Runnable:IMPLEMENTS:Runnable', 'class:' || {QN}, 'interface:external.Runnable', 'IMPLEMENTS', 'class-implements', 1.0 from {p}_sup
  union all select source_id || '->' || target_id || ':CALLS:handle' || cast(n2 as string) || ':' || cast(line as bigint), source_id, target_id, type, 'strategy=' || strategy || ';source=tree-sitter', confidence from {p}_found where source_id <> target_id
)"""


FULL = f"with {J.BASE}, {graph_sql('j', 'true', J.java(), True, 'true').lstrip()}"
NODE_COLUMNS, EDGE_COLUMNS = ("id", "label", "name", "file_path", "start_line"), ("id", "source_id", "target_id", "type", "reason", "confidence")


def indexed(t: T.Tables) -> tuple[DataFrame, DataFrame]:
    made = []

    def make(i: int) -> DataFrame:
        made.extend(made or I.index_full(sources(t)))
        return made[i]

    return t.staged("index-nodes", lambda: make(0)), t.staged("index-edges", lambda: make(1))


query("index_nodes", f"{FULL} select * from j_nodes")(lambda t: indexed(t)[0].select(*NODE_COLUMNS))
query("index_edges", f"{FULL} select * from j_edges")(lambda t: indexed(t)[1].select(*EDGE_COLUMNS))

#: Every fifth file is changed (its fields are gone), of the others some are deleted.
CHANGED, DELETED = "(sk % 5 = 0)", "(sk % 7 = 3 and sk % 5 <> 0)"
CHANGES = f"select 'tpch' as repo, path as file_path, {CHANGED} as to_index, true as to_invalidate from sup where {CHANGED} or {DELETED}"


def refreshed_sql(known: str, region: bool) -> str:
    patch = graph_sql("p", known, J.java("p", CHANGED, fields=False), region, known)
    if region:  # regions' types are known, but their files are no part of the patch
        for text in (f" union all select path, 'com.acme', cls from {REGIONS}", f" union all select 'interface:com.acme.' || cls, 'Interface', cls, path, 3 from {REGIONS}", f" union all select 'method:com.acme.' || cls || '.ping(int)', 'Method', 'ping', path, 4 from {REGIONS}"):
            patch = patch.replace(text, "")
        patch = "\n".join(line for line in patch.split("\n") if "'interface:com.acme.' || cls" not in line)
    return f"""{FULL}, {patch.lstrip()},
gone as materialized (select path from sup where {CHANGED} or {DELETED}),
keep as materialized (select * from j_nodes where file_path not in (select path from gone)),
mn as materialized (select * from keep union all select * from p_nodes where id not in (select id from keep)),
be as materialized (select e.* from j_edges e where source_id in (select id from keep) and target_id in (select id from mn)),
me as (select * from be union all select * from p_edges where source_id in (select id from mn) and target_id in (select id from mn) and id not in (select id from be))"""


def refreshed(t: T.Tables, against: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = indexed(t)
    made = []

    def make(i: int) -> DataFrame:
        if not made:
            patch = J.sources(t.spark, f"{J.BASE}, {J.java('p', CHANGED, fields=False).lstrip()}", "p", regions=False)
            made.extend(I.index_incremental(nodes, edges, patch, t.sql(f"with {J.BASE} {CHANGES}"), resolve_against=against))
        return made[i]

    return t.staged(f"refreshed-nodes-{against}", lambda: make(0)), t.staged(f"refreshed-edges-{against}", lambda: make(1))


PATCHED, MERGED = refreshed_sql(CHANGED, False), refreshed_sql(f"(not {DELETED})", True)
query("index_incremental_nodes", f"{PATCHED} select * from mn")(lambda t: refreshed(t, "patch")[0].select(*NODE_COLUMNS))
query("index_incremental_edges", f"{PATCHED} select * from me")(lambda t: refreshed(t, "patch")[1].select(*EDGE_COLUMNS))
query("index_merged_nodes", f"{MERGED} select * from mn")(lambda t: refreshed(t, "merged")[0].select(*NODE_COLUMNS))
query("index_merged_edges", f"{MERGED} select * from me")(lambda t: refreshed(t, "merged")[1].select(*EDGE_COLUMNS))
