"""The registered code-graph queries and, for each, the SQL that DuckDB answers it with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import merge as M
from ..operators import patterns as P
from ..operators import resolve as R
from ..operators import search as S
from ..operators import search_index as SI
from ..operators import traversal as V
from ..shared import new_path, stage
from ..sources import store
from . import fixtures as T
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]



def _once(text: str) -> str:
    """DuckDB works out nodes, edges and calls once a query instead of at each mention."""
    for name in ("nodes", "edges", "called"):
        text = text.replace(f"\n{name} as (", f"\n{name} as materialized (")
    return text


N, E = _once(f"with {T.NODES}"), _once(f"with {T.EDGES}")
RES, CHG = f"with {T.RESOLVER}", f"with {T.CHANGES}"
LABELLED = "'Class','Interface','Enum','Annotation','Method','Constructor','Field'"
CLASS_NAMES = "select 'Supplier' || cast(s_suppkey as string) as name from supplier"

# --- filters -----------------------------------------------------------------------------------------------------

query("nodes_by_label", f"{N} select id, name from nodes where label = 'Class'")(lambda t: P.nodes_by_label(t.nodes, "Class").select("id", "name"))
query("nodes_by_name", f"{N} select id, label from nodes where name in ({CLASS_NAMES})")(lambda t: P.nodes_by_name(t.nodes, t.sql(CLASS_NAMES)).select("id", "label"))
query("nodes_by_label_name", f"{N} select id, name from nodes where label = 'Constructor' and name in ({CLASS_NAMES})")(lambda t: P.nodes_by_label_name(t.nodes, t.sql(CLASS_NAMES).withColumn("label", F.lit("Constructor"))).select("id", "name"))

SYMBOLS = "select s_suppkey as query_id, case when s_suppkey % 2 = 0 then 'Supplier' || cast(s_suppkey as string) else 'com.acme.n' || cast(s_nationkey as string) || '.Supplier' || cast(s_suppkey as string) end as symbol from supplier"
query("nodes_by_name_or_qname", f"{N}, q as ({SYMBOLS}) select query_id, id from nodes, q where name = symbol or qualified_name = symbol")(lambda t: P.nodes_by_name_or_qname(t.nodes, t.sql(SYMBOLS)).select("query_id", "id"))
query("nodes_name_contains", f"{N} select row_number() over (order by name, id) as position, id, name from nodes where contains(name, 'plier1') and label = 'Class'")(lambda t: P.numbered(P.nodes_name_contains(t.nodes, "plier1", "Class")).select("position", "id", "name"))
PACKAGES = "select 'com.acme.n' || cast(n_nationkey as string) as package from nation union all select 'com.acme'"
query("classes_in_package", f"{N}, q as ({PACKAGES}) select package, id from nodes, q where label = 'Class' and starts_with(qualified_name, package || '.')")(lambda t: P.classes_in_package(t.nodes, t.sql(PACKAGES)).select("package", "id"))
query("searchable_nodes", f"{N} select id from nodes where label in ({LABELLED})")(lambda t: P.searchable_nodes(t.nodes).select("id"))
query("edges_by_type", f"{E} select id, source_id, target_id from edges where type = 'IMPLEMENTS'")(lambda t: P.edges_by_type(t.edges, "IMPLEMENTS").select("id", "source_id", "target_id"))
query("limit_n", f"{N} select id, name from nodes where label = 'Method' order by ord limit 20")(lambda t: P.limit_n(P.nodes_by_label(t.nodes, "Method")).select("id", "name"))
query("sort_names", f"{N} select row_number() over (order by name, id) as position, id, name from nodes where label = 'Method'")(lambda t: P.numbered(P.sort_names(P.nodes_by_label(t.nodes, "Method"))).select("position", "id", "name"))
query("symbol_view", f'{N} select id, name, label as type, qualified_name as "qualifiedName", file_path as file, return_type as "returnType", type as "fieldType" from nodes')(lambda t: P.symbol_view(t.nodes))
query("return_columns", f'{N} select name as "n.name", label as "n.label", cast(null as varchar) as "n.nothing" from nodes')(lambda t: P.return_columns(t.nodes, "n", ["name", "label", "nothing"]))
query("return_all_columns", f'{N} select id as "n.id", name as "n.name", label as "n.label" from nodes')(lambda t: P.return_columns(t.nodes.select("id", "name", "label"), "n", ["*"]))
query("changed_java_paths", f"{CHG} select path from changes where lower(path) like '%.java'")(lambda t: M.changed_java_paths(t.get(T.CHANGES, "changes")).select("path"))

# --- joins -------------------------------------------------------------------------------------------------------

ENDS = "edges e join nodes s on e.source_id = s.id join nodes t on e.target_id = t.id"
query("match_edges", f"{E} select e.id as edge_id, s.name as source_name, t.name as target_name from {ENDS} where s.label = 'Class' and e.type = 'CONTAINS'")(lambda t: P.match_edges(t.nodes, t.edges, source_label="Class", kind="CONTAINS").select("edge_id", "source_name", "target_name"))
query("class_relationships", f"""{E} select s.name as "from", e.type as rel, t.name as "to", t.label as "targetType" from {ENDS} where s.label = 'Class'""")(lambda t: P.class_relationships(t.nodes, t.edges))
query("class_to_class_edges", f"""{E} select s.name as "from", e.type as rel, t.name as "to" from {ENDS} where s.label = 'Class' and t.label = 'Class'""")(lambda t: P.class_to_class_edges(t.nodes, t.edges))
query("class_call_pairs", f"""{E}, own as (select e.target_id as m, s.name as c from {ENDS} where s.label = 'Class' and t.label = 'Method' and e.type = 'CONTAINS')
select distinct a.c as from_class, b.c as to_class from edges e join own a on a.m = e.source_id join own b on b.m = e.target_id where e.type = 'CALLS'""")(lambda t: P.class_call_pairs(t.nodes, t.edges))
query("distinct_pairs", f"{E} select distinct s.label as source_label, t.label as target_label from {ENDS}")(lambda t: P.distinct_pairs(P.match_edges(t.nodes, t.edges), "source_label", "target_label"))
CALL_PAIRS = "select distinct 'handle' || cast(l_linenumber as string) as from_name, 'handle' || cast(l_linenumber + l_suppkey % 3 as string) as to_name from lineitem"
query("call_exists", f"{E}, q as ({CALL_PAIRS}) select * from q where exists (select 1 from {ENDS} where e.type = 'CALLS' and s.name = q.from_name and t.name = q.to_name)")(lambda t: P.call_exists(t.nodes, t.edges, t.sql(CALL_PAIRS)))
query("class_members", f"{E} select s.name as class_name, t.id as member_id, t.name as member from {ENDS} where s.label = 'Class' and t.label = 'Field' and e.type = 'CONTAINS'")(lambda t: P.class_members(t.nodes, t.edges, "Field"))
query("class_member_methods", f"{E} select s.name as class_name, t.id as member_id, t.name as member from {ENDS} where s.label = 'Class' and t.label = 'Method' and e.type = 'CONTAINS' and s.name in ({CLASS_NAMES})")(lambda t: P.class_members(t.nodes, t.edges, "Method", t.sql(CLASS_NAMES)))
METHODS = "select distinct 'handle' || cast(l_linenumber as string) as name from lineitem"
query("method_callees", f"{E} select distinct s.name as method, t.name as callee, t.id as callee_id from {ENDS} where e.type = 'CALLS' and s.label = 'Method' and s.name in ({METHODS})")(lambda t: P.method_callees(t.nodes, t.edges, t.sql(METHODS)))
query("method_callers", f"{E} select distinct t.name as method, s.name as caller, s.id as caller_id from {ENDS} where e.type = 'CALLS' and t.label = 'Method' and t.name in ({METHODS})")(lambda t: P.method_callers(t.nodes, t.edges, t.sql(METHODS)))
query("symbol_relationships", f"""{E} select s.name, 'out' as direction, e.type, t.name as other, e.id as edge_id from {ENDS} where s.name in ({CLASS_NAMES})
union all select t.name, 'in', e.type, s.name, e.id from {ENDS} where t.name in ({CLASS_NAMES})""")(lambda t: P.symbol_relationships(t.nodes, t.edges, t.sql(CLASS_NAMES)))
query("superclasses", f"{E} select s.name, t.name as super, e.type from {ENDS} where e.type in ('EXTENDS', 'IMPLEMENTS') and s.name in ({CLASS_NAMES})")(lambda t: P.superclasses(t.nodes, t.edges, t.sql(CLASS_NAMES)))
query("subclasses", f"{E} select t.name, s.name as sub, e.type from {ENDS} where e.type in ('EXTENDS', 'IMPLEMENTS') and s.label = 'Class' and t.name in ({CLASS_NAMES})")(lambda t: P.subclasses(t.nodes, t.edges, t.sql(CLASS_NAMES)))

# --- counts ------------------------------------------------------------------------------------------------------

query("count_nodes", f"{N} select count(*) as n from nodes")(lambda t: P.count_nodes(t.nodes))
query("count_by_label", f"{N} select label, count(*) as n from nodes group by label")(lambda t: P.count_by_label(t.nodes))
query("graph_stats", f"""{E} select count(*) as nodes, count(*) filter (label = 'Class') as classes, count(*) filter (label = 'Method') as methods, count(*) filter (label = 'Field') as fields,
count(*) filter (label = 'Interface') as interfaces, count(*) filter (label = 'Enum') as enums, (select count(*) from edges) as relationships from nodes""")(lambda t: P.graph_stats(t.nodes, t.edges))
query("methods_per_class", f"{E} select row_number() over (order by count(*) desc, min(e.ord)) as position, s.name as class_name, count(*) as methods from {ENDS} where s.label = 'Class' and t.label = 'Method' and e.type = 'CONTAINS' group by s.name")(lambda t: P.numbered(P.methods_per_class(t.nodes, t.edges)))
query("count_name_contains", f"{N} select count(*) as n from nodes where label in ('Class', 'Constructor') and contains(name, 'plier1')")(lambda t: P.count_name_contains(t.nodes, "plier1"))
SAMPLES = "select event_type as scenario, value as latency_ms from events"
query("latency_summary", "select event_type as scenario, count(*) as samples, round(quantile_disc(value, 0.5), 2) as p50_ms, round(quantile_disc(value, 0.95), 2) as p95_ms, round(count(*) / (sum(value) / 1000), 2) as throughput from events group by event_type")(lambda t: P.latency_summary(t.sql(SAMPLES)))
query("first_wins", f"{E}, b as (select target_id as id, type, id as edge from edges) select id, arg_min(type, edge) as type, min(edge) as edge from b group by id")(
    lambda t: P.first_wins(t.edges.select(F.col("target_id").alias("id"), "type", F.col("id").alias("edge")), ["id"], "edge")
)
query("first_candidate", f"{RES} select name, arg_min(id, ord) as id, count(*) as candidates from method_refs group by name")(lambda t: P.first_candidate(t.get(T.RESOLVER, "method_refs"), ["name"], "id"))

# --- search ------------------------------------------------------------------------------------------------------

TOKENS = r"list_filter(string_split_regex(lower(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9_]+'), lambda x: x <> '')"
TEXT = "concat_ws(' ', nullif(name, ''), nullif(qualified_name, ''), nullif(package_name, ''), nullif(class_name, ''), nullif(return_type, ''), nullif(type, ''), nullif(file_path, ''))"
DOCS = f"docs as (select *, {TOKENS.format(TEXT)} as tokens from nodes where label in ({LABELLED}))"
TF = f"{N}, {DOCS}, tok as (select id, unnest(tokens) as token from docs), tf as (select id, token, count(*) as tf from tok group by id, token), len as (select id, greatest(len(tokens), 1) as length from docs), size as (select count(*) as n, avg(length) as avg_length from len), df as (select token, count(*) as df from tf group by token)"
query("document_text", f"{N} select id, {TEXT} as document from nodes")(lambda t: t.nodes.select("id", X.document_text().alias("document")))
query("tokenize", f"select doc_id, len({TOKENS.format('text')}) as n, array_to_string({TOKENS.format('text')}, ' ') as tokens from documents")(lambda t: t.sql("select doc_id, text from documents").select("doc_id", X.tokenize(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens")))
query("term_frequency", f"{TF} select id, token, tf, length from tf join len using (id)")(lambda t: S.term_frequency(S.documents(t.nodes)).select("id", "token", "tf", "length"))
query("document_frequency", f"{TF} select token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from df, size")(
    lambda t: S.document_frequency(S.term_frequency(d := S.documents(t.nodes)), S.average_length(d)).select("token", "df", F.round("idf", 6).alias("idf"))
)
query("average_length", f"{TF} select n, round(avg_length, 6) as avg_length from size")(lambda t: S.average_length(S.documents(t.nodes)).select("n", F.round("avg_length", 6).alias("avg_length")))

SEARCHES = "select cast(n_nationkey as bigint) as query_id, case when n_nationkey % 3 = 0 then 'Supplier' || cast(n_nationkey as string) when n_nationkey % 3 = 1 then 'handle' || cast(n_nationkey % 7 as string) || ' n' || cast(n_nationkey as string) || ' void void' else 'getRegion' || cast(n_nationkey % 5 as string) || ' String' end as query from nation union all select -1, 'nothing at all here' union all select -2, ''"
HITS = f"""{TF}, q as ({SEARCHES}), qt as (select query_id, unnest({TOKENS.format("query")}) as token from q), qc as (select query_id, token, count(*) as times from qt group by all),
scored as (select qc.query_id, tf.id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 4) as score
  from qc join tf using (token) join df using (token) join len using (id), size group by qc.query_id, tf.id),
hits as (select * from (select s.*, d.name, d.qualified_name, d.label, d.file_path, row_number() over (partition by query_id order by score desc, ord)::int as rank from scored s join nodes d using (id) where score > 0) where rank <= 10)"""
query("bm25_search", f"{HITS} select query_id, rank, id, name, score from hits")(lambda t: S.bm25_search(t.nodes, t.sql(SEARCHES)).select("query_id", "rank", "id", "name", "score"))
query("search_rank", f"{HITS} select query_id, rank, id from hits where rank <= 3")(lambda t: S.bm25_search(t.nodes, t.sql(SEARCHES), 3).select("query_id", "rank", "id"))
query("search_substring_postfilter", f"{HITS} select query_id, rank, id from hits join q using (query_id) where contains(lower(name), lower(query)) or contains(lower(qualified_name), lower(query))")(
    lambda t: S.search_substring_postfilter(S.bm25_search(t.nodes, q := t.sql(SEARCHES)), q).select("query_id", "rank", "id")
)
query("search_by_type", f"{HITS} select query_id, rank, id from hits where label = 'Method'")(lambda t: S.search_by_type(S.bm25_search(t.nodes, t.sql(SEARCHES)), "Method").select("query_id", "rank", "id"))
query("query_tool", f"{HITS} select query_id, rank, id, name, case label when 'Constructor' then 'Class' else label end as type, file_path, score from hits join q using (query_id) where contains(lower(name), lower(query)) or contains(lower(qualified_name), lower(query))")(
    lambda t: S.query_tool(t.nodes, t.sql(SEARCHES))
)
query("query_cli", f"{HITS} select query_id, rank, printf('%d. %s [%s] %s score=%.4f', rank, name, label, file_path, score) as line from hits union all select query_id, 0, 'No results.' from q where query_id not in (select query_id from hits)")(
    lambda t: S.query_cli(t.nodes, t.sql(SEARCHES))
)

# --- traversal ---------------------------------------------------------------------------------------------------

TARGETS = "select cast(r_regionkey as bigint) as query_id, 'Region' || cast(r_regionkey as string) as target from region union all select 100 + cast(n_nationkey as bigint), 'com.acme.n' || cast(n_nationkey as string) from nation union all select -1, 'nobody'"


def impact_sql(here: str, there: str) -> str:
    """Three levels, each with the least path key; the oracle of impact()."""
    ctes = [f"q as ({TARGETS})", "l0 as (select query_id, n.id, [n.ord] as k, '' as via, 0 as depth from q join nodes n on n.name = q.target)"]
    seen = "select query_id, id from l0"
    for d in (1, 2, 3):
        ctes.append(f"r{d} as (select f.query_id, e.{there} as id, list_append(f.k, e.ord) as k, e.type from l{d - 1} f join edges e on e.{here} = f.id)")
        ctes.append(f"l{d} as (select query_id, id, min(k) as k, arg_min(type, k) as via, {d} as depth from r{d} where (query_id, id) not in ({seen}) group by query_id, id)")
        seen += f" union all select query_id, id from l{d}"
    return f"{E}, {', '.join(ctes)}, found as (select f.query_id, f.id, n.name, n.label, f.depth, f.via from (select * from l1 union all select * from l2 union all select * from l3) f join nodes n using (id))"


UP, DOWN = impact_sql("target_id", "source_id"), impact_sql("source_id", "target_id")
query("impact_upstream", f"{UP} select * from found")(lambda t: V.impact(t.nodes, t.edges, t.sql(TARGETS)).drop("repo"))
query("impact_downstream", f"{DOWN} select * from found")(lambda t: V.impact(t.nodes, t.edges, t.sql(TARGETS), direction="downstream").drop("repo"))
query("impact_tool", f"""{UP} select f.query_id, f.id, f.name, f.label as type, f.depth, f.via as "relationshipType", q.target || '/' || f.name as path from found f join q using (query_id) where via <> 'CONTAINS'""")(
    lambda t: V.impact_tool(t.nodes, t.edges, t.sql(TARGETS)).withColumn("path", F.array_join("path", "/"))
)
query("impact_target", f"{N}, q as ({TARGETS}), f as (select name, arg_min(label, ord) as type from nodes group by name) select query_id, target as name, type from q left join f on f.name = q.target")(lambda t: V.impact_target(t.nodes, t.sql(TARGETS)))
PATH_TARGETS = "select 100 + cast(n_nationkey as bigint) as query_id, 'com.acme.n' || cast(n_nationkey as string) as target from nation"
query("impact_paths", f"""{E}, q as ({PATH_TARGETS}), st as (select e.source_id, e.target_id, n.name from edges e join nodes n on n.id = e.target_id where e.type in ('CALLS', 'CONTAINS')),
p1 as (select query_id, s.target_id as at, target || '/' || s.name as names from q join nodes n on n.name = q.target join st s on s.source_id = n.id), p2 as (select query_id, s.target_id as at, names || '/' || s.name as names from p1 join st s on s.source_id = p1.at),
p3 as (select query_id, s.target_id as at, names || '/' || s.name as names from p2 join st s on s.source_id = p2.at) select query_id, 1 as depth, names from p1 union all select query_id, 2, names from p2 union all select query_id, 3, names from p3""")(
    lambda t: V.impact_paths(t.nodes, t.edges, t.sql(PATH_TARGETS)).withColumn("names", F.array_join("names", "/"))
)
CHAINS = "select s_suppkey as query_id, 'Supplier' || cast(s_suppkey as string) as name from supplier"
query("inheritance_chain", f"""{E.replace("with", "with recursive", 1)}, q as ({CHAINS}), ch as (select query_id, e.target_id as id from q join nodes n on n.name = q.name and n.label = 'Class' join edges e on e.source_id = n.id and e.type = 'EXTENDS'
union select ch.query_id, e.target_id from ch join edges e on e.source_id = ch.id and e.type = 'EXTENDS')
select query_id, id, name from ch join nodes using (id) where (query_id, id) not in (select query_id, n.id from q join nodes n on n.name = q.name and n.label = 'Class')""")(lambda t: V.inheritance_chain(t.nodes, t.edges, t.sql(CHAINS)))
CONTEXTS = f"{SYMBOLS} union all select 100000 + cast(r_regionkey as bigint), 'Region' || cast(r_regionkey as string) from region union all select -1, 'nobody'"
FIRST_HIT = "hit as (select query_id, n.id, n.ord from q join nodes n on n.name = q.symbol or n.qualified_name = q.symbol), cnt as (select query_id, count(*) as matches, min(id) as id, string_agg(id, ',' order by ord, id) as candidates from hit group by query_id)"
query("symbol_context", f"""{E}, q as ({CONTEXTS}), {FIRST_HIT}, io as (select c.query_id, string_agg(e.type || ' ' || s.name || '>' || t.name, ',' order by e.ord, e.type, s.name, t.name) filter (e.target_id = c.id) as incoming,
string_agg(e.type || ' ' || s.name || '>' || t.name, ',' order by e.ord, e.type, s.name, t.name) filter (e.source_id = c.id) as outgoing from cnt c join {ENDS} on (e.target_id = c.id or e.source_id = c.id) where matches = 1 group by c.query_id)
select q.query_id, coalesce(matches, 0) as matches, case when matches = 1 then cnt.id end as id, case when matches > 1 then candidates end as candidates, case when matches = 1 then coalesce(incoming, '') end as incoming, case when matches = 1 then coalesce(outgoing, '') end as outgoing
from q left join cnt using (query_id) left join io using (query_id)""")(
    lambda t: V.symbol_context(t.nodes, t.edges, t.sql(CONTEXTS)).select(
        "query_id", "matches", "id", F.array_join("candidates", ",").alias("candidates"), *[F.array_join(F.transform(c, lambda e: F.concat(e["type"], F.lit(" "), e["from"], F.lit(">"), e["to"])), ",").alias(c) for c in ("incoming", "outgoing")]
    )
)
query("context_tool", f"""{E}, q as ({CONTEXTS}), {FIRST_HIT}, f as (select query_id, arg_min(id, ord) as id from hit group by query_id), r as (select f.query_id, t.name, t.label, e.type, e.ord from f join {ENDS} on e.source_id = f.id)
select q.query_id, coalesce((select string_agg(name, ',' order by ord, name) from r where r.query_id = q.query_id and type = 'CONTAINS' and label = 'Method'), '') as methods,
coalesce((select string_agg(name, ',' order by ord, name) from r where r.query_id = q.query_id and type = 'CONTAINS' and label = 'Field'), '') as fields, coalesce((select string_agg(name, ',' order by ord, name) from r where r.query_id = q.query_id and type = 'CALLS'), '') as calls from q""")(
    lambda t: V.context_tool(t.nodes, t.edges, t.sql(CONTEXTS)).select("query_id", *[F.array_join(c, ",").alias(c) for c in ("methods", "fields", "calls")])
)

# --- resolution --------------------------------------------------------------------------------------------------

query("import_scope", f"""{RES}, b as (select file_path, import, starts_with(import, 'static ') as st, regexp_replace(import, '^static ', '') as bare from imports)
select file_path, case when st and bare like '%.*' then 'static_wildcard' when st then 'static_member' when bare like '%.*' then 'wildcard' else 'type' end as kind,
case when bare like '%.*' then bare[:-3] when st then regexp_replace(bare, '\\.[^.]*$', '') else bare end as owner, case when st and bare not like '%.*' then regexp_extract(bare, '[^.]*$') end as member from b""")(
    lambda t: R.import_scope(t.get(T.RESOLVER, "imports")).drop("repo")
)
NAIVE = f"""{RES}, imp as (select distinct file_path, starts_with(import, 'static ') as st, import like '%.*' as wild, regexp_replace(regexp_replace(import, '^static ', ''), '\\.\\*$', '') as bare from imports),
m as (select *, regexp_replace(qualified_name, '\\.[^.]*$', '') as owner from method_refs),
k as (select distinct caller_class, caller_file, caller_pkg, simple_name, hint, arg_count from call_sites),
cand as (select k.*, m.id, m.ord, m.parameter_count = k.arg_count as ar, m.class_name = k.caller_class as same_class, m.file_path = k.caller_file as same_file, m.qualified_name = k.hint as hinted,
  (m.package_name = k.caller_pkg or exists (select 1 from imp i where i.file_path = k.caller_file and not i.st and ((not i.wild and i.bare = m.owner) or (i.wild and i.bare = m.package_name)))) as scoped,
  k.hint is null and exists (select 1 from imp i where i.file_path = k.caller_file and i.st and ((i.wild and i.bare = m.owner) or (not i.wild and i.bare = m.owner || '.' || k.simple_name))) as statics
  from k join m on m.name = k.simple_name),
pri as (select *, count(*) filter (statics and ar) over w as n_static, bool_or(coalesce(hinted and ar, false)) over w as h1, bool_or(coalesce(hinted, false)) over w as h0,
  case when statics and ar then 1 end as p_static,
  case when same_class then 1 when same_file then 2 when scoped then 3 else 4 end as place from cand window w as (partition by caller_class, caller_file, caller_pkg, simple_name, hint, arg_count)),
ranked as (select *, case when n_static > 1 then null when n_static = 1 then (case when statics and ar then 1 end) when h1 then (case when hinted and ar then 10 + place end) when h0 then (case when hinted then 20 + place end)
  when ar then 30 + place when same_class then 40 else 41 end as pr from pri),
best as (select * from (select *, row_number() over (partition by caller_class, caller_file, caller_pkg, simple_name, hint, arg_count order by pr, ord) as rn from ranked where pr is not null) where rn = 1),
resolved as (select c.caller_method_id as source_id, b.id as target_id, c.simple_name, c.line, c.source,
  case when pr = 1 then 'static-import-owner-arity-exact' when pr between 11 and 14 then 'qualifiedName-exact' when pr between 21 and 24 then 'qualifiedName-exact-no-arity' when pr = 31 then 'name-arity-same-class' when pr = 32 then 'name-arity-same-file' when pr = 33 then 'name-arity-import-scope' when pr = 40 then 'name-same-class-no-arity' else 'fallback-first-candidate' end as strategy,
  case when pr = 1 then 0.9 when pr between 11 and 14 then 0.95 when pr between 21 and 24 then 0.6 when pr = 31 then 0.85 when pr = 32 then 0.8 when pr = 33 then 0.75 when pr = 40 then 0.6 else 0.4 end::double as confidence
  from call_sites c join best b on c.caller_class = b.caller_class and c.caller_file = b.caller_file and c.caller_pkg = b.caller_pkg and c.simple_name = b.simple_name and c.hint is not distinct from b.hint and c.arg_count = b.arg_count where c.caller_method_id <> b.id)"""


def _resolved(t: T.Tables) -> DataFrame:
    return R.resolve_calls(t.get(T.RESOLVER, "call_sites"), t.get(T.RESOLVER, "method_refs"), R.import_scope(t.get(T.RESOLVER, "imports")))


query("resolve_calls", f"{NAIVE} select source_id, target_id, strategy, confidence, line, source, simple_name from resolved")(lambda t: _resolved(t).drop("repo", "type"))
query("call_edges", f"{NAIVE} select distinct source_id || '->' || target_id || ':CALLS:' || simple_name || ':' || cast(line as varchar) as id, source_id, target_id from resolved")(lambda t: R.call_edges(_resolved(t)).select("id", "source_id", "target_id"))
PENDING = "select 'tpch' as repo, 'class:' || cls as source_type_id, case when sk % 3 = 0 then 'Unknown' || cast(sk % 7 as string) when sk > 0 then 'Supplier' || cast(cast(floor(sk / 2) as bigint) as string) end as super_class, 'Region' || cast(nk5 as string) || case when sk % 4 = 0 then ',Odd' else '' end as faces from rsup"
TYPES = "select 'tpch' as repo, 'class:' || cls as id, cls as name, path || cls as ord from rsup union all select 'tpch', 'interface:Region' || cast(r_regionkey as string), 'Region' || cast(r_regionkey as string), 'z' from region where r_regionkey < 3"
INHERIT = f"""{RES}, pend as ({PENDING}), ty as ({TYPES}), asked as (select source_type_id, super_class as wanted, 'EXTENDS' as type from pend where super_class is not null union select source_type_id, unnest(string_split(faces, ',')), 'IMPLEMENTS' from pend),
f as (select name, arg_min(id, ord) as found from ty group by name), a as (select *, coalesce(found, case type when 'EXTENDS' then 'class' else 'interface' end || ':external.' || wanted) as target_id from asked left join f on f.name = asked.wanted)"""


def _inheritance(t: T.Tables) -> tuple[DataFrame, DataFrame]:
    pending = t.sql(f"{RES} {PENDING}").withColumn("interfaces", F.split("faces", ","))
    types = t.sql(f"{RES} {TYPES}")
    return R.resolve_inheritance(pending, types, types)


query("resolve_inheritance", f"{INHERIT} select source_type_id || '->' || target_id || ':' || type || case type when 'IMPLEMENTS' then ':' || wanted else '' end as id, source_type_id as source_id, target_id, type from a")(lambda t: _inheritance(t)[0].select("id", "source_id", "target_id", "type"))
query("inheritance_externals", f"{INHERIT} select distinct target_id as id, wanted as name from a where found is null")(lambda t: _inheritance(t)[1].select("id", "name"))

# --- incremental -------------------------------------------------------------------------------------------------

query("changed_file_sets", f"""{CHG}, e as (select path, status not like 'R%' and status not like 'D%' and status not like 'C%' as i, status not like 'C%' as v from changes union all select new_path, true, true from changes where status like 'R%' or status like 'C%')
select path, bool_or(i) as to_index, bool_or(v) as to_invalidate from e where lower(path) like '%.java' group by path""")(lambda t: M.changed_file_sets(t.get(T.CHANGES, "changes")))
GONE = "select distinct 'tpch' as repo, 'src/n' || cast(s_nationkey as string) || '/Supplier' || cast(s_suppkey as string) || '.java' as file_path from supplier join orders on o_custkey = s_suppkey"
PATCH_NODES = "select repo, id, label, name, qualified_name, package_name, class_name, file_path, return_type, type, '5|' || ord as ord from nodes where file_path in (select file_path from gone) and label in ('File', 'Class', 'Method')"
PATCH_EDGES = "select repo, id, source_id, target_id, type, confidence, 'patch' as reason, line, '5|' || ord as ord from edges where source_id in (select id from patch_nodes) and type in ('CONTAINS', 'CALLS')"
PATCHES = f"gone as ({GONE}), patch_nodes as ({PATCH_NODES}), patch_edges as ({PATCH_EDGES})"
MERGE = f"{E}, {PATCHES}".replace("gone as (", "gone as materialized (").replace("patch_nodes as (", "patch_nodes as materialized (")
MERGED = f"""{MERGE}, bad as materialized (select id from nodes where file_path <> '' and file_path in (select file_path from gone)), keep as materialized (select id, ord from nodes where id not in (select id from bad)),
mn as materialized (select id, ord from keep union all select id, ord from patch_nodes where id not in (select id from keep)),
be as (select id, reason from edges where source_id not in (select id from bad) and source_id in (select id from mn) and target_id in (select id from mn)),
me as (select * from be union all select id, reason from patch_edges where source_id in (select id from mn) and target_id in (select id from mn) and id not in (select id from be))"""


def _merged(t: T.Tables) -> tuple[DataFrame, DataFrame]:
    at = lambda name: t.sql(f"with {T.EDGES}, {PATCHES} select * from {name}")
    return M.merge_incremental(t.nodes, t.edges, at("patch_nodes"), at("patch_edges"), at("gone"))


query("merge_incremental_nodes", f"{MERGED} select id, ord from mn")(lambda t: _merged(t)[0].select("id", "ord"))
query("merge_incremental_edges", f"{MERGED} select id, reason from me")(lambda t: _merged(t)[1].select("id", "reason"))
query("invalidate_files", f"{MERGE} select id from nodes where file_path <> '' and file_path in (select file_path from gone)")(lambda t: M.invalidate_files(t.nodes, t.sql(GONE)).select("id"))


def _merged_store(t: T.Tables) -> tuple[DataFrame, DataFrame]:
    """The same merge into a graph that is stored in buckets, of which only those that it touches are written."""
    root = new_path(t.spark, "store")
    at = lambda name: t.sql(f"with {T.EDGES}, {PATCHES} select * from {name}")
    store.write_graph(t.nodes, t.edges, root)
    store.merge_graph(t.spark, root, at("patch_nodes"), at("patch_edges"), at("gone"))
    return store.read_graph(t.spark, root)


#: The nodes after the merge, whole, in place of those before it.
HITS_AFTER = HITS.replace(N, f"""{MERGE}, after as materialized (select * from nodes where not (file_path <> '' and file_path in (select file_path from gone)) union all select * from patch_nodes)""").replace("from nodes where label", "from after where label").replace("join nodes d", "join after d")


def _indexed(t: T.Tables, updates: bool) -> DataFrame:
    """Questions to a stored index, which follows the merge by a segment for each kind of node where updates is set."""
    root = new_path(t.spark, "search")
    SI.search_index(t.nodes, root)
    if updates:
        at = lambda name: t.sql(f"with {T.EDGES}, {PATCHES} select * from {name}")
        removed, added = (stage(df, "changed") for df in M.node_changes(t.nodes, at("patch_nodes"), at("gone")))
        for kind in ("label = 'Class'", "label <> 'Class'"):
            SI.update_search_index(t.spark, root, removed.filter(kind), added.filter(kind))
    return SI.bm25_indexed(t.spark, root, t.sql(SEARCHES)).select("query_id", "rank", "id", "name", "score")


query("bm25_indexed", f"{HITS} select query_id, rank, id, name, score from hits")(lambda t: _indexed(t, False))
query("bm25_indexed_merged", f"{HITS_AFTER} select query_id, rank, id, name, score from hits")(lambda t: _indexed(t, True))
query("merge_stored_nodes", f"{MERGED} select id, ord from mn")(lambda t: _merged_store(t)[0].select("id", "ord"))
query("merge_stored_edges", f"{MERGED} select id, reason from me")(lambda t: _merged_store(t)[1].select("id", "reason"))
query("union_graphs", f"{MERGE} select id, ord from nodes union all select id, ord from patch_nodes where id not in (select id from nodes)")(lambda t: M.union_graphs(t.nodes, t.sql(f"with {T.EDGES}, {PATCHES} select * from patch_nodes")).select("id", "ord"))

from . import fluent, index_queries, source_queries  # noqa: E402, F401  (they register their queries)
