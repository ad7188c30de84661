"""Queries over stored graphs, the registry, change logs and streams: each writes, reads back, and is held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import new_path
from ..operators.merge import changed_file_sets
from ..sources import files as S
from ..sources import graphs as G
from ..sources import store
from ..streaming import refresh as R
from . import fixtures as T
from . import index_queries as Q
from . import javatext as J
from .registry import query

# --- sources and change logs ---------------------------------------------------------------------------------------

WANTED = f"select 'tpch' as repo, './' || path as file_path from sup where {Q.CHANGED} union all select 'tpch', path from sup where {Q.CHANGED} union all select 'tpch', 'src/missing.java' from nation union all select 'tpch', path || '.txt' from sup"
query("read_sources_subset", f"with {T.SUP} select path as file_path from sup where {Q.CHANGED}")(lambda t: S.read_sources_subset(Q.sources(t), t.sql(f"with {T.SUP} {WANTED}")).select("file_path"))

ODD_PATHS = "select s_suppkey as sk, 'a b/n' || cast(s_nationkey as string) || '/Ü+%20 ' || cast(s_suppkey as string) || case s_suppkey % 3 when 0 then '.java' when 1 then '.JAVA' else '.java.txt' end as path, 'class A' || cast(s_suppkey as string) || ' { }' as source from supplier"


def tree(t: T.Tables) -> str:
    """Files with odd names below a folder of their own."""
    root = new_path(t.spark, "tree")
    S.write_sources(t.sql(f"select path as file_path, source from ({ODD_PATHS})"), root)
    return root


query("read_sources", f"select path as file_path, source from ({ODD_PATHS}) o where sk % 3 = 0")(lambda t: S.read_sources(t.spark, tree(t), "tpch").select("file_path", "source"))


def requested(t: T.Tables) -> DataFrame:
    """Every second file, each named in four ways, files that there are not, and files of another repository."""
    root = tree(t)
    ways = "array(path, './' || path, 'x/../' || replace(path, '/', '//'), concat('{0}/', path), path || 'x.java')"
    asked = t.sql(f"select case when sk % 4 = 2 then 'other' else 'tpch' end as repo, explode({ways.format(root)}) as file_path from ({ODD_PATHS}) where sk % 2 = 0")
    return S.read_requested(t.spark, root, "tpch", asked).select("file_path", "source")


query("read_requested", f"select path as file_path, source from ({ODD_PATHS}) o where sk % 3 = 0 and sk % 4 = 0")(requested)

LINES = "select event_id, case event_type when 'click' then 'M' when 'view' then ' A' when 'purchase' then 'D' else 'R100' end as status, 'src/U' || cast(user_id as string) || '.java' as path, case when event_type not in ('click', 'view', 'purchase') then 'src/V' || cast(user_id % 97 as string) || '.java' end as new_path from events"
LOG = f"with c as ({LINES}) select trim(status) as status, path, new_path, count(*) as n from c group by all"


def change_log(t: T.Tables) -> str:
    path = new_path(t.spark, "changes")
    lines = t.sql(LINES).select(F.concat_ws("\t", "status", "path", "new_path").alias("value"))
    lines.unionByName(t.sql("select '' as value from nation union all select 'X' from region")).write.text(path)
    return path


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status", "path", "new_path").agg(F.count("*").alias("n"))


def streamed(t: T.Tables) -> DataFrame:
    out = new_path(t.spark, "streamed")
    R.stream_changes(t.spark, change_log(t)).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{out}/rows")


query("read_change_log", LOG)(lambda t: counted(S.read_change_log(t.spark, change_log(t))))
query("stream_changes", LOG)(lambda t: counted(streamed(t)))


#: A log with doubled tabs and renames that name no second path, beside a list of untracked files.
SETS = """with l as (select event_id, user_id, event_id % 7 as k from events), c as (
  select case k when 0 then 'R100' when 1 then 'C75' when 2 then 'D' else 'M' end as code, 'src/U' || cast(user_id as string) || case when user_id % 11 = 0 then '.txt' else '.java' end as path,
         case when k = 0 and event_id % 2 = 0 then 'src/V' || cast(user_id % 97 as string) || '.java' when k = 1 and event_id % 3 = 0 then 'src/W' || cast(user_id as string) || '.JAVA' end as new_path from l
), u as (select distinct 'src/N' || cast(user_id % 50 as string) || case when user_id % 3 = 0 then '.md' else '.java' end as path from l where k = 3)"""
SETS_ORACLE = SETS + """, e as (
  select path, false as i from c where code in ('R100', 'D') union all select new_path, true from c where code = 'R100' and new_path is not null
  union all select coalesce(new_path, path), true from c where code = 'C75' union all select path, true from c where code = 'M' union all select path, true from u)
select path, bool_or(i) as to_index, true as to_invalidate from e where lower(path) like '%.java' group by path"""


def change_folders(t: T.Tables) -> tuple[str, str]:
    path = new_path(t.spark, "log")
    t.sql(f"{SETS} select code || '\t\t' || path || '\t' || coalesce('\t' || new_path, '') as value from c").write.text(f"{path}/changes")
    t.sql(f"{SETS} select '  ' || path as value from u union all select '' from u").write.text(f"{path}/untracked")
    return f"{path}/changes", f"{path}/untracked"


query("changed_sets_of_log", SETS_ORACLE)(lambda t: changed_file_sets(S.read_change_log(t.spark, *change_folders(t))))


def streamed_sets(t: T.Tables) -> DataFrame:
    """What each micro-batch hands on, put together."""
    out = new_path(t.spark, "sets")
    R.stream_changed_sets(t.spark, *change_folders(t), f"{out}/checkpoint", lambda sets, n: sets.write.mode("overwrite").parquet(f"{out}/sets/batch={n}"), once=True).awaitTermination()
    return t.spark.read.parquet(f"{out}/sets").groupBy("path").agg(F.bool_or("to_index").alias("to_index"), F.bool_or("to_invalidate").alias("to_invalidate"))


query("stream_changed_sets", SETS_ORACLE)(streamed_sets)


def registry(t: T.Tables) -> DataFrame:
    path = new_path(t.spark, "registry")
    S.list_repositories(t.spark, path).unionByName(t.sql("select s_name as name, '/old' as path from supplier")).write.json(path)
    S.upsert_repository(S.list_repositories(t.spark, path), t.sql("select s_name as name, '/new/' || cast(s_nationkey as string) as path from supplier where s_suppkey % 3 = 0 union all select n_name, '/n' from nation")).write.json(f"{path}-2")
    return S.list_repositories(t.spark, f"{path}-2")


query("upsert_repository", "select s_name as name, case when s_suppkey % 3 = 0 then '/new/' || cast(s_nationkey as string) else '/old' end as path from supplier union all select n_name, '/n' from nation")(registry)

# --- stored graphs -------------------------------------------------------------------------------------------------

QUALIFIED = "select id, label, name, file_path, start_line from j_nodes"
query("symbol_rows", f"{Q.FULL} {QUALIFIED}")(lambda t: G.symbol_rows(Q.indexed(t)[0]).select("id", "label", "name", "file_path", F.get_json_object("payload", "$.start_line").cast("int").alias("start_line")))


def tables(t: T.Tables) -> tuple[DataFrame, DataFrame]:
    """The index written with some edges into nowhere, over an older graph, and read again."""
    path = new_path(t.spark, "graph")
    nodes, edges = Q.indexed(t)
    G.write_graph_tables(nodes.limit(5), edges.limit(5), path)
    G.write_graph_tables(nodes, edges.unionByName(edges.filter("type = 'CALLS'").withColumn("id", F.concat("id", F.lit("?"))).withColumn("target_id", F.lit("nowhere"))), path)
    return G.read_graph_tables(t.spark, path)


query("graph_tables_nodes", f"{Q.FULL} {QUALIFIED}")(lambda t: tables(t)[0].select(*Q.NODE_COLUMNS))
query("graph_tables_edges", f"{Q.FULL} select * from j_edges")(lambda t: tables(t)[1].select(*Q.EDGE_COLUMNS))


def json_lines(t: T.Tables) -> tuple[DataFrame, DataFrame]:
    path = new_path(t.spark, "graph-json")
    G.write_graph_json(*Q.indexed(t), path)
    return G.read_graph_json(t.spark, path)


query("graph_json_nodes", f"{Q.FULL} {QUALIFIED}")(lambda t: json_lines(t)[0].select(*Q.NODE_COLUMNS))
query("graph_json_edges", f"{Q.FULL} select * from j_edges")(lambda t: json_lines(t)[1].select(*Q.EDGE_COLUMNS))


def documents(t: T.Tables, ranges: int = 0) -> tuple[DataFrame, DataFrame]:
    """A document for each supplier, as other tools store one for each repository: its class, and an edge to its package."""
    path = new_path(t.spark, "graph-documents")
    rows = t.sql(f"""with {T.SUP} select path, array(named_struct('id', 'class:' || pkg || '.' || cls, 'label', 'Class', 'properties', named_struct('name', cls, 'qualifiedName', pkg || '.' || cls, 'filePath', path, 'startLine', 5)),
        named_struct('id', 'class:' || pkg || '.' || cls, 'label', 'Enum', 'properties', named_struct('name', 'later', 'qualifiedName', '', 'filePath', '', 'startLine', 0))) as nodes,
        array(named_struct('id', 'e' || cast(sk as string), 'sourceId', 'package:' || pkg, 'targetId', 'class:' || pkg || '.' || cls, 'type', 'CONTAINS', 'reason', 'r')) as relationships from sup""")
    rows.repartition(8).select(F.to_json(F.struct("nodes", "relationships")).alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    return G.read_big_graph_document(t.spark, path, "tpch", range_bytes=ranges) if ranges else G.read_graph_document(t.spark, path, "tpch")


query("graph_document_nodes", f"with {T.SUP} select 'class:' || pkg || '.' || cls as id, 'Class' as label, cls as name, path as file_path, 5 as start_line from sup")(lambda t: documents(t)[0].select(*Q.NODE_COLUMNS))
query("graph_document_edges", f"with {T.SUP} select 'e' || cast(sk as string) as id, 'package:' || pkg as source_id, 'class:' || pkg || '.' || cls as target_id, 'CONTAINS' as type, 'r' as reason, 1.0::double as confidence from sup")(lambda t: documents(t)[1].select(*Q.EDGE_COLUMNS))
query("graph_ranges_nodes", f"with {T.SUP} select 'class:' || pkg || '.' || cls as id, 'Class' as label, cls as name, path as file_path, 5 as start_line from sup")(lambda t: documents(t, 100)[0].select(*Q.NODE_COLUMNS))
query("graph_ranges_edges", f"with {T.SUP} select 'e' || cast(sk as string) as id, 'package:' || pkg as source_id, 'class:' || pkg || '.' || cls as target_id, 'CONTAINS' as type, 'r' as reason, 1.0::double as confidence from sup")(lambda t: documents(t, 100)[1].select(*Q.EDGE_COLUMNS))


def stream_refreshed(t: T.Tables, against: str = "patch") -> tuple[DataFrame, DataFrame]:
    """The index stored, then refreshed by a stream of change-log lines; the files that it asks for are read from a tree."""
    path = new_path(t.spark, "refresh")
    store.write_graph(*Q.indexed(t), f"{path}/graph")
    t.sql(f"with {J.BASE} select case when {Q.CHANGED} then 'M' else 'D' end || '\t' || path as value from sup where {Q.CHANGED} or {Q.DELETED}").write.text(f"{path}/changes")
    S.write_sources(J.sources(t.spark, f"{J.BASE}, {J.java('p', Q.CHANGED, fields=False).lstrip()}", "p", regions=False), f"{path}/tree")
    read = lambda asked: S.read_requested(t.spark, f"{path}/tree", "tpch", asked)
    R.stream_incremental_index(t.spark, f"{path}/changes", f"{path}/graph", "tpch", read, f"{path}/checkpoint", resolve_against=against, once=True).awaitTermination()
    return store.read_graph(t.spark, f"{path}/graph")


query("stream_refresh_nodes", f"{Q.PATCHED} select * from mn")(lambda t: stream_refreshed(t)[0].select(*Q.NODE_COLUMNS))
query("stream_refresh_edges", f"{Q.PATCHED} select * from me")(lambda t: stream_refreshed(t)[1].select(*Q.EDGE_COLUMNS))
query("stream_refresh_merged_edges", f"{Q.MERGED} select * from me")(lambda t: stream_refreshed(t, "merged")[1].select(*Q.EDGE_COLUMNS))
