"""Stored graphs: symbol rows with a JSON payload, partitioned tables, and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import from_payload, payload_json
from ..operators.patterns import first_wins
from ..schemas import EDGES, PROPERTIES
from ..shared import no_shuffles_left, shuffled, stage
from . import bigjson
from .files import open_store, qualified

#: Rows of a file of a stored table.
ROWS_A_FILE = 1_000_000

NODE_JSON = T.StructType([T.StructField("repo", T.StringType()), T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("properties", PROPERTIES)])


def symbol_rows(nodes: DataFrame) -> DataFrame:
    """repo, id, label, name, qualified_name ('' for none), file_path and payload, the JSON of all properties."""
    return nodes.select("repo", "id", "label", "name", F.coalesce("qualified_name", F.lit("")).alias("qualified_name"), "file_path", payload_json(nodes.columns).alias("payload"))


def read_symbols(rows: DataFrame) -> DataFrame:
    """Nodes from symbol rows: the payload's properties, or without a payload the name and the file alone."""
    p = rows.withColumn("p", from_payload(F.col("payload")))
    plain = {"name": F.col("name"), "file_path": F.col("file_path")}
    return p.select("repo", "id", "label", *[F.when(F.col("payload").isNotNull(), F.col("p")[f.name]).otherwise(plain.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in PROPERTIES.fields])


def with_defaults(edges: DataFrame) -> DataFrame:
    return edges.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).withColumn("reason", F.coalesce("reason", F.lit("")))


def complete_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ends = nodes.select("repo", F.col("id").alias("end"))
    return shuffled(shuffled(edges).join(ends.withColumnRenamed("end", "source_id"), ["repo", "source_id"], "left_semi")).join(ends.withColumnRenamed("end", "target_id"), ["repo", "target_id"], "left_semi").select(*edges.columns)


def _sized(rows: DataFrame, groups: list[str], most: int) -> DataFrame:
    """rows partitioned so that a group's rows lie in as few tasks as files of `most` rows can hold them, a big group's in many:
    however many tasks there were, a group has one file for each `most` rows begun."""
    sizes = stage(rows.groupBy(*groups).agg(F.count("*").alias("__n")), "group-sizes")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    parts = F.ceil(F.col("__n") / most)
    salt = F.pmod(F.xxhash64("repo", "id"), parts).cast("int")
    salted = rows.join(sizes, groups).withColumn("__salt", salt)
    return salted.repartition(max(1, -(-total // most)), *groups, "__salt").select(*rows.columns)


def write_graph_tables(nodes: DataFrame, edges: DataFrame, path: str, *, rows_a_file: int = ROWS_A_FILE) -> None:
    """Replace the graph at path: symbols by repo and label, complete edges by repo and type. A partition has about one file
    for each rows_a_file rows."""
    for rows, groups, name in ((symbol_rows(nodes), ["repo", "label"], "symbols"), (complete_edges(nodes, edges), ["repo", "type"], "relations")):
        with no_shuffles_left(rows.sparkSession):
            _sized(rows, groups, rows_a_file).write.mode("overwrite").partitionBy(*groups).parquet(f"{path}/{name}")


def read_graph_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_symbols(spark.read.parquet(f"{path}/symbols")), with_defaults(spark.read.parquet(f"{path}/relations"))


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON object a line: {id, label, properties} under nodes, edges under relationships; gzip, for the names of members
    are most of their bytes."""
    properties = F.struct(*[F.col(f.name) for f in PROPERTIES.fields if f.name in nodes.columns])
    nodes.select("repo", "id", "label", properties.alias("properties")).write.mode("overwrite").json(f"{path}/nodes", compression="gzip")
    edges.write.mode("overwrite").json(f"{path}/relationships", compression="gzip")


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The graph that write_graph_json wrote; of several rows of an id the first in the file order wins."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("at")
    nodes = spark.read.schema(NODE_JSON).json(f"{path}/nodes").select("repo", "id", "label", "properties.*", at)
    edges = spark.read.schema(EDGES).json(f"{path}/relationships").select("*", at)
    return first_wins(nodes, ["repo", "id"], "at").drop("at"), with_defaults(first_wins(edges, ["repo", "id"], "at").drop("at"))


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


_DOCUMENT = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("properties", T.StructType([T.StructField(_camel(f.name), f.dataType) for f in PROPERTIES.fields]))]))),
        T.StructField("relationships", T.ArrayType(T.StructType([T.StructField(_camel(n), t) for n, t in (("id", T.StringType()), ("source_id", T.StringType()), ("target_id", T.StringType()), ("type", T.StringType()), ("confidence", T.DoubleType()), ("reason", T.StringType()), ("line", T.LongType()))]))),
    ]
)


def _from_document(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of elements (at, n) and (at, e) of documents, the first of several with one id."""
    nodes = nodes.select(F.lit(repo).alias("repo"), "n.id", "n.label", F.col("n.properties").cast(PROPERTIES).alias("p"), "at").select("repo", "id", "label", "p.*", "at")
    edges = edges.select(F.lit(repo).alias("repo"), *[F.col(f"e.{_camel(f.name)}").alias(f.name) for f in EDGES.fields if f.name not in ("repo", "ord")], "at")
    return first_wins(nodes, ["repo", "id"], "at").drop("at"), with_defaults(first_wins(edges, ["repo", "id"], "at").drop("at"))


def read_graph_document(spark: SparkSession, path: str, repo: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the JSON documents {nodes, relationships} at path, each the graph of one repository with names in
    camel case, such as other tools store. The first of several nodes or edges of an id wins; absent confidences are 1.

    A document is one JSON value, so one task reads it; graphs of many documents are read by many, and a big document by
    read_big_graph_document."""
    read = spark.read.schema(_DOCUMENT).json(path, multiLine=True)
    listed = lambda name, alias: read.select("_metadata.file_path", F.posexplode(name).alias("pos", alias)).select(F.struct("file_path", "pos").alias("at"), alias)
    return _from_document(listed("nodes", "n"), listed("relationships", "e"), repo)


def read_big_graph_document(spark: SparkSession, path: str, repo: str, *, range_bytes: int = bigjson.RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """What read_graph_document reads, by many tasks a document: each takes a range of its bytes, and elements of nodes and
    relationships that are no objects are left out. A store that only Spark can open is read by that one instead."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    try:
        open_store(qualified(spark, path))
    except Exception:  # an unknown scheme, or no library for it
        return read_graph_document(spark, path, repo)
    found = stage(bigjson.elements(spark, files, ("nodes", "relationships"), range_bytes), "elements")
    at = F.struct("path", "offset").alias("at")
    parsed = lambda name, alias: found.filter(F.col("name") == name).select(at, F.from_json("text", _DOCUMENT[name].dataType.elementType).alias(alias))
    return _from_document(parsed("nodes", "n"), parsed("relationships", "e"), repo)
