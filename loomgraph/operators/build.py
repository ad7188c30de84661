"""Projections: parsed rows become the nodes and edges of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, import_package, method_signature, qualified_name_hint
from ..schemas import EDGES, NODES

DEFAULT_PACKAGE = "default"


def _ord(phase: int, file_path: Column, seq: Column) -> Column:
    return F.struct(F.lit(phase).alias("phase"), file_path.alias("file_path"), seq.cast("long").alias("seq"))


def _shaped(rows: DataFrame, schema) -> DataFrame:
    """rows with exactly the columns of the schema, absent ones null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def explode_imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo", "file_path", F.posexplode("imports").alias("pos", "import"))


def explode_types(parsed: DataFrame) -> DataFrame:
    """repo, file_path, package_name, parser_source, type_pos and the fields of a type, with its qualified name and id."""
    t = parsed.select("repo", "file_path", "package_name", "parser_source", F.posexplode("types").alias("type_pos", "t")).select("repo", "file_path", "package_name", "parser_source", "type_pos", "t.*")
    qualified = F.when(F.coalesce("package_name", F.lit("")) == "", F.col("name")).otherwise(F.concat("package_name", F.lit("."), "name"))
    return t.withColumn("qualified_name", qualified).withColumn("type_id", F.concat(F.lower("kind"), F.lit(":"), qualified))


def explode_fields(types: DataFrame) -> DataFrame:
    return types.select("repo", "file_path", "package_name", "type_pos", "type_id", F.col("qualified_name").alias("type_qn"), F.col("name").alias("class_name"), F.posexplode("fields").alias("field_pos", "f")).select("*", "f.*").drop("f")


def explode_methods(types: DataFrame) -> DataFrame:
    m = types.select("repo", "file_path", "package_name", "parser_source", "type_pos", "type_id", F.col("qualified_name").alias("type_qn"), F.col("name").alias("class_name"), F.posexplode("methods").alias("method_pos", "m")).select("*", "m.*").drop("m")
    return m.withColumn("signature", method_signature(F.col("name"), F.col("parameters"))).withColumn("method_id", F.concat(F.lit("method:"), "type_qn", F.lit("."), "signature"))


def explode_calls(methods: DataFrame) -> DataFrame:
    """Call sites with who calls: method_id, class_name, file_path, package_name."""
    c = methods.select("repo", "file_path", "package_name", "parser_source", "class_name", "method_id", "type_pos", "method_pos", F.posexplode("calls").alias("call_pos", "c"))
    return c.select("repo", "file_path", "package_name", "parser_source", "class_name", "method_id", "type_pos", "method_pos", "call_pos", F.col("c.name").alias("simple_name"), F.col("c.qualifier").alias("qualifier"), F.col("c.arg_count").alias("arg_count"), F.col("c.line").alias("line"))


def project_nodes(repos: DataFrame) -> DataFrame:
    """repos: repo -> one Project node each."""
    none = F.lit("")
    return _shaped(repos.select("repo", F.concat(F.lit("project:"), "repo").alias("id"), F.lit("Project").alias("label"), F.col("repo").alias("name"), F.col("repo").alias("qualified_name"), none.alias("file_path"), _ord(0, none, F.lit(0)).alias("ord")), NODES)


def _package(c: str = "package_name") -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(DEFAULT_PACKAGE))


def package_nodes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files: repo, file_path, package_name -> Package nodes and project-package edges, one for each file (first wins later)."""
    pkg = _package()
    nodes = files.select("repo", F.concat(F.lit("package:"), pkg).alias("id"), F.lit("Package").alias("label"), pkg.alias("name"), pkg.alias("qualified_name"), F.lit("").alias("file_path"), _ord(1, F.col("file_path"), F.lit(0)).alias("ord"))
    project, target = F.concat(F.lit("project:"), "repo"), F.concat(F.lit("package:"), pkg)
    return _shaped(nodes, NODES), _contains(files, project, target, "file-package", F.lit(0))


def _contains(rows: DataFrame, source: Column, target: Column, reason: str, seq: Column, phase: int = 1) -> DataFrame:
    edges = rows.select("repo", F.concat(source, F.lit("->"), target, F.lit(":CONTAINS")).alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit("CONTAINS").alias("type"), F.lit(1.0).alias("confidence"), F.lit(reason).alias("reason"), _ord(phase, F.col("file_path"), seq).alias("ord"))
    return _shaped(edges, EDGES)


def file_nodes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    node_id = F.concat(F.lit("file:"), "file_path")
    nodes = files.select("repo", node_id.alias("id"), F.lit("File").alias("label"), base_name(F.col("file_path")).alias("name"), F.col("file_path").alias("qualified_name"), F.col("package_name"), "file_path", _ord(1, F.col("file_path"), F.lit(1)).alias("ord"))
    return _shaped(nodes, NODES), _contains(files, F.concat(F.lit("package:"), _package()), node_id, "package-file", F.lit(1))


#: A type's members keep their order within a million places.
_TYPE, _FIELD, _METHOD = 4_000_000, 0, 1_000_000


def _seq(offset: int, pos: str | None = None) -> Column:
    return (F.col("type_pos") + 1) * _TYPE + offset + ((F.col(pos) + 1) if pos else 0)


def type_nodes(types: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = types.select("repo", F.col("type_id").alias("id"), F.col("kind").alias("label"), "name", "qualified_name", "package_name", "file_path", "start_line", "end_line", "modifiers", "super_class", "interfaces", _ord(1, F.col("file_path"), _seq(0)).alias("ord"))
    return _shaped(nodes, NODES), _contains(types, F.concat(F.lit("file:"), "file_path"), F.col("type_id"), "file-type", _seq(0))


def field_nodes(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    node_id = F.concat(F.lit("field:"), "type_qn", F.lit("."), "name")
    nodes = fields.select("repo", node_id.alias("id"), F.lit("Field").alias("label"), "name", F.concat("type_qn", F.lit("."), "name").alias("qualified_name"), "package_name", "class_name", "file_path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), "modifiers", "type", F.array_contains("modifiers", "static").alias("is_static"), _ord(1, F.col("file_path"), _seq(_FIELD, "field_pos")).alias("ord"))
    return _shaped(nodes, NODES), _contains(fields, F.col("type_id"), node_id, "type-field", _seq(_FIELD, "field_pos"))


def method_nodes(methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    label = F.when(F.col("is_constructor"), "Constructor").otherwise("Method")
    nodes = methods.select("repo", F.col("method_id").alias("id"), label.alias("label"), "name", F.concat("type_qn", F.lit("."), "signature").alias("qualified_name"), "package_name", "class_name", "file_path", "start_line", "end_line", "modifiers", "signature", "return_type", "parameters", F.array_contains("modifiers", "static").alias("is_static"), _ord(1, F.col("file_path"), _seq(_METHOD, "method_pos")).alias("ord"))
    return _shaped(nodes, NODES), _contains(methods, F.col("type_id"), F.col("method_id"), "type-method", _seq(_METHOD, "method_pos"))


def method_refs(methods: DataFrame) -> DataFrame:
    """What calls resolve to: one row a declaration, the qualified name without the signature."""
    return methods.select("repo", F.col("method_id").alias("id"), "name", "class_name", "type_id", "file_path", "package_name", F.concat("type_qn", F.lit("."), "name").alias("qualified_name"), F.size("parameters").alias("parameter_count"), _ord(1, F.col("file_path"), _seq(_METHOD, "method_pos")).alias("ord"))


def pending_calls(calls: DataFrame) -> DataFrame:
    """Call sites as the resolver takes them."""
    return calls.select("repo", F.col("method_id").alias("caller_method_id"), F.col("class_name").alias("caller_class"), F.col("file_path").alias("caller_file"), F.col("package_name").alias("caller_pkg"), "simple_name", qualified_name_hint(F.col("qualifier"), F.col("simple_name")).alias("hint"), "arg_count", "line", F.col("parser_source").alias("source"), F.lit(None).cast("string").alias("unsupported_reason"))


def pending_inheritance(types: DataFrame) -> DataFrame:
    return types.select("repo", F.col("type_id").alias("source_type_id"), "super_class", "interfaces")


def import_edges(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Package nodes of imports and file-package IMPORTS edges; the first import of a package gives the reason."""
    pkg = import_package(F.col("import"))
    at = _ord(2, F.col("file_path"), F.col("pos"))
    nodes = imports.select("repo", F.concat(F.lit("package:"), pkg).alias("id"), F.lit("Package").alias("label"), pkg.alias("name"), pkg.alias("qualified_name"), F.lit("").alias("file_path"), at.alias("ord"))
    source, target = F.concat(F.lit("file:"), "file_path"), F.concat(F.lit("package:"), pkg)
    edges = imports.select("repo", F.concat(source, F.lit("->"), target, F.lit(":IMPORTS")).alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit("IMPORTS").alias("type"), F.lit(1.0).alias("confidence"), F.col("import").alias("reason"), at.alias("ord"))
    return _shaped(nodes, NODES), _shaped(edges, EDGES)
