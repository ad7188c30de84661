"""The tables of a code graph. Every key begins with repo; `ord` is any orderable value that says which row came first."""

from pyspark.sql import types as T

_S, _I, _A = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())

ORD = T.StructType([T.StructField("phase", _I), T.StructField("file_path", _S), T.StructField("seq", T.LongType())])

#: Properties of a node, which the stored payload holds as JSON.
PROPERTIES = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("name", _S), ("qualified_name", _S), ("package_name", _S), ("class_name", _S), ("file_path", _S), ("start_line", _I), ("end_line", _I), ("modifiers", _A),
            ("super_class", _S), ("interfaces", _A), ("annotations", _A), ("signature", _S), ("return_type", _S), ("parameters", _A), ("type", _S), ("is_static", T.BooleanType()),
        )
    ]
)

NODES = T.StructType([T.StructField("repo", _S), T.StructField("id", _S), T.StructField("label", _S), *PROPERTIES.fields, T.StructField("ord", ORD)])
EDGES = T.StructType(
    [T.StructField(n, _S) for n in ("repo", "id", "source_id", "target_id", "type")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("reason", _S), T.StructField("line", T.LongType()), T.StructField("ord", ORD)]
)

LABELS = ("Project", "Package", "File", "Class", "Interface", "Enum", "Annotation", "Method", "Constructor", "Field", "LocalVariable")
RELATIONS = ("CONTAINS", "EXTENDS", "IMPLEMENTS", "CALLS", "ACCESSES", "IMPORTS", "OVERRIDES", "TYPE_OF")
SEARCHABLE = ("Class", "Interface", "Enum", "Annotation", "Method", "Constructor", "Field")
