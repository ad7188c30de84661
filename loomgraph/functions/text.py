"""Column functions over names, types, signatures and paths; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PROPERTIES


def _nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def tokenize(text: Column) -> Column:
    """Lower-case tokens: cut between a lower and an upper case letter, then at everything but a-z, 0-9 and _."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9_]+"), lambda t: t != "")


def document_text(columns: tuple[str, ...] = ("name", "qualified_name", "package_name", "class_name", "return_type", "type", "file_path")) -> Column:
    """What a symbol is searched by, empty parts left out."""
    return F.concat_ws(" ", *[_nonempty(F.col(c)) for c in columns])


def split_modifiers(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda m: m != "")


def owner_type(qualified_name: Column) -> Column:
    """A qualified name without its last part."""
    return F.regexp_replace(qualified_name, r"\.?[^.]*$", "")


def clean_type_name(text: Column) -> Column:
    """A written type without its innermost type arguments, one pair of array marks, and all from a wildcard on."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), "<[^<>]*>", ""), r"\[\]$", ""), r"\?.*$", ""))


def simple_type_name(text: Column) -> Column:
    return F.element_at(F.split(clean_type_name(text), r"\."), -1)


def qualified_type_name(text: Column) -> Column:
    """The cleaned name where it is written with a dot, else null."""
    clean = clean_type_name(text)
    return F.when(F.contains(clean, F.lit(".")), clean)


def import_package(text: Column) -> Column:
    """The package that an import names: a wildcard's prefix, a type's package, or all of any other name."""
    bare = F.regexp_replace(text, "^static ", "")
    return F.when(bare.endswith(".*"), F.regexp_replace(bare, r"\.\*$", "")).when(bare.rlike(r"(^|\.)[A-Z][^.]*$"), F.regexp_replace(bare, r"\.?[^.]*$", "")).otherwise(bare)


def method_signature(name: Column, parameters: Column) -> Column:
    """name(first word of each parameter, joined by commas)."""
    words = F.filter(F.transform(parameters, lambda p: F.element_at(F.split(F.trim(p), r"\s+"), 1)), lambda w: w != "")
    return F.concat(name, F.lit("("), F.concat_ws(",", words), F.lit(")"))


def qualified_name_hint(qualifier: Column, name: Column) -> Column:
    """qualifier.name, for a dotted qualifier that calls nothing."""
    return F.when(F.contains(qualifier, F.lit(".")) & ~F.contains(qualifier, F.lit("(")), F.concat(qualifier, F.lit("."), name))


def relative_path(path: Column, root: Column) -> Column:
    """The path below root; the last part where nothing is left."""
    below = F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).when(path == root, F.lit("")).otherwise(path)
    return F.coalesce(_nonempty(below), base_name(path))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def payload_json(available: list[str]) -> Column:
    """The properties that a table has, as JSON without the null ones."""
    return F.to_json(F.struct(*[F.col(f.name) for f in PROPERTIES.fields if f.name in available]))


def from_payload(payload: Column) -> Column:
    return F.from_json(payload, PROPERTIES)
