"""Source text to parsed rows: a parser of one file at a time, run by mapInPandas over all of them.

Mode "structural" reads declarations (nested types, methods without a body, type arguments, several names in one
declaration) and every call of an expression; it takes the line where a declaration begins, annotations included. Mode
"regex" sees less, and other calls: see javapattern. The default takes the first, or the second where brackets don't match.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .javapattern import parse_by_pattern
from .javastructure import parse_by_structure

CALL = "struct<name:string,qualifier:string,arg_count:int,line:int>"
METHOD = f"struct<name:string,parameters:array<string>,return_type:string,modifiers:array<string>,is_constructor:boolean,start_line:int,end_line:int,calls:array<{CALL}>>"
FIELD = "struct<name:string,type:string,modifiers:array<string>,line:int>"
TYPE = f"struct<kind:string,name:string,modifiers:array<string>,super_class:string,interfaces:array<string>,start_line:int,end_line:int,fields:array<{FIELD}>,methods:array<{METHOD}>>"
PARSED = f"repo string, file_path string, package_name string, imports array<string>, types array<{TYPE}>, parser_source string"


def parse_file(source: str | None, mode: str = "fallback") -> tuple[str, list[str], list[dict], str]:
    """(package, imports, types, which parser): structural, or the pattern where that fails, or one of the two alone."""
    source = source or ""
    if mode != "regex":
        try:
            return *parse_by_structure(source), "tree-sitter"
        except (ValueError, KeyError, IndexError):
            if mode == "structural":
                raise
    return *parse_by_pattern(source), "regex-fallback"


def parse_sources(sources: DataFrame, mode: str = "fallback") -> DataFrame:
    """sources (repo, file_path, source) -> one row a file: package, imports, types with their members, the parser."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [parse_file(s, mode) for s in f["source"]]
            yield pd.DataFrame({"repo": f["repo"], "file_path": f["file_path"], "package_name": [r[0] for r in rows], "imports": [r[1] for r in rows], "types": [r[2] for r in rows], "parser_source": [r[3] for r in rows]})

    return sources.select("repo", "file_path", "source").mapInPandas(run, PARSED)
