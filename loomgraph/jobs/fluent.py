"""Queries over derived Java files in which the two parse modes differ: chains, constructors, nested and generic types,
anonymous classes, several names in a declaration, comments, annotations, and literals that look like code.

Each supplier has a file with a generic class, a class within it and a plain one; the generic class has a method for each
of its line numbers, in which a chain calls all methods before it. Lines are those of the text below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import build as B
from ..sources.javaparse import parse_sources
from . import fixtures as T
from . import index as I
from . import index_queries as Q
from .registry import query

HEAD = """package com.fluent.n{nk};
import java.util.*;

/* class Hidden {{ void hidden() {{ gone(1); }} }} */
@SuppressWarnings("all")
public final class Fluent{sk}<T extends Comparable<T>> extends base.Base{nk}<T> implements I<T>, J {{
    private final Map<String, List<T>> all = make(), rest[] = {{}};
    Fluent{sk}() {{
        this({sk}, null); // gone(2)
    }}
    Fluent{sk}(int n, T t) {{
        super(n);
    }}
"""
METHOD = '''    public <Q> Q m{ln}(final Map<String, Integer> a, int b) {{
        a.get(i(b)){chain};
        String s = """
            gone(3) "quoted" \\"""
            """;
        return new Box<String, T>({ln}, s).open(() -> {{ return new Lid() {{ int size() {{ return s.length(); }} }}; }});
    }}
'''
TAIL = """    static class Inner {{ void deep() {{ Fluent{sk}.<T>of("a(b)").go(); }} }}
}}
class Plain{sk} extends Base{nk} implements J {{
    int n = 1;
    void run(int a, int b) {{
        a.get(i(b)).step1(1);
        this . far . go(new Box({sk}, f(1)));
    }}
}}
"""


def _filled(template: str, **columns):
    """A template as a column: literals and columns in turn."""
    out = [F.lit("")]
    for part in template.replace("{{", "\0").replace("}}", "\1").split("{"):
        name, _, rest = part.partition("}")
        if rest or part.endswith("}"):
            out += [columns[name], F.lit(rest.replace("\0", "{").replace("\1", "}"))]
        else:
            out.append(F.lit(part.replace("\0", "{").replace("\1", "}")))
    return F.concat(*out)


def sources(t: T.Tables) -> DataFrame:
    """(repo, file_path, source), one file a supplier."""
    rows = t.sql(f"with {T.SUP} select s.sk, s.nk, array_sort(collect_list(m.ln)) as lns from sup s left join meth m on m.sk = s.sk group by s.sk, s.nk")
    text = lambda c: c.cast("string")
    sk, nk = text(F.col("sk")), text(F.col("nk"))
    step = lambda x: F.concat(F.lit(".m"), text(x), F.lit("("), text(x), F.lit(", b)"))
    chain = lambda ln: F.array_join(F.transform(F.filter("lns", lambda x: x < ln), step), "")
    methods = F.array_join(F.transform("lns", lambda ln: _filled(METHOD, ln=text(ln), chain=chain(ln))), "")
    source = F.concat(_filled(HEAD, sk=sk, nk=nk), methods, _filled(TAIL, sk=sk, nk=nk))
    return rows.select(F.lit("tpch").alias("repo"), F.concat(F.lit("src/Fluent"), sk, F.lit(".java")).alias("file_path"), source.alias("source"))


def parsed(t: T.Tables, mode: str) -> DataFrame:
    return t.staged(f"fluent-{mode}", lambda: parse_sources(t.staged("fluent", lambda: sources(t)), mode))


def methods(t: T.Tables, mode: str) -> DataFrame:
    return B.explode_methods(B.explode_types(parsed(t, mode)))


#: f: a row a file, n its methods; m: a row a method, k its place; later: its chain's calls, each with what it is called on.
FILES = f"""with {T.SUP}, f as materialized (
  select s.sk, any_value(s.nk) as nk, count(m.ln)::int as n, 'src/Fluent' || s.sk || '.java' as path, 'com.fluent.n' || any_value(s.nk) as pkg, 'com.fluent.n' || any_value(s.nk) || '.Fluent' || s.sk as q
  from sup s left join meth m on m.sk = s.sk group by s.sk
), m as materialized (
  select f.*, m.ln, (14 + 7 * (row_number() over (partition by f.sk order by m.ln) - 1))::int as line, list(m.ln) over (partition by f.sk order by m.ln rows between unbounded preceding and 1 preceding) as before from f join meth m on m.sk = f.sk
), steps as (
  select path, q, ln, line, before, unnest(range(1, coalesce(len(before), 0) + 1)) as j from m
), later as (
  select path, q, ln, line, before[j] as callee, 'a.get(i(b))' || array_to_string(list_transform(before[1:j - 1], lambda x: '.m' || x || '(' || x || ', b)'), '') as on_what from steps
)"""
TYPES = """ select path as file_path, 'Fluent' || sk as name, 'base.Base' || nk || '<T>' as super_class, 'I<T>,J' as interfaces, 'public,final' as modifiers, 5 as start_line, 15 + 7 * n as end_line from f
  union all select path, 'Inner', null, '', 'static', 14 + 7 * n, 14 + 7 * n from f
  union all select path, 'Plain' || sk, 'Base' || nk, 'J', '', 16 + 7 * n, 22 + 7 * n from f"""
PATTERN_TYPES = """ select path as file_path, 'Hidden' as name, null as super_class, '' as interfaces, '' as modifiers, 4 as start_line, 4 as end_line from f
  union all select path, 'Inner', null, '', 'static', 14 + 7 * n, 14 + 7 * n from f
  union all select path, 'Plain' || sk, 'Base' || nk, 'J', '', 16 + 7 * n, 22 + 7 * n from f"""
FIELDS = """ select path as file_path, name, 'Map<String, List<T>>' as type, 'private,final' as modifiers, 7 as line from f, (values ('all'), ('rest')) v(name)
  union all select path, 'n', 'int', '', 17 + 7 * n from f"""
METHODS = """ select path as file_path, q as type_qn, 'Fluent' || sk as name, 'Fluent' || sk || '()' as signature, null as return_type, true as is_constructor, '' as modifiers, 8 as start_line, 10 as end_line from f
  union all select path, q, 'Fluent' || sk, 'Fluent' || sk || '(int,T)', null, true, '', 11, 13 from f
  union all select path, q, 'm' || ln, 'm' || ln || '(final,int)', 'Q', false, 'public', line, line + 6 from m
  union all select path, q, 'size', 'size()', 'int', false, '', line + 5, line + 5 from m
  union all select path, pkg || '.Inner', 'deep', 'deep()', 'void', false, '', 14 + 7 * n, 14 + 7 * n from f
  union all select path, pkg || '.Plain' || sk, 'run', 'run(int,int)', 'void', false, '', 18 + 7 * n, 21 + 7 * n from f"""
PATTERN_METHODS = """ select path as file_path, pkg || '.Hidden' as type_qn, 'hidden' as name, 'hidden()' as signature, 'void' as return_type, false as is_constructor, '' as modifiers, 4 as start_line, 4 as end_line from f
  union all select path, pkg || '.Inner', 'deep', 'deep()', 'void', false, '', 14 + 7 * n, 14 + 7 * n from f
  union all select path, pkg || '.Plain' || sk, 'run', 'run(int,int)', 'void', false, '', 18 + 7 * n, 21 + 7 * n from f"""
CALLS = """ select path as file_path, 'method:' || q || '.Fluent' || sk || '()' as method_id, 'Fluent' || sk as simple_name, q as qualifier, 2 as arg_count, 9 as line from f
  union all select path, 'method:' || q || '.Fluent' || sk || '(int,T)', 'Base' || nk, 'base.Base' || nk, 1, 12 from f
  union all select path, 'method:' || q || '.m' || ln || '(final,int)', 'm' || callee, on_what, 2, line + 1 from later
  union all select path, 'method:' || q || '.m' || ln || '(final,int)', name, on_what, args, line + down from m, lateral (values ('get', 'a', 1, 1), ('i', null, 1, 1), ('Box', 'Box<String, T>', 2, 5), ('open', 'new Box<String, T>(' || ln || ', s)', 1, 5), ('Lid', 'Lid', 0, 5), ('length', 's', 0, 5)) v(name, on_what, args, down)
  union all select path, 'method:' || q || '.size()', 'length', 's', 0, line + 5 from m
  union all select path, 'method:' || pkg || '.Inner.deep()', name, on_what, args, 14 + 7 * n from f, lateral (values ('of', 'Fluent' || sk, 1), ('go', 'Fluent' || sk || '.<T>of("a(b)")', 0)) v(name, on_what, args)
  union all select path, 'method:' || pkg || '.Plain' || sk || '.run(int,int)', name, on_what, args, down + 7 * n from f, (values ('get', 'a', 1, 19), ('i', null, 1, 19), ('step1', 'a.get(i(b))', 1, 19), ('go', 'this . far', 1, 20), ('Box', 'Box', 2, 20), ('f', null, 1, 20)) v(name, on_what, args, down)"""
PATTERN_CALLS = """ select path as file_path, 'method:' || pkg || '.Hidden.hidden()' as method_id, 'gone' as simple_name, null as qualifier, 1 as arg_count, 4 as line from f
  union all select path, 'method:' || pkg || '.Inner.deep()', name, null, args, 14 + 7 * n from f, (values ('of', 1), ('a', 1), ('go', 0)) v(name, args)
  union all select path, 'method:' || pkg || '.Plain' || sk || '.run(int,int)', name, on_what, args, down + 7 * n from f, (values ('get', 'a', 1, 19), ('i', null, 1, 19), ('step1', null, 1, 19), ('go', 'this.far', 1, 20), ('Box', null, 2, 20), ('f', null, 1, 20)) v(name, on_what, args, down)"""
EDGES = """ select 'method:' || q || '.m' || ln || '(final,int)->method:' || q || '.m' || callee || '(final,int):CALLS:m' || callee || ':' || (line + 1) as id, 'strategy=name-arity-same-class;source=tree-sitter' as reason, 0.85::double as confidence from later
  union all select 'method:' || q || '.Fluent' || sk || '()->method:' || q || '.Fluent' || sk || '(int,T):CALLS:Fluent' || sk || ':9', 'strategy=qualifiedName-exact;source=tree-sitter', 0.95 from f"""

for _mode, _types, _methods, _calls in (("structural", TYPES, METHODS, CALLS), ("regex", PATTERN_TYPES, PATTERN_METHODS, PATTERN_CALLS)):
    query(f"fluent_{_mode}_types", FILES + _types)(lambda t, mode=_mode: B.explode_types(parsed(t, mode)).select("file_path", "name", "super_class", *Q.joined("interfaces", "modifiers"), "start_line", "end_line"))
    query(f"fluent_{_mode}_methods", FILES + _methods)(lambda t, mode=_mode: Q.method_columns(methods(t, mode)))
    query(f"fluent_{_mode}_calls", FILES + _calls)(lambda t, mode=_mode: Q.call_columns(B.explode_calls(methods(t, mode))))
query("fluent_fields", FILES + FIELDS)(lambda t: B.explode_fields(B.explode_types(parsed(t, "structural"))).select("file_path", "name", "type", *Q.joined("modifiers"), "line"))
query("fluent_call_edges", FILES + EDGES)(lambda t: I.index_full(t.staged("fluent", lambda: sources(t)))[1].filter("type = 'CALLS'").select("id", "reason", "confidence"))
