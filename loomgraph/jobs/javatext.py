"""Java files derived from the star-schema tables: a class file for each supplier, an interface file for each region.

The same definitions, in SQL that Spark and DuckDB both run, give the rows from which Spark writes the text of the files
and, in DuckDB, what parsing and indexing them has to give back. A class has a field for each brand that its supplier
sold, a constructor, a method for each line number, and in it a call for each method called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import CALLED, SUP

BASE = SUP + "," + CALLED
PARAMETERS = "case {0} % 3 when 0 then '' when 1 then 'int a' else 'int a, String b' end"
TYPES_OF = "case {0} % 3 when 0 then '' when 1 then 'int' else 'int,String' end"
ARGUMENTS = "case {0} % 3 when 0 then '' when 1 then '1' else '1, null' end"


def java(p: str = "j", who: str = "true", fields: bool = True) -> str:
    """CTEs, their names beginning with p, of the files of the suppliers that `who` selects: p_sup, p_fld, p_meth, p_call
    and p_end, with lines as the text has them."""
    return f"""
{p}_sup as (select s.*, n.n_regionkey as region, b.pkg as before_pkg, b.cls as before_cls, cast(floor(s.sk / 2) as bigint) as up from sup s join nation n on s.nk = n.n_nationkey left join sup b on b.sk = s.sk - 1 and s.sk % 2 = 1 where {who.replace("sk", "s.sk")}),
{p}_fld as (select f.sk, lower(replace(f.brand, '#', '')) as name, row_number() over (partition by f.sk order by f.brand) as k from fld f join {p}_sup s on f.sk = s.sk where {"true" if fields else "false"}),
{p}_nf as (select s.sk, count(f.k) as nf from {p}_sup s left join {p}_fld f on f.sk = s.sk group by s.sk),
{p}_call as (select c.s1, c.n1, c.s2, c.n2, (c.s2 + c.n2) % 2 = 0 as qualified, row_number() over (partition by c.s1, c.n1 order by c.s2, c.n2) as k from called c join {p}_sup s on s.sk = c.s1),
{p}_nc as (select s1, n1, count(*) as nc from {p}_call group by s1, n1),
{p}_len as (select m.sk, m.ln, coalesce(c.nc, 0) as nc, n.nf from meth m join {p}_nf n on m.sk = n.sk left join {p}_nc c on c.s1 = m.sk and c.n1 = m.ln),
{p}_meth as (select sk, ln, nc, 8 + nf + coalesce(sum(nc + 2) over (partition by sk order by ln rows between unbounded preceding and 1 preceding), 0) as first from {p}_len),
{p}_end as (select n.sk, max(n.nf) as nf, max(n.nf) + 8 + coalesce(sum(m.nc + 2), 0) as last from {p}_nf n left join {p}_meth m on m.sk = n.sk group by n.sk)"""


FILES = f"{BASE},{java()}"


def sources(spark: SparkSession, parts: str = FILES, p: str = "j", regions: bool = True) -> DataFrame:
    """(repo, file_path, source) of the files that the CTEs describe; the star-schema tables are registered as views."""
    get = lambda text: spark.sql(f"with {parts} {text}")
    lines = lambda column: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", column))), lambda x: x[column]), "").alias(column)
    fields = get(f"select sk, k, '    private static String ' || name || ';\n' as fields from {p}_fld").groupBy("sk").agg(lines("fields"))
    calls = get(f"""select c.s1 as sk, c.n1 as ln, c.k, '        ' || case when qualified then t.pkg || '.' || t.cls || '.' else '' end || 'handle' || cast(c.n2 as string) || '(' || {ARGUMENTS.format("c.n2")} || ');\n' as calls
        from {p}_call c join sup t on t.sk = c.s2""").groupBy("sk", "ln").agg(lines("calls"))  # fmt: skip
    methods = get(f"select sk, ln, ln as k, '    public void handle' || cast(ln as string) || '(' || {PARAMETERS.format('ln')} || ') {{\n' as head from {p}_meth").join(calls, ["sk", "ln"], "left")
    methods = methods.select("sk", "k", F.concat("head", F.coalesce("calls", F.lit("")), F.lit("    }\n")).alias("methods")).groupBy("sk").agg(lines("methods"))
    classes = get(f"select * from {p}_sup").join(fields, "sk", "left").join(methods, "sk", "left")
    static = F.coalesce(F.concat(F.lit("import static "), "before_pkg", F.lit("."), "before_cls", F.lit(".handle1;")), F.lit(""))
    up = F.when(F.col("sk") > 0, F.concat(F.lit(" extends Supplier"), F.col("up").cast("string"))).otherwise("")
    text = F.concat(
        F.lit("package "), "pkg", F.lit(";\nimport com.acme.Region"), F.col("region").cast("string"), F.lit(";\nimport java.util.*;\n"), static, F.lit("\npublic class "), "cls", up, F.lit(" implements Region"), F.col("region").cast("string"), F.lit(", Runnable {\n"),
        F.coalesce("fields", F.lit("")), F.lit("    public "), "cls", F.lit("(int key) {\n    }\n"), F.coalesce("methods", F.lit("")), F.lit("}\n"),
    )
    out = classes.select(F.lit("tpch").alias("repo"), F.col("path").alias("file_path"), text.alias("source"))
    if regions:
        out = out.unionByName(spark.sql("select 'tpch' as repo, 'src/Region' || cast(r_regionkey as string) || '.java' as file_path, 'package com.acme;\n\npublic interface Region' || cast(r_regionkey as string) || ' {\n    void ping(int a);\n}\n' as source from region"))
    return out
