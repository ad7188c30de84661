"""Ranked keyword search (BM25) over symbols, for a DataFrame of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import document_text, tokenize
from ..shared import scope, stage
from .patterns import searchable_nodes

K1, B = 1.2, 0.75
DEFAULT_LIMIT = 10


def documents(nodes: DataFrame) -> DataFrame:
    """Searchable nodes with their tokens and length (1 at least)."""
    docs = searchable_nodes(nodes).withColumn("tokens", tokenize(document_text()))
    return docs.withColumn("length", F.greatest(F.size("tokens"), F.lit(1)))


def term_frequency(docs: DataFrame) -> DataFrame:
    """(repo, id, token, tf, length)."""
    return docs.select("repo", "id", "length", F.explode("tokens").alias("token")).groupBy("repo", "id", "token", "length").agg(F.count("*").alias("tf"))


def average_length(docs: DataFrame) -> DataFrame:
    """(repo, n, avg_length) of a repository's documents."""
    return docs.groupBy("repo").agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))


def document_frequency(tf: DataFrame, sizes: DataFrame) -> DataFrame:
    """(repo, token, df, idf)."""
    df = tf.groupBy("repo", "token").agg(F.count("*").alias("df"))
    return df.join(sizes, "repo").select("repo", "token", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25_search(nodes: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(query_id, rank, node columns, score) of the best symbols of each repository for queries (query_id, query).

    A repeated query token counts again; only scores above 0 are hits; ties go to the smaller ord. Postings are cut to
    the queries' tokens before anything is grouped, so tokens that every path holds cost nothing unless asked for.
    """
    with scope() as keep:
        asked = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
        docs = stage(documents(nodes).select("repo", "id", "ord", "length", "tokens"), "documents")  # tokenized once
        sizes = average_length(docs)
        wanted = asked.select("token").distinct()
        postings = docs.select("repo", "id", "ord", "length", F.explode("tokens").alias("token")).join(wanted, "token", "left_semi").groupBy("repo", "id", "ord", "length", "token").agg(F.count("*").alias("tf"))
        postings = stage(postings, "postings")
        frequency = postings.groupBy("repo", "token").agg(F.count("*").alias("df"))
        weighed = postings.join(frequency.join(sizes, "repo"), ["repo", "token"])
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
        scores = weighed.select("repo", "id", "ord", "token", gain.alias("gain")).join(asked, "token").groupBy("query_id", "repo", "id", "ord").agg(F.round(F.sum(F.col("gain") * F.col("times")), 4).alias("score")).filter("score > 0")
        best = search_rank(scores).filter(F.col("rank") <= limit).drop("ord")
        return keep(stage(best.join(nodes, ["repo", "id"]), "hits"))


def search_rank(hits: DataFrame) -> DataFrame:
    """rank of each hit in its query and repository: score, then what came first."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "repo").orderBy(F.desc("score"), "ord")))


def search_substring_postfilter(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits whose name or qualified name holds the whole query, in lower case; taken after the limit."""
    q = queries.select("query_id", F.lower("query").alias("__q"))
    joined = hits.join(q, "query_id")
    return joined.filter(F.lower("name").contains(F.col("__q")) | F.lower(F.coalesce("qualified_name", F.lit(""))).contains(F.col("__q"))).drop("__q")


def search_by_type(hits: DataFrame, label: str) -> DataFrame:
    """Hits of one label; taken after the limit."""
    return hits.filter(F.col("label") == label)


def query_tool(nodes: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Search hits as the query tool shows them: constructors as classes, only names that hold the query."""
    hits = search_substring_postfilter(bm25_search(nodes, queries, limit), queries)
    return hits.select("query_id", "rank", "id", "name", F.when(F.col("label") == "Constructor", "Class").otherwise(F.col("label")).alias("type"), "file_path", "score")


def query_cli(nodes: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(query_id, rank, line): numbered lines, or one line that says there are no results (rank 0)."""
    hits = bm25_search(nodes, queries, limit).select("query_id", "rank", F.format_string("%d. %s [%s] %s score=%.4f", "rank", "name", "label", "file_path", "score").alias("line"))
    none = queries.select("query_id").join(hits, "query_id", "left_anti").select("query_id", F.lit(0).alias("rank"), F.lit("No results.").alias("line"))
    return hits.unionByName(none)
