"""Sinks: tables of the engine as Parquet, JSON and CSV; each write replaces or adds whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Results kept for each question in the record of an evaluation.
RECORDED = 20


def save(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace a table: vectors, postings, edges, weights."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def add(df: DataFrame, path: str) -> None:
    """Add rows to a log: events, queries, results."""
    df.write.mode("append").parquet(path)


def clear(df: DataFrame, path: str) -> None:
    """Empty a table, keeping its columns."""
    df.limit(0).write.mode("overwrite").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def record(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, query, expected, candidate_count, candidates) of each question: its first results, as they are recorded.

    Lists hold at most ``RECORDED`` results.
    """
    listed = F.sort_array(F.collect_list(F.when(F.col("rank") <= RECORDED, F.struct("rank", "id", "final"))))
    rows = results.groupBy("query_id").agg(F.count("*").alias("candidate_count"), listed.alias("candidates"))
    asked = questions.select(F.col("question_id").alias("query_id"), F.col("query_text").alias("query"), "expected")
    return asked.join(rows, "query_id", "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0).cast("long")))


def formatted(results: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, rank, id, text, normalized_text, score, metadata): results in the form that adapters of other evaluations read; ids as text."""
    shown = memories.select("id", "text", F.coalesce("normalized_text", "text").alias("normalized_text"), "metadata")
    rows = results.join(shown, "id")
    return rows.select("query_id", "rank", F.col("id").cast("string").alias("id"), "text", "normalized_text", F.col("final").alias("score"), "metadata")


def graph_json(adjacency: DataFrame, path: str) -> None:
    """Write a graph (src, dst, relation, weight) as JSON lines."""
    adjacency.write.mode("overwrite").json(path)


def graph_from_json(spark, path: str) -> DataFrame:
    return spark.read.schema("src string, dst string, relation string, weight double").json(path)
