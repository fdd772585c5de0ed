"""Evaluation of retrieval: ranks of expected answers, recall at k, failures, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expected_rank(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, family, rank): the first result that holds the expected text, else the first of the expected ids; null if none.

    ``results`` has (query_id, id, rank, text, metadata); questions without an expected answer are left out.
    """
    asked = questions.where("expected IS NOT NULL").select(F.col("question_id").alias("query_id"), "family", F.lower("expected").alias("expected"), "expected_ids")
    joined = asked.join(results, "query_id", "left")
    hit = F.contains(F.lower("text"), F.col("expected")) | F.contains(F.lower(F.coalesce("metadata", F.lit(""))), F.col("expected"))
    by_text = F.min(F.when(hit, F.col("rank")))
    by_id = F.min(F.when(F.array_contains("expected_ids", F.col("id").cast("string")), F.col("rank")))
    return joined.groupBy("query_id", "family").agg(F.coalesce(by_text, by_id).alias("rank"))


def _share(hit: Column) -> Column:
    return F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 6)


def recall_at(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), by: list[str] | None = None) -> DataFrame:
    """Numbers of questions, the share retrieved at all, and recall at each k; per group if asked."""
    aggs = [F.count("*").alias("questions"), _share(F.col("rank").isNotNull()).alias("retrieved"), *[_share(F.col("rank") <= k).alias(f"recall_{k}") for k in ks]]
    return ranks.groupBy(*(by or [])).agg(*aggs)


def rank_buckets(ranks: DataFrame) -> DataFrame:
    bucket = F.when(F.col("rank").isNull(), "never").when(F.col("rank") == 1, "1").when(F.col("rank") <= 3, "2-3").when(F.col("rank") <= 10, "4-10").otherwise("11+")
    return ranks.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("questions"))


def expected_ids(questions: DataFrame) -> DataFrame:
    """(query_id, id) of the memories that questions expect."""
    return questions.select(F.col("question_id").alias("query_id"), F.explode("expected_ids").alias("e")).select("query_id", F.expr("try_cast(e AS bigint)").alias("id")).distinct()


def signal_deltas(scored: DataFrame, questions: DataFrame, signals: list[str], above: int = 3) -> DataFrame:
    """(signal, delta, n): over questions whose expected memory ranks below ``above``, the winner's mean lead in each signal.

    ``scored`` has (query_id, id, rank) and a column for each signal. It is read once.
    """
    ids = expected_ids(questions).groupBy("query_id").agg(F.collect_set("id").alias("_ids"))
    hit = F.when(F.array_contains("_ids", F.col("id")), F.col("rank"))
    # of each question only the winner and its expected memories are compared
    rows = scored.join(ids, "query_id").withColumn("_hit", hit).where("rank = 1 OR _hit IS NOT NULL")
    pairs = rows.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.struct(*signals))).alias("w"), F.min_by(F.struct("rank", *signals), "_hit").alias("e"))
    pairs = pairs.where(F.col("w").isNotNull() & (F.col("e.rank") > above))
    stacked = pairs.select(F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), (F.col(f"w.{s}") - F.col(f"e.{s}")).alias("d")) for s in signals])).alias("x"))
    return stacked.groupBy("x.signal").agg(F.round(F.avg("x.d"), 6).alias("delta"), F.count("*").alias("n"))
