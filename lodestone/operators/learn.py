"""Learning from use: feedback, relevance, sessions, query history and adaptive weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scores as S
from lodestone.functions import vocab
from lodestone.functions.vocab import Settings
from lodestone.session import cut_lineage


def once(events: DataFrame) -> DataFrame:
    """Events delivered twice count once: the one received first."""
    best = events.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in events.columns if c != "event_id"]), F.coalesce("received_at", F.lit("9999-12-31").cast("timestamp_ntz"))).alias("x"))
    return best.select("event_id", "x.*")


def delta(action: Column, duration_ms: Column) -> Column:
    """What one event adds to its memory's feedback; follow-ups act on the query before."""
    dwell = F.when(duration_ms > 100, F.least(F.lit(2.0), F.log(duration_ms / 1000 + 1) * 0.5)).otherwise(0.0)
    a = F.lower(action)
    return F.when(a == "click", 0.5).when(a == "skip", -0.2).when(a == "dwell", dwell).otherwise(0.0)


def feedback(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(mem_id, raw, boost): the sum of a memory's feedback, decayed by whole days since the last event, within -1 and 1."""
    sums = once(events).where("mem_id IS NOT NULL").groupBy("mem_id").agg(F.sum(delta(F.col("user_action"), F.col("duration_ms"))).alias("raw"), F.max("ts").alias("last"))
    days = F.greatest(F.lit(0), F.floor((F.unix_seconds(F.lit(settings.now).cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))) / 86400))
    boost = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("raw") * F.pow(F.lit(settings.feedback_decay), days)))
    return sums.select("mem_id", F.round("raw", 6).alias("raw"), F.round(boost, 6).alias("boost"))


def session_boost(events: DataFrame, recent: int = 5, kept: int = 500) -> DataFrame:
    """(session_id, mem_id, boost): 0.3 if among the last clicks of a session with enough clicks, 0.2 if clicked at all."""
    clicks = once(events).where(F.lower("user_action") == "click")
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id"))
    late = clicks.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= kept)
    counts = clicks.groupBy("session_id").agg(F.count("*").alias("n"))
    boost = F.when((F.col("n") >= recent) & (F.col("rn") <= recent), 0.3).otherwise(0.2)
    return late.join(counts, "session_id").groupBy("session_id", "mem_id").agg(F.max(boost).alias("boost"))


def follow_up_credit(events: DataFrame, last: int = 10) -> DataFrame:
    """(mem_id, credit): what follow-up questions add to the memories used for the query just before in the session.

    Of the last ten actions on that query the clicks and dwells count, the older ones more.
    """
    own = once(events).where("query_text IS NOT NULL")
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    prior = own.withColumn("previous", F.lag("query_text").over(w)).where((F.lower("user_action") == "follow_up") & F.col("previous").isNotNull())
    asked = prior.groupBy(F.col("previous").alias("query_text")).agg(F.count("*").alias("times"))
    acted = own.join(asked.select("query_text"), "query_text", "left_semi")
    late = acted.withColumn("rn", F.row_number().over(Window.partitionBy("query_text").orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("rn") <= last)
    sizes = late.groupBy("query_text").agg(F.count("*").alias("size"))
    # the oldest of the listed has index 0
    index = F.col("size") - F.col("rn")
    credit = F.lit(0.3) * (1.0 - index / F.col("size") * 0.5) * F.col("times")
    return late.where(F.lower("user_action").isin("click", "dwell")).join(sizes, "query_text").join(asked, "query_text").groupBy("mem_id").agg(F.round(F.sum(credit), 6).alias("credit"))


def relevance(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(mem_id, uses, relevance): by number of uses, age of the last one and feedback."""
    ev = once(events).where("mem_id IS NOT NULL")
    agg = ev.groupBy("mem_id").agg(F.count("*").alias("uses"), F.max("ts").alias("last"), F.sum(delta(F.col("user_action"), F.col("duration_ms"))).alias("raw"))
    age = (F.unix_seconds(F.lit(settings.now).cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))) / 86400
    score = F.col("uses") * 0.5 + F.lit(0.3) / (1 + age / 30) + F.col("raw") * 0.2
    return agg.select("mem_id", "uses", F.round(score, 6).alias("relevance"))


def stale(events: DataFrame, settings: Settings = Settings(), days: int = 180) -> DataFrame:
    """(mem_id): memories whose last use is so many days back."""
    cutoff = F.lit(settings.now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return events.where("mem_id IS NOT NULL").groupBy("mem_id").agg(F.max("ts").alias("last")).where(F.col("last") < cutoff).select("mem_id")


def frequent_queries(events: DataFrame, n: int) -> DataFrame:
    return once(events).where("query_text IS NOT NULL").groupBy("query_text").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "query_text").limit(n)


def ring(rows: DataFrame, partition: list[str], order: list, keep: int) -> DataFrame:
    """The latest ``keep`` rows of each group."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long")).where(F.col("rn") <= keep)


def history(events: DataFrame, kept: int = 50, after_skip: int = 30) -> DataFrame:
    """The latest events of each query, fewer once one of its results was skipped."""
    own = once(events).where("query_text IS NOT NULL")
    skipped = own.where(F.lower("user_action") == "skip").select("query_text").distinct().withColumn("_skipped", F.lit(True))
    rows = ring(own, ["query_text"], [F.desc("ts"), F.desc("event_id")], kept).join(skipped, "query_text", "left")
    return rows.where(F.col("_skipped").isNull() | (F.col("rn") <= after_skip)).drop("_skipped", "rn")


def adapt(deltas: DataFrame, step: float = 0.02) -> DataFrame:
    """(signal, weight): the weights after one step against the mean deltas (signal, delta), within bounds and summing to about 1."""
    start = deltas.sparkSession.createDataFrame(sorted(vocab.START_WEIGHTS.items()), "signal string, weight double")
    moved = cut_lineage(start.join(deltas, "signal", "left").select("signal", S.adjusted_weight(F.col("weight"), F.col("delta"), step).alias("weight")))
    total = moved.agg(F.sum("weight").alias("total"))
    return moved.crossJoin(F.broadcast(total)).select("signal", F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.5), F.col("weight") / F.col("total"))), 6).alias("weight"))
