"""Turning texts into rows of memories: analysis, facts, entities, relationships, importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scores as S
from lodestone.functions import text as T
from lodestone.functions import vocab
from lodestone.functions.vocab import Settings
from lodestone.operators import store

_EDGE = "array<struct<source:string,relation:string,target:string>>"


def relationships(text: Column, entities: Column) -> Column:
    """Edges between entities: by the cues that occur, from each entity before a cue to the first later one behind it; else from each to the next."""
    low = F.lower(text)
    n = F.size(entities)

    def place(e: Column) -> Column:
        return F.instr(low, F.lower(e))

    def cued_by(cue: str, relation: str) -> Column:
        at = F.instr(low, F.lit(cue))

        def link(e: Column, i: Column) -> Column:
            later = F.filter(F.slice(entities, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda x: place(x) > at)
            return F.struct(e.alias("source"), F.lit(relation).alias("relation"), F.get(later, F.lit(0)).alias("target"))

        linked = F.filter(F.transform(entities, link), lambda x: (place(x["source"]) < at) & x["target"].isNotNull())
        return F.when(at > 0, linked).otherwise(F.array().cast(_EDGE))

    cued = F.concat(*[cued_by(cue, relation) for cue, relation in vocab.RELATION_CUES])
    chain = F.zip_with(F.slice(entities, 1, F.greatest(n - 1, F.lit(0))), F.slice(entities, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("source"), F.lit("related_to").alias("relation"), b.alias("target")))
    return F.when(n < 2, F.array().cast(_EDGE)).when(F.size(cued) > 0, cued).otherwise(chain)


def enrich(texts: DataFrame, now: str = Settings().now, plugins=None) -> DataFrame:
    """(text, ...) with all derived columns of a memory but its id."""
    rows = texts.where("text IS NOT NULL AND text <> ''").withColumns({"entities": plugins.entities(F.col("text"), T.entities(F.col("text"))) if plugins is not None else T.entities(F.col("text")), "_fact": T.fact(F.col("text")), "tokens": T.store_tokens(F.col("text"))})
    importance = S.importance(F.col("text"), T.has_importance_cue(F.col("text")), F.lit(False), F.lit("semantic"), F.lit(None).cast("double"), F.lit(None).cast("timestamp"), F.lit(0), now)
    fact_edge = F.array(F.struct(F.col("_fact.subject").alias("source"), F.col("_fact.attribute").alias("relation"), F.col("_fact.value").alias("target")))
    return rows.select(
        *texts.columns,
        T.normalize(F.col("text")).alias("normalized_text"),
        "tokens",
        F.size("tokens").alias("token_count"),
        F.when(F.col("_fact").isNotNull(), "semantic").otherwise("general").alias("memory_type"),
        F.when(F.col("_fact").isNotNull(), F.to_json("_fact")).alias("metadata"),
        "entities",
        F.when(F.col("_fact").isNotNull(), fact_edge).otherwise(relationships(F.col("text"), F.col("entities"))).alias("relationships"),
        F.round(importance, 6).alias("importance"),
        F.lit(now).cast("timestamp_ntz").alias("created_at"),
        F.lit(0).alias("tombstone"),
        F.col("_fact.subject").alias("subject"),
        F.col("_fact.attribute").alias("attribute"),
    )


def store_many(memories: DataFrame, texts: DataFrame, order: str, now: str = Settings().now, plugins=None) -> DataFrame:
    """The new rows for ``texts``, with ids above those of ``memories``, ready to be appended."""
    return store.insert_many(memories, enrich(texts, now, plugins), order)


def append(rows: DataFrame, path: str) -> None:
    """Add rows to the table of memories, partitioned by type, so that a type is a partition filter."""
    rows.write.mode("append").partitionBy("memory_type").parquet(path)
