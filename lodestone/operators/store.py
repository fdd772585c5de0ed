"""Stored memories: scans, look-ups, and changes as merge-on-read transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vocab
from lodestone.session import cut_lineage

METADATA = "map<string,string>"


def live(memories: DataFrame) -> DataFrame:
    """Rows that are not deleted; a missing flag means not deleted."""
    return memories.where(F.coalesce("tombstone", F.lit(0)) == 0)


def decode(memories: DataFrame) -> DataFrame:
    """Rows with their defaults: text for a missing normalised text, 0.5 for a missing or zero importance, the closed set of types."""
    kind = F.when(F.col("memory_type").isin(*vocab.MEMORY_TYPES), F.col("memory_type")).otherwise("general")
    n_tokens = F.coalesce(F.nullif("token_count", F.lit(0)), F.size(F.coalesce("tokens", F.array().cast("array<string>"))))
    return memories.withColumns(
        {
            "normalized_text": F.coalesce("normalized_text", "text"),
            "token_count": n_tokens.cast("long"),
            "memory_type": kind,
            "importance": F.coalesce(F.nullif("importance", F.lit(0.0)), F.lit(0.5)),
            "tombstone": F.coalesce("tombstone", F.lit(0)),
            "metadata": F.from_json("metadata", METADATA),
        }
    )


def multi_get(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The live rows whose id is among ``ids.id``."""
    return live(memories).join(ids.select("id").distinct(), "id", "left_semi")


def top_by_type(memories: DataFrame, n: int = 50) -> DataFrame:
    """The n most important, then newest, live rows of each type, with their rank."""
    w = Window.partitionBy("memory_type").orderBy(F.desc("importance"), F.desc("created_at"), "id")
    return decode(live(memories)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def attribute_lookup(memories: DataFrame, keys: DataFrame) -> DataFrame:
    """Live rows whose subject and attribute equal those of ``keys``."""
    return live(memories).join(keys.select("subject", "attribute").distinct(), ["subject", "attribute"], "left_semi")


def latest(memories: DataFrame, n: int = 10) -> DataFrame:
    return live(memories).orderBy(F.desc("id")).limit(n)


def batches(memories: DataFrame, size: int) -> DataFrame:
    """Rows with the number of their batch of ``size`` rows in the order of ids, however sparse these are."""
    return number(memories, "id").withColumn("batch", F.floor((F.col("number") - 1) / size).cast("long")).drop("number")


def number(rows: DataFrame, order: str) -> DataFrame:
    """Rows with their place, from 1, in the order of a column, without bringing them into one task."""
    ranged = cut_lineage(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(order)) + F.col("_before")
    return ranged.join(F.broadcast(counts), "_part").withColumn("number", at).drop("_part", "_before")  # one row a partition


def insert_many(memories: DataFrame, texts: DataFrame, order: str) -> DataFrame:
    """(id, ...) of new rows: dense ids above the largest one, in the order of a column."""
    top = memories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return number(texts, order).crossJoin(F.broadcast(top)).withColumn("id", (F.col("_top") + F.col("number")).cast("long")).drop("_top", "number")


def merge(memories: DataFrame, changes: DataFrame, columns: list[str], key: str = "id", nulls: bool = False) -> DataFrame:
    """Rows with the values of ``changes`` in the given columns; null values leave a column as it is, unless ``nulls``."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = memories.join(new, key, "left")
    value = (lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))) if nulls else (lambda c: F.coalesce(f"_new_{c}", c))
    return joined.withColumns({c: value(c) for c in columns}).drop("_hit", *[f"_new_{c}" for c in columns])


def soft_delete(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with the flag set where the id is among ``ids.id``."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(1))
    return memories.join(gone, "id", "left").withColumn("tombstone", F.coalesce("_gone", "tombstone", F.lit(0))).drop("_gone")


def touch(memories: DataFrame, ids: DataFrame, now: str, step: float = 0.01) -> DataFrame:
    """Rows with a new time of access and a slightly higher importance where the id is among ``ids.id``."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    touched = F.coalesce("_hit", F.lit(False))
    return memories.join(hit, "id", "left").withColumns(
        {
            "importance": F.when(touched, F.coalesce("importance", F.lit(0.5)) + step).otherwise(F.col("importance")),
            "last_accessed": F.when(touched, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("last_accessed")),
        }
    ).drop("_hit")


def decay(memories: DataFrame, now: str, rate: float, floor: float) -> DataFrame:
    """Rows not accessed for a day with a slightly lower importance, not below the floor."""
    old = F.col("last_accessed") < F.lit(now).cast("timestamp_ntz") - F.expr("interval 1 day")
    return memories.withColumn("importance", F.when(old, F.greatest(F.lit(floor), F.col("importance") - rate)).otherwise(F.col("importance")))


def prunable(memories: DataFrame, now: str, importance: float, days: int) -> DataFrame:
    """Live rows of low importance that are old."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return live(memories).where((F.col("importance") < importance) & (F.col("created_at") < cutoff))


def typed_or_all(candidates: DataFrame, query: str, kind: Column, wanted: Column) -> DataFrame:
    """The candidates of the wanted type; all of a query's if it has none of that type."""
    typed = candidates.where(kind == wanted).select(query).distinct().withColumn("_typed", F.lit(True))
    return candidates.join(typed, query, "left").where((kind == wanted) | F.col("_typed").isNull()).drop("_typed")


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The new edges that are not there yet, each once."""
    key = ["memory_id", "source", "relation", "target"]
    return new.dropDuplicates(key).join(edges.select(*key), key, "left_anti")


def drop_edges(edges: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return edges.join(gone.select(*key).distinct(), key, "left_anti")


def add_aliases(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Entities with further aliases, each once, never the name itself. ``new`` has (id, alias)."""
    extra = new.groupBy("id").agg(F.sort_array(F.collect_set("alias")).alias("_extra"))
    none = F.array().cast("array<string>")
    merged = F.array_remove(F.array_union(F.coalesce("aliases", none), F.coalesce("_extra", none)), F.coalesce("name", F.lit("")))
    return entities.join(extra, "id", "left").withColumn("aliases", merged).drop("_extra")


def remove_alias(entities: DataFrame, alias: str) -> DataFrame:
    return entities.withColumn("aliases", F.array_remove("aliases", alias))


def set_type(entities: DataFrame, entity_id: int, entity_type: str) -> DataFrame:
    return entities.withColumn("entity_type", F.when(F.col("id") == entity_id, F.lit(entity_type)).otherwise(F.col("entity_type")))


def add_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """(id, embedding) cut to the dimension; rows without one are skipped."""
    vec = F.slice("embedding", 1, dim)
    return rows.where(F.size("embedding") >= 1).select("id", vec.alias("embedding"))
