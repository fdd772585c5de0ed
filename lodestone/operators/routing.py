"""Detection of the memory type that a question asks for, and where its memories lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vocab

#: The shard of each type.
SHARDS = {"semantic": 0, "episodic": 1, "procedural": 2, "code": 3, "science": 4, "relevance": 0}


def detection(text: Column, n_entities: Column, has_attribute: Column, route: tuple) -> tuple[Column, Column]:
    """(points, confidence) of one type: its words add, its exclusions subtract, what it needs adds a boost."""
    _, _, penalty, needs_entity, entity_boost, needs_attribute, attribute_boost, _, _, words, exclusions = route
    low = F.lower(text)
    count = lambda listed: sum((F.contains(low, F.lit(w)).cast("int") for w in listed.split("|") if w), F.lit(0))
    points = count(words) * vocab.KEYWORD_POINTS - count(exclusions) * penalty
    if needs_entity:
        points = points + F.when(n_entities > 0, entity_boost).otherwise(0.0)
    if needs_attribute:
        points = points + F.when(has_attribute, attribute_boost).otherwise(0.0)
    return points.cast("double"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (points + 10) / 30))


def detections(queries: DataFrame) -> DataFrame:
    """(query_id, priority, kind, points, confidence, passed) of each type for each understood query."""
    each = []
    for i, route in enumerate(vocab.ROUTES):
        points, confidence = detection(F.col("q"), F.size("q_entities"), F.col("q_attribute").isNotNull(), route)
        each.append(F.struct(F.lit(i).cast("long").alias("priority"), F.lit(route[0]).alias("kind"), F.round(points, 6).alias("points"), F.round(confidence, 6).alias("confidence"), (confidence >= route[1]).alias("passed")))
    return queries.select("query_id", F.explode(F.array(*each)).alias("x")).select("query_id", "x.*")


def classify(queries: DataFrame) -> DataFrame:
    """(query_id, kind, confidence): the most confident type that passes its bound, the earlier one if equal."""
    best = detections(queries).where("passed").groupBy("query_id").agg(F.max_by(F.struct("kind", "confidence"), F.struct("confidence", -F.col("priority"))).alias("x"))
    return best.select("query_id", "x.kind", "x.confidence")


def routes(spark) -> DataFrame:
    """The table of routes: type, least confidence, graph depth and sources."""
    rows = [(r[0], r[1], r[7], r[8].split()) for r in vocab.ROUTES]
    return spark.createDataFrame(rows, "kind string, min_confidence double, graph_depth long, sources array<string>")


def shards_of_query(kind: Column) -> Column:
    """The shard that holds the memories of a question's type; null for a general one, which has to read all."""
    out = F.lit(None).cast("long")
    for name, at in SHARDS.items():
        out = F.when(kind == name, at).otherwise(out)
    return out.cast("long")


def shard(memory_type: Column, shards: int = 5) -> Column:
    """The shard of a type; other types are spread by a hash, a missing one is in shard 0."""
    out = F.when(memory_type.isNull(), 0).otherwise(F.pmod(F.xxhash64(memory_type), F.lit(shards)))
    for kind, at in SHARDS.items():
        out = F.when(memory_type == kind, at).otherwise(out)
    return out.cast("long")
