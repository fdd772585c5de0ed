"""Scoring formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import vocab


def semantic(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def bm25_distance(score: Column) -> Column:
    return F.lit(1.0) / (score + 1e-6)


def recency(created: Column, memory_type: Column, now: str) -> Column:
    """exp(-age / tau) in whole periods of 24 hours; a missing time counts as 0.5."""
    age = F.greatest(F.lit(0), F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(created.cast("timestamp"))) / 86400))
    days = F.lit(vocab.OTHER_RECENCY_DAYS)
    for kind, tau in vocab.RECENCY_DAYS.items():
        days = F.when(memory_type == kind, F.lit(tau)).otherwise(days)
    return F.when(created.isNull(), F.lit(0.5)).otherwise(F.exp(-age / days))


def token_overlap(query: Column, memory: Column, memory_type: Column) -> Column:
    """Share of the query's words that occur, or Jaccard for types that are not matched exactly."""
    q, m = F.array_distinct(query), F.array_distinct(memory)
    shared = F.size(F.array_intersect(q, m))
    exact = F.coalesce(memory_type.isin("episodic", "procedural", "code"), F.lit(False))
    share = F.when(F.size(q) > 0, shared / F.size(q)).otherwise(0.0)
    union = F.size(F.array_union(q, m))
    return F.when(exact, share).when(union > 0, shared / union).otherwise(0.0)


def entity_overlap(query: Column, memory: Column) -> Column:
    q = F.array_distinct(F.transform(query, F.lower))
    m = F.transform(F.coalesce(memory, F.array().cast("array<string>")), F.lower)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, m)) / F.size(q)).otherwise(0.0)


def sigmoid(x: Column, scale: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x / scale))


def linear_relevance(x: Column) -> Column:
    """The other form of the relevance: a fifth of the normalised score between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / 5))


def entity_boost(query: Column, memory: Column) -> Column:
    """Half a point for each entity that both name; only shown, never ranked by."""
    lower = lambda x: F.array_distinct(F.transform(F.coalesce(x, F.array().cast("array<string>")), F.lower))
    return F.size(F.array_intersect(lower(query), lower(memory))) * 0.5


def final_score(normalized: Column, importance: Column, recency_score: Column, attribute_boost: Column, bm25: Column, weights: dict | None = None) -> Column:
    """The final score; diversity is not known yet and counts as none."""
    w = weights or vocab.FINAL_WEIGHTS
    return (
        sigmoid(normalized) * w["relevance"]
        + importance * w["importance"]
        + recency_score * w["recency"]
        + F.lit(w["diversity"])
        + sigmoid(attribute_boost, 0.5) * w["attribute"]
        + sigmoid(bm25) * w["bm25"]
    )


def importance(text: Column, cue: Column, goal: Column, memory_type: Column, given: Column, created: Column, access_count: Column, now: str) -> Column:
    """The importance of a memory by its cues; at most 1."""
    age = F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(created.cast("timestamp"))) / 86400)
    return F.least(
        F.lit(1.0),
        F.lit(0.3)
        + F.when(cue, 0.3).otherwise(0.0)
        + F.when(F.length(text) > 100, 0.1).otherwise(0.0)
        + F.when(goal, 0.2).otherwise(0.0)
        + F.when(memory_type.isin("science", "code", "procedural"), 0.1).otherwise(0.0)
        + F.when(given > 0.5, 0.1).otherwise(0.0)
        + F.when(given.isNotNull(), 0.05).otherwise(0.0)
        + F.when(age == 0, 0.05).when(age < 7, 0.02).otherwise(0.0)
        + F.when(access_count > 5, F.least(F.lit(0.1), access_count * 0.01)).otherwise(0.0),
    )


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(1e-8))
    return dot(a, b) / (norm(a) * norm(b))


def mmr_lambda(n: Column) -> Column:
    """The weight of relevance by the number of candidates, already raised by its bonus."""
    return F.least(F.lit(1.0), F.when(n <= 10, 0.95).when(n <= 30, 0.90).when(n <= 75, 0.85).otherwise(0.80) + 0.10)


def adjusted_weight(weight: Column, delta: Column, step: float = 0.02) -> Column:
    """One step of a signal's weight against its delta, within bounds; a missing delta leaves it."""
    return F.when(delta.isNull(), weight).otherwise(F.least(F.lit(0.5), F.greatest(F.lit(0.01), weight - F.lit(step) * delta / (F.abs(delta) + 0.001))))
