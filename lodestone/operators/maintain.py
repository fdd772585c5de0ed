"""Maintenance: consolidation of similar memories, and checks that stored parts agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vocab import Settings
from lodestone.operators import store


def ward(x: np.ndarray, limit: float) -> np.ndarray:
    """Cluster numbers by Ward's linkage over cosine distances, joined while the linkage stays within the limit."""
    n = len(x)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    d = np.maximum(0.0, 1 - unit @ unit.T)
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - 1):
        flat = int(np.argmin(d))
        i, j = sorted(divmod(flat, n))
        best = d[i, j]
        if not best <= limit:
            break
        ok = alive.copy()
        ok[[i, j]] = False
        total = size[i] + size[j] + size
        new = np.sqrt(np.maximum(0.0, ((size[i] + size) * d[i] ** 2 + (size[j] + size) * d[j] ** 2 - size * best**2)[ok] / total[ok]))
        d[i, ok] = d[ok, i] = new
        d[j, :] = d[:, j] = np.inf
        alive[j] = False
        size[i] += size[j]
        label[label == j] = i
    return label


def clusters(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(id, cluster): the smallest id of each memory's cluster among the rows of its batch of ids.

    Batches are bounded, so each is a grouped function over at most ``cluster_batch`` rows.
    """
    limit = settings.cluster_distance

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        label = ward(np.array(pdf["embedding"].tolist(), np.float64), limit)
        return pd.DataFrame({"id": ids, "cluster": ids[label]})

    return store.batches(rows.where(F.size("embedding") > 0), settings.cluster_batch).groupBy("batch").applyInPandas(run, "id long, cluster long")


def _grouped(memories: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, keep_id, n, top, entities, relationships) of each cluster; what a cluster unites is made distinct before it is collected."""
    rows = store.decode(store.live(memories)).select("id", "importance", "entities", "relationships").join(labels, "id")
    best = rows.groupBy("cluster").agg(F.max_by("id", F.struct("importance", -F.col("id"))).alias("keep_id"), F.count("*").alias("n"), F.max("importance").alias("top"))
    united = rows.select("cluster", F.explode("entities").alias("e")).distinct().groupBy("cluster").agg(F.sort_array(F.collect_list("e")).alias("entities"))
    linked = rows.select("cluster", F.explode("relationships").alias("r")).distinct().groupBy("cluster").agg(F.sort_array(F.collect_list("r")).alias("relationships"))
    return best.where("n > 1").join(united, "cluster", "left").join(linked, "cluster", "left")


def merge_clusters(memories: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, keep_id, n, importance, entities, relationships): the merge of each cluster of more than one memory.

    The most important memory stays, a little more important than before; entities and relationships are united.
    """
    importance = F.round(F.least(F.lit(1.0), F.col("top") + 0.1), 6).alias("importance")
    entities = F.coalesce("entities", F.array().cast("array<string>")).alias("entities")
    return _grouped(memories, labels).select("cluster", "keep_id", "n", importance, entities, F.coalesce("relationships", F.array()).alias("relationships"))


def apply_merges(memories: DataFrame, labels: DataFrame) -> DataFrame:
    """The table after the merges: the row that stays has what its cluster unites, the others are flagged as deleted."""
    merged = merge_clusters(memories, labels)
    kept = merged.select(F.col("keep_id").alias("id"), F.col("importance").alias("_i"), F.col("entities").alias("_e"), F.col("relationships").alias("_r"))
    gone = labels.join(merged.select("cluster", "keep_id"), "cluster").where("id <> keep_id").select("id", F.lit(1).alias("_gone"))
    rows = memories.join(kept, "id", "left").join(gone, "id", "left")
    changed = {"importance": F.coalesce("_i", "importance"), "entities": F.coalesce("_e", "entities"), "relationships": F.coalesce("_r", "relationships"), "tombstone": F.coalesce("_gone", "tombstone")}
    return rows.withColumns(changed).select(*memories.columns)


def sync(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, side): ids of only one of two sets, as missing (only left) or orphaned (only right)."""
    a, b = left.select("id").distinct(), right.select("id").distinct()
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "id", "left_anti").withColumn("side", F.lit("orphaned")))


def cached_vectors(memories: DataFrame, vectors: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(id, embedding) of all live memories: what a cache holds already, else the stored vector, null where there is none; without a cache all are fetched anew."""
    rows = store.live(memories).select("id").join(vectors.select("id", F.col("embedding").alias("_stored")), "id", "left")
    if cache is None:
        return rows.select("id", F.col("_stored").alias("embedding"))
    return rows.join(cache.select("id", F.col("embedding").alias("_kept")), "id", "left").select("id", F.coalesce("_kept", "_stored").alias("embedding"))
