"""Exact vector search for stated sets of queries, and similar pairs, of all vectors or within bounded batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scores as S
from lodestone.session import cut_lineage

#: About as many query vectors are searched for in one task.
BLOCK_QUERIES = 4_096
#: Most distinct vectors of a block that meets other blocks, and rows of it that are multiplied at once.
BLOCK_VECTORS, STRIP = 8_192, 512


def _block_search(dim: int, k: int, metric: str):
    """A function over the queries of one block and a part of the vectors: the k best of each query in that part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["role"].to_numpy() == 1
        ids, x = pdf["id"].to_numpy(), np.array(pdf["embedding"].tolist(), np.float64).reshape(-1, dim)
        if metric == "cosine":
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
        qids, q, ids, x = ids[asks], x[asks], ids[~asks], x[~asks]
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        out = []
        for a in range(0, len(q), STRIP):
            part = q[a : a + STRIP]
            d = -(part @ x.T) if metric == "cosine" else np.maximum(0, (part**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * part @ x.T)
            d = np.round(d, 6)
            if d.shape[1]:
                best = np.argsort(d, axis=1, kind="stable")[:, :k]  # of equal distances the smaller id
                out.append(pd.DataFrame({"query_id": np.repeat(qids[a : a + STRIP], best.shape[1]), "id": ids[best].ravel(), "distance": np.take_along_axis(d, best, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "distance": []})

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of each query, exactly; for cosine the distance is its negative.

    Queries are spread over blocks and vectors over parts; each block meets each part in one task, which gives the k best
    of each query there, and only those are ranked. Nothing of either passes through the driver.
    """
    from lodestone.operators.lexical import top_k

    asked = cut_lineage(queries.select(F.col("query_id").alias("id"), "embedding"))
    held = cut_lineage(vectors.select("id", "embedding"))
    n_queries, n_vectors = asked.count(), held.count()
    blocks, parts = max(1, math.ceil(n_queries / BLOCK_QUERIES)), max(1, math.ceil(n_vectors / BLOCK_VECTORS))
    first = held.select(F.size("embedding").alias("n")).first()

    def dealt(rows: DataFrame, role: int, own: int, others: int) -> DataFrame:
        mine, other = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        rows = rows.select("id", "embedding", F.lit(role).alias("role"), mine.alias("mine"), other.alias("other"))
        task = F.col("mine") * parts + F.col("other") if role else F.col("other") * parts + F.col("mine")
        return rows.select(task.alias("task"), "role", "id", "embedding")

    together = dealt(asked, 1, blocks, parts).unionByName(dealt(held, 0, parts, blocks))
    found = together.groupBy("task").applyInPandas(_block_search(first.n if first else 1, k, metric), "query_id long, id long, distance double")
    return top_k(found.withColumn("_neg", -F.col("distance")), k, "_neg").drop("_neg")


def similar_in_batches(vectors: DataFrame, batch_col: str, at_least: float) -> DataFrame:
    """(a, b, similarity): pairs of one bounded batch whose cosine similarity reaches a bound."""
    left = vectors.select(batch_col, F.col("id").alias("a"), F.col("embedding").alias("va"))
    right = vectors.select(batch_col, F.col("id").alias("b"), F.col("embedding").alias("vb"))
    sim = F.round(S.cosine(F.col("va"), F.col("vb")), 6)
    return left.join(right, batch_col).where("a < b").select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= at_least)


def similar_pairs(vectors: DataFrame, at_least: float, dim: int = 64, block: int = BLOCK_VECTORS) -> DataFrame:
    """(a, b, similarity): all pairs of (id, embedding) whose cosine similarity reaches a bound, exactly; a < b.

    Equal embeddings are compared once. The others are spread over blocks, and every
    two blocks meet in one task, which multiplies strips of the one with the other.
    """
    schema = "a long, b long, similarity double"
    named = cut_lineage(vectors.select("id", "embedding"))
    reps = named.groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    groups = cut_lineage(reps)
    n_blocks = max(1, math.ceil(groups.count() / block))
    # the blocks of a task as one number: the lesser one times n_blocks, plus the greater one
    own = F.pmod(F.xxhash64("rep"), F.lit(n_blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    rows = groups.select("rep", "embedding", own.alias("own"), other.alias("other"))
    rows = rows.select((F.least("own", "other") * n_blocks + F.greatest("own", "other")).alias("task"), "own", "rep", "embedding")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, last = divmod(int(pdf["task"].iloc[0]), n_blocks)
        ids, x = pdf["rep"].to_numpy(), np.array(pdf["embedding"].tolist(), np.float64).reshape(-1, dim)
        norms = np.maximum(np.sqrt((x * x).sum(1)), 1e-8)
        left, right = (np.flatnonzero(pdf["own"].to_numpy() == i) for i in (first, last))
        y, out = x[right].T.copy(), []
        for at in range(0, len(left), STRIP):
            part = left[at : at + STRIP]
            sim = np.round(x[part] @ y / norms[part][:, None] / norms[right][None], 6)
            i, j = np.nonzero(sim >= at_least)
            a, b = ids[part][i], ids[right][j]
            keep = a < b if first == last else a != b
            out.append(pd.DataFrame({"a": a[keep], "b": b[keep], "similarity": sim[i, j][keep]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "similarity": []})

    near = rows.groupBy("task").applyInPandas(run, schema)
    itself = F.round(S.cosine(F.col("embedding"), F.col("embedding")), 6)
    same = groups.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), itself.alias("similarity")).where(F.col("similarity") >= at_least)
    # back to the rows that have the embeddings
    members = cut_lineage(named.join(groups, "embedding").select("rep", "id"))
    x, y = (members.select(F.col("rep").alias(c), F.col("id").alias(i)) for c, i in (("a", "x"), ("b", "y")))
    found = near.unionByName(same).join(x, "a").join(y, "b").where("a <> b OR x < y")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
