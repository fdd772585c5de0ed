"""Filling containers of fixed capacity with texts, sized in tokens.

Method: cost-balanced packing. A text of n tokens costs ``n + n * n / QUADRATIC``
(the linear layers and the attention). Texts come in descending order, and each
goes to the container of lowest cost that still has room for its tokens; if none
has, a new one is opened. The number of containers at the start is the least
that could hold all tokens, so containers are not opened before they are needed.

Only a text that alone exceeds the capacity is cut: into pieces that fill a
container each, and a last piece that is packed like any other text.

At scale: texts are dealt by a hash of their id into shards of about
``SHARD_CONTAINERS`` containers, which are packed independently; a shard wastes at
most about one container more than a common packing would. The number of tokens
in each shard is bounded by the shard count, which follows the corpus, so no
task grows with it.

Defined cases: null or empty texts are left out; ties in size are ordered by id;
repeated ids are packed as separate texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

CAPACITY = 2048
#: Tokens at which the attention costs as much as the linear layers.
QUADRATIC = 4096.0
#: Containers of an average shard.
SHARD_CONTAINERS = 2048


def assign(sizes: np.ndarray, capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> np.ndarray:
    """The container of each size; sizes must come in descending order and fit the capacity."""
    n = len(sizes)
    start = max(1, -(-int(sizes.sum()) // capacity))
    room, cost = np.full(start + 64, capacity, np.int64), np.zeros(start + 64)
    used, out = start, np.empty(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        best = int(np.argmin(np.where(room[:used] >= size, cost[:used], np.inf)))
        if room[best] < size:
            if used == len(room):
                room, cost = np.concatenate([room, np.full(used, capacity)]), np.concatenate([cost, np.zeros(used)])
            best, used = used, used + 1
        room[best] -= size
        cost[best] += size + size * size / quadratic
        out[i] = best
    return out


def _pack(capacity: int, quadratic: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        shard = int(pdf["shard"].iloc[0])
        slot = assign(pdf["n_tokens"].to_numpy(np.int64), capacity, quadratic)
        return pd.DataFrame(
            {
                "container_id": (shard << 32) + slot,
                "doc_id": pdf["doc_id"],
                "piece": pdf["piece"],
                "start_token": pdf["start_token"],
                "n_tokens": pdf["n_tokens"],
            }
        )

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, quadratic: float = QUADRATIC, shard_containers: int = SHARD_CONTAINERS) -> DataFrame:
    """(container_id, doc_id, piece, start_token, n_tokens) from (doc_id, n_tokens)."""
    sizes = cut_lineage(sizes.where("n_tokens > 0"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = max(1, round(total / (capacity * shard_containers)))
    items = (
        sizes.select("doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("piece", "_"))
        .withColumn("start_token", F.col("piece").cast("long") * capacity)
        .select("doc_id", F.col("piece").cast("long").alias("piece"), "start_token", F.least(F.lit(capacity), F.col("n_tokens") - F.col("start_token")).cast("long").alias("n_tokens"))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    )
    schema = "container_id long, doc_id long, piece long, start_token long, n_tokens long"
    return items.groupBy("shard").applyInPandas(_pack(capacity, quadratic), schema)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, fill, least, waste): how full the containers are, and how many more there are than could hold all tokens at all."""
    loads = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    totals = loads.agg(F.count("*").alias("containers"), F.coalesce(F.sum("load"), F.lit(0)).cast("long").alias("tokens"))
    least = F.ceil(F.col("tokens") / capacity).cast("long")
    return totals.select("containers", "tokens", F.round(F.try_divide(F.col("tokens"), F.col("containers") * capacity), 6).alias("fill"), least.alias("least"), (F.col("containers") - least).alias("waste"))
