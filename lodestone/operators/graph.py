"""Graph of named entities: adjacency, neighbourhoods, paths and the memories behind them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.skew import join_spread
from lodestone.session import cut_lineage

#: Edges of a graph that every task may hold, about 20 bytes each; the driver collects and sends them.
HELD_EDGES = 4_000_000
#: Rows that a search gives out at a time.
OUT_ROWS = 50_000


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, relation, weight): one edge for each ordered pair, the last one stored; names in lower case."""
    clean = edges.select(F.lower(F.trim("source")).alias("src"), F.lower(F.trim("target")).alias("dst"), "id", "relation", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    last = clean.groupBy("src", "dst").agg(F.max_by(F.struct("relation", "weight"), "id").alias("x"))
    return last.select("src", "dst", "x.relation", "x.weight")


def undirected(adj: DataFrame) -> DataFrame:
    return adj.select("src", "dst").unionByName(adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def hops(adj: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, node, hops): the least number of edges from each seed, the seed itself at 0; without a depth of all that can be reached.

    Each round expands only what is new, so there are as many rounds as the longest shortest path has edges.
    """
    links = cut_lineage(adj.select("src", "dst").distinct())
    seen = seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).cast("long").alias("hops")).distinct()
    edge, d = seen, 0
    while depth is None or d < depth:
        d += 1
        step = join_spread(edge.select("seed", F.col("node").alias("src")), links, "src", "dst").select("seed", F.col("dst").alias("node")).distinct()
        edge = cut_lineage(step.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(d).cast("long")))
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
        if d % 8 == 0:
            seen = cut_lineage(seen)
    return seen


def _paths_by_rounds(links: DataFrame, starts: DataFrame, rounds: int | None) -> DataFrame:
    """``weighted_paths`` by joins, of materialised edges and starts (seed); every round writes what is known so far."""
    best = cut_lineage(starts.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0.0).alias("cost")))
    moved, d = best, 0
    while rounds is None or d < rounds:
        d += 1
        step = join_spread(moved.withColumnRenamed("node", "src"), links, "src", "dst").groupBy("seed", F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("weight")).alias("new"))
        moved = cut_lineage(step.join(best, ["seed", "node"], "left").where("cost IS NULL OR new < cost").select("seed", "node", F.col("new").alias("cost")))
        if moved.isEmpty():
            break
        best = cut_lineage(best.unionByName(moved).groupBy("seed", "node").agg(F.min("cost").alias("cost")))
    return best


def _held(links: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The names of the nodes, and by the node's place among them where its edges begin, to which place each leads, and its weight."""
    ends = pa.chunked_array([*links["src"].chunks, *links["dst"].chunks], links.schema.field("src").type).combine_chunks().dictionary_encode()
    src, dst = np.split(ends.indices.to_numpy(), 2)
    weight = links["weight"].to_numpy() + 0.0
    weight[np.isnan(weight)] = np.nan  # of one sign
    order = np.argsort(src, kind="stable")
    return ends.dictionary, np.searchsorted(src[order], np.arange(len(ends.dictionary) + 1)), dst[order], weight[order]


def _cheapest(start: int, begin: np.ndarray, to: np.ndarray, weight: np.ndarray, rounds: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that can be reached from one of them, by place, and their costs."""
    # costs are compared by their bits, which order those above 0 as Spark does: infinity, then NaN, then what is not reached
    none = np.iinfo(np.int64).max
    best = np.full(len(begin) - 1, none)
    best[start] = 0
    moved, d = np.array([start]), 0
    while len(moved) and (rounds is None or d < rounds):
        d += 1
        n = begin[moved + 1] - begin[moved]
        ways = np.repeat(begin[moved] - np.cumsum(n) + n, n) + np.arange(n.sum())
        ends, new = to[ways], (np.repeat(best[moved].view(float), n) + weight[ways]).view(np.int64)
        less = new < best[ends]
        ends = ends[less]
        np.minimum.at(best, ends, new[less])
        changed = np.zeros(len(best), bool)
        changed[ends] = True
        moved = np.flatnonzero(changed)
    found = np.flatnonzero(best != none)
    return found, best[found].view(float)


def _paths_in_tasks(links: DataFrame, starts: DataFrame, rounds: int | None) -> DataFrame:
    """``weighted_paths`` with the whole graph in every task: each start is searched by itself, and its rows are written nowhere before they come out."""
    sc = links.sparkSession.sparkContext
    graph = sc.broadcast(_held(links.toArrow()))

    def run(batches):
        names, *edges = graph.value
        for batch in batches:
            seeds = batch.column(0)
            for seed, at in zip(seeds, pc.index_in(seeds, names).to_pylist(), strict=True):
                if at is None:
                    yield pa.record_batch({"seed": pa.array([seed]), "node": pa.array([seed]), "cost": pa.array([0.0])})
                    continue
                found, cost = _cheapest(at, *edges, rounds)
                for i in range(0, len(found), OUT_ROWS):
                    node = names.take(pa.array(found[i : i + OUT_ROWS]))
                    yield pa.record_batch({"seed": pa.repeat(seed, len(node)), "node": node, "cost": pa.array(cost[i : i + OUT_ROWS])})

    return starts.repartition(4 * sc.defaultParallelism).mapInArrow(run, "seed string, node string, cost double")


def weighted_paths(adj: DataFrame, seeds: DataFrame, rounds: int | None = None, held: int = HELD_EDGES) -> DataFrame:
    """(seed, node, cost): the cheapest path from each seed, of at most ``rounds`` edges if given; negative weights count as 0.

    A round starts only from nodes that became cheaper in the one before, until none does. A graph of at most ``held`` edges
    is sent to all tasks, so that nothing but the result grows with seeds times nodes; a larger one is searched by joins.
    """
    links = cut_lineage(adj.select("src", "dst", F.greatest(F.lit(0.0), "weight").alias("weight")))
    starts = cut_lineage(seeds.select("seed").distinct())
    return (_paths_in_tasks if links.count() <= held else _paths_by_rounds)(links, starts, rounds)


def neighbour_relations(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, neighbour, relation, direction): the edges that touch each seed, seen from it; names in lower case."""
    ends = edges.select(F.lower(F.trim("source")).alias("a"), F.lower(F.trim("target")).alias("b"), "relation")
    rows = ends.select(F.col("a").alias("seed"), F.col("b").alias("neighbour"), "relation", F.lit("out").alias("direction"))
    rows = rows.unionByName(ends.select(F.col("b").alias("seed"), F.col("a").alias("neighbour"), "relation", F.lit("in").alias("direction")))
    return rows.distinct().join(seeds.select("seed").distinct(), "seed", "left_semi")


def explain(adj: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, src, relation, dst): the edges between the nodes within ``depth`` edges of each seed."""
    near = cut_lineage(hops(adj, seeds, depth).select("seed", "node"))
    inner = join_spread(near.withColumnRenamed("node", "src"), cut_lineage(adj.select("src", "dst", "relation")), "src", "dst")
    return inner.join(near.withColumnRenamed("node", "dst"), ["seed", "dst"], "left_semi").select("seed", "src", "relation", "dst")


def export(adj: DataFrame) -> DataFrame:
    """(group, data): the nodes and edges as the JSON elements that graph viewers read."""
    nodes = adj.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select(F.lit("nodes").alias("group"), F.to_json(F.struct("id", F.col("id").alias("label"))).alias("data"))
    edges = adj.select(F.lit("edges").alias("group"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("relation").alias("label"))).alias("data"))
    return nodes.unionByName(edges)


def entity_memories(edges: DataFrame) -> DataFrame:
    """(node, memory_id): the memories whose edges touch an entity."""
    ends = F.explode(F.array(F.lower(F.trim("source")), F.lower(F.trim("target"))))
    return edges.select(ends.alias("node"), "memory_id").where("memory_id IS NOT NULL").distinct()


def reachable_memories(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, memory_id, hops): memories of entities within ``depth`` edges, with the least number of edges."""
    near = hops(adjacency(edges), seeds, depth)
    return join_spread(near, cut_lineage(entity_memories(edges)), "node", "memory_id").groupBy("seed", "memory_id").agg(F.min("hops").alias("hops"))


def nearest_memories(edges: DataFrame, seeds: DataFrame, depth: int, k: int) -> DataFrame:
    """(seed, memory_id, hops): the k first of ``reachable_memories`` of each seed by edges, then id, without those of all nodes in reach.

    A level holds the memories at the end of so many edges from each node. Of a level the 2 * k first ids are enough: if
    fewer than k memories are nearer, no more than those can stand before the k that count.
    """
    links = cut_lineage(adjacency(edges).select("src", "dst"))
    first = Window.partitionBy("node").orderBy("memory_id")

    def least(rows: DataFrame) -> DataFrame:
        return cut_lineage(rows.distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= 2 * k).drop("_n"))

    starts = cut_lineage(seeds.select(F.col("seed").alias("node")).distinct())
    level = least(entity_memories(edges))
    found = level.join(starts, "node").withColumn("hops", F.lit(0).cast("long"))
    for d in range(1, depth + 1):
        # the last level is needed only for the seeds
        ways = links if d < depth else links.join(starts.withColumnRenamed("node", "src"), "src", "left_semi")
        level = least(ways.join(level.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "memory_id"))
        found = found.unionByName(level.join(starts, "node").withColumn("hops", F.lit(d).cast("long")))
    rows = found.groupBy(F.col("node").alias("seed"), "memory_id").agg(F.min("hops").alias("hops"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("hops", "memory_id")))
    return rows.where(F.col("_n") <= k).drop("_n")
