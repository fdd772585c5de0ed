"""Queries over the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.plans.storage_queries import LIVE
from lodestone.queries import register
from lodestone.session import table

DEPTH = 3
_EDGES = "e AS (SELECT id, memory_id, lower(trim(source)) AS src, lower(trim(target)) AS dst, relation, coalesce(weight, 1.0) AS weight FROM graph_edges WHERE source IS NOT NULL AND target IS NOT NULL)"
_ADJ = f"{_EDGES}, adj AS (SELECT src, dst, arg_max(relation, id) AS relation, arg_max(weight, id) AS weight FROM e GROUP BY 1, 2)"
_SEEDS = "seeds AS (SELECT DISTINCT lower(trim(name)) AS seed FROM entities WHERE id % 100 = 0 AND name IS NOT NULL)"


def _edges(spark, sf):
    return table(spark, sf, "graph_edges").where("source IS NOT NULL AND target IS NOT NULL")


def _seeds(spark, sf):
    """Searches start at the entities whose id is divisible by 100, against the whole graph."""
    return table(spark, sf, "entities").where((F.pmod("id", F.lit(100)) == 0) & F.col("name").isNotNull()).select(F.lower(F.trim("name")).alias("seed")).distinct()


@register("graph_build", f"WITH {_ADJ} SELECT src, dst, relation, round(weight, 6) AS weight FROM adj")
def graph_build(spark, sf):
    return graph.adjacency(_edges(spark, sf)).select("src", "dst", "relation", F.round("weight", 6).alias("weight"))


@register("graph_stats", f"WITH {_ADJ}, n AS (SELECT src AS x FROM adj UNION SELECT dst FROM adj) SELECT count(*) AS edges, count(DISTINCT relation) AS relations, (SELECT count(*) FROM n) AS nodes FROM adj")
def graph_stats(spark, sf):
    adj = graph.adjacency(_edges(spark, sf))
    nodes = adj.select(F.explode(F.array("src", "dst")).alias("x")).agg(F.countDistinct("x").alias("nodes"))
    return adj.agg(F.count("*").alias("edges"), F.countDistinct("relation").alias("relations")).crossJoin(nodes)


def _hops(links: str, depth: int = DEPTH) -> str:
    return f"""h AS (SELECT seed, seed AS node, CAST(0 AS BIGINT) AS hops FROM seeds UNION SELECT h.seed, l.dst, h.hops + 1 FROM h JOIN {links} l ON l.src = h.node WHERE h.hops < {depth}),
    near AS (SELECT seed, node, min(hops) AS hops FROM h GROUP BY 1, 2)"""


@register("k_hop_neighbors", f"WITH RECURSIVE {_ADJ}, {_SEEDS}, {_hops('adj')} SELECT seed, node, hops FROM near WHERE hops > 0")
def k_hop_neighbors(spark, sf):
    return graph.hops(graph.adjacency(_edges(spark, sf)), _seeds(spark, sf), DEPTH).where("hops > 0")


@register(
    "undirected_neighbors",
    f"WITH RECURSIVE {_ADJ}, {_SEEDS}, both_ways AS (SELECT src, dst FROM adj UNION SELECT dst, src FROM adj), {_hops('both_ways', 2)} SELECT seed, node, hops FROM near WHERE hops > 0",
)
def undirected_neighbors(spark, sf):
    return graph.hops(graph.undirected(graph.adjacency(_edges(spark, sf))), _seeds(spark, sf), 2).where("hops > 0")


@register(
    "multi_hop_memories",
    f"""WITH RECURSIVE {_ADJ}, {_SEEDS}, {_hops('adj')}, em AS (SELECT src AS node, memory_id FROM e UNION SELECT dst, memory_id FROM e)
    SELECT seed, memory_id, min(hops) AS hops FROM near JOIN em USING (node) WHERE memory_id IS NOT NULL GROUP BY 1, 2""",
)
def multi_hop_memories(spark, sf):
    return graph.reachable_memories(_edges(spark, sf), _seeds(spark, sf), DEPTH)


#: Shortest paths to the fixpoint: a node comes again only if it became nearer.
_HOPS_TO_THE_END = """h(seed, node, hops) USING KEY (seed, node) AS (SELECT seed, seed, CAST(0 AS BIGINT) FROM seeds UNION
    SELECT n.seed, n.node, min(n.hops) FROM (SELECT h.seed, a.dst AS node, h.hops + 1 AS hops FROM h JOIN adj a ON a.src = h.node) n
    LEFT JOIN recurring.h r ON r.seed = n.seed AND r.node = n.node WHERE r.hops IS NULL OR n.hops < r.hops GROUP BY 1, 2)"""


@register(
    "shortest_path_hops",
    f"WITH RECURSIVE {_ADJ}, {_SEEDS}, {_HOPS_TO_THE_END} SELECT h.seed AS source, b.seed AS target, h.hops FROM h JOIN seeds b ON b.seed = h.node",
)
def shortest_path_hops(spark, sf):
    """Least number of edges between the entities that searches start at; pairs without a path give no row."""
    near = graph.hops(graph.adjacency(_edges(spark, sf)), _seeds(spark, sf))
    ends = _seeds(spark, sf).select(F.col("seed").alias("target"))
    return near.join(ends, F.col("node") == F.col("target")).select(F.col("seed").alias("source"), "target", "hops")


@register(
    "weighted_shortest_path",
    f"""WITH RECURSIVE {_ADJ}, {_SEEDS}, p(seed, node, cost) USING KEY (seed, node) AS (SELECT seed, seed, CAST(0 AS DOUBLE) FROM seeds UNION
      SELECT n.seed, n.node, min(n.cost) FROM (SELECT p.seed, a.dst AS node, p.cost + greatest(0.0, a.weight) AS cost FROM p JOIN adj a ON a.src = p.node) n
      LEFT JOIN recurring.p r ON r.seed = n.seed AND r.node = n.node WHERE r.cost IS NULL OR n.cost < r.cost GROUP BY 1, 2)
    SELECT seed, node, round(cost, 6) AS cost FROM p""",
)
def weighted_shortest_path(spark, sf):
    """The cheapest path of any length to every node that can be reached."""
    return graph.weighted_paths(graph.adjacency(_edges(spark, sf)), _seeds(spark, sf)).select("seed", "node", F.round("cost", 6).alias("cost"))


@register(
    "neighbour_relations",
    f"""WITH {_EDGES}, {_SEEDS}, r AS (SELECT src AS seed, dst AS neighbour, relation, 'out' AS direction FROM e UNION SELECT dst, src, relation, 'in' FROM e)
    SELECT * FROM r WHERE seed IN (SELECT seed FROM seeds)""",
)
def neighbour_relations(spark, sf):
    return graph.neighbour_relations(_edges(spark, sf), _seeds(spark, sf))


@register(
    "graph_explain",
    f"""WITH RECURSIVE {_ADJ}, {_SEEDS}, {_hops('adj', 2)} SELECT n.seed, a.src, a.relation, a.dst FROM near n JOIN adj a ON a.src = n.node JOIN near m ON m.seed = n.seed AND m.node = a.dst""",
)
def graph_explain(spark, sf):
    """The edges within two edges of each start."""
    return graph.explain(graph.adjacency(_edges(spark, sf)), _seeds(spark, sf), 2)


@register(
    "graph_export",
    f"""WITH {_ADJ}, n AS (SELECT src AS id FROM adj UNION SELECT dst FROM adj)
    SELECT 'nodes' AS "group", CAST(to_json(struct_pack(id := id, label := id)) AS VARCHAR) AS data FROM n
    UNION ALL SELECT 'edges', CAST(to_json(struct_pack(source := src, target := dst, label := relation)) AS VARCHAR) FROM adj""",
)
def graph_export(spark, sf):
    return graph.export(graph.adjacency(_edges(spark, sf)))


@register("entity_memories", f"WITH {_EDGES} SELECT src AS node, memory_id FROM e WHERE memory_id IS NOT NULL UNION SELECT dst, memory_id FROM e WHERE memory_id IS NOT NULL")
def entity_memories(spark, sf):
    return graph.entity_memories(_edges(spark, sf))


@register(
    "entity_connections",
    f"WITH {_ADJ} SELECT src, relation, count(*) AS n, min(dst) AS first_target FROM adj GROUP BY 1, 2",
)
def entity_connections(spark, sf):
    return graph.adjacency(_edges(spark, sf)).groupBy("src", "relation").agg(F.count("*").alias("n"), F.min("dst").alias("first_target"))


@register(
    "relationship_build",
    f"""WITH r AS (SELECT id, unnest(relationships) AS r FROM memories WHERE {LIVE}),
    c AS (SELECT DISTINCT id AS memory_id, lower(trim(r.source)) AS source, r.relation, lower(trim(r.target)) AS target FROM r)
    SELECT * FROM c WHERE source <> '' AND target <> '' AND source <> target""",
)
def relationship_build(spark, sf):
    """The edges that live memories give: distinct, without empty ends and self loops."""
    from lodestone.operators import store

    rows = store.live(table(spark, sf, "memories")).select(F.col("id").alias("memory_id"), F.explode("relationships").alias("r"))
    clean = rows.select("memory_id", F.lower(F.trim("r.source")).alias("source"), "r.relation", F.lower(F.trim("r.target")).alias("target")).distinct()
    return clean.where("source <> '' AND target <> '' AND source <> target")


@register(
    "entity_resolution",
    f"""WITH {_EDGES}, names AS (SELECT src AS name FROM e UNION SELECT dst FROM e), known AS (SELECT lower(trim(name)) AS name FROM entities WHERE name IS NOT NULL),
    new AS (SELECT name FROM names WHERE name NOT IN (SELECT name FROM known)) SELECT name, CAST((SELECT max(id) FROM entities) + row_number() OVER (ORDER BY name) AS BIGINT) AS id FROM new""",
)
def entity_resolution(spark, sf):
    """Ids for the names in the graph that no entity has yet."""
    from lodestone.operators import store

    ent = table(spark, sf, "entities")
    edges = _edges(spark, sf)
    names = edges.select(F.explode(F.array(F.lower(F.trim("source")), F.lower(F.trim("target")))).alias("name")).distinct()
    new = names.join(ent.where("name IS NOT NULL").select(F.lower(F.trim("name")).alias("name")), "name", "left_anti")
    return store.insert_many(ent, new, "name").select("name", "id")
