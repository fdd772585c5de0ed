"""Queries over stored memories: scans, look-ups, counts and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import vocab
from lodestone.functions.vocab import Settings
from lodestone.operators import store
from lodestone.queries import register
from lodestone.session import table

S = Settings()
NOW = f"TIMESTAMP '{S.now}'"
LIVE = "coalesce(tombstone, 0) = 0"
#: The closed set of types and the default importance, as SQL.
KIND = f"CASE WHEN memory_type IN ({', '.join(repr(t) for t in vocab.MEMORY_TYPES)}) THEN memory_type ELSE 'general' END"
IMPORTANCE = "coalesce(nullif(importance, 0), 0.5)"
#: Feedback events delivered twice count once, and what one event adds, as SQL.
EVENTS = "ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at NULLS LAST) AS rn FROM feedback_events) WHERE rn = 1)"
DELTA = "CASE lower(user_action) WHEN 'click' THEN 0.5 WHEN 'skip' THEN -0.2 WHEN 'dwell' THEN CASE WHEN duration_ms > 100 THEN least(2.0, ln(duration_ms / 1000 + 1) * 0.5) ELSE 0 END ELSE 0 END"


def expected_ids(spark, sf):
    """(id): the memories that questions expect."""
    return table(spark, sf, "questions").select(F.explode("expected_ids").alias("e")).select(F.expr("try_cast(e AS bigint)").alias("id"))


EXPECTED = "(SELECT TRY_CAST(unnest(expected_ids) AS BIGINT) AS id FROM questions)"


@register("live_scan", f"SELECT id, text FROM memories WHERE {LIVE}")
def live_scan(spark, sf):
    return store.live(table(spark, sf, "memories")).select("id", "text")


@register("multi_get", f"SELECT id, text FROM memories WHERE {LIVE} AND id IN {EXPECTED}")
def multi_get(spark, sf):
    return store.multi_get(table(spark, sf, "memories"), expected_ids(spark, sf)).select("id", "text")


@register(
    "point_lookup",
    f"SELECT id, text, subject FROM memories WHERE {LIVE} AND id = 42",
)
def point_lookup(spark, sf):
    return store.live(table(spark, sf, "memories")).where("id = 42").select("id", "text", "subject")


@register(
    "typed_top_n",
    f"""WITH d AS (SELECT id, {KIND} AS memory_type, {IMPORTANCE} AS importance, created_at FROM memories WHERE {LIVE}),
    r AS (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY importance DESC, created_at DESC, id) AS rank FROM d)
    SELECT memory_type, id, importance, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 50""",
)
def typed_top_n(spark, sf):
    return store.top_by_type(table(spark, sf, "memories"), 50).select("memory_type", "id", "importance", F.col("rank").cast("long").alias("rank"))


@register(
    "attribute_lookup",
    f"""SELECT id, subject, attribute FROM memories m WHERE {LIVE} AND EXISTS (
    SELECT 1 FROM memories k WHERE k.id IN {EXPECTED} AND k.subject = m.subject AND k.attribute = m.attribute)""",
)
def attribute_lookup(spark, sf):
    mem = table(spark, sf, "memories")
    keys = mem.join(expected_ids(spark, sf).distinct(), "id", "left_semi")
    return store.attribute_lookup(mem, keys).select("id", "subject", "attribute")


@register("latest_n", f"SELECT id, text, importance FROM memories WHERE {LIVE} ORDER BY id DESC LIMIT 10")
def latest_n(spark, sf):
    return store.latest(table(spark, sf, "memories"), 10).select("id", "text", "importance")


@register(
    "keyset_batches",
    "SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 500) AS BIGINT) AS batch FROM memories",
)
def keyset_batches(spark, sf):
    return store.batches(table(spark, sf, "memories").select("id"), 500)


@register(
    "record_projection",
    f"""SELECT id, coalesce(normalized_text, text) AS normalized_text,
    CAST(coalesce(nullif(token_count, 0), len(coalesce(tokens, []))) AS BIGINT) AS token_count, {KIND} AS memory_type, {IMPORTANCE} AS importance,
    CASE WHEN json_valid(metadata) THEN metadata ->> '$.subject' END AS subject FROM memories WHERE {LIVE}""",
)
def record_projection(spark, sf):
    rows = store.decode(store.live(table(spark, sf, "memories")))
    return rows.select("id", "normalized_text", "token_count", "memory_type", "importance", F.col("metadata")["subject"].alias("subject"))


@register(
    "soft_delete_view",
    f"SELECT id, text FROM memories WHERE {LIVE} AND id NOT IN (SELECT memory_id FROM graph_edges WHERE source = target AND memory_id IS NOT NULL)",
)
def soft_delete_view(spark, sf):
    gone = table(spark, sf, "graph_edges").where("source = target").select(F.col("memory_id").alias("id"))
    return store.live(store.soft_delete(table(spark, sf, "memories"), gone)).select("id", "text")


@register(
    "touch_importance",
    f"""SELECT id, round(CASE WHEN id IN {EXPECTED} THEN coalesce(importance, 0.5) + 0.01 ELSE importance END, 6) AS importance,
    CASE WHEN id IN {EXPECTED} THEN TRUE ELSE coalesce(last_accessed = {NOW}, FALSE) END AS touched_now FROM memories""",
)
def touch_importance(spark, sf):
    rows = store.touch(table(spark, sf, "memories"), expected_ids(spark, sf).where("id IS NOT NULL"), S.now)
    return rows.select("id", F.round("importance", 6).alias("importance"), F.coalesce(F.col("last_accessed") == F.lit(S.now).cast("timestamp_ntz"), F.lit(False)).alias("touched_now"))


@register(
    "decay_importance",
    f"""SELECT id, round(CASE WHEN last_accessed < {NOW} - INTERVAL 1 DAY THEN greatest(0.1, importance - 0.001) ELSE importance END, 6) AS importance FROM memories""",
)
def decay_importance(spark, sf):
    return store.decay(table(spark, sf, "memories"), S.now, S.decay_rate, S.decay_floor).select("id", F.round("importance", 6).alias("importance"))


@register(
    "merge_update",
    """WITH n AS (SELECT memory_id AS id, max(importance_score) AS importance FROM candidates GROUP BY memory_id)
    SELECT m.id, round(coalesce(n.importance, m.importance), 6) AS importance FROM memories m LEFT JOIN n ON m.id = n.id""",
)
def merge_update(spark, sf):
    new = table(spark, sf, "candidates").groupBy(F.col("memory_id").alias("id")).agg(F.max("importance_score").alias("importance"))
    return store.merge(table(spark, sf, "memories"), new, ["importance"]).select("id", F.round("importance", 6).alias("importance"))


@register(
    "bulk_insert_ids",
    "SELECT question_id, CAST((SELECT max(id) FROM memories) + row_number() OVER (ORDER BY question_id) AS BIGINT) AS id FROM questions",
)
def bulk_insert_ids(spark, sf):
    return store.insert_many(table(spark, sf, "memories"), table(spark, sf, "questions").select("question_id"), "question_id").select("question_id", "id")


@register(
    "prune_candidates",
    f"SELECT id FROM memories WHERE {LIVE} AND importance < 0.1 AND created_at < {NOW} - INTERVAL 365 DAY",
)
def prune_candidates(spark, sf):
    return store.prunable(table(spark, sf, "memories"), S.now, S.prune_importance, S.prune_days).select("id")


@register(
    "typed_filter_fallback",
    f"""WITH c AS (SELECT DISTINCT c.query_id, m.id, {KIND} AS memory_type, CASE family WHEN 'temporal' THEN 'episodic' WHEN 'attribute' THEN 'semantic' WHEN 'summary' THEN 'science' ELSE 'general' END AS hint
      FROM candidates c JOIN memories m ON m.id = c.memory_id JOIN questions ON question_id = query_id WHERE {LIVE}),
    t AS (SELECT *, sum(CASE WHEN memory_type = hint THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS n FROM c)
    SELECT query_id, id FROM t WHERE n = 0 OR memory_type = hint""",
)
def typed_filter_fallback(spark, sf):
    mem = store.decode(store.live(table(spark, sf, "memories"))).select("id", "memory_type")
    rows = table(spark, sf, "candidates").select("query_id", F.col("memory_id").alias("id")).distinct().join(mem, "id")
    family = F.col("family")
    hint = F.when(family == "temporal", "episodic").when(family == "attribute", "semantic").when(family == "summary", "science").otherwise("general")
    rows = rows.join(table(spark, sf, "questions").select(F.col("question_id").alias("query_id"), hint.alias("hint")), "query_id")
    return store.typed_or_all(rows, "query_id", F.col("memory_type"), F.col("hint")).select("query_id", "id")


@register("goals_active", "SELECT id, goal, progress, lower(coalesce(status, 'active')) AS status FROM goals WHERE lower(coalesce(status, 'active')) = 'active'")
def goals_active(spark, sf):
    from lodestone.api import Engine

    return Engine.open(spark, sf).list_goals("active").select("id", "goal", "progress", "status")


@register("shard_filter", "SELECT id FROM memories WHERE id % 5 = 3")
def shard_filter(spark, sf):
    return table(spark, sf, "memories").where(F.pmod("id", F.lit(5)) == 3).select("id")


@register("count_live", f"SELECT count(*) AS n FROM memories WHERE {LIVE}")
def count_live(spark, sf):
    return store.live(table(spark, sf, "memories")).agg(F.count("*").alias("n"))


@register("entity_type_counts", "SELECT lower(entity_type) AS entity_type, count(*) AS n FROM entities GROUP BY 1")
def entity_type_counts(spark, sf):
    return table(spark, sf, "entities").groupBy(F.lower("entity_type").alias("entity_type")).agg(F.count("*").alias("n"))


@register(
    "entity_lookup",
    """WITH names AS (SELECT DISTINCT lower(trim(source)) AS key FROM graph_edges WHERE source IS NOT NULL),
    hits AS (SELECT key, e.id, 0 AS prio FROM names JOIN entities e ON lower(trim(e.name)) = key
      UNION ALL SELECT key, a.id, 1 FROM names JOIN (SELECT id, lower(trim(unnest(aliases))) AS alias FROM entities) a ON a.alias = key),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio, id) AS rn FROM hits)
    SELECT key, id FROM ranked WHERE rn = 1""",
)
def entity_lookup(spark, sf):
    """Each name used in the graph with its entity: by name, else by alias, the first id."""
    keys = table(spark, sf, "graph_edges").where("source IS NOT NULL").select(F.lower(F.trim("source")).alias("key")).distinct()
    ent = table(spark, sf, "entities")
    named = ent.select(F.lower(F.trim("name")).alias("key"), "id", F.lit(0).alias("prio"))
    aliased = ent.select(F.explode("aliases").alias("a"), "id").select(F.lower(F.trim("a")).alias("key"), "id", F.lit(1).alias("prio"))
    best = named.unionByName(aliased).where("key IS NOT NULL").groupBy("key").agg(F.min_by("id", F.struct("prio", "id")).alias("id"))
    return keys.join(best, "key").select("key", "id")


@register(
    "entity_add_alias",
    """WITH extra AS (SELECT e.id, g.target AS alias FROM entities e JOIN graph_edges g ON g.source = e.name WHERE g.relation = 'related_to'),
    every AS (SELECT id, unnest(aliases) AS alias FROM entities UNION SELECT id, alias FROM extra)
    SELECT e.id, coalesce(string_agg(a.alias, ' | ' ORDER BY a.alias), '') AS aliases FROM entities e LEFT JOIN every a ON a.id = e.id AND a.alias <> coalesce(e.name, '') GROUP BY e.id""",
)
def entity_add_alias(spark, sf):
    ent = table(spark, sf, "entities")
    new = table(spark, sf, "graph_edges").where("relation = 'related_to'").join(ent.select("id", F.col("name").alias("source")).withColumnRenamed("id", "eid"), "source")
    return store.add_aliases(ent, new.select(F.col("eid").alias("id"), F.col("target").alias("alias"))).select("id", F.array_join(F.array_sort("aliases"), " | ").alias("aliases"))


@register("entity_remove_alias", "SELECT id, array_to_string(list_filter(coalesce(aliases, []), lambda a: a <> 'head office'), ' | ') AS aliases FROM entities")
def entity_remove_alias(spark, sf):
    """Entities without a general alias."""
    return store.remove_alias(table(spark, sf, "entities"), "head office").select("id", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " | ").alias("aliases"))


@register("entity_set_type", "SELECT id, name, CASE WHEN id = 7 THEN 'place' ELSE entity_type END AS entity_type FROM entities")
def entity_set_type(spark, sf):
    return store.set_type(table(spark, sf, "entities"), 7, "place").select("id", "name", "entity_type")


@register(
    "edge_dedup",
    "SELECT memory_id, source, relation, target, count(*) AS copies FROM graph_edges GROUP BY ALL",
)
def edge_dedup(spark, sf):
    return table(spark, sf, "graph_edges").groupBy("memory_id", "source", "relation", "target").agg(F.count("*").alias("copies"))


@register(
    "edge_insert",
    """WITH new AS (SELECT DISTINCT m.id AS memory_id, r.source, r.relation, r.target FROM (SELECT id, unnest(relationships) AS r FROM memories) m)
    SELECT memory_id, source, relation, target FROM new n WHERE NOT EXISTS (
      SELECT 1 FROM graph_edges g WHERE g.memory_id = n.memory_id AND g.source = n.source AND g.relation = n.relation AND g.target = n.target)""",
)
def edge_insert(spark, sf):
    new = table(spark, sf, "memories").select(F.col("id").alias("memory_id"), F.explode("relationships").alias("r")).select("memory_id", "r.source", "r.relation", "r.target")
    return store.add_edges(table(spark, sf, "graph_edges"), new)


@register(
    "edge_delete",
    "SELECT id FROM graph_edges WHERE memory_id IS NULL OR memory_id NOT IN (SELECT id FROM memories WHERE coalesce(tombstone, 0) = 1)",
)
def edge_delete(spark, sf):
    gone = table(spark, sf, "memories").where(F.coalesce("tombstone", F.lit(0)) == 1).select(F.col("id").alias("memory_id"))
    return store.drop_edges(table(spark, sf, "graph_edges"), gone, ["memory_id"]).select("id")


@register("edge_stats", "SELECT count(*) AS edges, count(DISTINCT memory_id) AS memories, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM graph_edges")
def edge_stats(spark, sf):
    return table(spark, sf, "graph_edges").agg(
        F.count("*").alias("edges"), F.countDistinct("memory_id").alias("memories"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets")
    )


@register("relation_histogram", "SELECT memory_id, relation, count(*) AS n FROM graph_edges GROUP BY 1, 2")
def relation_histogram(spark, sf):
    return table(spark, sf, "graph_edges").groupBy("memory_id", "relation").agg(F.count("*").alias("n"))


@register(
    "goals_by_status",
    "SELECT lower(coalesce(status, 'active')) AS status, count(*) AS n, count(DISTINCT lower(progress)) AS progress_values FROM goals GROUP BY 1",
)
def goals_by_status(spark, sf):
    """Goals without a status are active."""
    return (
        table(spark, sf, "goals")
        .groupBy(F.lower(F.coalesce("status", F.lit("active"))).alias("status"))
        .agg(F.count("*").alias("n"), F.countDistinct(F.lower("progress")).alias("progress_values"))
    )


@register(
    "vector_append",
    "SELECT memory_id, array_to_string(list_transform(min(embedding[1:32]), lambda x: CAST(round(x * 512) AS BIGINT)), ' ') AS steps FROM candidates WHERE len(embedding) >= 1 GROUP BY memory_id",
)
def vector_append(spark, sf):
    """Vectors cut to 32 numbers, as multiples of 1/512."""
    rows = store.add_vectors(table(spark, sf, "candidates").withColumnRenamed("memory_id", "id"), 32)
    least = rows.groupBy(F.col("id").alias("memory_id")).agg(F.min("embedding").alias("e"))
    return least.select("memory_id", F.array_join(F.transform("e", lambda x: F.round(x * 512).cast("long").cast("string")), " ").alias("steps"))


@register(
    "sync_check",
    """WITH a AS (SELECT id FROM memories WHERE coalesce(tombstone, 0) = 0), b AS (SELECT DISTINCT memory_id AS id FROM candidates WHERE len(embedding) > 0)
    SELECT id, 'missing' AS side FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'orphaned' FROM b WHERE id NOT IN (SELECT id FROM a)""",
)
def sync_check(spark, sf):
    from lodestone.operators import maintain

    vectors = table(spark, sf, "candidates").where(F.size("embedding") > 0).select(F.col("memory_id").alias("id"))
    return maintain.sync(store.live(table(spark, sf, "memories")), vectors)


@register(
    "health_report",
    """SELECT 'memories' AS item, count(*) AS n FROM memories UNION ALL SELECT 'live', count(*) FROM memories WHERE coalesce(tombstone, 0) = 0
    UNION ALL SELECT 'without_normalized_text', count(*) FROM memories WHERE normalized_text IS NULL
    UNION ALL SELECT 'broken_metadata', count(*) FROM memories WHERE metadata IS NOT NULL AND NOT json_valid(metadata)
    UNION ALL SELECT 'edges_without_memory', count(*) FROM graph_edges g WHERE memory_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM memories m WHERE m.id = g.memory_id)""",
)
def health_report(spark, sf):
    mem, edges = table(spark, sf, "memories"), table(spark, sf, "graph_edges")
    broken = F.col("metadata").isNotNull() & F.from_json("metadata", "map<string,string>").isNull()
    counts = mem.agg(
        F.count("*").alias("memories"), F.count_if(F.coalesce("tombstone", F.lit(0)) == 0).alias("live"), F.count_if(F.col("normalized_text").isNull()).alias("without_normalized_text"), F.count_if(broken).alias("broken_metadata")
    )
    orphans = edges.where("memory_id IS NOT NULL").join(mem.select(F.col("id").alias("memory_id")), "memory_id", "left_anti").agg(F.count("*").alias("n"))
    return counts.unpivot([], ["memories", "live", "without_normalized_text", "broken_metadata"], "item", "n").unionByName(orphans.select(F.lit("edges_without_memory").alias("item"), "n"))


@register(
    "export_texts",
    f"SELECT id, CAST(to_json(struct_pack(id := id, text := text)) AS VARCHAR) AS record FROM memories WHERE {LIVE}",
)
def export_texts(spark, sf):
    return store.live(table(spark, sf, "memories")).select("id", F.to_json(F.struct("id", "text")).alias("record"))
