"""Queries over feedback, sessions and history, and over the quality of retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.vocab import START_WEIGHTS, Settings
from lodestone.operators import evaluate, learn, maintain, rank, store
from lodestone.plans import retrieval_queries as R
from lodestone.plans.storage_queries import IMPORTANCE, KIND, LIVE, NOW
from lodestone.queries import register
from lodestone.session import table

S = Settings()
_EV = "ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at NULLS LAST) AS rn FROM feedback_events) WHERE rn = 1)"
_DELTA = "CASE lower(user_action) WHEN 'click' THEN 0.5 WHEN 'skip' THEN -0.2 WHEN 'dwell' THEN CASE WHEN duration_ms > 100 THEN least(2.0, ln(duration_ms / 1000 + 1) * 0.5) ELSE 0 END ELSE 0 END"


def _events(spark, sf):
    return table(spark, sf, "feedback_events")


@register("events_once", f"WITH {_EV} SELECT event_id, mem_id, lower(user_action) AS user_action FROM ev")
def events_once(spark, sf):
    return learn.once(_events(spark, sf)).select("event_id", "mem_id", F.lower("user_action").alias("user_action"))


_FEEDBACK = f"""s AS (SELECT mem_id, CAST(sum({_DELTA}) AS DOUBLE) AS raw, max(ts) AS last FROM ev WHERE mem_id IS NOT NULL GROUP BY 1),
  fb AS (SELECT mem_id, round(raw, 6) AS raw, round(greatest(-1.0, least(1.0, raw * pow(0.95, greatest(0, floor((epoch({NOW}) - floor(epoch(last))) / 86400))))), 6) AS boost FROM s)"""


@register("feedback_boost", f"WITH {_EV}, {_FEEDBACK} SELECT mem_id, raw, boost FROM fb")
def feedback_boost(spark, sf):
    return learn.feedback(_events(spark, sf), S)


@register("top_boosted", f"WITH {_EV}, {_FEEDBACK} SELECT mem_id, raw FROM fb ORDER BY raw DESC, mem_id LIMIT 25")
def top_boosted(spark, sf):
    return learn.feedback(_events(spark, sf), S).select("mem_id", "raw").orderBy(F.desc("raw"), "mem_id").limit(25)


@register(
    "session_boost",
    f"""WITH {_EV}, c AS (SELECT session_id, mem_id, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM ev WHERE lower(user_action) = 'click')
    SELECT session_id, mem_id, max(CAST(CASE WHEN n >= 5 AND r <= 5 THEN 0.3 ELSE 0.2 END AS DOUBLE)) AS boost FROM c WHERE r <= 500 GROUP BY 1, 2""",
)
def session_boost(spark, sf):
    return learn.session_boost(_events(spark, sf))


@register(
    "follow_up_credit",
    f"""WITH {_EV}, own AS (SELECT *, lag(query_text) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS previous FROM ev WHERE query_text IS NOT NULL),
    asked AS (SELECT previous AS query_text, count(*) AS times FROM own WHERE lower(user_action) = 'follow_up' AND previous IS NOT NULL GROUP BY 1),
    late AS (SELECT o.query_text, o.mem_id, lower(o.user_action) AS a, times, row_number() OVER (PARTITION BY o.query_text ORDER BY ts DESC, event_id DESC) AS r FROM own o JOIN asked USING (query_text)),
    kept AS (SELECT *, count(*) OVER (PARTITION BY query_text) AS size FROM late WHERE r <= 10)
    SELECT mem_id, CAST(round(sum(0.3 * (1.0 - (size - r) / size * 0.5) * times), 6) AS DOUBLE) AS credit FROM kept WHERE a IN ('click', 'dwell') GROUP BY 1""",
)
def follow_up_credit(spark, sf):
    return learn.follow_up_credit(_events(spark, sf))


_REL = f"""a AS (SELECT mem_id, count(*) AS uses, max(ts) AS last, CAST(sum({_DELTA}) AS DOUBLE) AS raw FROM ev WHERE mem_id IS NOT NULL GROUP BY 1),
  rel AS (SELECT mem_id, uses, round(uses * 0.5 + 0.3 / (1 + (epoch({NOW}) - floor(epoch(last))) / 86400 / 30) + raw * 0.2, 6) AS relevance FROM a)"""


@register("relevance_score", f"WITH {_EV}, {_REL} SELECT mem_id, uses, relevance FROM rel")
def relevance_score(spark, sf):
    return learn.relevance(_events(spark, sf), S)


@register(
    "top_relevant_by_type",
    f"""WITH {_EV}, {_REL}, j AS (SELECT {KIND} AS memory_type, m.id, relevance FROM memories m JOIN rel ON mem_id = m.id WHERE {LIVE}),
    k AS (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY relevance DESC, id) AS rank FROM j) SELECT memory_type, id, relevance, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= 10""",
)
def top_relevant_by_type(spark, sf):
    rel = learn.relevance(_events(spark, sf), S).select(F.col("mem_id").alias("id"), "relevance")
    rows = store.decode(store.live(table(spark, sf, "memories"))).select("id", "memory_type").join(rel, "id")
    return learn.ring(rows, ["memory_type"], [F.desc("relevance"), "id"], 10).select("memory_type", "id", "relevance", F.col("rn").alias("rank"))


@register("relevance_prune", f"SELECT mem_id FROM feedback_events WHERE mem_id IS NOT NULL GROUP BY 1 HAVING max(ts) < {NOW} - INTERVAL 180 DAY")
def relevance_prune(spark, sf):
    return learn.stale(_events(spark, sf), S)


@register("frequent_queries", f"WITH {_EV} SELECT query_text, count(*) AS uses FROM ev WHERE query_text IS NOT NULL GROUP BY 1 ORDER BY uses DESC, query_text LIMIT 20")
def frequent_queries(spark, sf):
    return learn.frequent_queries(_events(spark, sf), 20)


@register(
    "query_ring_buffer",
    f"""WITH {_EV}, r AS (SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r FROM ev) SELECT session_id, event_id, CAST(r AS BIGINT) AS rn FROM r WHERE r <= 10""",
)
def query_ring_buffer(spark, sf):
    """The last ten events of each session."""
    return learn.ring(learn.once(_events(spark, sf)), ["session_id"], [F.desc("ts"), F.desc("event_id")], 10).select("session_id", "event_id", "rn")


@register(
    "previous_query",
    f"WITH {_EV} SELECT event_id, lag(query_text) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS previous FROM ev",
)
def previous_query(spark, sf):
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    return learn.once(_events(spark, sf)).select("event_id", F.lag("query_text").over(w).alias("previous"))


@register(
    "history_search",
    """SELECT question_id, count(DISTINCT memory_id) AS results, round(max(final_score), 6) AS best FROM questions q JOIN candidates c ON c.query_id = q.question_id
    WHERE lower(query_text) LIKE '%what%' AND retrieved_at >= TIMESTAMP '2024-03-01' AND retrieved_at < TIMESTAMP '2025-01-01' GROUP BY 1 HAVING count(DISTINCT memory_id) >= 3 AND max(final_score) >= 0.5""",
)
def history_search(spark, sf):
    """Past questions by words, time, number of results and best score."""
    asked = table(spark, sf, "questions").where(F.contains(F.lower("query_text"), F.lit("what")))
    rows = table(spark, sf, "candidates").where("retrieved_at >= TIMESTAMP_NTZ '2024-03-01' AND retrieved_at < TIMESTAMP_NTZ '2025-01-01'")
    joined = asked.join(rows, F.col("question_id") == F.col("query_id")).groupBy("question_id")
    return joined.agg(F.countDistinct("memory_id").alias("results"), F.round(F.max("final_score"), 6).alias("best")).where("results >= 3 AND best >= 0.5")


@register(
    "history_diff",
    """WITH a AS (SELECT memory_id, max(final_score) AS s FROM candidates WHERE query_id = 1 GROUP BY 1), b AS (SELECT memory_id, max(final_score) AS s FROM candidates WHERE query_id = 2 GROUP BY 1)
    SELECT coalesce(a.memory_id, b.memory_id) AS memory_id, CASE WHEN b.memory_id IS NULL THEN 'first' WHEN a.memory_id IS NULL THEN 'second' ELSE 'both' END AS side, round(b.s - a.s, 6) AS delta
    FROM a FULL JOIN b ON a.memory_id = b.memory_id""",
)
def history_diff(spark, sf):
    """The results of two questions against each other."""
    rows = table(spark, sf, "candidates")
    of = lambda q, name: rows.where(F.col("query_id") == q).groupBy("memory_id").agg(F.max("final_score").alias(name))
    side = F.when(F.col("b").isNull(), "first").when(F.col("a").isNull(), "second").otherwise("both")
    return of(1, "a").join(of(2, "b"), "memory_id", "full_outer").select("memory_id", side.alias("side"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def _results(spark, sf):
    """The recall pipeline's results with text and metadata."""
    mem = table(spark, sf, "memories").select("id", "text", "metadata")
    return rank.recall(table(spark, sf, "questions"), table(spark, sf, "candidates"), table(spark, sf, "memories"), S).join(mem, "id")


_PIPE = f"""{R._Q}, {R._SIGNALS}, {R._FINAL}, {R._WALK.format(budget=S.token_budget)},
  res AS (SELECT f.query_id, f.id, row_number() OVER (PARTITION BY f.query_id ORDER BY normalized DESC, final DESC, f.id) AS rank FROM f JOIN walk USING (query_id, id) WHERE kept),
  rk AS (SELECT qu.question_id AS query_id, qu.family, coalesce(min(CASE WHEN contains(lower(m.text), lower(qu.expected)) OR contains(lower(coalesce(m.metadata, '')), lower(qu.expected)) THEN rank END),
      min(CASE WHEN list_contains(qu.expected_ids, CAST(m.id AS VARCHAR)) THEN rank END)) AS rank
    FROM questions qu LEFT JOIN (SELECT res.*, text, metadata FROM res JOIN memories USING (id) WHERE rank <= {S.response_limit}) m ON m.query_id = qu.question_id WHERE qu.expected IS NOT NULL GROUP BY 1, 2)"""
_RECALL = "count(*) AS questions, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS retrieved, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END), 6) AS recall_{k}" for k in (1, 3, 5, 10))


def _ranks(spark, sf):
    return evaluate.expected_rank(_results(spark, sf), table(spark, sf, "questions"))


@register("expected_rank", f"WITH RECURSIVE {_PIPE} SELECT query_id, family, CAST(rank AS BIGINT) AS rank FROM rk")
def expected_rank(spark, sf):
    return _ranks(spark, sf)


@register("recall_at_k", f"WITH RECURSIVE {_PIPE} SELECT {_RECALL} FROM rk")
def recall_at_k(spark, sf):
    return evaluate.recall_at(_ranks(spark, sf))


@register("recall_by_family", f"WITH RECURSIVE {_PIPE} SELECT family, {_RECALL} FROM rk GROUP BY family")
def recall_by_family(spark, sf):
    return evaluate.recall_at(_ranks(spark, sf), by=["family"])


@register("rank_buckets", f"WITH RECURSIVE {_PIPE} SELECT CASE WHEN rank IS NULL THEN 'never' WHEN rank = 1 THEN '1' WHEN rank <= 3 THEN '2-3' WHEN rank <= 10 THEN '4-10' ELSE '11+' END AS bucket, count(*) AS questions FROM rk GROUP BY 1")
def rank_buckets(spark, sf):
    return evaluate.rank_buckets(_ranks(spark, sf))


_NAMES = ["semantic", "token", "entity", "recency", "importance"]
_DELTAS = f"""r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, id) AS rank FROM b),
  ids AS (SELECT DISTINCT question_id AS query_id, TRY_CAST(unnest(expected_ids) AS BIGINT) AS id FROM questions),
  ex AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM r JOIN ids USING (query_id, id)) WHERE rn = 1 AND rank > 3),
  pr AS (SELECT {', '.join(f'w.{s} - ex.{s} AS {s}' for s in _NAMES)} FROM r w JOIN ex USING (query_id) WHERE w.rank = 1),
  dl AS ({' UNION ALL '.join(f"SELECT '{s}' AS signal, round(avg({s}), 6) AS delta, count(*) AS n FROM pr" for s in _NAMES)})"""


#: The signals of the union of all sources, in place of the given candidates.
_OWN = f"{R._LEX}, {R._Q}, {R._UNION}, " + R._SIGNALS.replace("c AS (SELECT query_id, memory_id AS id, min(distance) AS distance, max(coalesce(bm25_score, 0)) AS bm25 FROM candidates GROUP BY 1, 2)", "c AS (SELECT query_id, id, distance, CAST(0 AS DOUBLE) AS bm25 FROM won WHERE rn = 1)")


def _deltas(spark, sf):
    # only questions with an expected memory among their candidates have a delta; the others are not ranked
    questions = table(spark, sf, "questions").where(F.exists("expected_ids", lambda e: e.try_cast("bigint").isNotNull()))
    ids = evaluate.expected_ids(questions).groupBy("query_id").agg(F.collect_set("id").alias("_ids"))
    found = R.union_sources(spark, sf, questions=questions).select("query_id", "id", "distance", F.lit(0.0).alias("bm25")).join(ids, "query_id")
    found = found.withColumn("_any", F.max(F.array_contains("_ids", F.col("id"))).over(Window.partitionBy("query_id"))).where("_any").drop("_any", "_ids")
    rows = rank.base_score(rank.signals(found, table(spark, sf, "memories"), rank.understand(questions)))
    rows = rows.select("query_id", "id", "base", *_NAMES)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("base"), "id")))
    return evaluate.signal_deltas(ranked.select("query_id", "id", "rank", *_NAMES), questions, _NAMES)


@register("failure_signal_delta", f"WITH {_OWN}, {_DELTAS} SELECT signal, CAST(delta AS DOUBLE) AS delta, n FROM dl WHERE n > 0")
def failure_signal_delta(spark, sf):
    """By how much the first result leads the expected one in each signal, where that ranks below 3; over the candidates of all sources."""
    return _deltas(spark, sf)


@register(
    "adaptive_weights",
    f"""WITH {_OWN}, {_DELTAS}, w0(signal, weight) AS (VALUES {', '.join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in sorted(START_WEIGHTS.items()))}),
    mv AS (SELECT signal, CASE WHEN delta IS NULL THEN weight ELSE least(0.5, greatest(0.01, weight - 0.02 * delta / (abs(delta) + 0.001))) END AS weight FROM w0 LEFT JOIN dl USING (signal))
    SELECT signal, round(greatest(0.01, least(0.5, weight / (SELECT sum(weight) FROM mv))), 6) AS weight FROM mv""",
)
def adaptive_weights(spark, sf):
    return learn.adapt(_deltas(spark, sf).select("signal", "delta"))


@register(
    "flight_recorder",
    f"WITH RECURSIVE {_PIPE} SELECT query_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS top_ids, count(*) AS n FROM res WHERE rank <= 20 GROUP BY 1",
)
def flight_recorder(spark, sf):
    """The first 20 results of each question, as they are recorded."""
    rows = rank.recall(table(spark, sf, "questions"), table(spark, sf, "candidates"), table(spark, sf, "memories"), S).where("rank <= 20")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",")
    return rows.groupBy("query_id").agg(listed.alias("top_ids"), F.count("*").alias("n"))


def _vectors(spark, sf):
    return R._vectors(spark, sf)


@register("consolidate_clusters")
def consolidate_clusters(spark, sf):
    """Clusters of similar memories within batches of 500, merged."""
    rows = maintain.merge_clusters(table(spark, sf, "memories"), maintain.clusters(_vectors(spark, sf), S))
    return rows.select("cluster", "keep_id", "n", "importance", F.size("entities").cast("long").alias("n_entities"), F.size("relationships").cast("long").alias("n_relationships"))


@register(
    "apply_merges",
    f"""WITH m AS (SELECT id, subject, attribute, {IMPORTANCE} AS importance FROM memories WHERE {LIVE} AND subject IS NOT NULL AND attribute IS NOT NULL),
    g AS (SELECT subject, attribute, count(*) AS n, max(importance) AS top, arg_max(id, (importance, -id)) AS keep_id FROM m GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT o.id, round(CASE WHEN o.id = keep_id THEN least(1.0, top + 0.1) ELSE o.importance END, 6) AS importance, CASE WHEN m.id IS NOT NULL AND keep_id IS NOT NULL AND o.id <> keep_id THEN 1 ELSE coalesce(tombstone, 0) END AS tombstone
    FROM memories o LEFT JOIN m USING (id) LEFT JOIN g ON g.subject = m.subject AND g.attribute = m.attribute""",
)
def apply_merges(spark, sf):
    """The table after those merges are made."""
    mem = table(spark, sf, "memories")
    labels = store.live(mem).where("subject IS NOT NULL AND attribute IS NOT NULL").select("id", F.struct("subject", "attribute").alias("cluster"))
    return maintain.apply_merges(mem, labels).select("id", F.round("importance", 6).alias("importance"), F.coalesce("tombstone", F.lit(0)).alias("tombstone"))


@register(
    "merge_by_subject",
    f"""WITH m AS (SELECT id, subject, attribute, {IMPORTANCE} AS importance, coalesce(entities, []) AS entities, relationships FROM memories WHERE {LIVE} AND subject IS NOT NULL AND attribute IS NOT NULL),
    g AS (SELECT subject, attribute, count(*) AS n, max(importance) AS top, arg_max(id, (importance, -id)) AS keep_id FROM m GROUP BY 1, 2),
    u AS (SELECT subject, attribute, string_agg(DISTINCT e, ' | ' ORDER BY e) AS entities FROM (SELECT subject, attribute, unnest(entities) AS e FROM m) GROUP BY 1, 2),
    r AS (SELECT subject, attribute, count(DISTINCT r) AS relationships FROM (SELECT subject, attribute, unnest(relationships) AS r FROM m) GROUP BY 1, 2)
    SELECT g.subject, g.attribute, keep_id, n, round(least(1.0, top + 0.1), 6) AS importance, coalesce(entities, '') AS entities, coalesce(relationships, 0) AS relationships FROM g LEFT JOIN u USING (subject, attribute) LEFT JOIN r USING (subject, attribute) WHERE n > 1""",
)
def merge_by_subject(spark, sf):
    """The merge step of consolidation on the memories that state one attribute of one subject."""
    mem = table(spark, sf, "memories").where("subject IS NOT NULL AND attribute IS NOT NULL")
    rows = maintain.merge_clusters(mem, mem.select("id", F.struct("subject", "attribute").alias("cluster")))
    return rows.select("cluster.subject", "cluster.attribute", "keep_id", "n", "importance", F.array_join("entities", " | ").alias("entities"), F.size("relationships").cast("long").alias("relationships"))
