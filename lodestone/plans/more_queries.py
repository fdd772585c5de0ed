"""Further queries: registry of signals, vectors by id, records and summaries of evaluations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import scores, vocab
from lodestone.functions.vocab import Settings
from lodestone.operators import rank
from lodestone.operators.signals import SignalRegistry
from lodestone.operators import evaluate, learn, lexical
from lodestone.plans import retrieval_queries as R
from lodestone.plans.learning_queries import _PIPE, _RECALL, _ranks
from lodestone.plans.storage_queries import DELTA, EVENTS, EXPECTED, LIVE, NOW, expected_ids
from lodestone.plans.text_queries import WORDS
from lodestone.queries import register
from lodestone.session import table
from lodestone.sources import sinks

S = Settings()
_WEIGHTS = ", ".join(f"('{n}', '{k}', CAST({of.get(k, of['default'])} AS DOUBLE))" for n, of in vocab.SIGNALS.items() for k in vocab.MEMORY_TYPES)


@register("signal_weights", f"SELECT * FROM (VALUES {_WEIGHTS}) t(signal, kind, weight)")
def signal_weights(spark, sf):
    return SignalRegistry().table(spark)


@register(
    "vector_fetch",
    f"""WITH v AS (SELECT memory_id, min(embedding) AS e FROM candidates WHERE len(embedding) > 0 GROUP BY 1)
    SELECT DISTINCT i.id, array_to_string(list_transform(v.e, lambda x: CAST(round(x * 512) AS BIGINT)), ' ') AS steps FROM {EXPECTED} i LEFT JOIN v ON v.memory_id = i.id WHERE i.id IS NOT NULL""",
)
def vector_fetch(spark, sf):
    """The stored vectors, as multiples of 1/512, of the memories that questions expect; null where nothing is stored."""
    vec = table(spark, sf, "candidates").where(F.size("embedding") > 0).groupBy(F.col("memory_id").alias("id")).agg(F.min("embedding").alias("e"))
    ids = expected_ids(spark, sf).where("id IS NOT NULL").distinct()
    return ids.join(vec, "id", "left").select("id", F.array_join(F.transform("e", lambda x: F.round(x * 512).cast("long").cast("string")), " ").alias("steps"))


@register(
    "evaluation_summary",
    f"""WITH RECURSIVE {_PIPE} SELECT count(*) AS questions, count(rank) AS retrieved, CAST(sum(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS BIGINT) AS rank_1,
    CAST(sum(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS rank_3, CAST(sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS rank_5, round(avg(rank), 6) AS mean_rank FROM rk""",
)
def evaluation_summary(spark, sf):
    at = lambda k: F.count_if(F.col("rank") <= k)
    return _ranks(spark, sf).agg(F.count("*").alias("questions"), F.count("rank").alias("retrieved"), at(1).alias("rank_1"), at(3).alias("rank_3"), at(5).alias("rank_5"), F.round(F.avg("rank"), 6).alias("mean_rank"))


@register(
    "evaluation_record",
    f"""WITH RECURSIVE {_PIPE}, cc AS (SELECT query_id, count(*) AS n, count(CASE WHEN rank <= 20 THEN 1 END) AS kept FROM res WHERE rank <= {S.response_limit} GROUP BY 1)
    SELECT question_id AS query_id, query_text AS query, expected, coalesce(n, 0) AS candidate_count, coalesce(kept, 0) AS recorded FROM questions LEFT JOIN cc ON cc.query_id = question_id""",
)
def evaluation_record(spark, sf):
    questions = table(spark, sf, "questions")
    rows = sinks.record(rank.recall(questions, table(spark, sf, "candidates"), table(spark, sf, "memories"), S), questions)
    return rows.select("query_id", "query", "expected", "candidate_count", F.coalesce(F.size("candidates"), F.lit(0)).cast("long").alias("recorded"))


@register(
    "memory_types",
    f"SELECT lower(coalesce(memory_type, 'unknown')) AS memory_type, count(*) AS n, count(DISTINCT subject) AS subjects, round(avg(importance), 6) AS importance FROM memories WHERE {LIVE} GROUP BY 1",
)
def memory_types(spark, sf):
    rows = table(spark, sf, "memories").where(F.coalesce("tombstone", F.lit(0)) == 0).groupBy(F.lower(F.coalesce("memory_type", F.lit("unknown"))).alias("memory_type"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"), F.round(F.avg("importance"), 6).alias("importance"))


_OWN = (
    f"{R._LEX}, {R._BM25}, own AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM bm25), "
    + _PIPE.replace("c AS (SELECT query_id, memory_id AS id, min(distance) AS distance, max(coalesce(bm25_score, 0)) AS bm25 FROM candidates GROUP BY 1, 2)", "c AS (SELECT query_id, id, 1 / (score + 1e-6) AS distance, score AS bm25 FROM own WHERE r <= 150)")
)


@register("recall_of_own_retrieval", f"WITH RECURSIVE {_OWN} SELECT family, {_RECALL} FROM rk GROUP BY family")
def recall_of_own_retrieval(spark, sf):
    """Recall by family when the engine retrieves by words itself, instead of ranking the given candidates."""
    questions, memories = table(spark, sf, "questions"), table(spark, sf, "memories")
    found = lexical.bm25_best(R._docs(spark, sf), R._terms(spark, sf), S.source_k)
    rows = found.select("query_id", F.col("id").alias("memory_id"), (1.0 / (F.col("score") + 1e-6)).alias("distance"), F.col("score").alias("bm25_score"), F.lit(False).alias("graph_hit"))
    shown = rank.recall(questions, rows, memories, S).join(memories.select("id", "text", "metadata"), "id")
    return evaluate.recall_at(evaluate.expected_rank(shown, questions), by=["family"])


def world_engine(spark, people: int = 500):
    """(engine over a generated world, its questions): the texts are ingested as any others, and the graph has what ingestion finds."""
    from lodestone.api import Engine
    from lodestone.session import cut_lineage
    from lodestone.sources import ingest
    from lodestone.sources.world import World

    own = World(spark, people)
    memories = cut_lineage(ingest.enrich(own.memories().select("id", "text")).withColumn("last_accessed", F.col("created_at")))
    found = memories.select(F.col("id").alias("memory_id"), F.explode("relationships").alias("r"))
    edges = found.select((F.col("memory_id") * 1000 + F.row_number().over(Window.partitionBy("memory_id").orderBy("r"))).alias("id"), "memory_id", "r.source", "r.relation", "r.target", F.lit(1.0).alias("weight"))
    edges = edges.unionByName(own.edges().withColumn("id", F.col("id") * 1000))
    return Engine(spark, memories, edges=cut_lineage(edges)), cut_lineage(own.questions())


@register("world_recall")
def world_recall(spark, sf):
    """Recall by family on a generated world of 500 people, retrieved and ranked by the engine from the texts alone."""
    engine, questions = world_engine(spark)
    return engine.evaluate(questions, engine.recall(questions), ["family"])


@register(
    "isolated_bm25",
    f"""WITH docs AS (SELECT DISTINCT query_id, memory_id AS id FROM candidates), toks AS (SELECT d.query_id, d.id, {WORDS.format('text')} AS tokens FROM docs d JOIN memories m ON m.id = d.id WHERE {LIVE}),
    sized AS (SELECT *, len(tokens) AS dl FROM toks WHERE len(tokens) > 0), stats AS (SELECT query_id, count(*) AS n_docs, avg(dl) AS avgdl FROM sized GROUP BY 1),
    w AS (SELECT query_id, id, dl, unnest(tokens) AS term FROM sized), tf AS (SELECT query_id, id, dl, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY 1, 2), {R._QT}
    SELECT query_id, id, round(sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN qt USING (query_id, term) JOIN df USING (query_id, term) JOIN stats USING (query_id) GROUP BY 1, 2""",
)
def isolated_bm25(spark, sf):
    """Each question against its own candidates only: all statistics are those of its own texts."""
    own = table(spark, sf, "candidates").select("query_id", F.col("memory_id").alias("id")).distinct()
    return lexical.bm25_isolated(own.join(R._docs(spark, sf), "id"), R._terms(spark, sf))


@register(
    "expected_by_source",
    f"""WITH {R._LEX}, {R._Q}, {R._UNION}, {R._SOURCES}, ids AS (SELECT DISTINCT question_id AS query_id, TRY_CAST(unnest(expected_ids) AS BIGINT) AS id FROM questions)
    SELECT source, count(*) AS candidates, count(ids.id) AS expected FROM won JOIN prio USING (p) LEFT JOIN ids ON ids.query_id = won.query_id AND ids.id = won.id WHERE rn = 1 GROUP BY 1""",
)
def expected_by_source(spark, sf):
    """How many candidates and how many expected memories come from each source."""
    want = table(spark, sf, "questions").select(F.col("question_id").alias("query_id"), F.explode("expected_ids").alias("e")).select("query_id", F.expr("try_cast(e AS bigint)").alias("id"), F.lit(1).alias("hit")).distinct()
    return R.union_sources(spark, sf).join(want, ["query_id", "id"], "left").groupBy("source").agg(F.count("*").alias("candidates"), F.count("hit").alias("expected"))


@register(
    "rank_distribution",
    f"WITH RECURSIVE {_PIPE} SELECT family, CAST(rank AS BIGINT) AS rank, count(*) AS questions FROM rk GROUP BY 1, 2",
)
def rank_distribution(spark, sf):
    """The rank of the expected memory by family; null where it was not found."""
    return _ranks(spark, sf).groupBy("family", "rank").agg(F.count("*").alias("questions"))


@register(
    "formatted_results",
    f"""WITH RECURSIVE {_PIPE} SELECT res.query_id, res.rank, CAST(res.id AS VARCHAR) AS id, m.text, coalesce(m.normalized_text, m.text) AS normalized_text FROM res JOIN memories m USING (id) WHERE rank <= {S.response_limit}""",
)
def formatted_results(spark, sf):
    """Results in the form that adapters read."""
    rows = rank.recall(table(spark, sf, "questions"), table(spark, sf, "candidates"), table(spark, sf, "memories"), S)
    return sinks.formatted(rows, table(spark, sf, "memories")).select("query_id", "rank", "id", "text", "normalized_text")


@register(
    "auto_store",
    """WITH c AS (SELECT query_id, memory_id AS id, max(final_score) AS score FROM candidates WHERE final_score >= 0.7 GROUP BY 1, 2) SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM c) WHERE r <= 5""",
)
def auto_store(spark, sf):
    """The five best results of each question that are good enough to be stored."""
    from lodestone.api import Engine

    best = table(spark, sf, "candidates").groupBy("query_id", F.col("memory_id").alias("id")).agg(F.max("final_score").alias("score"))
    return Engine.open(spark, sf).worth_storing(best, "query_id").select("query_id", "id", F.round("score", 6).alias("score"))


@register(
    "auto_clicks",
    f"""WITH RECURSIVE {_PIPE} SELECT id AS mem_id, query_text, 'click' AS user_action FROM res JOIN questions ON question_id = query_id WHERE rank = 1""",
)
def auto_clicks(spark, sf):
    """The events that a click on the first result of each question would be."""
    from lodestone.api import Engine

    engine, questions = Engine.open(spark, sf), table(spark, sf, "questions")
    return engine.clicks_of(questions, engine.recall(questions, table(spark, sf, "candidates"))).select("mem_id", "query_text", "user_action")


@register(
    "history_caps",
    f"""WITH {EVENTS}, r AS (SELECT event_id, query_text, lower(user_action) AS a, row_number() OVER (PARTITION BY query_text ORDER BY ts DESC, event_id DESC) AS r FROM ev WHERE query_text IS NOT NULL),
    n AS (SELECT query_text, max(CASE WHEN a = 'skip' THEN 1 ELSE 0 END) AS skipped FROM r GROUP BY 1) SELECT query_text, count(*) AS kept FROM r JOIN n USING (query_text) WHERE r <= CASE WHEN skipped = 1 THEN 30 ELSE 50 END GROUP BY 1""",
)
def history_caps(spark, sf):
    """The events that are kept of each query: the last 50, or 30 once something was skipped."""
    return learn.history(table(spark, sf, "feedback_events")).groupBy("query_text").agg(F.count("*").alias("kept"))


@register("top_relevant", f"WITH {EVENTS}, a AS (SELECT mem_id, count(*) AS uses, max(ts) AS last, CAST(sum({DELTA}) AS DOUBLE) AS raw FROM ev WHERE mem_id IS NOT NULL GROUP BY 1), r AS (SELECT mem_id, round(uses * 0.5 + 0.3 / (1 + (epoch({NOW}) - floor(epoch(last))) / 86400 / 30) + raw * 0.2, 6) AS relevance FROM a) SELECT mem_id, relevance FROM r ORDER BY relevance DESC, mem_id LIMIT 25")
def top_relevant(spark, sf):
    """The most relevant memories of all types."""
    return learn.relevance(table(spark, sf, "feedback_events"), S).select("mem_id", "relevance").orderBy(F.desc("relevance"), "mem_id").limit(25)


@register(
    "linear_relevance",
    f"WITH {R._Q}, {R._SIGNALS}, {R._FINAL} SELECT query_id, id, round(greatest(0.0, least(1.0, normalized / 5)), 6) AS relevance, CAST(0.5 * len(list_intersect(q_ents, list_distinct(list_transform(coalesce(entities, []), lambda x: lower(x))))) AS DOUBLE) AS entity_boost FROM z JOIN q USING (query_id) JOIN (SELECT id, entities FROM memories) USING (id)",
)
def linear_relevance(spark, sf):
    """The linear form of the relevance, and the boost of shared entities that is shown beside it."""
    rows = rank.zscore(R._signals(spark, sf))
    shown = scores.entity_boost(F.col("q_entities"), F.col("m_entities"))
    return rows.select("query_id", "id", F.round(scores.linear_relevance(F.col("normalized")), 6).alias("relevance"), shown.alias("entity_boost"))


_CASES = " UNION ALL ".join(
    f"SELECT question_id AS query_id, '{n}' AS attribute, CAST({b} AS DOUBLE) AS boost, list_has_any({WORDS.format('query_text')}, [{', '.join(repr(w) for w in a.split())}]) AS whole, {' OR '.join(f"contains(lower(coalesce(query_text, '')), '{w}')" for w in a.split())} AS part FROM questions"
    for n, b, a in vocab.ATTRIBUTES
)


@register("attribute_fields", f"WITH c AS ({_CASES}), w AS (SELECT *, bool_or(whole) OVER (PARTITION BY query_id) AS any_whole FROM c) SELECT query_id, attribute, boost FROM w WHERE whole OR (NOT any_whole AND part)")
def attribute_fields(spark, sf):
    """The attributes that each question points to, by whole words, else by parts of words."""
    return rank.attribute_fields(rank.understand(table(spark, sf, "questions")))


@register("entities_of_type", "SELECT id, name FROM entities WHERE lower(entity_type) = 'place'")
def entities_of_type(spark, sf):
    return table(spark, sf, "entities").where(F.lower("entity_type") == "place").select("id", "name")


@register("edges_of_relation", "SELECT id, memory_id, source, target FROM graph_edges WHERE relation = 'related_to'")
def edges_of_relation(spark, sf):
    return table(spark, sf, "graph_edges").where("relation = 'related_to'").select("id", "memory_id", "source", "target")


@register(
    "session_stats",
    f"WITH {EVENTS} SELECT session_id, count(*) AS events, count(DISTINCT query_text) AS queries, count(DISTINCT mem_id) AS memories, count(CASE WHEN lower(user_action) = 'click' THEN 1 END) AS clicks, CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) AS seconds FROM ev GROUP BY 1",
)
def session_stats(spark, sf):
    rows = learn.once(table(spark, sf, "feedback_events")).groupBy("session_id")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    length = F.floor((micros(F.max("ts")) - micros(F.min("ts"))) / 1_000_000).cast("long")
    return rows.agg(F.count("*").alias("events"), F.countDistinct("query_text").alias("queries"), F.countDistinct("mem_id").alias("memories"), F.count_if(F.lower("user_action") == "click").alias("clicks"), length.alias("seconds"))


@register(
    "embedding_cache",
    f"WITH v AS (SELECT memory_id AS id, min(embedding) AS e FROM candidates WHERE len(embedding) = 64 GROUP BY 1) SELECT m.id, v.id IS NOT NULL AS cached FROM memories m LEFT JOIN v USING (id) WHERE {LIVE}",
)
def embedding_cache(spark, sf):
    """The cache of vectors built anew: which live memories have one."""
    from lodestone.operators import maintain

    return maintain.cached_vectors(table(spark, sf, "memories"), R._vectors(spark, sf)).select("id", F.col("embedding").isNotNull().alias("cached"))
