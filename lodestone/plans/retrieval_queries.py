"""Queries that search: lexical, vector, attribute and graph retrieval, their union, and the ranking of candidates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import scores as SC
from lodestone.functions import text as T
from lodestone.functions import vocab
from lodestone.functions.vocab import Settings
from lodestone.operators import learn, lexical, rank, retrieve, routing, store, vector
from lodestone.plans.storage_queries import DELTA, EVENTS, IMPORTANCE, KIND, LIVE, NOW
from lodestone.plans.text_queries import WORDS, _TAU, attribute_sql, entities_sql, sql_list
from lodestone.queries import _SQL, register
from lodestone.session import checkpoint_dir, cut_lineage, table

S = Settings()
STOP = vocab.STOPWORDS + vocab.INTERROGATIVES


def _docs(spark, sf):
    return store.live(table(spark, sf, "memories")).select("id", "text")


def _terms(spark, sf):
    return lexical.query_terms(table(spark, sf, "questions"), "question_id", "query_text", STOP)


_TOKS = f"toks AS (SELECT id, {WORDS.format('text')} AS tokens FROM memories WHERE {LIVE}), sized AS (SELECT id, tokens, len(tokens) AS dl FROM toks WHERE len(tokens) > 0)"
_TF = "words AS (SELECT id, dl, unnest(tokens) AS term FROM sized), tf AS (SELECT term, id, dl, count(*) AS tf FROM words GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"
_STATS = "stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM sized)"
_QT = f"""qw AS (SELECT question_id AS query_id, unnest({WORDS.format('query_text')}) AS term FROM questions),
  qt AS (SELECT query_id, term, count(*) AS qtf FROM qw WHERE NOT list_contains({sql_list(STOP)}, term) GROUP BY ALL)"""
_LEX = f"{_TOKS}, {_TF}, {_STATS}, {_QT}"
_BM25 = """bm25 AS (SELECT query_id, id, round(sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN df USING (term) JOIN tf USING (term), stats GROUP BY ALL)"""


def _top(source: str, k: int, score: str = "score", order: str = "DESC") -> str:
    return f"""SELECT query_id, id, {score}, CAST(rank AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} {order}, id) AS rank FROM {source}) WHERE rank <= {k}"""


@register("bm25_topk", f"WITH {_LEX}, {_BM25} {_top('bm25', 150)}")
def bm25_topk(spark, sf):
    rows = lexical.bm25_best(_docs(spark, sf), _terms(spark, sf), S.source_k, S.k1, S.b)
    return rows.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


_TFIDF = """nq AS (SELECT query_id, count(*) AS q_terms FROM qt GROUP BY 1),
  tfidf AS (SELECT query_id, id, round(sum((ln((n_docs + 1) / (df + 1)) + 1) / q_terms * tf / dl), 6) AS score
  FROM qt JOIN nq USING (query_id) JOIN df USING (term) JOIN tf USING (term), stats GROUP BY ALL)"""


@register("tfidf_topk", f"WITH {_LEX}, {_TFIDF} {_top('tfidf', 50)}")
def tfidf_topk(spark, sf):
    rows = lexical.tfidf_best(_docs(spark, sf), _terms(spark, sf), 50)
    return rows.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@register("document_frequency", f"WITH {_TOKS}, {_TF} SELECT term, df FROM df")
def document_frequency(spark, sf):
    return lexical.document_frequency(_docs(spark, sf))


@register(
    "postings_stats",
    f"WITH {_TOKS}, {_TF}, {_STATS} SELECT count(DISTINCT term) AS terms, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS occurrences, (SELECT round(avgdl, 6) FROM stats) AS avgdl FROM tf",
)
def postings_stats(spark, sf):
    post = lexical.postings(_docs(spark, sf))
    sizes = lexical.tokens(_docs(spark, sf)).agg(F.round(F.avg("dl"), 6).alias("avgdl"))
    return post.agg(F.countDistinct("term").alias("terms"), F.count("*").alias("postings"), F.sum("tf").cast("long").alias("occurrences")).crossJoin(F.broadcast(sizes))


@register(
    "term_positions",
    f"WITH {_TOKS}, p AS (SELECT id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM toks) SELECT term, id, array_to_string(list(pos ORDER BY pos), ' ') AS positions, count(*) AS tf FROM p GROUP BY 1, 2",
)
def term_positions(spark, sf):
    return lexical.positions(_docs(spark, sf)).groupBy("term", "id").agg(F.array_join(F.sort_array(F.collect_list("pos")).cast("array<string>"), " ").alias("positions"), F.count("*").alias("tf"))


@register("bool_or", f"WITH {_LEX} SELECT DISTINCT query_id, id FROM qt JOIN tf USING (term)")
def bool_or(spark, sf):
    return lexical.boolean_or(_docs(spark, sf), _terms(spark, sf))


@register(
    "bool_and",
    f"WITH {_LEX}, n AS (SELECT query_id, count(*) AS needed FROM qt GROUP BY 1) SELECT query_id, id FROM qt JOIN tf USING (term) JOIN n USING (query_id) GROUP BY query_id, id, needed HAVING count(*) = needed",
)
def bool_and(spark, sf):
    return lexical.boolean_and(_docs(spark, sf), _terms(spark, sf))


@register(
    "bool_and_known_terms",
    f"WITH {_LEX}, n AS (SELECT query_id, count(*) AS needed FROM qt JOIN df USING (term) GROUP BY 1) SELECT query_id, id FROM qt JOIN tf USING (term) JOIN n USING (query_id) GROUP BY query_id, id, needed HAVING count(*) = needed",
)
def bool_and_known_terms(spark, sf):
    return lexical.boolean_and(_docs(spark, sf), _terms(spark, sf), known_only=True)


@register(
    "phrase_search",
    f"""WITH {_TOKS}, ents AS ({entities_sql('questions', 'question_id', 'query_text', sql_list(STOP))}),
    ph AS (SELECT question_id AS query_id, {WORDS.format('entity')} AS words FROM ents WHERE pos = 1),
    parts AS (SELECT query_id, len(words) AS n, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS off FROM ph),
    places AS (SELECT id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM toks),
    starts AS (SELECT query_id, id, pos - off AS start FROM places JOIN parts USING (term) GROUP BY query_id, n, id, pos - off HAVING count(*) = n)
    SELECT query_id, id, count(*) AS hits FROM starts GROUP BY 1, 2""",
)
def phrase_search(spark, sf):
    """The first name in each question, searched as a phrase."""
    asked = rank.understand(table(spark, sf, "questions")).where("q_subject IS NOT NULL")
    return lexical.phrase_search(_docs(spark, sf), asked.select("query_id", T.words(F.col("q_subject")).alias("words")))


def _vectors(spark, sf):
    rows = table(spark, sf, "candidates").where(F.size("embedding") == 64)
    return rows.groupBy(F.col("memory_id").alias("id")).agg(F.min("embedding").alias("embedding"))


_VEC = "v AS (SELECT memory_id AS id, min(embedding) AS e FROM candidates WHERE len(embedding) = 64 GROUP BY 1), q AS (SELECT id AS query_id, e AS qe FROM v WHERE id % 100 = 0)"
_L2 = "list_sum(list_transform(list_zip(qe, e), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))"
_COS = "list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(e AS DOUBLE[]))"


@register("knn_l2_topk", f"WITH {_VEC}, d AS (SELECT query_id, id, round({_L2}, 6) AS distance FROM q, v) {_top('d', 10, 'distance', 'ASC')}")
def knn_l2_topk(spark, sf):
    """The 10 nearest of each vector whose id is divisible by 100, against all vectors."""
    vec = _vectors(spark, sf)
    queries = vec.where(F.pmod("id", F.lit(100)) == 0).select(F.col("id").alias("query_id"), "embedding")
    return vector.knn(vec, queries, 10).select("query_id", "id", "distance", F.col("rank").cast("long").alias("rank"))


@register(
    "cosine_topk",
    f"WITH {_VEC}, d AS (SELECT query_id, id, round({_COS}, 6) AS similarity FROM q, v) {_top('d', 10, 'similarity')}",
)
def cosine_topk(spark, sf):
    """The 10 most similar by rounded similarity, then id."""
    vec = _vectors(spark, sf)
    queries = vec.where(F.pmod("id", F.lit(100)) == 0).select(F.col("id").alias("query_id"), "embedding")
    rows = vector.knn(vec, queries, 10, "cosine")
    return rows.select("query_id", "id", (-F.col("distance")).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@register(
    "embedding_similar_in_batch",
    """WITH v AS (SELECT memory_id AS id, min(embedding) AS e FROM candidates WHERE len(embedding) = 64 GROUP BY 1),
    b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 100) AS BIGINT) AS batch FROM v),
    p AS (SELECT a.id AS a, c.id AS b, round(list_cosine_similarity(CAST(a.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])), 6) AS similarity FROM b a JOIN b c ON a.batch = c.batch AND a.id < c.id)
    SELECT a, b, similarity FROM p WHERE similarity >= 0.99""",
)
def embedding_similar_in_batch(spark, sf):
    """Pairs of very similar vectors within batches of 100; embedding_similar has those of all vectors."""
    return vector.similar_in_batches(store.batches(_vectors(spark, sf), 100), "batch", 0.99)


@register(
    "embedding_similar",
    """WITH v AS (SELECT memory_id AS id, min(embedding) AS e FROM candidates WHERE len(embedding) = 64 GROUP BY 1),
    p AS (SELECT a.id AS a, c.id AS b, round(list_cosine_similarity(CAST(a.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])), 6) AS similarity FROM v a JOIN v c ON a.id < c.id)
    SELECT a, b, similarity FROM p WHERE similarity >= 0.99""",
)
def embedding_similar(spark, sf):
    """All pairs of very similar vectors."""
    return vector.similar_pairs(_vectors(spark, sf), 0.99)


@register(
    "vector_distance_check",
    """WITH v AS (SELECT memory_id AS id, min(embedding) AS e FROM candidates WHERE len(embedding) = 64 GROUP BY 1)
, p AS (SELECT id, e, lead(id) OVER (ORDER BY id) AS next_id, lead(e) OVER (ORDER BY id) AS qe FROM v)
    SELECT id, next_id, round(list_sum(list_transform(list_zip(qe, e), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))), 6) AS l2, round(list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS cosine FROM p WHERE next_id IS NOT NULL""",
)
def vector_distance_check(spark, sf):
    """Both distances between each vector and the one with the next id."""
    rows = store.number(_vectors(spark, sf), "id")
    after = rows.select((F.col("number") - 1).alias("number"), F.col("id").alias("next_id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    return rows.join(after, "number").select("id", "next_id", F.round(SC.l2_squared(a, b), 6).alias("l2"), F.round(SC.cosine(a, b), 6).alias("cosine"))


_Q = f"""ents AS ({entities_sql('questions', 'question_id', 'query_text', sql_list(STOP))}),
  subj AS (SELECT question_id, entity FROM ents WHERE pos = 1),
  el AS (SELECT question_id, list(DISTINCT lower(entity)) AS q_ents FROM ents GROUP BY 1),
  q AS (SELECT q.question_id AS query_id, coalesce(q.query_text, '') AS q, {WORDS.format('q.query_text')} AS q_tokens, coalesce(el.q_ents, []) AS q_ents, s.entity AS q_subject, {attribute_sql('q.query_text')} AS q_attribute
    FROM questions q LEFT JOIN subj s USING (question_id) LEFT JOIN el USING (question_id))"""
_SOURCES = """prio(source, p) AS (VALUES ('vector', 0), ('bm25', 1), ('graph', 2), ('phrase', 3), ('attribute', 4))"""


@register(
    "attribute_retrieval",
    f"""WITH {_Q} SELECT query_id, m.id FROM q JOIN memories m ON m.subject = q_subject AND m.attribute = q_attribute WHERE {LIVE}""",
)
def attribute_retrieval(spark, sf):
    return retrieve.by_attribute(rank.understand(table(spark, sf, "questions")), table(spark, sf, "memories"))


@register(
    "graph_retrieval",
    f"""WITH RECURSIVE {_Q}, adj AS (SELECT DISTINCT lower(trim(source)) AS src, lower(trim(target)) AS dst FROM graph_edges WHERE source IS NOT NULL AND target IS NOT NULL),
    h AS (SELECT DISTINCT query_id, lower(q_subject) AS node, CAST(0 AS BIGINT) AS hops FROM q WHERE q_subject IS NOT NULL
      UNION SELECT h.query_id, a.dst, h.hops + 1 FROM h JOIN adj a ON a.src = h.node WHERE h.hops < 2),
    near AS (SELECT query_id, node, min(hops) AS hops FROM h GROUP BY 1, 2),
    em AS (SELECT DISTINCT lower(trim(source)) AS node, memory_id FROM graph_edges UNION SELECT lower(trim(target)), memory_id FROM graph_edges),
    r AS (SELECT query_id, memory_id AS id, min(hops) AS hops FROM near JOIN em USING (node) WHERE memory_id IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hops, id) AS rank FROM r)
    SELECT query_id, id, hops, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= 50""",
)
def graph_retrieval(spark, sf):
    """Memories of entities within two edges of the one asked about, the nearest 50 of each question."""
    return retrieve.by_graph(rank.understand(table(spark, sf, "questions")), table(spark, sf, "graph_edges"), S.graph_k)


@register(
    "phrase_retrieval",
    f"SELECT query_id, id, hits, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rank FROM ({_SQL['phrase_search']})) WHERE rank <= 100",
)
def phrase_retrieval(spark, sf):
    """The 100 memories that hold a question's phrase most often; no question of the tables has one in quotation marks, so it is the first name."""
    return retrieve.by_phrase(rank.understand(table(spark, sf, "questions")), _docs(spark, sf))


def union_sources(spark, sf, sources: tuple[str, ...] = retrieve.SOURCES, questions=None):
    """(query_id, id, distance, p, source): the candidates of all sources; of several sources of one memory the last one wins.

    questions: those that are asked, if not all of the table.
    """
    near = table(spark, sf, "candidates").select("query_id", F.col("memory_id").alias("id"), "distance")
    if questions is None:
        questions = table(spark, sf, "questions")
    else:
        near = near.join(questions.select(F.col("question_id").alias("query_id")), "query_id", "left_semi")
    found = retrieve.sources(rank.understand(questions), retrieve.terms_of(questions), table(spark, sf, "memories"), table(spark, sf, "graph_edges"), near, settings=S, only=sources)
    return retrieve.union({s: found[s] for s in sources})


_UNION = f"""{_BM25}, graph AS ({_SQL["graph_retrieval"]}), phrase AS ({_SQL["phrase_retrieval"]}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm25),
  attr AS (SELECT query_id, m.id FROM q JOIN memories m ON m.subject = q_subject AND m.attribute = q_attribute WHERE {LIVE}),
  vec AS (SELECT query_id, memory_id AS id, min(distance) AS distance FROM candidates GROUP BY query_id, memory_id),
  uni AS (SELECT query_id, id, 0 AS p, distance FROM vec
    UNION ALL SELECT query_id, id, 1, 1 / (score + 1e-6) FROM ranked WHERE rank <= 150
    UNION ALL SELECT query_id, id, 2, CAST(0 AS DOUBLE) FROM graph
    UNION ALL SELECT query_id, id, 3, CAST(0 AS DOUBLE) FROM phrase
    UNION ALL SELECT query_id, id, 4, CAST(0 AS DOUBLE) FROM attr),
  won AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY p DESC) AS rn FROM uni)"""
_KINDS = f"kd AS ({_SQL['classify_type']})"


@register(
    "retriever_union",
    f"WITH {_LEX}, {_Q}, {_UNION}, {_SOURCES} SELECT query_id, id, source, round(distance, 6) AS distance FROM won JOIN prio USING (p) WHERE rn = 1",
)
def retriever_union(spark, sf):
    """The candidates of all five sources."""
    return union_sources(spark, sf).select("query_id", "id", "source", F.round("distance", 6).alias("distance"))


@register(
    "candidate_cap",
    f"""WITH {_LEX}, {_Q}, {_UNION}, one AS (SELECT query_id, id, p, round(distance, 6) AS distance FROM won WHERE rn = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, distance, id) AS rank FROM one) SELECT query_id, id, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= {S.candidate_cap}""",
)
def candidate_cap(spark, sf):
    """As many candidates of all sources as are ranked (300), by the priority of their source, then distance, then id."""
    return retrieve.capped(union_sources(spark, sf), S.candidate_cap).select("query_id", "id", "rank")


@register(
    "sequential_retrieval",
    f"""WITH {_LEX}, {_Q}, {_UNION}, s AS (SELECT query_id, id, 'vector' AS source, 0 AS o, distance FROM vec UNION ALL SELECT query_id, id, 'attribute', 1, CAST(0 AS DOUBLE) FROM attr UNION ALL SELECT query_id, id, 'graph', 2, CAST(0 AS DOUBLE) FROM graph)
    SELECT query_id, id, source, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY o) AS rn FROM s) WHERE rn = 1""",
)
def sequential_retrieval(spark, sf):
    """Vector, then attribute, then graph, each without what was found before."""
    near = table(spark, sf, "candidates").select("query_id", F.col("memory_id").alias("id"), "distance")
    found = retrieve.sources(rank.understand(table(spark, sf, "questions")), _terms(spark, sf), table(spark, sf, "memories"), table(spark, sf, "graph_edges"), near, settings=S, only=("vector", "attribute", "graph"))
    return retrieve.sequential(found).select("query_id", "id", "source", F.round("distance", 6).alias("distance"))


_ROUTED = f"""rt(kind, source) AS (VALUES {', '.join(f"('{r[0]}', '{s}')" for r in vocab.ROUTES for s in [*r[8].split(), 'phrase'])}),
  routed AS (SELECT w.query_id, w.id, source FROM (SELECT won.*, source FROM won JOIN prio USING (p) WHERE rn = 1) w LEFT JOIN kd USING (query_id) WHERE kd.kind IS NULL OR EXISTS (SELECT 1 FROM rt WHERE rt.kind = kd.kind AND rt.source = w.source))"""


def _routed(spark, sf):
    return retrieve.routed(union_sources(spark, sf), routing.classify(rank.understand(table(spark, sf, "questions"))))


@register("routed_union", f"WITH {_LEX}, {_Q}, {_UNION}, {_SOURCES}, {_KINDS}, {_ROUTED} SELECT query_id, id, source FROM routed")
def routed_union(spark, sf):
    """The union of the sources that the type of each question is routed to."""
    return _routed(spark, sf).select("query_id", "id", "source")


@register(
    "retrieval_sufficient",
    f"WITH {_LEX}, {_Q}, {_UNION}, {_SOURCES}, {_KINDS}, {_ROUTED} SELECT query_id, count(DISTINCT source) AS sources, count(*) AS candidates, count(DISTINCT source) >= 2 AND count(*) >= 20 AS enough FROM routed GROUP BY 1",
)
def retrieval_sufficient(spark, sf):
    """Whether two sources and twenty candidates answered each question."""
    return retrieve.sufficient(_routed(spark, sf), 2, 20)


@register(
    "query_shards",
    f"WITH {_KINDS} SELECT query_id, kind, CAST(CASE kind {' '.join(f'WHEN {k!r} THEN {v}' for k, v in routing.SHARDS.items())} END AS BIGINT) AS shard FROM kd",
)
def query_shards(spark, sf):
    """The shard that a question of one type has to read; none for general questions, which read all."""
    kinds = routing.classify(rank.understand(table(spark, sf, "questions")))
    return kinds.select("query_id", "kind", routing.shards_of_query(F.col("kind")).alias("shard"))


_W = {s: rank.weight(s, "general") for s in vocab.SIGNALS}
_BOOST = " + ".join(
    f"""CASE WHEN list_has_any(q_tokens, {sql_list(a.split())}) AND memory_type = '{n}' THEN {b} ELSE 0 END
      + CASE WHEN list_has_any(q_tokens, {sql_list(a.split())}) AND len(list_filter(meta_parts, lambda x: contains(x, '{n}'))) > 0 THEN {b * 0.5} ELSE 0 END"""
    for n, b, a in vocab.ATTRIBUTES
)
_SIGNALS = f"""c AS (SELECT query_id, memory_id AS id, min(distance) AS distance, max(coalesce(bm25_score, 0)) AS bm25 FROM candidates GROUP BY 1, 2),
  m AS (SELECT id, text, {KIND} AS memory_type, {IMPORTANCE} AS importance_score, subject, attribute, created_at, coalesce(entities, []) AS entities,
    CASE WHEN json_valid(metadata) THEN metadata END AS meta, {WORDS.format('text')} AS m_tokens FROM memories WHERE {LIVE}),
  md AS (SELECT *, list_transform(list_concat(coalesce(json_keys(meta), []), coalesce(json_extract_string(meta, '$.*'), [])), lambda x: lower(x)) AS meta_parts FROM m),
  j AS (SELECT *, len(list_intersect(q_tokens, m_tokens)) AS shared, len(list_distinct(q_tokens)) AS nq, len(list_distinct(list_concat(q_tokens, m_tokens))) AS nu
    FROM c JOIN md USING (id) JOIN q USING (query_id)),
  s AS (SELECT query_id, id, bm25, text, memory_type, 1 / (1 + distance) AS semantic,
    CASE WHEN memory_type IN ('episodic', 'procedural', 'code') THEN CASE WHEN nq > 0 THEN shared / nq ELSE 0 END WHEN nu > 0 THEN shared / nu ELSE 0 END AS token,
    CASE WHEN len(q_ents) > 0 THEN len(list_intersect(q_ents, list_transform(entities, lambda x: lower(x)))) / len(q_ents) ELSE 0 END AS entity,
    CASE WHEN lower(q_subject) = lower(subject) THEN 1.0 ELSE 0.0 END AS subject, CASE WHEN q_attribute = attribute THEN 1.0 ELSE 0.0 END AS attribute,
    CASE WHEN created_at IS NULL THEN 0.5 ELSE exp(-greatest(0, floor((epoch({NOW}) - floor(epoch(created_at))) / 86400)) / ({_TAU})) END AS recency,
    least(1.0, greatest(0.0, importance_score)) AS importance, {_BOOST} AS boost FROM j),
  b AS (SELECT *, round({' + '.join(f'{_W[x]} * {x}' for x in ('semantic', 'token', 'entity', 'subject', 'attribute', 'recency', 'importance'))}, 6) AS base FROM s)"""
_FINAL = """st AS (SELECT query_id, avg(base) AS mean, stddev_pop(base) AS std FROM b GROUP BY 1),
  z AS (SELECT b.*, round((base - mean) / CASE WHEN std < 1e-6 THEN 1e-6 ELSE std END, 6) AS normalized FROM b JOIN st USING (query_id)),
  f AS (SELECT *, round(0.25 / (1 + exp(-normalized)) + 0.10 * importance + 0.10 * recency + 0.05 + 0.50 / (1 + exp(-2 * boost)) + 0.10 / (1 + exp(-bm25)), 6) AS final,
    CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 4)) END AS BIGINT) AS cost FROM z)"""


def _signals(spark, sf):
    queries = rank.understand(table(spark, sf, "questions"))
    return rank.base_score(rank.signals(rank.candidate_rows(table(spark, sf, "candidates")), table(spark, sf, "memories"), queries, S))


_SIGNAL_NAMES = ["semantic", "token", "entity", "subject", "attribute", "recency", "importance"]


@register("ranking_signals", f"WITH {_Q}, {_SIGNALS} SELECT query_id, id, {', '.join(f'CAST(round({x}, 6) AS DOUBLE) AS {x}' for x in _SIGNAL_NAMES)}, base FROM b")
def ranking_signals(spark, sf):
    return _signals(spark, sf).select("query_id", "id", *[F.round(x, 6).alias(x) for x in _SIGNAL_NAMES], "base")


@register("zscore_per_query", f"WITH {_Q}, {_SIGNALS}, {_FINAL} SELECT query_id, id, normalized FROM z")
def zscore_per_query(spark, sf):
    return rank.zscore(_signals(spark, sf)).select("query_id", "id", "normalized")


def _finals(spark, sf):
    rows = _signals(spark, sf)
    rows = rows.withColumn("boost", rank.attribute_boost(F.col("q_asked"), F.col("memory_type"), F.col("m_parts")))
    rows = cut_lineage(rows.select("query_id", "id", "base", "importance", "recency", "boost", "bm25", "cost"))
    return rank.finalize(rank.zscore(rows), S)


@register("final_score", f"WITH {_Q}, {_SIGNALS}, {_FINAL} SELECT query_id, id, CAST(round(boost, 6) AS DOUBLE) AS boost, final FROM f")
def final_score(spark, sf):
    return _finals(spark, sf).select("query_id", "id", F.round("boost", 6).alias("boost"), "final")


_WALK = f"""w AS (SELECT query_id, id, cost, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) AS at_ FROM f WHERE base >= {S.min_score}),
  walk AS (SELECT query_id, at_, CASE WHEN cost <= {{budget}} THEN cost ELSE 0 END AS used, CASE WHEN cost <= {{budget}} THEN 1 ELSE 0 END AS n, cost <= {{budget}} AS kept, id FROM w WHERE at_ = 1
    UNION ALL SELECT w.query_id, w.at_, walk.used + CASE WHEN (walk.n < {S.context_size} AND walk.used + w.cost <= {{budget}}) OR w.cost = 0 THEN w.cost ELSE 0 END,
      walk.n + CASE WHEN (walk.n < {S.context_size} AND walk.used + w.cost <= {{budget}}) OR w.cost = 0 THEN 1 ELSE 0 END,
      (walk.n < {S.context_size} AND walk.used + w.cost <= {{budget}}) OR w.cost = 0, w.id
    FROM walk JOIN w ON w.query_id = walk.query_id AND w.at_ = walk.at_ + 1 WHERE w.at_ <= {S.candidate_cap})"""


@register("token_budget_context", f"WITH RECURSIVE {_Q}, {_SIGNALS}, {_FINAL}, {_WALK.format(budget=200)} SELECT query_id, id FROM walk WHERE kept")
def token_budget_context(spark, sf):
    """The memories that fit 200 tokens, walked in order of their final score."""
    return rank.context(_finals(spark, sf), Settings(token_budget=200)).select("query_id", "id")


@register(
    "recall_pipeline",
    f"""WITH RECURSIVE {_Q}, {_SIGNALS}, {_FINAL}, {_WALK.format(budget=S.token_budget)},
    k AS (SELECT f.query_id, f.id, base, normalized, final, row_number() OVER (PARTITION BY f.query_id ORDER BY normalized DESC, final DESC, f.id) AS rank FROM f JOIN walk USING (query_id, id) WHERE kept)
    SELECT query_id, id, base, normalized, final, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= {S.response_limit}""",
)
def recall_pipeline(spark, sf):
    """All questions ranked in one plan; the flagship."""
    return rank.recall(table(spark, sf, "questions"), table(spark, sf, "candidates"), table(spark, sf, "memories"), S)


def _wanted(spark, sf, wanted):
    """Further signals of (query_id, id): tfidf, feedback, and the graph distance."""
    docs, terms = _docs(spark, sf), _terms(spark, sf)
    tfidf = lexical.tfidf(docs, terms).join(wanted, ["query_id", "id"], "left_semi").withColumnRenamed("score", "tfidf")
    feedback = learn.feedback(table(spark, sf, "feedback_events"), S).select(F.col("mem_id").alias("id"), F.col("boost").alias("feedback"))
    queries = rank.understand(table(spark, sf, "questions"))
    near = rank.graph_signal(wanted, queries, table(spark, sf, "memories"), table(spark, sf, "graph_edges"))
    return tfidf, feedback, near, routing.classify(queries)


@register(
    "graph_signal",
    f"""WITH RECURSIVE {_Q}, adj AS (SELECT DISTINCT lower(trim(source)) AS src, lower(trim(target)) AS dst FROM graph_edges WHERE source IS NOT NULL AND target IS NOT NULL),
    asked AS (SELECT DISTINCT query_id, unnest(q_ents) AS seed FROM q), held AS (SELECT DISTINCT id, lower(trim(unnest(entities))) AS node FROM memories),
    h AS (SELECT DISTINCT seed, seed AS node, CAST(0 AS BIGINT) AS hops FROM asked UNION SELECT h.seed, a.dst, h.hops + 1 FROM h JOIN adj a ON a.src = h.node WHERE h.hops < 2),
    near AS (SELECT seed, node, min(hops) AS hops FROM h GROUP BY 1, 2), c AS (SELECT DISTINCT query_id, memory_id AS id FROM candidates)
    SELECT query_id, id, round(1 / (min(hops) + 1e-6), 6) AS graph FROM c JOIN held USING (id) JOIN asked USING (query_id) JOIN near USING (seed, node) GROUP BY 1, 2""",
)
def graph_signal(spark, sf):
    """The graph distance between question and candidate, within two edges."""
    wanted = table(spark, sf, "candidates").select("query_id", F.col("memory_id").alias("id")).distinct()
    return _wanted(spark, sf, wanted)[2].select("query_id", "id", F.round("graph", 6).alias("graph"))


def _by_kind(signal: str, column: str) -> str:
    of = vocab.SIGNALS[signal]
    return f"coalesce({column}, 0) * CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in of.items() if k != "default") + f" ELSE {of['default']} END" if len(of) > 1 else f"coalesce({column}, 0) * {of['default']}"


_TEN = " + ".join([*[_by_kind(x, x) for x in ("semantic", "token", "entity", "subject", "attribute", "recency", "importance")], _by_kind("tfidf", "CASE WHEN memory_type <> 'episodic' THEN tfidf END"), _by_kind("feedback", "feedback")])


@register(
    "base_score",
    f"""WITH {_LEX}, {_Q}, {_SIGNALS}, {_TFIDF}, {_KINDS}, ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at NULLS LAST) AS rn FROM feedback_events) WHERE rn = 1),
    fs AS (SELECT mem_id, CAST(sum({DELTA}) AS DOUBLE) AS raw, max(ts) AS last FROM ev WHERE mem_id IS NOT NULL GROUP BY 1),
    fb AS (SELECT mem_id AS id, round(greatest(-1.0, least(1.0, raw * pow(0.95, greatest(0, floor((epoch({NOW}) - floor(epoch(last))) / 86400))))), 6) AS feedback FROM fs),
    a AS (SELECT s.*, tfidf.score AS tfidf, feedback, coalesce(kind, 'general') AS kind FROM s LEFT JOIN kd USING (query_id) LEFT JOIN tfidf USING (query_id, id) LEFT JOIN fb USING (id))
    SELECT query_id, id, kind, coalesce(tfidf, 0) AS tfidf, coalesce(feedback, 0) AS feedback, round({_TEN}, 6) AS base FROM a""",
)
def base_score(spark, sf):
    """The base score of the given candidates with all signals that have a weight, by the weights of the question's type."""
    rows = rank.candidate_rows(table(spark, sf, "candidates"))
    tfidf, feedback, near, kinds = _wanted(spark, sf, rows.select("query_id", "id"))
    rows = rank.signals(rows, table(spark, sf, "memories"), rank.understand(table(spark, sf, "questions")), S)
    rows = rows.join(kinds.select("query_id", "kind"), "query_id", "left").withColumn("kind", F.coalesce("kind", F.lit("general")))
    rows = rows.join(tfidf, ["query_id", "id"], "left").join(feedback, "id", "left").join(near, ["query_id", "id"], "left")
    rows = rank.base_score(rows, F.col("kind"), ("tfidf", "feedback", "graph"))
    return rows.select("query_id", "id", "kind", F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"), F.coalesce("feedback", F.lit(0.0)).alias("feedback"), "base")


@register("recall_hybrid")
def recall_hybrid(spark, sf):
    """Recall from the engine's own retrieval: union and cap of all sources, then the ranking with all signals, by the type of the question."""
    from lodestone.api import Engine

    return Engine.open(spark, sf).recall(table(spark, sf, "questions"))


def _normalized(spark, sf):
    return cut_lineage(rank.zscore(cut_lineage(_signals(spark, sf).select("query_id", "id", "base"))).select("query_id", "id", "normalized"))


_POOL = f"""top AS (SELECT query_id, id, normalized, CAST(row_number() OVER (PARTITION BY query_id ORDER BY normalized DESC, id) AS INTEGER) AS at_ FROM z),
  v AS (SELECT memory_id AS id, min(embedding) AS e FROM candidates WHERE len(embedding) = 64 GROUP BY 1)"""


@register(
    "mmr_rerank",
    f"""WITH RECURSIVE {_Q}, {_SIGNALS}, {_FINAL}, {_POOL},
    pl AS (SELECT query_id, list(normalized ORDER BY at_) AS rel, list(top.id ORDER BY at_) AS ids, list(coalesce(list_transform(e, lambda x: CAST(x AS DOUBLE)), list_transform(range(64), lambda x: CAST(0 AS DOUBLE))) ORDER BY at_) AS vs,
        least(1.0, CASE WHEN count(*) <= 10 THEN 0.95 WHEN count(*) <= 30 THEN 0.90 WHEN count(*) <= 75 THEN 0.85 ELSE 0.80 END + 0.10) AS lam, count(*) AS n
      FROM top LEFT JOIN v ON v.id = top.id WHERE at_ <= 50 GROUP BY 1),
    un AS (SELECT query_id, rel, ids, lam, n, list_transform(vs, lambda u: list_transform(u, lambda x: x / greatest(sqrt(list_dot_product(u, u)), 1e-8))) AS us FROM pl),
    w AS (SELECT query_id, [1] AS chosen, [lam * rel[1]] AS score, CAST(1 AS BIGINT) AS step FROM un
      UNION ALL SELECT query_id, list_append(chosen, pick[2]), list_append(score, pick[1]), step + 1 FROM (
        SELECT w.query_id, chosen, score, step, list_reduce(list_transform(list_filter(range(1, n + 1), lambda i: NOT list_contains(chosen, i)),
            lambda i: [lam * rel[i] - (1 - lam) * list_max(list_transform(chosen, lambda c: list_dot_product(us[i], us[c]))), CAST(i AS DOUBLE)]), lambda a, b: CASE WHEN b[1] > a[1] THEN b ELSE a END) AS pick
        FROM w JOIN un USING (query_id) WHERE step < least(20, n))),
    fin AS (SELECT w.query_id, un.ids, chosen, score FROM w JOIN un USING (query_id) WHERE step = least(20, n)),
    ex AS (SELECT query_id, ids, unnest(chosen) AS c, unnest(score) AS mmr, generate_subscripts(score, 1) AS rank FROM fin)
    SELECT query_id, ids[CAST(c AS INTEGER)] AS id, round(mmr, 6) AS mmr, CAST(rank AS BIGINT) AS rank FROM ex""",
)
def mmr_rerank(spark, sf):
    """The 20 most relevant and diverse of the 50 best candidates of each question."""
    return rank.mmr(_normalized(spark, sf), _vectors(spark, sf), k=20)


@register("mmr_off", f"WITH {_Q}, {_SIGNALS}, {_FINAL} SELECT query_id, id, normalized AS mmr, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY normalized DESC, id) AS rank FROM z) WHERE rank <= 20")
def mmr_off(spark, sf):
    """The order without diversity."""
    return rank.without_mmr(_normalized(spark, sf), 20)


@register("mmr_legacy")
def mmr_legacy(spark, sf):
    """The older form of the re-ranking."""
    return rank.mmr(_normalized(spark, sf), _vectors(spark, sf), k=20, legacy=True)


@register(
    "mmr_diagnostics",
    f"WITH o AS ({_SQL['mmr_off']}), m AS ({_SQL['mmr_rerank']}) SELECT query_id, count(*) AS n, count(CASE WHEN m.rank <> o.rank THEN 1 END) AS moved, CAST(sum(abs(m.rank - o.rank)) AS BIGINT) AS total_moves, round(avg(abs(m.rank - o.rank)), 6) AS mean_move FROM o JOIN m USING (query_id, id) GROUP BY 1",
)
def mmr_diagnostics(spark, sf):
    """How far the re-ranking moved the results of each question."""
    rows = _normalized(spark, sf)
    return rank.diagnostics(rank.without_mmr(rows, 20), rank.mmr(rows, _vectors(spark, sf), k=20))


_POOLED = f"""{EVENTS}, a AS (SELECT mem_id, count(*) AS uses, max(ts) AS last, CAST(sum({DELTA}) AS DOUBLE) AS raw FROM ev WHERE mem_id IS NOT NULL GROUP BY 1),
    j AS (SELECT {KIND} AS memory_type, m.id, round(uses * 0.5 + 0.3 / (1 + (epoch({NOW}) - floor(epoch(last))) / 86400 / 30) + raw * 0.2, 6) AS relevance FROM memories m JOIN a ON a.mem_id = m.id WHERE {LIVE}),
    pooled AS (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY relevance DESC, id) AS rank FROM j)"""


def _pool(spark, sf, most):
    return retrieve.pool(learn.relevance(table(spark, sf, "feedback_events"), S), table(spark, sf, "memories"), most)


@register("relevance_pool", f"WITH {_POOLED} SELECT memory_type, id, relevance, CAST(rank AS BIGINT) AS rank FROM pooled WHERE rank <= {S.top_k}")
def relevance_pool(spark, sf):
    """The most relevant memories of each type, as many as a retrieval gives."""
    return _pool(spark, sf, S.top_k)


@register(
    "pool_union",
    f"""WITH {_LEX}, {_Q}, {_UNION}, {_SOURCES}, {_KINDS}, {_POOLED},
    mine AS (SELECT query_id, id FROM kd JOIN pooled ON memory_type = kind WHERE kind <> 'general' AND rank <= 20), full_ AS (SELECT query_id FROM mine GROUP BY 1 HAVING count(*) >= 20)
    SELECT query_id, id, 'pool' AS source FROM mine UNION ALL SELECT query_id, id, source FROM won JOIN prio USING (p) WHERE rn = 1 AND query_id NOT IN (SELECT query_id FROM full_)
      AND NOT EXISTS (SELECT 1 FROM mine WHERE mine.query_id = won.query_id AND mine.id = won.id)""",
)
def pool_union(spark, sf):
    """The pool of each question's type before its candidates; a pool of 20 is enough by itself here."""
    kinds = routing.classify(rank.understand(table(spark, sf, "questions")))
    return retrieve.with_pool(union_sources(spark, sf), _pool(spark, sf, 20), kinds, 20)


@register("stored_postings", f"WITH {_LEX}, {_BM25} {_top('bm25', 150)}")
def stored_postings(spark, sf):
    """The best memories by words from an index that was written and read back."""
    at = f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    lexical.Index.build(_docs(spark, sf)).save(at)
    rows = lexical.bm25_best(lexical.Index.load(spark, at), _terms(spark, sf), S.source_k, S.k1, S.b)
    return rows.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))
