"""Queries over single texts: analysis, facts, flags, estimates, routing of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scores, vocab
from lodestone.functions import text as T
from lodestone.functions.vocab import Settings
from lodestone.operators import rank, routing, store
from lodestone.plans.storage_queries import IMPORTANCE, KIND, LIVE, NOW
from lodestone.queries import register
from lodestone.session import table

S = Settings()
#: The analyzer and the white-space tokenizer, as SQL.
WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"
SPACED = "trim(regexp_replace(lower(trim(coalesce({0}, ''))), '\\s+', ' ', 'g'))"
STOP = "[" + ", ".join(f"'{w}'" for w in vocab.STOPWORDS) + "]"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def attribute_sql(text: str) -> str:
    """The first attribute with a whole word in a text, as SQL."""
    w = WORDS.format(text)
    cases = " ".join(f"WHEN list_has_any({w}, {sql_list(a.split())}) THEN '{n}'" for n, _, a in vocab.ATTRIBUTES)
    return f"(CASE {cases} END)"


@register(
    "text_flags",
    f"""SELECT id, CAST(length(text) AS BIGINT) AS n_length, CAST(len(list_filter(string_split({SPACED.format('text')}, ' '), lambda w: w <> '')) AS BIGINT) AS word_count,
    regexp_matches(text, '[0-9]') AS contains_number, regexp_matches(text, 'https?://|www\\.') AS contains_url, regexp_matches(text, '[^\\s]+@[^\\s]+') AS contains_email,
    contains(text, '?') AS contains_question, regexp_matches(text, '[{{}};]|def\\s+|class\\s+|return\\s+|import\\s+') AS contains_code FROM memories""",
)
def text_flags(spark, sf):
    return table(spark, sf, "memories").select("id", *[c.alias(n) for n, c in T.flags(F.col("text")).items()])


@register(
    "analyzed_words",
    f"SELECT id, CAST(len({WORDS.format('text')}) AS BIGINT) AS n_words, array_to_string({WORDS.format('text')}, ' ') AS words FROM memories",
)
def analyzed_words(spark, sf):
    w = T.words(F.col("text"))
    return table(spark, sf, "memories").select("id", F.size(w).cast("long").alias("n_words"), F.array_join(w, " ").alias("words"))


@register(
    "index_words",
    """SELECT id, array_to_string(list_filter(string_split_regex(translate(lower(text), '.,!?;:()"''', '          '), '\\s+'), lambda w: w <> ''), ' ') AS words FROM memories""",
)
def index_words(spark, sf):
    return table(spark, sf, "memories").select("id", F.array_join(T.index_tokens(F.col("text")), " ").alias("words"))


@register(
    "keywords",
    f"""WITH k AS (SELECT question_id, list_filter({WORDS.format('query_text')}, lambda w: NOT list_contains({STOP}, w)) AS ws FROM questions)
    SELECT question_id, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i), ' ') AS keywords FROM k""",
)
def keywords(spark, sf):
    return table(spark, sf, "questions").select("question_id", F.array_join(T.keywords(F.col("query_text")), " ").alias("keywords"))


@register("quoted_phrases", """SELECT doc_id, unnest(regexp_extract_all(text, '"([^"]*)"', 1)) AS phrase FROM documents""")
def quoted_phrases(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.quoted_phrases(F.col("text"))).alias("phrase"))


_TRIM = r"""regexp_replace(w, '^[.,!?()\[\]{}"'']+|[.,!?()\[\]{}"'']+$', '', 'g')"""
_CAPITAL = "((w = upper(w) AND w <> lower(w) AND length(w) >= 2) OR (substr(w, 1, 1) <> lower(substr(w, 1, 1)) AND NOT (w = upper(w) AND w <> lower(w))))"


def entities_sql(source: str, key: str, text: str, stop: str) -> str:
    """(key, pos, entity): runs of capitalised words, as SQL."""
    return f"""
    SELECT {key}, ord AS pos, entity FROM (
      SELECT {key}, unnest(ents) AS entity, generate_subscripts(ents, 1) AS ord FROM (
        SELECT {key}, list_filter(list_transform(string_split(array_to_string(list_transform(
          list_filter(list_transform(string_split_regex(coalesce({text}, ''), '\\s+'), lambda w: {_TRIM}), lambda w: w <> ''),
          lambda w: CASE WHEN {_CAPITAL} THEN w ELSE chr(1) END), ' '), chr(1)), lambda r: trim(r)), lambda r: length(r) > 1 AND NOT list_contains({stop}, lower(r))) AS ents
        FROM {source}))"""


@register(
    "entity_runs",
    f"""WITH e AS ({entities_sql('memories', 'id', 'text', "CAST([] AS VARCHAR[])")}) SELECT DISTINCT id, entity FROM e""",
)
def entity_runs(spark, sf):
    return table(spark, sf, "memories").select("id", F.explode(T.entities(F.col("text"))).alias("entity"))


def _fact_sql() -> str:
    clean = lambda x: f"regexp_replace(regexp_replace(trim({x}), '[.,!?;:]+$', ''), '^(?:a|an|the)\\s+', '', 'i')"
    whole = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
    parts = ", ".join(
        f"struct_pack(subject := {clean(f'''regexp_extract({whole}, '(?i){p}', 1)''')}, attribute := '{a}', value := {clean(f'''regexp_extract({whole}, '(?i){p}', 2)''')})" for a, p in vocab.FACTS
    )
    return f"""WITH f AS (SELECT id, list_filter([{parts}], lambda x: x.subject <> '' AND x.value <> '') AS found FROM memories)
    SELECT id, found[1].subject AS subject, found[1].attribute AS attribute, found[1].value AS value FROM f WHERE len(found) > 0"""


@register("fact_extract", _fact_sql())
def fact_extract(spark, sf):
    return table(spark, sf, "memories").select("id", T.fact(F.col("text")).alias("f")).where("f IS NOT NULL").select("id", "f.subject", "f.attribute", "f.value")


@register(
    "importance_cues",
    "SELECT id FROM memories WHERE regexp_matches(lower(text), '\\b(" + "|".join(p.replace("'", "''") for p in vocab.IMPORTANCE_PHRASES) + ")\\b')",
)
def importance_cues(spark, sf):
    return table(spark, sf, "memories").where(T.has_importance_cue(F.col("text"))).select("id")


@register(
    "token_estimate",
    """SELECT doc_id, CAST(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 4)) END AS BIGINT) AS tokens FROM documents""",
)
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@register(
    "truncated_texts",
    """WITH h AS (SELECT doc_id, text, substr(text, 1, 400) AS head FROM documents WHERE text IS NOT NULL),
    s AS (SELECT *, 400 - instr(reverse(head), ' ') AS cut_at FROM h)
    SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN contains(head, ' ') AND cut_at > 320 THEN substr(text, 1, cut_at) || '...' ELSE head || '...' END AS short FROM s""",
)
def truncated_texts(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.truncate(F.col("text"), 100).alias("short"))


@register("text_checksum", "SELECT doc_id, sha256(text) AS checksum FROM documents WHERE text IS NOT NULL")
def text_checksum(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("checksum"))


@register(
    "chat_prompt",
    f"""WITH c AS (SELECT query_id, memory_id, min(distance) AS d FROM candidates GROUP BY 1, 2),
    r AS (SELECT c.query_id, m.id, m.text, row_number() OVER (PARTITION BY c.query_id ORDER BY d, m.id) AS rn FROM c JOIN memories m ON m.id = c.memory_id WHERE {LIVE}),
    l AS (SELECT query_id, string_agg(text, ' / ' ORDER BY rn) AS context FROM r WHERE rn <= 3 GROUP BY 1)
    SELECT q.question_id, concat_ws(chr(10), '[system] answer from the context', '[context] ' || l.context, '[user] ' || q.query_text, '[assistant]') AS prompt
    FROM questions q JOIN l ON l.query_id = q.question_id""",
)
def chat_prompt(spark, sf):
    from pyspark.sql import Window

    best = table(spark, sf, "candidates").groupBy("query_id", F.col("memory_id").alias("id")).agg(F.min("distance").alias("d"))
    rows = best.join(store.live(table(spark, sf, "memories")).select("id", "text"), "id")
    top = rows.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))).where("rn <= 3")
    context = top.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "text"))), lambda x: x["text"]), " / ").alias("context"))
    asked = table(spark, sf, "questions").join(context, F.col("question_id") == F.col("query_id"))
    return asked.select("question_id", T.prompt(F.lit("answer from the context"), F.col("context"), F.col("query_text")).alias("prompt"))


@register("detect_attribute", f"SELECT question_id, {attribute_sql('query_text')} AS attribute FROM questions")
def detect_attribute(spark, sf):
    return table(spark, sf, "questions").select("question_id", T.attribute_of(F.col("query_text")).alias("attribute"))


@register(
    "detect_attribute_substring",
    "SELECT question_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(query_text), '{w}')" for w in a.split()) + f" THEN '{n}'" for n, _, a in vocab.ATTRIBUTES) + " END AS attribute FROM questions",
)
def detect_attribute_substring(spark, sf):
    return table(spark, sf, "questions").select("question_id", T.attribute_of(F.col("query_text"), substring=True).alias("attribute"))


def _detection_sql() -> str:
    ents = entities_sql("questions", "question_id", "query_text", sql_list(vocab.STOPWORDS + vocab.INTERROGATIVES))
    each = []
    for i, (kind, least, penalty, ne, eb, na, ab, _, _, words, excl) in enumerate(vocab.ROUTES):
        n = lambda ws: " + ".join([f"CAST(contains(q, '{w}') AS INT)" for w in ws.split("|") if w] or ["0"])
        points = f"({n(words)}) * 1.0 - ({n(excl)}) * {penalty}" + (f" + CASE WHEN n_ent > 0 THEN {eb} ELSE 0 END" if ne else "") + (f" + CASE WHEN attr IS NOT NULL THEN {ab} ELSE 0 END" if na else "")
        each.append(f"SELECT question_id, CAST({i} AS BIGINT) AS priority, '{kind}' AS kind, CAST({points} AS DOUBLE) AS points, CAST({least} AS DOUBLE) AS least FROM u")
    return f"""WITH e AS ({ents}), n AS (SELECT question_id, count(DISTINCT entity) AS n_ent FROM e GROUP BY 1),
    u AS (SELECT q.question_id, lower(coalesce(q.query_text, '')) AS q, coalesce(n.n_ent, 0) AS n_ent, {attribute_sql('q.query_text')} AS attr FROM questions q LEFT JOIN n USING (question_id)),
    d AS ({' UNION ALL '.join(each)}),
    c AS (SELECT *, greatest(0.0, least(1.0, (points + 10) / 30)) AS confidence FROM d)"""


@register("detection_scores", _detection_sql() + " SELECT question_id AS query_id, priority, kind, round(points, 6) AS points, round(confidence, 6) AS confidence, confidence >= least AS passed FROM c")
def detection_scores(spark, sf):
    return routing.detections(rank.understand(table(spark, sf, "questions")))


@register(
    "classify_type",
    _detection_sql()
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(confidence, 6) DESC, priority) AS rn FROM c WHERE confidence >= least)
    SELECT question_id AS query_id, kind, round(confidence, 6) AS confidence FROM r WHERE rn = 1""",
)
def classify_type(spark, sf):
    return routing.classify(rank.understand(table(spark, sf, "questions")))


@register(
    "route_table",
    "SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', CAST({r[1]} AS DOUBLE), CAST({r[7]} AS BIGINT), '{s}')" for r in vocab.ROUTES for s in r[8].split()) + ") t(kind, min_confidence, graph_depth, source)",
)
def route_table(spark, sf):
    return routing.routes(spark).select("kind", "min_confidence", "graph_depth", F.explode("sources").alias("source"))


@register(
    "shard_assignment",
    f"""SELECT shard, count(*) AS n FROM (SELECT CASE {KIND} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in routing.SHARDS.items())} ELSE -1 END AS shard FROM memories) GROUP BY 1""",
)
def shard_assignment(spark, sf):
    """Rows by shard; types outside the table are listed as -1, since their hash differs between engines."""
    rows = store.decode(table(spark, sf, "memories"))
    known = F.when(F.col("memory_type").isin(*routing.SHARDS), routing.shard(F.col("memory_type"))).otherwise(F.lit(-1))
    return rows.groupBy(known.cast("int").alias("shard")).agg(F.count("*").alias("n"))


@register(
    "importance_score",
    f"""WITH m AS (SELECT id, text, {KIND} AS memory_type, CASE WHEN json_valid(metadata) THEN metadata END AS meta, importance, created_at FROM memories),
    f AS (SELECT *, TRY_CAST(meta ->> '$.importance' AS DOUBLE) AS given, epoch(TIMESTAMP '2025-02-01') - epoch(date_trunc('second', created_at)) AS age_s FROM m)
    SELECT id, CAST(round(least(1.0, 0.3 + CASE WHEN regexp_matches(lower(text), '\\b({'|'.join(p.replace("'", "''") for p in vocab.IMPORTANCE_PHRASES)})\\b') THEN 0.3 ELSE 0 END
      + CASE WHEN length(text) > 100 THEN 0.1 ELSE 0 END + CASE WHEN (meta ->> '$.goal') IS NOT NULL THEN 0.2 ELSE 0 END
      + CASE WHEN memory_type IN ('science', 'code', 'procedural') THEN 0.1 ELSE 0 END + CASE WHEN given > 0.5 THEN 0.1 ELSE 0 END + CASE WHEN given IS NOT NULL THEN 0.05 ELSE 0 END
      + CASE WHEN floor(age_s / 86400) = 0 THEN 0.05 WHEN floor(age_s / 86400) < 7 THEN 0.02 ELSE 0 END), 6) AS DOUBLE) AS score FROM f""",
)
def importance_score(spark, sf):
    rows = store.decode(table(spark, sf, "memories"))
    given = F.expr("try_cast(metadata['importance'] AS double)")
    score = scores.importance(F.col("text"), T.has_importance_cue(F.col("text")), F.col("metadata")["goal"].isNotNull(), F.col("memory_type"), given, F.col("created_at"), F.lit(0), S.now)
    return rows.select("id", F.round(score, 6).alias("score"))


_TAU = "CASE memory_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.RECENCY_DAYS.items()) + " ELSE 30.0 END"


@register(
    "recency_by_type",
    f"""WITH m AS (SELECT id, {KIND} AS memory_type, created_at FROM memories)
    SELECT id, round(CASE WHEN created_at IS NULL THEN 0.5 ELSE exp(-greatest(0, floor((epoch({NOW}) - floor(epoch(created_at))) / 86400)) / ({_TAU})) END, 6) AS recency FROM m""",
)
def recency_by_type(spark, sf):
    return store.decode(table(spark, sf, "memories")).select("id", F.round(scores.recency(F.col("created_at"), F.col("memory_type"), S.now), 6).alias("recency"))


@register(
    "recall_gate",
    f"SELECT id, round({IMPORTANCE}, 6) AS importance FROM memories WHERE {LIVE} AND {IMPORTANCE} >= 0.7",
)
def recall_gate(spark, sf):
    """Memories important enough to be stored without being asked for."""
    return store.decode(store.live(table(spark, sf, "memories"))).where("importance >= 0.7").select("id", F.round("importance", 6).alias("importance"))


@register("folded_names")
def folded_names(spark, sf):
    """Entity names in compatibility form and lower case."""
    return table(spark, sf, "entities").select("id", T.fold_case(F.col("name")).alias("folded"))
