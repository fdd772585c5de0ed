"""Queries over sources: chunking, conversations, ingestion, a generated world, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vocab
from lodestone.plans.learning_queries import _DELTA, _EV
from lodestone.plans.text_queries import SPACED, _fact_sql, entities_sql
from lodestone.queries import register
from lodestone.session import checkpoint_dir, table
from lodestone.sources import ingest, readers
from lodestone.sources.world import World
from lodestone.streaming import feedback


@register(
    "sentence_chunks",
    """WITH RECURSIVE s AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i, len(p) AS n FROM (
      SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL)),
    c AS (SELECT doc_id, i, n, s AS chunk, length(s) >= 1000 AS done FROM s WHERE i = 1
      UNION ALL SELECT s.doc_id, s.i, s.n, CASE WHEN c.done OR c.chunk = '' THEN s.s ELSE c.chunk || ' ' || s.s END, length(CASE WHEN c.done OR c.chunk = '' THEN s.s ELSE c.chunk || ' ' || s.s END) >= 1000
      FROM c JOIN s ON s.doc_id = c.doc_id AND s.i = c.i + 1)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS n, chunk FROM c WHERE (done OR (i = n AND chunk <> '')) AND length(chunk) >= 50""",
)
def sentence_chunks(spark, sf):
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(readers.sentence_chunks(F.col("text"))).alias("n", "chunk"))
    return rows.withColumn("n", F.col("n").cast("long"))


@register(
    "conversation_turns",
    """WITH l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS turn FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, CAST(turn AS BIGINT) AS turn, regexp_extract(line, '^(user|assistant): (.*)$', 1) AS role, regexp_extract(line, '^(user|assistant): (.*)$', 2) AS text FROM l WHERE regexp_matches(line, '^(user|assistant): .')""",
)
def conversation_turns(spark, sf):
    """The turns of chats in documents, by speaker."""
    lines = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("turn", "line"))
    turns = lines.where(F.rlike("line", F.lit("^(user|assistant): .")))
    pattern = "^(user|assistant): (.*)$"
    return turns.select("doc_id", F.col("turn").cast("long").alias("turn"), F.regexp_extract("line", pattern, 1).alias("role"), F.regexp_extract("line", pattern, 2).alias("text"))


@register(
    "ingest_preview",
    f"""WITH f AS ({_fact_sql()}), e AS ({entities_sql('memories', 'id', 'text', "CAST([] AS VARCHAR[])")}), n AS (SELECT id, count(DISTINCT entity) AS n_entities FROM e GROUP BY 1)
    SELECT m.id, CASE WHEN f.id IS NULL THEN 'general' ELSE 'semantic' END AS memory_type, f.subject, f.attribute, coalesce(n.n_entities, 0) AS n_entities,
      CAST(len(list_filter(string_split({SPACED.format('m.text')}, ' '), lambda w: w <> '')) AS INTEGER) AS token_count
    FROM memories m LEFT JOIN f ON f.id = m.id LEFT JOIN n ON n.id = m.id WHERE m.text <> ''""",
)
def ingest_preview(spark, sf):
    """All memory texts as if they were stored anew: type, fact, number of entities and tokens."""
    rows = ingest.enrich(table(spark, sf, "memories").select("id", "text"))
    return rows.select("id", "memory_type", "subject", "attribute", F.size("entities").cast("long").alias("n_entities"), "token_count")


_CUES = ", ".join(f"('{c}', '{r}')" for c, r in vocab.RELATION_CUES)


@register(
    "ingest_relationships",
    f"""WITH f AS ({_fact_sql()}), e0 AS ({entities_sql('memories', 'id', 'text', "CAST([] AS VARCHAR[])")}), e1 AS (SELECT id, entity, min(pos) AS p FROM e0 GROUP BY 1, 2),
    e AS (SELECT e1.id, entity, row_number() OVER (PARTITION BY e1.id ORDER BY p) AS i, instr(lower(text), lower(entity)) AS at_, lower(text) AS low FROM e1 JOIN memories m ON m.id = e1.id WHERE e1.id NOT IN (SELECT id FROM f)),
    cue(cue, relation) AS (VALUES {_CUES}), k AS (SELECT e.*, relation, cue, instr(low, cue) AS cat FROM e, cue WHERE instr(low, cue) > 0 AND at_ < instr(low, cue)),
    cued AS (SELECT k.id, k.entity AS source, k.relation, k.cue, arg_min(b.entity, b.i) AS target FROM k JOIN e b ON b.id = k.id AND b.i > k.i AND b.at_ > k.cat GROUP BY ALL),
    chain AS (SELECT a.id, a.entity AS source, 'related_to' AS relation, b.entity AS target FROM e a JOIN e b ON b.id = a.id AND b.i = a.i + 1 WHERE a.id NOT IN (SELECT id FROM cued)),
    r AS (SELECT id, subject AS source, attribute AS relation, value AS target FROM f UNION ALL SELECT id, source, relation, target FROM cued UNION ALL SELECT * FROM chain)
    SELECT id, source, relation, target, count(*) AS n FROM r GROUP BY ALL""",
)
def ingest_relationships(spark, sf):
    """The relationships that all memory texts would get if they were stored anew."""
    rows = ingest.enrich(table(spark, sf, "memories").select("id", "text"))
    return rows.select("id", F.explode("relationships").alias("r")).groupBy("id", "r.source", "r.relation", "r.target").agg(F.count("*").alias("n"))


@register("synthetic_world")
def synthetic_world(spark, sf):
    """The memories of a generated world of 500 people by kind."""
    return World(spark, 500).memories().groupBy("kind").agg(F.count("*").alias("memories"), F.count_if(T.has_importance_cue(F.col("text"))).alias("with_cue"))


@register("world_people")
def world_people(spark, sf):
    """People of the generated world by city and by job."""
    facts = World(spark, 500).facts().where("attribute IN ('city', 'job')")
    return facts.groupBy("attribute", "value").agg(F.count("*").alias("people"))


@register("code_symbols")
def code_symbols(spark, sf):
    """Functions, classes and imports in the code among the documents."""
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), readers.language_of(F.col("text")).alias("language"), "text")
    return readers.symbols(rows.where("language IS NOT NULL")).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def _stream(spark, sf):
    path = f"{sf}/feedback_events.parquet"
    return feedback.once(feedback.read(spark, path + "*", spark.read.parquet(path).schema, files_per_trigger=1000))


def _last(spark, result, key: list[str]):
    """Runs a stream over what is there and reads the newest state of each key back."""
    at = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    feedback.run_to_folder(result, f"{at}/out", f"{at}/state").awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    rest = [c for c in rows.columns if c not in (*key, "epoch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "epoch").alias("x")).select(*key, "x.*")


@register(
    "stream_feedback",
    f"WITH {_EV} SELECT mem_id, CAST(round(sum({_DELTA}), 6) AS DOUBLE) AS raw, count(*) AS uses FROM ev WHERE mem_id IS NOT NULL GROUP BY 1",
)
def stream_feedback(spark, sf):
    """Running feedback of each memory from the stream of events; equals the batch result."""
    return _last(spark, feedback.running_feedback(_stream(spark, sf)), ["mem_id"]).select("mem_id", F.round("raw", 6).alias("raw"), "uses")


@register(
    "stream_daily_actions",
    f"WITH {_EV} SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, lower(user_action) AS user_action, count(*) AS n FROM ev GROUP BY 1, 2",
)
def stream_daily_actions(spark, sf):
    """Actions of each day from the stream."""
    rows = _last(spark, feedback.windowed_actions(_stream(spark, sf)), ["start", "user_action"])
    return rows.select(F.floor(F.unix_seconds("start") / 86400).cast("long").alias("day"), "user_action", "n")


@register("analyzer_round_trip")
def analyzer_round_trip(spark, sf):
    """Texts whose analysed words change with compatibility folding, by number."""
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select(T.words(F.col("text")).alias("a"), T.words(T.fold_case(F.col("text"))).alias("b"))
    return rows.groupBy((F.col("a") == F.col("b")).alias("same")).agg(F.count("*").alias("n"))


@register("code_display", "SELECT doc_id, substr('document ' || source || ' in ' || lang || ': ' || text, 1, 2000) AS shown FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
def code_display(spark, sf):
    """The capped text under which a symbol or a document is stored."""
    rows = table(spark, sf, "documents").where("text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
    return rows.select("doc_id", readers.display(F.lit("document"), F.col("source"), F.col("text"), F.col("lang")).alias("shown"))


@register(
    "stream_sessions",
    f"""WITH {_EV}, c AS (SELECT session_id, ts, lag(ts) OVER (PARTITION BY session_id ORDER BY ts) AS before FROM ev WHERE lower(user_action) = 'click' AND session_id IS NOT NULL),
    s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM c)
    SELECT session_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS clicks FROM s GROUP BY session_id, n""",
)
def stream_sessions(spark, sf):
    """Clicks by session, ended by half an hour without one, from the stream of events."""
    at = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows = feedback.session_clicks(_stream(spark, sf).where("session_id IS NOT NULL"))
    feedback.run_to_folder(rows, f"{at}/out", f"{at}/state", "complete").awaitTermination()
    last = spark.read.parquet(f"{at}/out")
    newest = last.agg(F.max("epoch").alias("epoch"))
    return last.join(F.broadcast(newest), "epoch").select("session_id", F.unix_millis("start").alias("start_ms"), "clicks")
