"""The engine over a folder: writing, routing by type, plugins, isolation, stored indexes, joins of hot keys."""

import datetime as dt
import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.api import Engine
from lodestone.operators import graph, lexical, rank, retrieve, routing, skew
from lodestone.operators.signals import SignalRegistry
from lodestone.plugins import Registry
from lodestone.sources import readers, sinks
from tests.conftest import DATA

tables = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test data")


@pytest.fixture
def folder(spark, tmp_path):
    for name in ("memories", "candidates", "graph_edges", "feedback_events", "goals", "entities", "questions"):
        spark.read.parquet(str(DATA / "sf0.001" / f"{name}.parquet")).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@tables
def test_writing_through_the_engine(spark, folder, tmp_path):
    engine = Engine.open(spark, folder)
    before = engine.memories.count()
    new = engine.remember("Zacharias lives in Fennimoor.").first()
    assert engine.memories.count() == before + 1 and Engine.open(spark, folder).memories.where(f"id = {new.id}").first().subject == "Zacharias"
    (tmp_path / "more.json").write_text(json.dumps(["Zoe likes ramen.", {"memory": "Zoe drives a van."}]))
    assert engine.import_json(str(tmp_path / "more.json")).count() == 2
    found = engine.search(spark.createDataFrame([(1, "Where does Zacharias live?")], "question_id long, query_text string"), 3)
    assert found.where("rank = 1").first().id == new.id
    n = engine.events.count()
    engine.record(spark.createDataFrame([(dt.datetime(2025, 1, 31), new.id, "Zacharias", "click", "s")], "ts timestamp_ntz, mem_id long, query_text string, user_action string, session_id string"))
    assert engine.events.count() == n + 1 and engine.feedback().where(f"mem_id = {new.id}").first().raw == 0.5
    engine.add_goal("learn the harp")
    goal = engine.goals.where("goal = 'learn the harp'").first()
    engine.update_goal(goal.id, status="done")
    assert engine.get_goal(goal.id).first().status == "done" and engine.list_goals("done").where(f"id = {goal.id}").count() == 1
    engine.add_entity("Zacharias", "person")
    engine.add_entity("zacharias ", "place")  # there already
    own = engine.entities.where("lower(name) = 'zacharias'").collect()
    assert len(own) == 1
    engine.set_entity_type(own[0].id, "organization")
    assert engine.entities.where(f"id = {own[0].id}").first().entity_type == "organization"
    prompt = engine.chat(spark.createDataFrame([(1, "Where does Zacharias live?")], "question_id long, query_text string"), "Be brief.").first().prompt
    assert "Be brief." in prompt and "Fennimoor" in prompt
    engine.clear()
    assert engine.memories.count() == 0 and Engine.open(spark, folder).goals.count() == 0


@tables
def test_merges_and_embedded_recall(spark, folder):
    engine = Engine.open(spark, folder)
    vectors = engine.candidates.where(F.size("embedding") == 64).groupBy(F.col("memory_id").alias("id")).agg(F.min("embedding").alias("embedding"))
    report, after = engine.consolidate(vectors), engine.consolidate(vectors, dry_run=False)
    merged = sum(r.n - 1 for r in report.collect())
    live = lambda rows: rows.where("coalesce(tombstone, 0) = 0").count()
    assert merged > 0 and live(engine.memories) - live(after) == merged and after.count() == engine.memories.count()
    engine.embed = lambda text: F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))
    engine.vectors = engine.save("vectors", engine.embedded()) if engine.vectors else engine.embedded()
    rows = engine.retrieve(spark.read.parquet(f"{folder}/questions.parquet").limit(3))
    assert rows.where("source = 'vector'").count() > 0


@tables
def test_command_line(spark, folder, tmp_path, capsys):
    engine = Engine.open(spark, folder)
    for line in (["stats"], ["goals"], ["remember", "Yvonne owns a parrot."], ["search", "Yvonne", "--limit", "2"], ["recall", "What does Yvonne own?"], ["history"], ["diagnose"], ["feedback"], ["prune"], ["query", "count_live"], ["graph", str(tmp_path / "g")]):
        cli.run(cli.parser().parse_args([folder, *line]), engine)
    assert "Yvonne owns a parrot." in capsys.readouterr().out and spark.read.json(str(tmp_path / "g")).count() > 0


def test_types_of_questions_decide_sources_and_weights(spark):
    asked = [(1, "When did the event happen? Where did it occur during that day, before or after?"), (2, "hello")]
    questions = spark.createDataFrame(asked, "question_id long, query_text string")
    queries = rank.understand(questions)
    kinds = {r.query_id: r.kind for r in routing.classify(queries).collect()}
    assert kinds[2] == "general"
    forced = spark.createDataFrame([(1, "code"), (2, "general"), (3, "semantic")], "query_id long, kind string")
    rows = spark.createDataFrame([(q, i, 0.5, s) for q in (1, 2, 3, 4) for i, s in enumerate(retrieve.SOURCES)], "query_id long, id long, distance double, source string")
    got = {(r.query_id, r.source) for r in retrieve.routed(rows, forced).collect()}
    assert {s for q, s in got if q == 1} == {"bm25", "vector", "phrase"} and {s for q, s in got if q == 3} == {"vector", "attribute", "graph", "phrase"}
    assert {s for q, s in got if q == 2} == {"vector", "bm25", "graph", "attribute", "phrase"} == {s for q, s in got if q == 4}
    enough = {r.query_id: r.enough for r in retrieve.sufficient(retrieve.routed(rows, forced), 4, 4).collect()}
    assert enough == {1: False, 2: True, 3: True, 4: True}
    scored = spark.createDataFrame([(1, "code", "general", 1.0, 1.0), (1, "code", "episodic", 1.0, 1.0), (1, "odd", "general", 1.0, 1.0)], "query_id long, kind string, memory_type string, token double, tfidf double")
    for s in ("semantic", "entity", "subject", "attribute", "recency", "importance"):
        scored = scored.withColumn(s, F.lit(0.0))
    base = [r.base for r in rank.base_score(scored, F.col("kind"), ("tfidf",)).collect()]
    assert base == [0.7, 0.4, round(0.3107 + 0.2929, 6)]
    registry = SignalRegistry()
    registry.disable("token")
    assert [r.base for r in rank.base_score(scored, F.col("kind"), ("tfidf",), registry).collect()] == [0.3, 0.0, 0.2929]


def test_pool_comes_first_and_may_be_enough(spark):
    rows = spark.createDataFrame([(1, 10, "bm25"), (1, 11, "bm25"), (2, 10, "graph"), (3, 10, "graph")], "query_id long, id long, source string")
    pooled = spark.createDataFrame([("code", 11, 9.0, 1), ("science", 10, 5.0, 1), ("science", 12, 4.0, 2)], "memory_type string, id long, relevance double, rank long")
    kinds = spark.createDataFrame([(1, "code"), (2, "science"), (3, "general")], "query_id long, kind string")
    got = {tuple(r) for r in retrieve.with_pool(rows, pooled, kinds, 2).collect()}
    assert got == {(1, 11, "pool"), (1, 10, "bm25"), (2, 10, "pool"), (2, 12, "pool"), (3, 10, "graph")}


def test_quoted_phrases_are_searched_before_names(spark):
    docs = spark.createDataFrame([(1, "a blue truck and a blue truck"), (2, "blue sky"), (3, "Bob saw the truck")], "id long, text string")
    asked = rank.understand(spark.createDataFrame([(1, 'Where is the "blue truck" of Bob?'), (2, "Where is Bob?")], "question_id long, query_text string"))
    assert {tuple(r) for r in retrieve.by_phrase(asked, docs).collect()} == {(1, 1, 2, 1), (2, 3, 1, 1)}


def test_plugins_are_discovered_and_used(spark, tmp_path):
    (tmp_path / "digits.py").write_text("from pyspark.sql import functions as F\n\ndef register(r):\n    r.recognizer('digits', lambda t: F.regexp_extract_all(t, F.lit(r'(\\d+)'), F.lit(1)))\n")
    plugins = Registry()
    assert plugins.discover(str(tmp_path)) == ["digits"]
    memories = spark.createDataFrame([(1, "about 42", None, None, None, "general", None, None, None, 0.5, dt.datetime(2025, 1, 1), None, 0, None, None)], "id long, text string, normalized_text string, tokens array<string>, token_count int, memory_type string, metadata string, entities array<string>, relationships array<struct<source:string,relation:string,target:string>>, importance double, created_at timestamp_ntz, last_accessed timestamp_ntz, tombstone int, subject string, attribute string")
    engine = Engine(spark, memories, plugins=plugins)
    assert "7" in engine.remember("code 7 of Ann").first().entities
    questions = spark.createDataFrame([(1, "what about 42")], "question_id long, query_text string")
    with_it, without = engine.recall(questions).first().base, Engine(spark, memories).recall(questions).first().base
    assert with_it > without


def test_questions_with_texts_of_their_own(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps([{"question_id": "q", "haystack_session_ids": ["a"], "haystack_sessions": [[{"content": "one"}, {"content": ""}], [{"content": "two"}]]}]))
    rows = readers.sessions(spark.read.option("multiLine", "true").json(str(tmp_path / "items.json"))).collect()
    assert [(r.session_id, r.turn, r.text) for r in rows] == [("a", 0, "one"), ("session_1", 0, "two")]
    docs = spark.createDataFrame([(1, 1, "red car"), (1, 2, "blue car"), (2, 1, "red car"), (2, 3, "red red sky")], "query_id long, id long, text string")
    terms = spark.createDataFrame([(1, "red", 1), (2, "red", 1)], "query_id long, term string, qtf long")
    got = {(r.query_id, r.id): r.score for r in lexical.bm25_isolated(docs, terms).collect()}
    for q, texts in ((1, {1: "red car", 2: "blue car"}), (2, {1: "red car", 3: "red red sky"})):
        words = {i: t.split() for i, t in texts.items()}
        df, mean = sum("red" in w for w in words.values()), sum(map(len, words.values())) / 2
        for i, w in words.items():
            tf = Counter(w)["red"]
            want = math.log((2 - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
            assert abs(got.get((q, i), 0) - want) < 1e-6


def test_stored_index_and_frequent_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    docs = spark.createDataFrame([(i, "common word" + (f" rare{i}" if i % 3 else "")) for i in range(90)], "id long, text string")
    terms = spark.createDataFrame([(1, "common", 1), (1, "rare4", 1), (2, "common", 2)], "query_id long, term string, qtf long")
    lexical.Index.build(docs).save(str(tmp_path / "index"))
    stored = lexical.Index.load(spark, str(tmp_path / "index"))
    a, b = ({tuple(r) for r in lexical.bm25(x, terms).collect()} for x in (docs, stored))
    assert a == b and len(a) == 180
    assert {tuple(r) for r in lexical.tfidf(docs, terms).collect()} == {tuple(r) for r in lexical.tfidf(stored.narrow(terms), terms).collect()}


def test_graph_with_a_hot_node_and_long_paths(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    rows = [(i, "Hub", f"n{i}", 1.0) for i in range(60)] + [(100 + i, f"c{i}", f"c{i + 1}", 1.0) for i in range(12)] + [(200, "c0", "c12", 50.0), (201, "n1", "Hub", 1.0)]
    edges = spark.createDataFrame([(i, i, s, "knows", t, w) for i, s, t, w in rows], "id long, memory_id long, source string, relation string, target string, weight double")
    adj = graph.adjacency(edges)
    seeds = spark.createDataFrame([("hub",), ("c0",)], "seed string")
    near = {(r.seed, r.node): r.hops for r in graph.hops(adj, seeds).collect()}
    assert sum(s == "hub" and h == 1 for (s, _), h in near.items()) == 60 and near["c0", "c11"] == 11 and near["c0", "c12"] == 1
    cost = {(r.seed, r.node): r.cost for r in graph.weighted_paths(adj, seeds).collect()}
    assert cost["c0", "c12"] == 12.0 and cost["hub", "hub"] == 0.0
    sinks.graph_json(adj, str(tmp_path / "graph"))
    assert {tuple(r) for r in sinks.graph_from_json(spark, str(tmp_path / "graph")).select("src", "dst", "relation", "weight").collect()} == {tuple(r) for r in adj.select("src", "dst", "relation", "weight").collect()}


def test_scheduled_runs(spark, tmp_path):
    import time

    from lodestone.streaming import feedback

    seen = []
    query = feedback.schedule(spark, seen.append, "1 second", str(tmp_path / "state"))
    end = time.time() + 30
    while len(seen) < 2 and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert seen[:2] == [0, 1]


@tables
def test_adapted_weights_are_used(spark, folder):
    engine = Engine.open(spark, folder)
    questions = spark.read.parquet(f"{folder}/questions.parquet").limit(20)
    before = {(r.query_id, r.id): r.base for r in engine.recall(questions, engine.candidates).collect()}
    weights = engine.adapt()
    assert weights.weight("entity") == weights.weight("entity", "code") != SignalRegistry().weight("entity")
    after = {(r.query_id, r.id): r.base for r in engine.recall(questions, engine.candidates).collect()}
    assert any(before[k] != after[k] for k in set(before) & set(after))
    assert engine.throughput(spark.createDataFrame([(i, f"Text {i}.") for i in range(20)], "place int, text string"), "place") > 0


def test_an_extractor_comes_before_the_rules(spark):
    plugins = Registry()
    plugins.extractor = lambda t: F.when(F.contains(t, F.lit("Ann")), F.array(F.lit("Ann of the model")))
    df = spark.createDataFrame([("Ann",), ("Bob",)], "t string")
    got = [r.e for r in df.select(plugins.entities(F.col("t"), F.array(F.col("t"))).alias("e")).collect()]
    assert got == [["Ann of the model"], ["Bob"]]


def test_cached_vectors(spark):
    from lodestone.operators import maintain

    memories = spark.createDataFrame([(1, 0), (2, None), (3, 1), (4, 0)], "id long, tombstone int")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "id long, embedding array<double>")
    cache = spark.createDataFrame([(1, [9.0])], "id long, embedding array<double>")
    assert {r.id: r.embedding for r in maintain.cached_vectors(memories, vectors, cache).collect()} == {1: [9.0], 2: [2.0], 4: None}
    assert {r.id: r.embedding for r in maintain.cached_vectors(memories, vectors).collect()} == {1: [1.0], 2: [2.0], 4: None}
