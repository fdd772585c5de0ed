import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestone.functions import scores as S
from lodestone.functions import text as T
from lodestone.functions.vocab import Settings
from lodestone.operators import graph, learn, lexical, maintain, rank, skew, store, vector
from lodestone.plugins import Registry
from lodestone.sources import ingest, readers


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_case_folding(spark):
    assert one(spark, " Café ", T.fold_case) == "cafe\u0301"
    assert one(spark, "ﬁn", T.fold_case) == "fin" and one(spark, None, T.fold_case) == ""
    assert one(spark, "  A   b\n C ", T.normalize) == "a b c" and one(spark, None, T.normalize) == ""


def test_facts_entities_and_phrases(spark):
    assert tuple(one(spark, "Alice likes the tacos!", T.fact)) == ("Alice", "likes", "tacos")
    assert tuple(one(spark, "Charlie lives in Detroit.", T.fact)) == ("Charlie", "city", "Detroit")
    assert one(spark, "nothing here", T.fact) is None and one(spark, None, T.fact) is None
    assert one(spark, "We met (Anna Maria) and NASA, in New York.", T.entities) == ["We", "Anna Maria", "NASA", "New York"]
    assert one(spark, 'say "a b" or "c"', T.quoted_phrases) == ["a b", "c"]
    assert one(spark, "", T.entities) == []


def test_token_estimate_and_truncation(spark):
    assert [one(spark, t, T.token_estimate) for t in (None, "", "abc", "a" * 9)] == [0, 0, 1, 2]
    assert one(spark, "short", lambda t: T.truncate(t, 10)) == "short"
    assert one(spark, "word " * 20, lambda t: T.truncate(t, 10)).endswith("word...")


def test_relationships_by_cue_and_by_chain(spark):
    of = lambda text: [tuple(r) for r in one(spark, text, lambda t: ingest.relationships(t, T.entities(t)))]
    assert of("Anna likes Berlin") == [("Anna", "likes", "Berlin")]
    assert of("Anna and Bert and Carl") == [("Anna", "related_to", "Bert"), ("Bert", "related_to", "Carl")]
    assert of("Anna") == []


def test_bm25_and_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c c"), (3, ""), (4, None), (5, "d")], "id long, text string")
    terms = spark.createDataFrame([(9, "a", 2), (9, "zz", 1)], "query_id long, term string, qtf long")
    got = {r.id: r.score for r in lexical.bm25(docs, terms).collect()}
    idf, avg = math.log((3 - 2 + 0.5) / 2.5 + 1), 7 / 3
    assert got == {i: round(2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)), 6) for i, tf, dl in ((1, 1, 2), (2, 2, 4))}
    got = {r.id: r.score for r in lexical.tfidf(docs, terms).collect()}
    assert got == {1: round((math.log(4 / 3) + 1) / 2 * 0.5, 6), 2: round((math.log(4 / 3) + 1) / 2 * 0.5, 6)}


def test_token_budget_skips_and_continues(spark):
    kept = spark.range(1).select(rank.budget(F.array(*[F.lit(c).cast("long") for c in (4, 7, 2, 0, 5)]), 7, 50).alias("k")).first().k
    assert kept == [True, False, True, True, False]


def test_mmr_prefers_different_vectors(spark):
    rows = [(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.9, [1.0, 0.0]), (1, 3, 0.8, [0.0, 1.0]), (1, 4, 0.1, None)]
    df = spark.createDataFrame([(q, i, s, e) for q, i, s, e in rows] + [(2, 7, 0.5, [1.0, 1.0])] * 1, "query_id long, id long, normalized double, embedding array<float>")
    vectors = df.select("id", "embedding")
    got = sorted(rank.mmr(df, vectors, k=3).collect(), key=lambda r: (r.query_id, r.rank))
    legacy = rank.mmr(df, vectors, k=3, legacy=True)
    assert legacy.count() == 4 and rank.diagnostics(rank.without_mmr(df, 3), legacy).count() == 2
    assert [r.id for r in got if r.query_id == 1][0] == 1 and len(got) == 4
    assert {r.id for r in got} <= {1, 2, 3, 4, 7}


def test_z_scores_have_mean_zero(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(10)] + [(2, 1, 5.0)], "query_id long, id long, base double")
    got = rank.zscore(df).collect()
    assert abs(sum(r.normalized for r in got if r.query_id == 1)) < 1e-4
    assert [r.normalized for r in got if r.query_id == 2] == [0.0]


def test_graph_with_cycle_loop_and_copies(spark):
    rows = [(1, 10, "A", "r", "B", 1.0), (2, 11, "B", "r", "C", None), (3, 12, "C", "r", "A", 2.0), (4, 13, "D", "r", "D", 1.0), (5, 14, "A", "s", "B", 3.0)]
    edges = spark.createDataFrame(rows, "id long, memory_id long, source string, relation string, target string, weight double")
    adj = graph.adjacency(edges)
    assert {(r.src, r.dst): (r.relation, r.weight) for r in adj.collect()}[("a", "b")] == ("s", 3.0)
    seeds = spark.createDataFrame([("a",), ("d",), ("zz",)], "seed string")
    got = {(r.seed, r.node): r.hops for r in graph.hops(adj, seeds, 4).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("d", "d"): 0, ("zz", "zz"): 0}
    cost = {(r.seed, r.node): r.cost for r in graph.weighted_paths(adj, seeds, 3).collect()}
    assert cost[("a", "c")] == 4.0


def test_feedback_decays_and_is_clamped(spark):
    t = dt.datetime(2025, 1, 22)
    rows = [(1, t, t, 5, "q", "CLICK", None, "s"), (1, t, t, 5, "q", "CLICK", None, "s"), (2, t, None, 5, "q", "dwell", 10_000, "s"), (3, t, t, 5, "q", "dwell", 50, "s"), (4, t, t, 6, None, "skip", None, "s")]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, received_at timestamp_ntz, mem_id long, query_text string, user_action string, duration_ms long, session_id string")
    got = {r.mem_id: r for r in learn.feedback(ev, Settings(now="2025-02-01 00:00:00")).collect()}
    raw = 0.5 + 0.5 * math.log(11)
    assert got[5].raw == round(raw, 6) and got[5].boost == round(min(1, raw * 0.95**10), 6) and got[6].raw == -0.2


def test_knn_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(1)
    x = rng.integers(-9, 9, (40, 4)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    got = {}
    for r in vector.knn(df.repartition(3), df.where("id < 8").withColumnRenamed("id", "query_id"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for q in range(8):
        want = sorted((((x[q] - x[i]) ** 2).sum(), i) for i in range(40))[:5]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]
    assert vector.knn(df, df.limit(0).withColumnRenamed("id", "query_id"), 5).count() == 0


def test_ward_clusters():
    x = np.array([[1, 0], [0.99, 0.01], [0, 1], [0.01, 0.99], [-1, 0]])
    label = maintain.ward(x, 0.5)
    assert label[0] == label[1] != label[2] == label[3] and label[4] not in (label[0], label[2])
    assert len(set(maintain.ward(x, 99.0))) == 1


def test_store_changes(spark):
    mem = spark.createDataFrame([(1, None, 0.05, "x"), (2, 1, 0.9, "y"), (3, 0, None, "z")], "id long, tombstone int, importance double, text string")
    assert {r.id for r in store.live(mem).collect()} == {1, 3}
    gone = store.soft_delete(mem, spark.createDataFrame([(3,), (3,)], "id long"))
    assert {r.id: r.tombstone for r in gone.collect()} == {1: 0, 2: 1, 3: 1}
    new = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "place int, text string")
    assert sorted(r.id for r in store.insert_many(mem, new, "place").collect()) == list(range(4, 54))
    by = {r.id: r.batch for r in store.batches(spark.range(250_000, 250_010).unionByName(spark.range(5)), 4).collect()}
    assert by[0] == 0 and by[4] == 1 and by[250_000] == 1 and by[250_009] == 3


def test_hot_groups_join_over_salts(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 7)
    rows = spark.range(100).select("id", F.when(F.col("id") < 60, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = skew.join_groups(rows, groups, ["k"], "n", 100, "id")
    assert got.count() == 100 and got.where("k = 0").count() == 60 and got.where("first > id").count() == 0


def test_plugins(spark):
    reg = Registry()
    reg.signal("half", lambda: F.col("base") / 2, 1.0)
    reg.recognizer("digits", lambda t: F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1)))
    seen = []
    reg.observe("after_store", seen.append)
    reg.notify("after_store", 5)
    df = spark.createDataFrame([(1, 2.0, "A 42")], "query_id long, base double, t string")
    assert reg.add_signals(df).first().base == 3.0 and seen == [5]
    assert df.select(reg.entities(F.col("t"), T.entities(F.col("t"))).alias("e")).first().e[-1] == "42"
    reg.reranker("top", lambda p: p.head(1), "query_id long, base double, t string")
    assert reg.rerank(df.union(df)).count() == 1
    reg.unregister("half")
    assert not reg.signals


def test_json_and_code_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('["one", {"memory": "two"}, {"text": "", "body": "three"}, ["four", "five"], {"n": 1}]')
    got = sorted(r.text for r in readers.texts_of_json(spark, str(tmp_path / "a.json")).collect())
    assert got == ["five", "four", "one", "three", "two", '{"n":1}']
    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "m.py").write_text("import os\nclass A:\n    def f(self):\n        pass\n")
    (src / "x.go").write_text("package main\nfunc Run() {\n}\n")
    (src / "node_modules" / "y.py").write_text("def hidden(): pass\n")
    (src / "bin.py").write_bytes(b"\x00\x01")
    found = {(r.kind, r.name.split("(")[0]) for r in readers.symbols(readers.code_files(spark, str(src))).collect()}
    assert {("import", "os"), ("class", "A"), ("function", "f")} <= found and not any(n == "hidden" for _, n in found)


def test_world_is_the_same_in_any_order(spark):
    from lodestone.sources.world import SLOTS, World

    one, two = World(spark, 50), World(spark, 50)
    a, b = {tuple(r) for r in one.memories().collect()}, {tuple(r) for r in two.memories().repartition(7).collect()}
    assert a == b and len({i for i, _, _ in a}) == len(a) > 50 * 15
    assert one.facts().select("name").distinct().count() == 50 and one.relations().where("person_id = other_id OR other_id >= 50").count() == 0
    asked = one.questions().collect()
    assert {r.family for r in asked} == {"attribute", "relationship", "multi_hop", "temporal", "summary", "unanswerable"} and len({r.question_id for r in asked}) == len(asked)
    told = {t for _, t, _ in a}
    assert all(any(q.expected in t for t in told) for q in asked[:40] if q.expected)
    assert max(i % SLOTS for i, _, _ in a) < SLOTS
    assert {tuple(r) for r in World(spark, 50, seed=1).memories().collect()} != a


def test_world_is_exported(spark, tmp_path):
    from lodestone.sources.world import World

    World(spark, 12).export(str(tmp_path))
    truth = spark.read.option("header", "true").csv(str(tmp_path / "benchmark_truth.csv"))
    assert truth.count() == 12 and set(truth.columns) == {"person", "food", "vehicle", "city", "job", "phone", "birthday"}
    summary = spark.read.json(str(tmp_path / "benchmark_summary.json")).first()
    assert summary.people == 12 and summary.memories == spark.read.text(str(tmp_path / "benchmark_memories.txt")).count()


def test_stream_equals_batch_with_late_and_repeated_events(spark, tmp_path):
    from lodestone.streaming import feedback

    t = dt.datetime(2025, 1, 1)
    schema = "event_id long, ts timestamp_ntz, received_at timestamp_ntz, mem_id long, query_text string, user_action string, duration_ms long, session_id string"
    rows = [(i % 40, t + dt.timedelta(hours=i % 40), t, i % 5, "q", ("click", "skip", "dwell")[i % 40 % 3], 4000, "s") for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = feedback.once(feedback.read(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema))
    feedback.run_to_folder(feedback.running_feedback(events), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("mem_id").agg(F.max_by(F.round("raw", 6), "epoch").alias("raw"))
    batch = learn.feedback(spark.createDataFrame(rows, schema))
    assert {tuple(r) for r in last.collect()} == {(r.mem_id, r.raw) for r in batch.collect()}


def test_engine_recalls_what_it_remembers(spark):
    from lodestone.api import Engine

    base = spark.createDataFrame([(1, "Bob drives a blue truck.", "bob drives a blue truck.", ["bob"], 5, "semantic", None, ["Bob"], None, 0.5, dt.datetime(2025, 1, 1), None, 0, "Bob", "vehicle")], "id long, text string, normalized_text string, tokens array<string>, token_count int, memory_type string, metadata string, entities array<string>, relationships array<struct<source:string,relation:string,target:string>>, importance double, created_at timestamp_ntz, last_accessed timestamp_ntz, tombstone int, subject string, attribute string")
    engine = Engine(spark, base)
    new = engine.remember("Alice likes tacos.").first()
    assert (new.id, new.memory_type, new.subject, new.attribute) == (2, "semantic", "Alice", "likes")
    asked = spark.createDataFrame([(7, "What does Bob drive?", "truck", ["1"], "attribute")], "question_id long, query_text string, expected string, expected_ids array<string>, family string")
    results = engine.recall(asked)
    assert [r.id for r in results.collect()] == [1]
    assert engine.evaluate(asked, results).first().recall_1 == 1.0
    assert engine.stats().first().live == 1
    assert isinstance(engine.respond(results).toPandas(), pd.DataFrame)


def test_scores(spark):
    row = spark.range(1).select(S.sigmoid(F.lit(0.0)).alias("s"), S.semantic(F.lit(1.0)).alias("d"), S.mmr_lambda(F.lit(20)).alias("l"), S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("c"), S.l2_squared(F.array(F.lit(1.0)), F.array(F.lit(3.0))).alias("e")).first()
    assert tuple(row) == (0.5, 0.5, 1.0, 0.0, 4.0)


def test_signal_registry(tmp_path):
    from lodestone.operators.signals import SignalRegistry

    reg = SignalRegistry()
    assert reg.weight("token", "code") == 0.40 and reg.weight("importance", "code") == 0.08 and not reg.problems()
    reg.disable("token")
    reg.disable("entity", "code")
    reg.register("new", 2.0, nonsense=0.1)
    assert reg.weight("token") == 0 and reg.weight("entity", "code") == 0 and reg.weight("entity") > 0 and len(reg.problems()) == 2
    reg.save(str(tmp_path / "s.json"))
    again = SignalRegistry.load(str(tmp_path / "s.json"))
    assert again.weights == reg.weights and again.off == reg.off and again.off_for == reg.off_for
    assert abs(sum(again.normalized().values()) - 1) < 1e-9
    again.enable("token")
    again.unregister("new")
    assert again.weight("token", "code") == 0.40 and not again.problems()


def test_sinks(spark, tmp_path):
    from lodestone.sources import sinks

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    path = str(tmp_path / "t")
    sinks.save(df, path)
    sinks.add(df, path)
    assert spark.read.parquet(path).count() == 4
    sinks.clear(df, path)
    assert spark.read.parquet(path).count() == 0
    sinks.export_json(df, str(tmp_path / "j"))
    sinks.export_csv(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 2
    results = spark.createDataFrame([(1, i, i, 0.5) for i in range(1, 31)], "query_id long, id long, rank long, final double")
    asked = spark.createDataFrame([(1, "q", "e"), (2, "r", None)], "question_id long, query_text string, expected string")
    got = {r.query_id: r for r in sinks.record(results, asked).collect()}
    assert got[1].candidate_count == 30 and len(got[1].candidates) == 20 and got[2].candidate_count == 0
