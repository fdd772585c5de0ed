"""Operators that once gave less than their whole result."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from lodestone.functions import vocab
from lodestone.operators import graph, learn, lexical, rank, retrieve, routing, vector
from lodestone.plans import learning_queries
from lodestone.plans import retrieval_queries as R
from lodestone.plugins import Registry
from lodestone.session import table
from tests.conftest import DATA

FOLDER = str(DATA / "sf0.001")
tables = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test data")


def keys(df):
    return {(r.query_id, r.id) for r in df.select("query_id", "id").collect()}


@tables
def test_union_has_what_only_graph_or_phrase_finds(spark):
    rows = R.union_sources(spark, FOLDER).collect()
    got = {(r.query_id, r.id): r.source for r in rows}
    assert set(got.values()) == set(retrieve.SOURCES) and len(got) == len(rows)
    graph, phrase = keys(R.graph_retrieval(spark, FOLDER)), keys(R.phrase_search(spark, FOLDER))
    assert {got.get(k) for k in phrase} <= {"phrase", "attribute"}
    assert {got.get(k) for k in graph} <= {"graph", "phrase", "attribute"}


def test_similar_pairs_of_all_vectors_and_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 4))
    x = np.round(np.concatenate([base[rng.integers(0, 12, 90)] * rng.uniform(0.5, 2, (90, 1)) + rng.normal(size=(90, 4)) * 0.05, np.repeat(base[:2], 15, axis=0)]) * 512) / 512
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if round(float(unit[a] @ unit[b]), 6) >= 0.99}
    for block in (7, 1_000):
        got = [(r.a, r.b) for r in vector.similar_pairs(df, 0.99, dim=4, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@tables
def test_similar_vectors_are_not_bound_to_batches(spark):
    batches, every = ({(r.a, r.b) for r in f(spark, FOLDER).collect()} for f in (R.embedding_similar_in_batch, R.embedding_similar))
    assert batches < every


@tables
def test_cap_is_that_of_the_settings(spark):
    counts = [r["count"] for r in R.candidate_cap(spark, FOLDER).groupBy("query_id").count().collect()]
    every = [r["count"] for r in R.retriever_union(spark, FOLDER).groupBy("query_id").count().collect()]
    assert sorted(counts) == sorted(min(n, R.S.candidate_cap) for n in every) and max(counts) > 100


@tables
def test_hybrid_recall_ranks_the_capped_union_with_all_signals(spark):
    got = {(r.query_id, r.id): r.base for r in R.recall_hybrid(spark, FOLDER).collect()}
    assert got and set(got) <= keys(R.candidate_cap(spark, FOLDER))
    queries = rank.understand(table(spark, FOLDER, "questions"))
    found = R.union_sources(spark, FOLDER).select("query_id", "id", "distance")
    rows = rank.signals(found, table(spark, FOLDER, "memories"), queries, R.S).select("query_id", "id", "memory_type", *R._SIGNAL_NAMES).collect()
    kinds = {r.query_id: r.kind for r in routing.classify(queries).collect()}
    tfidf = {(r.query_id, r.id): r.score for r in lexical.tfidf(R._docs(spark, FOLDER), R._terms(spark, FOLDER)).collect()}
    feedback = {r.mem_id: r.boost for r in learn.feedback(table(spark, FOLDER, "feedback_events"), R.S).collect()}
    want = {}
    for r in rows:
        # episodic memories do without tfidf
        values = r.asDict() | {"tfidf": 0 if r.memory_type == "episodic" else tfidf.get((r.query_id, r.id), 0), "feedback": feedback.get(r.id, 0)}
        want[r.query_id, r.id] = sum((values.get(s) or 0) * rank.weight(s, kinds.get(r.query_id, "general")) for s in vocab.SIGNALS)
    assert all(abs(got[k] - want[k]) < 2e-6 for k in got)
    assert any(tfidf.get(k) for k in got) and any(feedback.get(i) for _, i in got)


@tables
def test_signals_of_plugins_count(spark):
    plugins = Registry()
    plugins.signal("one", lambda: F.lit(1.0), 0.25)
    args = [table(spark, FOLDER, n) for n in ("questions", "candidates", "memories")]
    plain, raised = ({(r.query_id, r.id): r.base for r in rank.recall(*args, plugins=p).collect()} for p in (None, plugins))
    common = set(plain) & set(raised)
    assert common and all(abs(raised[k] - plain[k] - 0.25) < 2e-6 for k in common)


def test_best_texts_without_a_row_for_each_shared_word(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(40)]
    chance = 1 / np.arange(1, 41)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=chance / chance.sum()))
    docs = spark.createDataFrame([(i, text(rng.integers(1, 9))) for i in range(400)], "id long, text string")
    asked = spark.createDataFrame([(i, text(rng.integers(1, 6)) + " nowhere" * (i % 3)) for i in range(60)], "question_id long, query_text string")
    terms = lexical.query_terms(asked, "question_id", "query_text", [])
    pairs = ((lexical.bm25, lexical.bm25_best), (lexical.tfidf, lexical.tfidf_best))
    want = [{tuple(r) for r in lexical.top_k(every(docs, terms), 15).collect()} for every, _ in pairs]
    monkeypatch.setattr(lexical, "_summed", None)
    for (_, best), rows in zip(pairs, want, strict=True):
        for sizes in ({}, {"frequent": 30, "shard": 500}, {"frequent": 0}):
            got = [tuple(r) for r in best(docs, terms, 15, **sizes).collect()]
            assert len(got) == len(rows) and set(got) == rows


def test_texts_with_all_words_without_a_row_for_each_shared_word(spark, monkeypatch):
    monkeypatch.setattr(lexical, "join_spread", None)
    rng = np.random.default_rng(7)
    texts = {i: [f"w{x}" for x in rng.integers(0, 9, rng.integers(1, 7))] for i in range(200)}
    asks = {i: [f"w{x}" for x in rng.integers(0, 11, rng.integers(1, 4))] for i in range(40)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    terms = lexical.query_terms(spark.createDataFrame([(i, " ".join(t)) for i, t in asks.items()], "question_id long, query_text string"), "question_id", "query_text", [])
    known = {w for t in texts.values() for w in t}
    for known_only in (False, True):
        needed = {q: set(t) & known if known_only else set(t) for q, t in asks.items()}
        want = {(q, i) for q, n in needed.items() for i, t in texts.items() if n and n <= set(t)}
        got = [tuple(r) for r in lexical.boolean_and(docs, terms, known_only, shard=100).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_phrases_with_repeated_words_and_phrases_given_twice(spark):
    docs = spark.createDataFrame([(1, "a b a b a"), (2, "a a a"), (3, "b x a"), (4, "x")], "id long, text string")
    asked = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "a"]), (3, ["a"]), (4, ["b", "a"]), (4, ["b", "a"]), (5, []), (6, ["nowhere"])], "query_id long, words array<string>")
    got = {tuple(r) for r in lexical.phrase_search(docs, asked).collect()}
    assert got == {(1, 1, 2), (2, 2, 2), (3, 1, 3), (3, 2, 3), (3, 3, 1), (4, 1, 2)}


@tables
def test_sequential_retrieval_searches_only_its_sources(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "by_words", None)
    monkeypatch.setattr(retrieve, "by_phrase", None)
    assert {r.source for r in R.sequential_retrieval(spark, FOLDER).select("source").distinct().collect()} <= {"vector", "attribute", "graph"}


def test_nearest_memories_are_the_first_of_those_in_reach(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(0, 60)), f"n{rng.integers(0, 14)}", "r", "hub" if i % 5 == 0 else f"n{rng.integers(0, 14)}", 1.0) for i in range(90)]
    rows += [(100 + i, int(rng.integers(0, 60)), "hub", "r", f"n{rng.integers(0, 14)}", 1.0) for i in range(20)]
    edges = spark.createDataFrame(rows, "id long, memory_id long, source string, relation string, target string, weight double")
    seeds = spark.createDataFrame([("n1",), ("n2",), ("hub",), ("nobody",)], "seed string")
    every = {}
    for r in graph.reachable_memories(edges, seeds, 2).collect():
        every.setdefault(r.seed, []).append((r.hops, r.memory_id))
    monkeypatch.setattr(graph, "hops", None)
    for k in (3, 10, 50):
        got = [tuple(r) for r in graph.nearest_memories(edges, seeds, 2, k).collect()]
        assert sorted(got) == sorted((s, i, h) for s, found in every.items() for h, i in sorted(found)[:k])


@tables
def test_sources_meet_by_query_without_another_exchange(spark):
    plan = R.union_sources(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "Exchange" not in plan.split("Union")[0]


def test_union_of_known_and_other_sources(spark):
    rows = lambda *x: spark.createDataFrame([(1, i, d) for i, d in x], "query_id long, id long, distance double")
    found = {"vector": rows((1, 0.5), (2, 0.5)), "bm25": rows((2, 0.25), (3, 0.25)), "mine": rows((1, 0.1), (4, 0.1)), "attribute": rows((3, 0.0))}
    got = {tuple(r) for r in retrieve.union(found).select("id", "distance", "p", "source").collect()}
    assert got == {(1, 0.5, 0, "vector"), (2, 0.25, 1, "bm25"), (3, 0.0, 4, "attribute"), (4, 0.1, -1, "mine")}


def test_few_words_that_nobody_asks_for_are_exchanged(spark):
    words = spark.createDataFrame([(f"w{i}",) for i in range(500)], "term string")
    every = spark.createDataFrame([(f"{x}{i}",) for x in "wv" for i in range(500)], "term string")
    kept = {r.term for r in every.where(lexical._maybe(words)(F.col("term"))).collect()}
    assert {f"w{i}" for i in range(500)} <= kept and len(kept) < 510


@tables
def test_scores_of_pairs_are_those_of_all_texts(spark, monkeypatch):
    docs, terms = R._docs(spark, FOLDER), R._terms(spark, FOLDER)
    bm25, tfidf = lexical.bm25(docs, terms), lexical.tfidf(docs, terms).withColumnRenamed("score", "tfidf")
    pairs = table(spark, FOLDER, "candidates").select("query_id", F.col("memory_id").alias("id")).distinct()
    want = {(r.query_id, r.id): (r.score, r.tfidf) for r in bm25.join(tfidf, ["query_id", "id"]).join(pairs, ["query_id", "id"], "left_semi").collect()}
    monkeypatch.setattr(lexical, "_summed", None)
    got = {(r.query_id, r.id): (r.score, r.tfidf) for r in lexical.scores_of(pairs, docs, terms).collect()}
    assert set(got) == set(want) and all(abs(x - y) < 2e-6 for k in got for x, y in zip(got[k], want[k], strict=True)) and got


@tables
def test_deltas_rank_only_questions_with_an_expected_candidate(spark, monkeypatch):
    kept, signals = [], rank.signals
    monkeypatch.setattr(rank, "signals", lambda rows, *rest: kept.append(keys(rows)) or signals(rows, *rest))
    learning_queries.failure_signal_delta(spark, FOLDER)
    want = {(r.question_id, int(e)) for r in table(spark, FOLDER, "questions").collect() for e in r.expected_ids or []}
    asked = {q for q, _ in keys(R.union_sources(spark, FOLDER)) & want}
    assert asked and {q for q, _ in kept[0]} == asked


def test_weighted_paths_of_a_held_graph_write_no_rounds(spark, monkeypatch):
    rng = np.random.default_rng(11)
    name = lambda i: f"n{i:02}"
    weights = [0.0, -1.0, 0.1, 0.2, 0.7, 1.0, 3.5, float("inf")]
    edges = {(name(0 if rng.random() < 0.2 else rng.integers(0, 40)), name(rng.integers(0, 40))): float(rng.choice(weights)) for _ in range(110)}
    edges["n50", "n51"] = float("nan")
    adj = spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, weight double")
    starts = ["n00", "n03", "n17", "n17", "n50", "nowhere"]
    seeds = spark.createDataFrame([(s,) for s in starts], "seed string")
    rows = lambda df: sorted((r.seed, r.node, repr(r.cost)) for r in df.collect())
    by_joins = {d: rows(graph.weighted_paths(adj, seeds, d, held=0)) for d in (None, 2)}
    monkeypatch.setattr(graph, "join_spread", None)
    want = []
    for s in set(starts):
        cost = {s: 0.0}
        for _ in range(60):
            for (a, b), w in edges.items():
                if a in cost and not cost[a] + max(0.0, w) >= cost.get(b, float("inf")) or a in cost and b not in cost:
                    cost[b] = cost[a] + (w if w != w else max(0.0, w))
        want += [(s, n, repr(c)) for n, c in cost.items()]
    assert rows(graph.weighted_paths(adj, seeds)) == sorted(want) == by_joins[None]
    assert rows(graph.weighted_paths(adj, seeds, 2)) == by_joins[2] != by_joins[None]


def test_texts_with_any_word_are_given_out_without_an_exchange_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(lexical, "join_spread", None)
    monkeypatch.setattr(lexical, "cut_lineage", None)
    rng = np.random.default_rng(13)
    texts = {f"t{i}": [f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 6))] for i in range(300)}
    texts[None] = ["w1", "w2"]
    asks = {i: [f"w{x}" for x in rng.integers(0, 33, rng.integers(1, 5))] for i in range(80)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id string, text string")
    terms = lexical.query_terms(spark.createDataFrame([(i, " ".join(t)) for i, t in asks.items()], "question_id long, query_text string"), "question_id", "query_text", [])
    want = {(q, i) for q, n in asks.items() for i, t in texts.items() if set(n) & set(t)}
    words = [(w, i, len(t), t.count(w)) for i, t in texts.items() for w in set(t)]
    index = lexical.Index(spark.createDataFrame(words, "term string, id string, dl int, tf long"), spark.createDataFrame([(len(texts), 3.0)], "n_docs long, avgdl double"))
    for given, shard in ((docs, lexical.SHARD_TEXTS), (docs, 9), (docs.union(docs), 100), (index, 100)):
        got = [tuple(r) for r in lexical.boolean_or(given, terms, shard).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_texts_with_any_word_take_little_room_in_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "ANY_QUERIES", 150)
    rng = np.random.default_rng(14)
    has = rng.random((7000, 40)) < [0.5, *[0.05] * 39]
    asked = np.zeros((400, 40), bool)
    asked[:, 0] = asked[np.arange(400), rng.integers(1, 40, 400)] = True
    docs, queries = ([(i, " ".join(f"w{w}" for w in np.flatnonzero(x))) for i, x in enumerate(m)] for m in (has, asked))
    terms = lexical.query_terms(spark.createDataFrame(queries, "question_id long, query_text string"), "question_id", "query_text", [])
    lexical.boolean_or(spark.createDataFrame(docs, "id long, text string"), terms).write.parquet(str(tmp_path / "pairs"))
    got = spark.read.parquet(str(tmp_path / "pairs")).toPandas()
    want = np.flatnonzero(asked.astype(int) @ has.T.astype(int))
    assert np.array_equal(np.sort(got["query_id"] * len(has) + got["id"]), want)
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 0.3 * len(want)


def test_crossed_pairs_come_once_each():
    for q, n in ((1, 1), (1, 9), (3, 7), (9, 1), (8, 8), (13, 7), (70, 65), (5, 1000), (1000, 5), (300, 601), (601, 63)):
        rows, found = (np.concatenate(x) for x in zip(*lexical._crossed(np.arange(q, dtype=np.int32), np.arange(n, dtype=np.int32)), strict=True))
        assert len(rows) == q * n == len(set(zip(rows.tolist(), found.tolist(), strict=True)))
        assert rows.max() == q - 1 and found.max() == n - 1
