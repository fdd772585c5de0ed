"""Candidates for questions from five sources, their union, cap and routing."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scores as SC
from lodestone.functions import text as T
from lodestone.functions import vocab
from lodestone.functions.vocab import Settings
from lodestone.operators import graph, lexical, routing, store
from lodestone.session import cut_lineage

#: The sources in the order of their priority, the last one first.
SOURCES = ("vector", "bm25", "graph", "phrase", "attribute")


def by_attribute(asked: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, id): live memories with the subject and the attribute of an understood question."""
    keys = asked.select("query_id", F.col("q_subject").alias("subject"), F.col("q_attribute").alias("attribute"))
    return store.live(memories).join(keys, ["subject", "attribute"]).select("query_id", "id")


def by_graph(asked: DataFrame, edges: DataFrame, k: int, depth: int = 2) -> DataFrame:
    """(query_id, id, hops, rank): the k nearest memories of entities within ``depth`` edges of the one asked about."""
    seeds = asked.where("q_subject IS NOT NULL").select("query_id", F.lower("q_subject").alias("seed"))
    found = graph.nearest_memories(edges.where("source IS NOT NULL AND target IS NOT NULL"), seeds.select("seed").distinct(), depth, k)
    rows = seeds.join(found, "seed").repartition("query_id").groupBy("query_id", F.col("memory_id").alias("id")).agg(F.min("hops").alias("hops"))
    w = Window.partitionBy("query_id").orderBy("hops", "id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def phrases(asked: DataFrame) -> DataFrame:
    """(query_id, words): the phrases in quotation marks of each question; of a question without any its first name."""
    quoted = F.filter(F.col("q_phrases"), lambda p: F.size(T.words(p)) > 0)
    named = F.when(F.col("q_subject").isNotNull(), F.array("q_subject")).otherwise(F.array().cast("array<string>"))
    return asked.select("query_id", F.explode(F.when(F.size(quoted) > 0, quoted).otherwise(named)).alias("p")).select("query_id", T.words(F.col("p")).alias("words")).distinct()


def by_phrase(asked: DataFrame, docs: DataFrame, k: int = 100) -> DataFrame:
    """(query_id, id, hits, rank): the k texts that hold a phrase most often; of several phrases the best one counts."""
    each = cut_lineage(phrases(asked))
    found = lexical.phrase_hits(docs, each)
    # what is among the best of a question is among those of the phrase it holds most often; questions share phrases
    own = found.withColumn("n", F.row_number().over(Window.partitionBy("words").orderBy(F.desc("hits"), "id"))).where(F.col("n") <= k)
    best = own.join(each, "words").select("query_id", "id", "hits").repartition("query_id").groupBy("query_id", "id").agg(F.max("hits").alias("hits"))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def by_words(docs: DataFrame | lexical.Index, terms: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, id, score): the best texts of each question by BM25."""
    return lexical.bm25_best(docs, terms, settings.source_k, settings.k1, settings.b).select("query_id", "id", "score")


def sources(
    asked: DataFrame, terms: DataFrame, memories: DataFrame, edges: DataFrame | None = None, near: DataFrame | None = None, index: lexical.Index | None = None, settings: Settings = Settings(), only: tuple[str, ...] = SOURCES
) -> dict[str, DataFrame]:
    """(query_id, id, distance) by source; those without input or not among ``only`` are not searched. near: (query_id, id, distance) of a vector search."""
    docs = store.live(memories).select("id", "text")
    at_once = lambda rows: rows.select("query_id", "id", F.lit(0.0).alias("distance"))
    found = {
        "vector": lambda: near.repartition("query_id").groupBy("query_id", "id").agg(F.min("distance").alias("distance")),
        "bm25": lambda: by_words(index or docs, terms, settings).select("query_id", "id", SC.bm25_distance(F.col("score")).alias("distance")),
        "graph": lambda: at_once(by_graph(asked, edges, settings.graph_k)),
        "phrase": lambda: at_once(by_phrase(asked, docs)),
        "attribute": lambda: at_once(by_attribute(asked, memories)).repartition("query_id"),
    }
    missing = {s for s, rows in (("vector", near), ("graph", edges)) if rows is None}
    return {s: f() for s, f in found.items() if s in only and s not in missing}


def union(found: dict[str, DataFrame], priority: tuple[str, ...] = SOURCES) -> DataFrame:
    """(query_id, id, distance, p, source): one row for each candidate, from the source that comes last in the priority; others count as first."""
    order = [*(s for s in found if s not in priority), *priority]
    rows = [df.select("query_id", "id", "distance", F.lit(order.index(s)).alias("n")) for s, df in found.items()]
    # sources rank by query, so their rows meet where they are; only numbers are kept, which are merged without sorting
    best = functools.reduce(DataFrame.unionByName, rows).groupBy("query_id", "id").agg(F.max_by("distance", "n").alias("distance"), F.max("n").alias("n"))
    p = F.greatest(F.lit(-1), F.col("n") - (len(order) - len(priority)))
    return best.select("query_id", "id", "distance", p.alias("p"), F.element_at(F.array(*map(F.lit, order)), F.col("n") + 1).alias("source"))


def sequential(found: dict[str, DataFrame]) -> DataFrame:
    """(query_id, id, distance, source): vector, then attribute, then graph; what an earlier source has found is skipped."""
    order = [s for s in ("vector", "attribute", "graph") if s in found]
    return union({s: found[s] for s in order}, tuple(reversed(order))).drop("p")


def capped(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` candidates of each question by the priority of their source, then distance, then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("p"), F.round("distance", 6), "id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def routed(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """The candidates from the sources that the type of their question is routed to; phrases are always searched."""
    table = routing.routes(rows.sparkSession).select("kind", "sources")
    own = kinds.select("query_id", "kind").join(F.broadcast(table), "kind")  # one row a type
    joined = rows.join(own, "query_id", "left")
    kept = F.array_contains(F.coalesce("sources", F.lit(list(SOURCES))), F.col("source")) | (F.col("source") == "phrase")
    return joined.where(kept).drop("kind", "sources")


def sufficient(rows: DataFrame, n_sources: int, n_candidates: int) -> DataFrame:
    """(query_id, sources, candidates, enough): whether at least so many sources and candidates answered each question."""
    got = rows.groupBy("query_id").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("candidates"))
    return got.withColumn("enough", (F.col("sources") >= n_sources) & (F.col("candidates") >= n_candidates))


def pool(relevance: DataFrame, memories: DataFrame, most: int) -> DataFrame:
    """(memory_type, id, relevance, rank): the most relevant live memories of each type. relevance: (mem_id, relevance)."""
    rel = relevance.select(F.col("mem_id").alias("id"), "relevance")
    rows = store.decode(store.live(memories)).select("id", "memory_type").join(rel, "id")
    w = Window.partitionBy("memory_type").orderBy(F.desc("relevance"), "id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def with_pool(rows: DataFrame, pooled: DataFrame, kinds: DataFrame, top_k: int) -> DataFrame:
    """(query_id, id, source): the pool of each question's type, then its candidates that are not in it; a pool of ``top_k`` is enough by itself.

    Questions of the type general have no pool.
    """
    typed = kinds.where("kind <> 'general'").select("query_id", F.col("kind").alias("memory_type"))
    mine = typed.join(pooled.where(F.col("rank") <= top_k), "memory_type").select("query_id", "id", F.lit("pool").alias("source"))
    full = mine.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= top_k).select("query_id")
    rest = rows.join(full, "query_id", "left_anti").join(mine.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", "source")
    return mine.unionByName(rest)


def terms_of(questions: DataFrame) -> DataFrame:
    return lexical.query_terms(questions, "question_id", "query_text", vocab.STOPWORDS + vocab.INTERROGATIVES)
