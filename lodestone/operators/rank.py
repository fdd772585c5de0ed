"""Ranking of candidates: signals, base score, normalisation, boosts, final score, context, diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scores as S
from lodestone.functions import text as T
from lodestone.functions import vocab
from lodestone.functions.vocab import Settings
from lodestone.operators import graph, store
from lodestone.operators.signals import SignalRegistry
from lodestone.session import cut_lineage, spread

STOP = tuple(vocab.STOPWORDS) + tuple(vocab.INTERROGATIVES)


def understand(questions: DataFrame, id_col: str = "question_id", text_col: str = "query_text") -> DataFrame:
    """(query_id, text, tokens, keywords, entities, phrases, subject, attribute) of each question."""
    q = F.coalesce(F.col(text_col), F.lit(""))
    rows = questions.select(F.col(id_col).alias("query_id"), q.alias("q"))
    rows = rows.withColumns(
        {"q_tokens": T.words(F.col("q")), "q_keywords": T.keywords(F.col("q")), "q_entities": T.entities(F.col("q"), STOP), "q_phrases": T.quoted_phrases(F.col("q"))}
    )
    rows = rows.withColumns({"q_attribute": T.attribute_of(F.col("q"), tokens=F.col("q_tokens")), "q_asked": attributes_asked(F.col("q_tokens"))})
    return rows.withColumn("q_subject", F.get("q_entities", F.lit(0)))


_DEFAULT = SignalRegistry()
#: Least weight of a signal that is worth computing, and signals that some types of memories do without.
LEAST_WEIGHT = 0.001
#: Up to so many questions are sent to all tasks; more are exchanged, with the words of each candidate.
BROADCAST_QUERIES = 150_000
WITHOUT = {"tfidf": ("episodic",), "graph": ("semantic", "general")}


def weight(signal: str, kind: str, registry: SignalRegistry = _DEFAULT) -> float:
    return registry.weight(signal, kind)


def weight_by(signal: str, kind: Column, registry: SignalRegistry = _DEFAULT) -> Column:
    """The weight of a signal for the type of each row; a type without one has the default."""
    out = F.lit(registry.weight(signal, ""))
    for name in vocab.MEMORY_TYPES:
        out = F.when(kind == name, registry.weight(signal, name)).otherwise(out)
    return out


def candidate_rows(candidates: DataFrame) -> DataFrame:
    """One row for each (query, memory): the least distance and the best lexical score of its deliveries."""
    return candidates.groupBy("query_id", F.col("memory_id").alias("id")).agg(
        F.min("distance").alias("distance"), F.max(F.coalesce("bm25_score", F.lit(0.0))).alias("bm25"), F.max(F.coalesce("graph_hit", F.lit(False))).alias("graph_hit")
    )


def signals(candidates: DataFrame, memories: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Candidates of live memories with one column for each signal."""
    # words, size and metadata of a memory are worked out once, not for each of its candidate rows
    mem = store.decode(store.live(spread(memories))).select("id", T.words(F.col("text")).alias("m_tokens"), T.token_estimate(F.col("text")).alias("cost"), "memory_type", metadata_parts(F.col("metadata")).alias("m_parts"), F.col("entities").alias("m_entities"), F.col("importance").alias("importance_score"), F.col("subject").alias("m_subject"), F.col("attribute").alias("m_attribute"), "created_at")
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    joined = candidates.join(mem, "id").join(F.broadcast(queries) if few else queries, "query_id")
    equal = lambda a, b: F.when(a == b, 1.0).otherwise(0.0)
    return joined.withColumns(
        {
            "semantic": S.semantic(F.col("distance")),
            "token": S.token_overlap(F.col("q_tokens"), F.col("m_tokens"), F.col("memory_type")),
            "entity": S.entity_overlap(F.col("q_entities"), F.col("m_entities")),
            "subject": equal(F.lower("q_subject"), F.lower("m_subject")),
            "attribute": equal(F.col("q_attribute"), F.col("m_attribute")),
            "recency": S.recency(F.col("created_at"), F.col("memory_type"), settings.now),
            "importance": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("importance_score"))),
        }
    )


def wants(signal: str, registry: SignalRegistry) -> bool:
    """Whether a signal has a weight for any type of question."""
    return any(registry.weight(signal, k) > LEAST_WEIGHT for k in ("", *vocab.MEMORY_TYPES))


def graph_signal(candidates: DataFrame, queries: DataFrame, memories: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, id, graph): 1 / hops between the nearest entities of question and memory; pairs out of reach give no row."""
    asked = queries.select("query_id", F.explode("q_entities").alias("e")).select("query_id", F.lower("e").alias("seed")).distinct()
    held = memories.select("id", F.explode("entities").alias("e")).select("id", F.lower(F.trim("e")).alias("node")).distinct()
    near = graph.hops(graph.adjacency(edges.where("source IS NOT NULL AND target IS NOT NULL")), asked.select("seed").distinct(), depth)
    pairs = candidates.select("query_id", "id").distinct().join(held, "id").join(asked, "query_id").join(near, ["seed", "node"])
    return pairs.groupBy("query_id", "id").agg((1.0 / (F.min("hops") + 1e-6)).alias("graph"))


def base_score(rows: DataFrame, kind: str | Column = "general", extra: tuple[str, ...] = (), registry: SignalRegistry = _DEFAULT) -> DataFrame:
    """The weighted sum of the signals that the plan has, by the weights of the registry.

    A signal without a column or with hardly any weight is left out of the plan; some count for certain types of memories only.
    """
    total = F.lit(0.0)
    for s in ("semantic", "token", "entity", "subject", "attribute", "recency", "importance", *extra):
        if isinstance(kind, str):
            if registry.weight(s, kind) <= LEAST_WEIGHT:
                continue
            factor = F.lit(registry.weight(s, kind))
        else:
            if not wants(s, registry):
                continue
            factor = weight_by(s, kind, registry)
            factor = F.when(factor > LEAST_WEIGHT, factor).otherwise(0.0)
        value = F.coalesce(F.col(s), F.lit(0.0))
        if s in WITHOUT:
            value = F.when(F.col("memory_type").isin(*WITHOUT[s]), 0.0).otherwise(value)
        total = total + value * factor
    return rows.withColumn("base", F.round(total, 6))


def zscore(rows: DataFrame, value: str = "base", out: str = "normalized") -> DataFrame:
    """Values against mean and deviation of their query; the statistics are aggregated before they are joined back."""
    stats = rows.groupBy("query_id").agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    std = F.when(F.col("_std") < 1e-6, 1e-6).otherwise(F.col("_std"))
    return rows.join(stats, "query_id").withColumn(out, F.round((F.col(value) - F.col("_mean")) / std, 6)).drop("_mean", "_std")


def attributes_asked(query_tokens: Column) -> Column:
    """The attributes that a question's words point to, as structs of name and boost."""
    entries = ", ".join(f"named_struct('name', '{n}', 'boost', {b}D, 'words', split('{a}', ' '))" for n, b, a in vocab.ATTRIBUTES)
    return F.filter(F.expr(f"array({entries})"), lambda x: F.arrays_overlap(x["words"], query_tokens))


def attribute_fields(queries: DataFrame) -> DataFrame:
    """(query_id, attribute, boost) that a question points to: by its whole words, else by parts of words; queries are understood."""
    entries = ", ".join(f"named_struct('name', '{n}', 'boost', {b}D, 'words', split('{a}', ' '))" for n, b, a in vocab.ATTRIBUTES)
    low = F.lower("q")
    parts = F.filter(F.expr(f"array({entries})"), lambda x: F.exists(x["words"], lambda w: F.contains(low, w)))
    whole = attributes_asked(F.col("q_tokens"))
    found = queries.select("query_id", F.explode(F.when(F.size(whole) > 0, whole).otherwise(parts)).alias("x"))
    return found.select("query_id", F.col("x.name").alias("attribute"), F.col("x.boost").alias("boost"))


def metadata_parts(metadata: Column) -> Column:
    """The keys and values of the metadata in lower case."""
    meta = F.coalesce(metadata, F.create_map().cast(store.METADATA))
    return F.transform(F.concat(F.map_keys(meta), F.map_values(meta)), lambda x: F.lower(F.coalesce(x, F.lit(""))))


def attribute_boost(asked: Column, memory_type: Column, parts: Column) -> Column:
    """The boosts of the attributes asked for that the memory's type or a part of its metadata shows."""

    def add(total: Column, x: Column) -> Column:
        shown = F.exists(parts, lambda part: F.contains(part, x["name"]))
        return total + F.when(memory_type == x["name"], x["boost"]).otherwise(0.0) + F.when(shown, x["boost"] * 0.5).otherwise(0.0)

    return F.when(F.size(asked) > 0, F.aggregate(asked, F.lit(0.0), add)).otherwise(0.0)


def finalize(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    final = S.final_score(F.col("normalized"), F.col("importance"), F.col("recency"), F.col("boost"), F.col("bm25"), settings.final_weights)
    return rows.withColumn("final", F.round(final, 6))


def budget(costs: Column, limit: int, most: int) -> Column:
    """For each cost in order whether it is kept: skipped ones use nothing, and later ones may still fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<boolean>").alias("kept"))

    def step(acc, cost):
        fits = (acc["n"] < most) & (acc["used"] + cost <= limit)
        keep = fits | (cost == 0)
        return F.struct(
            (acc["used"] + F.when(keep, cost).otherwise(F.lit(0))).cast("long").alias("used"),
            (acc["n"] + keep.cast("int")).alias("n"),
            F.array_append(acc["kept"], keep).alias("kept"),
        )

    return F.aggregate(costs, start, step)["kept"]


def context(rows: DataFrame, settings: Settings = Settings(), by: str = "final") -> DataFrame:
    """The candidates that fit the token budget, walked in order of the final score.

    Only the ``candidate_cap`` best of a query are listed, so no list grows with the data.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "id")
    best = rows.where(F.col("base") >= settings.min_score).withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= settings.candidate_cap)
    listed = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_at", "id", "cost"))).alias("_all"))
    kept = listed.withColumn("_keep", budget(F.transform("_all", lambda x: x["cost"]), settings.token_budget, settings.context_size))
    ids = kept.select("query_id", F.explode(F.filter(F.arrays_zip("_all", "_keep"), lambda x: x["_keep"])).alias("x")).select("query_id", F.col("x._all.id").alias("id"))
    return rows.join(ids, ["query_id", "id"])


def respond(rows: DataFrame, limit: int) -> DataFrame:
    """Rows in the order of the normalised score, ties by final score and id, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("normalized"), F.desc("final"), "id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def recall(
    questions: DataFrame, candidates: DataFrame, memories: DataFrame, settings: Settings = Settings(),
    kinds: DataFrame | None = None, tfidf: DataFrame | None = None, feedback: DataFrame | None = None, plugins=None,
    graph_near: DataFrame | None = None, registry: SignalRegistry = _DEFAULT,
) -> DataFrame:
    """(query_id, id, base, normalized, final, rank): the ranking of the given candidates of all questions in one plan.

    Optional: kinds (query_id, kind) resolves the weights by type, ``general`` for questions that are not in it;
    tfidf (query_id, id, tfidf), feedback (id, feedback) and graph_near (query_id, id, graph) are further signals; registry has the
    weights; plugins is a registry of additions, with signals and entity recognisers.
    """
    queries = understand(questions)
    if plugins is not None and (plugins.recognizers or plugins.extractor):
        memories = memories.withColumn("entities", plugins.entities(F.col("text"), F.coalesce("entities", F.array().cast("array<string>"))))
        queries = queries.withColumn("q_entities", plugins.entities(F.col("q"), F.col("q_entities")))
    rows = signals(candidate_rows(candidates), memories, queries, settings)
    # before the joins, so that they need not carry the lists it is made of
    rows = rows.withColumn("boost", attribute_boost(F.col("q_asked"), F.col("memory_type"), F.col("m_parts")))
    if kinds is not None:
        rows = rows.join(kinds.select("query_id", "kind"), "query_id", "left")
    if tfidf is not None:
        rows = rows.join(tfidf, ["query_id", "id"], "left")
    if feedback is not None:
        rows = rows.join(feedback, "id", "left")
    if graph_near is not None:
        rows = rows.join(graph_near, ["query_id", "id"], "left")
    extra = tuple(name for name, given in (("tfidf", tfidf), ("feedback", feedback), ("graph", graph_near)) if given is not None)
    rows = base_score(rows, "general" if kinds is None else F.coalesce("kind", F.lit("general")), extra, registry)
    if plugins is not None:
        rows = plugins.add_signals(rows)
    # statistics, context and answer all start from these narrow rows: compute the signals once
    rows = cut_lineage(rows.select("query_id", "id", "base", "importance", "recency", "boost", "bm25", "cost"))
    rows = finalize(zscore(rows), settings)
    return respond(context(rows, settings), settings.response_limit).select("query_id", "id", "base", "normalized", "final", "rank")


def first(rows: DataFrame, n: int, by: str = "normalized") -> DataFrame:
    """The n best rows of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "id")
    return rows.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n).drop("_at")


def without_mmr(rows: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, id, mmr, rank) when diversity is off: the order of the normalised score."""
    w = Window.partitionBy("query_id").orderBy(F.desc("normalized"), "id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "id", F.col("normalized").alias("mmr"), "rank")


def mmr(rows: DataFrame, vectors: DataFrame, k: int = 20, pool: int = 50, legacy: bool = False) -> DataFrame:
    """(query_id, id, mmr, rank): greedy re-ranking for diversity of the ``pool`` best of each query; vectors: (id, embedding).

    Each choice depends on those before it, so it is a grouped function; its groups are bounded by the pool, and
    vectors are joined to those rows only. legacy: scores scaled to 0 to 1, a penalty of 0.7 times the greatest plus 0.3 times
    the mean similarity, and a weight of relevance of 0.85, 0.65 or 0.50 for up to 10, up to 30 and more candidates.
    """
    top = first(rows.select("query_id", "id", "normalized"), pool).join(vectors.select("id", "embedding"), "id", "left").withColumn("lam", S.mmr_lambda(F.count("*").over(Window.partitionBy("query_id"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["normalized", "id"], ascending=[False, True])
        n = len(pdf)
        dim = max((len(e) for e in pdf["embedding"] if e is not None), default=1)
        x = np.array([np.asarray(e, np.float64) if e is not None and len(e) == dim else np.zeros(dim) for e in pdf["embedding"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
        sim, rel = x @ x.T, pdf["normalized"].to_numpy()
        lam = float(pdf["lam"].iloc[0])
        if legacy:
            lam = 0.85 if n <= 10 else 0.65 if n <= 30 else 0.50
            rel = (rel - rel.min()) / max(1e-9, float(rel.max() - rel.min()))
        chosen, score = [0], [lam * rel[0]]
        left = list(range(1, n))
        while left and len(chosen) < k:
            alike = sim[np.ix_(left, chosen)]
            penalty = 0.7 * alike.max(1) + 0.3 * alike.mean(1) if legacy else alike.max(1)
            values = lam * rel[left] - (1 - lam) * penalty
            at = int(np.argmax(values))
            score.append(float(values[at]))
            chosen.append(left.pop(at))
        ids = pdf["id"].to_numpy()[chosen]
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "id": ids, "mmr": np.round(score, 6), "rank": np.arange(1, len(ids) + 1)})

    return top.groupBy("query_id").applyInPandas(run, "query_id long, id long, mmr double, rank long")


def diagnostics(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, n, moved, total_moves, mean_move): how far re-ranking moved the results of each query. Both: (query_id, id, rank)."""
    joined = before.select("query_id", "id", F.col("rank").alias("was")).join(after.select("query_id", "id", "rank"), ["query_id", "id"])
    far = F.abs(F.col("rank") - F.col("was"))
    return joined.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(far > 0).alias("moved"), F.sum(far).cast("long").alias("total_moves"), F.round(F.avg(far), 6).alias("mean_move"))
