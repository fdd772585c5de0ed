"""The engine as one object: remember, recall, goals, feedback and maintenance over tables of DataFrames.

Methods take and return DataFrames. Those named after a change return the changed table; ``save`` writes a table
into the engine's folder, ``append`` adds rows to one there, and both read it back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.vocab import Settings
from lodestone.operators import evaluate, learn, lexical, maintain, rank, retrieve, routing, store, vector
from lodestone.operators.signals import SignalRegistry
from lodestone.plugins import Registry
from lodestone.session import cut_lineage, table
from lodestone.sources import ingest, readers, sinks

#: Tables of an engine's folder by attribute.
TABLES = {"memories": "memories", "candidates": "candidates", "edges": "graph_edges", "events": "feedback_events", "goals": "goals", "entities": "entities", "vectors": "vectors"}


@dataclass
class Engine:
    """All tables of a memory; those that are None are done without. embed turns a text column into a column of vectors."""

    spark: SparkSession
    memories: DataFrame
    candidates: DataFrame | None = None
    edges: DataFrame | None = None
    events: DataFrame | None = None
    goals: DataFrame | None = None
    entities: DataFrame | None = None
    vectors: DataFrame | None = None
    index: lexical.Index | None = None
    folder: str | None = None
    embed: Callable[[Column], Column] | None = None
    settings: Settings = field(default_factory=Settings)
    plugins: Registry = field(default_factory=Registry)
    signals: SignalRegistry = field(default_factory=SignalRegistry)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, settings: Settings | None = None) -> Engine:
        """The engine over a folder with one Parquet table each."""
        t = lambda name: table(spark, folder, name)
        return cls(spark, t("memories"), t("candidates"), t("graph_edges"), t("feedback_events"), t("goals"), t("entities"), folder=folder, settings=settings or Settings())

    # writing

    def save(self, attribute: str, rows: DataFrame) -> DataFrame:
        """Replace a table in the folder by rows, which may come from it, and read it back."""
        sinks.save(cut_lineage(rows), f"{self.folder}/{TABLES[attribute]}.parquet")
        setattr(self, attribute, table(self.spark, self.folder, TABLES[attribute]))
        return getattr(self, attribute)

    def append(self, attribute: str, rows: DataFrame) -> DataFrame:
        """Add rows to a table in the folder; columns they lack are null."""
        now = getattr(self, attribute)
        have = set(rows.columns)
        shaped = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in now.schema.fields])
        sinks.add(cut_lineage(shaped), f"{self.folder}/{TABLES[attribute]}.parquet")
        setattr(self, attribute, table(self.spark, self.folder, TABLES[attribute]))
        return getattr(self, attribute)

    def clear(self) -> None:
        """Empty all tables of the folder."""
        for attribute in TABLES:
            if (rows := getattr(self, attribute)) is not None:
                self.save(attribute, rows.limit(0))

    def remember_many(self, texts: DataFrame, order: str) -> DataFrame:
        """The rows for new texts, in the order of a column; written if the engine has a folder."""
        self.plugins.notify("before_store", texts)
        rows = ingest.store_many(self.memories, texts, order, self.settings.now, self.plugins)
        if self.folder:
            rows = cut_lineage(rows)
            self.append("memories", rows)
        self.plugins.notify("after_store", rows)
        return rows

    def remember(self, text: str) -> DataFrame:
        return self.remember_many(self.spark.createDataFrame([(0, text)], "place int, text string"), "place").drop("place")

    def import_json(self, path: str) -> DataFrame:
        """Remember the texts of a JSON file."""
        return self.remember_many(readers.texts_of_json(self.spark, path).withColumn("place", F.monotonically_increasing_id()), "place").drop("place")

    def ingest_code(self, path: str, max_files: int | None = None) -> DataFrame:
        """Remember the functions, classes and imports of a folder of source files."""
        found = readers.symbols(readers.code_files(self.spark, path, max_files=max_files))
        texts = found.select(F.concat_ws("#", "path", F.format_string("%09d", "line"), "name").alias("place"), readers.display(F.col("kind"), F.col("name"), F.col("source"), F.col("path")).alias("text"))
        return self.remember_many(texts, "place").drop("place")

    def ingest_pdf(self, path: str) -> DataFrame:
        """Remember the chunks of the pages of PDF files."""
        pages = readers.pages(self.spark, path).select("source_file", "page", F.posexplode(readers.sentence_chunks(F.col("text"))).alias("n", "text"))
        return self.remember_many(pages.withColumn("place", F.concat_ws("#", "source_file", F.format_string("%06d#%06d", "page", "n"))).drop("source_file", "page", "n"), "place").drop("place")

    # recall

    def search(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): the best memories by their words; questions have (question_id, query_text)."""
        docs = self.index or store.live(self.memories).select("id", "text")
        return lexical.bm25_best(docs, retrieve.terms_of(questions), k or self.settings.source_k, self.settings.k1, self.settings.b)

    def nearest(self, queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
        return vector.knn(vectors, queries, k, metric)

    def embedded(self) -> DataFrame:
        """(id, embedding) of all live memories by the embedder: what a rebuilt index of vectors holds. Texts are cut to 512 characters."""
        if self.embed is None:
            raise ValueError("the engine has no embedder")
        return store.live(self.memories).select("id", self.embed(F.substring("text", 1, 512)).alias("embedding"))

    def _near(self, questions: DataFrame) -> DataFrame | None:
        """(query_id, id, distance) of the vector search: by the embedder if there is one, else as it was delivered."""
        if self.embed is not None and self.vectors is not None:
            asked = questions.select(F.col("question_id").alias("query_id"), self.embed(F.substring("query_text", 1, 512)).alias("embedding"))
            return vector.knn(self.vectors, asked, self.settings.source_k).select("query_id", "id", "distance")
        if self.candidates is None:
            return None
        return self.candidates.select("query_id", F.col("memory_id").alias("id"), "distance")

    def retrieve(self, questions: DataFrame, index: lexical.Index | None = None, route: bool = False) -> DataFrame:
        """(query_id, id, distance, source, rank): the capped union of all sources and of the registered retrievers."""
        asked = rank.understand(questions)
        found = retrieve.sources(asked, retrieve.terms_of(questions), self.memories, self.edges, self._near(questions), index or self.index, self.settings)
        for name, f in self.plugins.retrievers.items():
            found[name] = f(asked).select("query_id", "id", "distance")
        rows = retrieve.union(found)
        if route:
            rows = retrieve.routed(rows, routing.classify(asked)).unionByName(rows.where(~F.col("source").isin(*retrieve.SOURCES)))
        return retrieve.capped(rows, self.settings.candidate_cap)

    def recall(self, questions: DataFrame, candidates: DataFrame | None = None, classified: bool = True) -> DataFrame:
        """(query_id, id, base, normalized, final, rank) of all questions; their candidates are retrieved unless given.

        Retrieved candidates are ranked by all signals that have a weight, by the weights of the type of their question.
        """
        self.plugins.notify("before_recall", questions)
        if candidates is not None:
            rows = rank.recall(questions, candidates, self.memories, self.settings, plugins=self.plugins, registry=self.signals)
        else:
            # the texts are analysed once: for the search, for its scores and for tfidf
            terms = retrieve.terms_of(questions)
            index = (self.index or lexical.Index.build(store.live(self.memories).select("id", "text"))).narrow(terms)
            found = cut_lineage(self.retrieve(questions, index))
            wanted = found.select("query_id", "id")
            words = cut_lineage(lexical.scores_of(wanted, index, terms, self.settings.k1, self.settings.b))
            given = found.join(words, ["query_id", "id"], "left").select("query_id", F.col("id").alias("memory_id"), "distance", F.col("score").alias("bm25_score"), (F.col("source") == "graph").alias("graph_hit"))
            tfidf = words.select("query_id", "id", "tfidf")
            feedback = None if self.events is None else self.feedback().select(F.col("mem_id").alias("id"), F.col("boost").alias("feedback"))
            asked = rank.understand(questions)
            near = rank.graph_signal(wanted, asked, self.memories, self.edges) if self.edges is not None and rank.wants("graph", self.signals) else None
            rows = rank.recall(questions, given, self.memories, self.settings, routing.classify(asked) if classified else None, tfidf, feedback, self.plugins, near, self.signals)
        rows = self.plugins.rerank(rows)
        self.plugins.notify("after_recall", rows)
        return rows

    def respond(self, results: DataFrame) -> DataFrame:
        """Results with all that is shown of each memory."""
        mem = store.decode(self.memories)
        shown = mem.select("id", "text", "normalized_text", "memory_type", "importance", "created_at", "last_accessed", "token_count", "tokens", "metadata", "entities", "relationships", "subject", "attribute")
        joined = results.join(shown, "id").withColumn("score", F.col("base"))
        if self.candidates is not None:
            given = rank.candidate_rows(self.candidates).select("query_id", "id", "distance", "graph_hit")
            joined = joined.join(given, ["query_id", "id"], "left")
        return joined

    def chat(self, questions: DataFrame, system: str = "", limit: int = 5) -> DataFrame:
        """(query_id, prompt): the prompt of each question with its best memories as context."""
        best = self.recall(questions).where(F.col("rank") <= limit).join(self.memories.select("id", "text"), "id")
        told = best.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("context"))
        asked = questions.select(F.col("question_id").alias("query_id"), F.coalesce("query_text", F.lit("")).alias("q")).join(told, "query_id", "left")
        return asked.select("query_id", T.prompt(F.lit(system), F.coalesce("context", F.lit("")), F.col("q")).alias("prompt"))

    # learning

    def record(self, events: DataFrame) -> DataFrame:
        """Add feedback events (ts, mem_id, query_text, user_action, ...); ids continue those of the log."""
        self.plugins.notify("before_feedback", events)
        top = self.events.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("_top"))
        rows = store.number(events, "ts").crossJoin(F.broadcast(top)).withColumn("event_id", F.col("_top") + F.col("number")).withColumn("received_at", F.col("ts")).drop("_top", "number")
        out = self.append("events", rows)
        self.plugins.notify("after_feedback", rows)
        return out

    def clicks_of(self, questions: DataFrame, results: DataFrame, session: str = "auto") -> DataFrame:
        """Feedback events as if the first result of each question had been clicked; nothing records them unless asked to."""
        text = questions.select(F.col("question_id").alias("query_id"), "query_text")
        first = results.where("rank = 1").join(text, "query_id")
        return first.select(F.lit(self.settings.now).cast("timestamp_ntz").alias("ts"), F.col("id").alias("mem_id"), "query_text", F.lit("click").alias("user_action"), F.lit(session).alias("session_id"))

    def worth_storing(self, rows: DataFrame, session: str, most: int = 5, least: float = 0.7) -> DataFrame:
        """The rows (session, score) worth storing without being asked: a score from ``least`` on, the first ``most`` of each session."""
        w = Window.partitionBy(session).orderBy(F.desc("score"), "id")
        return rows.where(F.col("score") >= least).withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= most).drop("_at")

    def feedback(self) -> DataFrame:
        return learn.feedback(self.events, self.settings)

    def relevance(self) -> DataFrame:
        return learn.relevance(self.events, self.settings)

    # goals and entities

    def list_goals(self, status: str | None = None) -> DataFrame:
        own = self.goals.withColumn("status", F.lower(F.coalesce("status", F.lit("active"))))
        return own.where(F.col("status") == status) if status else own

    def get_goal(self, goal_id: int) -> DataFrame:
        return self.list_goals().where(F.col("id") == goal_id)

    def add_goal(self, goal: str, progress: str = "") -> DataFrame:
        top = self.goals.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
        return self.append("goals", self.spark.createDataFrame([(top, goal, progress, "active")], "id long, goal string, progress string, status string"))

    def update_goal(self, goal_id: int, progress: str | None = None, status: str | None = None) -> DataFrame:
        change = self.spark.createDataFrame([(goal_id, progress, status)], "id long, progress string, status string")
        return self.save("goals", store.merge(self.goals, change, ["progress", "status"]).select(*self.goals.columns))

    def add_entity(self, name: str, entity_type: str = "unknown", aliases: list[str] | None = None) -> DataFrame:
        """A new entity, unless one has the name already."""
        key = F.lower(F.trim(F.lit(name)))
        if self.entities.where(F.lower(F.trim("name")) == key).isEmpty():
            top = self.entities.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
            self.append("entities", self.spark.createDataFrame([(top, name, entity_type, aliases or [])], "id long, name string, entity_type string, aliases array<string>"))
        return self.entities

    def set_entity_type(self, entity_id: int, entity_type: str) -> DataFrame:
        return self.save("entities", store.set_type(self.entities, entity_id, entity_type))

    # maintenance

    def prunable(self) -> DataFrame:
        return store.prunable(self.memories, self.settings.now, self.settings.prune_importance, self.settings.prune_days)

    def prune(self) -> DataFrame:
        """The table with prunable memories flagged as deleted."""
        return store.soft_delete(self.memories, self.prunable())

    def consolidate(self, vectors: DataFrame, dry_run: bool = True) -> DataFrame:
        """A report of the merges of similar memories, or the table with them made and the merged rows flagged as deleted."""
        labels = maintain.clusters(vectors, self.settings)
        return maintain.merge_clusters(self.memories, labels) if dry_run else maintain.apply_merges(self.memories, labels)

    # evaluation

    def evaluate(self, questions: DataFrame, results: DataFrame, by: list[str] | None = None) -> DataFrame:
        """Recall at 1, 3, 5 and 10 of results for questions with expected answers; by family if asked."""
        self.plugins.notify("before_evaluate", questions, results)
        shown = results.join(self.memories.select("id", "text", "metadata"), "id")
        out = evaluate.recall_at(evaluate.expected_rank(shown, questions), by=by)
        self.plugins.notify("after_evaluate", out)
        return out

    def adapt(self) -> SignalRegistry:
        """Weights after one step against the signals of the failures among the given candidates; the next recall uses them."""
        from lodestone.operators.learn import adapt

        questions = table(self.spark, self.folder, "questions")
        rows = rank.base_score(rank.signals(rank.candidate_rows(self.candidates), self.memories, rank.understand(questions), self.settings))
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("base"), "id")))
        names = ["semantic", "token", "entity", "recency", "importance"]
        deltas = evaluate.signal_deltas(ranked.select("query_id", "id", "rank", *names), questions, names)
        self.signals = SignalRegistry.from_table(adapt(deltas.select("signal", "delta")))
        return self.signals

    def throughput(self, texts: DataFrame, order: str) -> float:
        """Texts a second that ingestion works off, without storing them."""
        import time

        began = time.time()
        ingest.store_many(self.memories, texts, order, self.settings.now, self.plugins).write.format("noop").mode("overwrite").save()
        return texts.count() / (time.time() - began)

    def stats(self) -> DataFrame:
        return store.decode(self.memories).groupBy("memory_type").agg(F.count("*").alias("rows"), F.count_if(F.col("tombstone") == 0).alias("live"))
