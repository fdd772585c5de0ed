"""Command line: ``python -m lodestone.cli FOLDER COMMAND ...`` over a folder of Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from lodestone.api import Engine
from lodestone.operators import graph, learn, maintain, store
from lodestone.session import local_session, ship


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    top.add_argument("folder")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *args: str, **options) -> None:
        one = sub.add_parser(name, help=text)
        for a in args:
            one.add_argument(a)
        for o, kind in options.items():
            one.add_argument(f"--{o}", type=kind)

    command("recall", "answer one question", "question", limit=int)
    command("search", "best memories by words", "question", limit=int)
    command("chat", "the prompt of a question with its context", "question", system=str)
    command("remember", "store one text", "text")
    command("import", "store the texts of a JSON file", "path")
    command("ingest-code", "store the symbols of a folder of source files", "path", max=int)
    command("ingest-pdf", "store the pages of PDF files", "path")
    command("export", "write all live memories as JSON", "target")
    command("goals", "list goals", status=str)
    command("goal-add", "add a goal", "goal")
    command("goal-update", "change a goal", "id", progress=str, status=str)
    command("stats", "rows by type")
    command("prune", "list what pruning would delete")
    command("consolidate", "list the merges that consolidation would make")
    command("feedback", "list feedback by memory")
    command("click", "record a click", "memory", "query")
    command("history", "list past queries by number", limit=int)
    command("graph", "write the entity graph as JSON", "target")
    command("diagnose", "memories without vectors and vectors without memories")
    command("evaluate", "recall at k of the questions of the folder")
    command("query", "run a registered query", "name")
    return top


def run(args: argparse.Namespace, engine: Engine) -> None:
    spark = engine.spark
    asked = lambda: spark.createDataFrame([(1, args.question)], "question_id long, query_text string")
    do = {
        "recall": lambda: engine.respond(engine.recall(asked())).orderBy("rank").select("rank", "id", "final", "text").limit(args.limit or 10),
        "search": lambda: engine.search(asked(), args.limit or 10).join(engine.memories.select("id", "text"), "id").orderBy("rank"),
        "chat": lambda: engine.chat(asked(), args.system or ""),
        "remember": lambda: engine.remember(args.text).select("id", "memory_type", "text"),
        "import": lambda: engine.import_json(args.path).select("id", "memory_type", "text"),
        "ingest-code": lambda: engine.ingest_code(args.path, args.max).select("id", "memory_type", "text"),
        "ingest-pdf": lambda: engine.ingest_pdf(args.path).select("id", "memory_type", "text"),
        "goals": lambda: engine.list_goals(args.status),
        "goal-add": lambda: engine.add_goal(args.goal),
        "goal-update": lambda: engine.update_goal(int(args.id), args.progress, args.status),
        "stats": engine.stats,
        "prune": lambda: engine.prunable().select("id", "importance", "created_at", "text"),
        "consolidate": lambda: engine.consolidate(store.add_vectors(engine.candidates.withColumnRenamed("memory_id", "id"), 64).groupBy("id").agg(F.min("embedding").alias("embedding"))),
        "feedback": engine.feedback,
        "click": lambda: engine.record(
            spark.createDataFrame([(int(args.memory), args.query, "click", "cli")], "mem_id long, query_text string, user_action string, session_id string").withColumn("ts", F.lit(engine.settings.now).cast("timestamp_ntz"))
        ).where("session_id = 'cli'"),
        "history": lambda: learn.frequent_queries(engine.events, args.limit or 20),
        "diagnose": lambda: maintain.sync(store.live(engine.memories), engine.candidates.where(F.size("embedding") > 0).select(F.col("memory_id").alias("id"))),
        "evaluate": lambda: engine.evaluate(q := spark.read.parquet(f"{engine.folder}/questions.parquet"), engine.recall(q)),
    }
    if args.command == "export":
        store.live(engine.memories).write.mode("errorifexists").json(args.target)
    elif args.command == "graph":
        graph.export(graph.adjacency(engine.edges.where("source IS NOT NULL AND target IS NOT NULL"))).write.mode("errorifexists").json(args.target)
    elif args.command == "query":
        from lodestone import queries

        queries.queries()[args.name](spark, engine.folder).show(50, truncate=100)
    else:
        do[args.command]().show(50, truncate=100)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = local_session()
    ship(spark)
    run(args, Engine.open(spark, args.folder))


if __name__ == "__main__":
    main()
