"""Sources: JSON datasets, conversations, pages and source code; a generated world is in ``world``."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages of source files by their ending.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin",
}
IGNORED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target")


def texts_of_json(spark: SparkSession, path: str) -> DataFrame:
    """(text) of a JSON array or of JSON lines: strings, or the first non-empty of the usual fields of an object.

    Lists within the array are flattened; objects without a text field are written out as JSON.
    """
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("item"))
    inner = F.from_json("item", "array<string>")
    flat = raw.select(F.explode(F.when(F.startswith("item", F.lit("[")), inner).otherwise(F.array("item"))).alias("item"))
    fields = [F.nullif(F.get_json_object("item", f"$.{f}"), F.lit("")) for f in ("text", "normalized_text", "memory", "content", "body")]
    is_object = F.startswith("item", F.lit("{"))
    return flat.select(F.when(is_object, F.coalesce(*fields, F.col("item"))).otherwise(F.col("item")).alias("text")).where("text <> ''")


def sessions(items: DataFrame) -> DataFrame:
    """(question_id, session_id, session, turn, text) of items with haystack_sessions: arrays of turns with a content.

    A session without an id gets one from its place.
    """
    each = items.select("question_id", "haystack_session_ids", F.posexplode("haystack_sessions").alias("session", "turns"))
    sid = F.coalesce(F.get("haystack_session_ids", F.col("session")), F.concat_ws("_", F.lit("session"), F.col("session").cast("string")))
    turns = each.select("question_id", sid.alias("session_id"), "session", F.posexplode("turns").alias("turn", "t"))
    return turns.select("question_id", "session_id", "session", "turn", F.col("t.content").alias("text")).where("text IS NOT NULL AND text <> ''")


def sentence_chunks(text: Column, size: int = 1000, least: int = 50) -> Column:
    """Sentences packed in order until a chunk reaches the size; chunks below the least length are dropped."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        joined = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        full = F.length(joined) >= size
        return F.struct(F.when(full, F.array_append(acc["done"], joined)).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(joined).alias("open"))

    chunks = F.aggregate(sentences, empty, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
    return F.filter(chunks, lambda c: F.length(c) >= least)


def pages(spark: SparkSession, path: str, page_limit: int = 100, least: int = 50) -> DataFrame:
    """(source_file, page, total_pages, text) of PDF files; needs the optional library pypdf on the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs pypdf") from e
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                found = PdfReader(io.BytesIO(content)).pages
                texts = ((i + 1, (p.extract_text() or "").strip()) for i, p in enumerate(found[:page_limit]))
                rows += [(name, i, len(found), t) for i, t in texts if len(t) >= least]
            yield pd.DataFrame(rows, columns=["source_file", "page", "total_pages", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "source_file string, page int, total_pages int, text string")


def code_files(spark: SparkSession, path: str, max_bytes: int = 5 << 20, max_files: int | None = None) -> DataFrame:
    """(path, language, text) of the source files of a folder, at most the first ``max_files`` by path; ignored folders, large and binary files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    language = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])[F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))]
    hidden = F.rlike("path", F.lit("/(" + "|".join(re.escape(i) for i in IGNORED) + ")/"))
    rows = files.where((F.col("length") <= max_bytes) & ~hidden).withColumn("language", language).where("language IS NOT NULL")
    if max_files is not None:
        rows = rows.join(rows.select("path").orderBy("path").limit(max_files), "path", "left_semi")
    rows = rows.where(F.instr(F.hex(F.substring("content", 1, 1024)), "00") % 2 == 0)
    return rows.select("path", "language", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text IS NOT NULL")


_SYMBOL = re.compile(r"^\s*(?:export\s+|public\s+|private\s+|static\s+|async\s+)*(function|func|fn|class|struct|interface|import|use|package)\s+([\w./:{}* ,\"']+)", re.M)


def symbols_of(text: str, language: str) -> list[tuple[str, str, int, str]]:
    """(kind, name, line, source line): functions, classes and imports of a file."""
    lines = text.split("\n")
    at = lambda n: lines[n - 1].strip() if 0 < n <= len(lines) else ""
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []
        out = []
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(("function", node.name, node.lineno, at(node.lineno)))
            elif isinstance(node, ast.ClassDef):
                out.append(("class", node.name, node.lineno, at(node.lineno)))
            elif isinstance(node, ast.Import):
                out += [("import", a.name, node.lineno, at(node.lineno)) for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                out += [("import", f"{node.module or ''}.{a.name}", node.lineno, at(node.lineno)) for a in node.names]
        return sorted(out, key=lambda x: x[2])
    kinds = {"func": "function", "fn": "function", "struct": "class", "interface": "class", "use": "import", "package": "import"}
    return [(kinds.get(m[1], m[1]), m[2].strip(" {\"'"), text.count("\n", 0, m.start(1)) + 1, at(text.count("\n", 0, m.start(1)) + 1)) for m in _SYMBOL.finditer(text)]


def symbols(files: DataFrame) -> DataFrame:
    """(path, language, kind, name, line, source) of the functions, classes and imports of code files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, lang, *s) for p, lang, t in zip(pdf["path"], pdf["language"], pdf["text"]) for s in symbols_of(t or "", lang)]
            yield pd.DataFrame(rows, columns=["path", "language", "kind", "name", "line", "source"])

    return files.select("path", "language", "text").mapInPandas(run, "path string, language string, kind string, name string, line long, source string")


def display(kind: Column, name: Column, source: Column, path: Column, most: int = 2000) -> Column:
    """The text under which a symbol is stored."""
    return F.substring(F.concat(kind, F.lit(" "), name, F.lit(" in "), path, F.lit(": "), source), 1, most)


def language_of(text: Column) -> Column:
    """The language of a piece of code by its first telling line; null for what is no code."""
    told = lambda pattern: F.rlike(text, F.lit(pattern))
    return (
        F.when(told(r"(?m)^(def \w+\(.*\):|class \w+.*:|from \w+ import |import \w+$)"), "python")
        .when(told(r"(?m)^\s*(function \w+\(|const \w+ = |export (default|function|class) )"), "javascript")
        .when(told(r"(?m)^(func \w+\(|package \w+$)"), "go")
        .when(told(r"(?m)^\s*(pub )?(fn \w+|struct \w+|use \w+::)"), "rust")
        .when(told(r"(?m)^\s*(public|private) (static |final )*(class|interface|void|int) "), "java")
    )
