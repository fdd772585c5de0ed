"""Registry of additions: signals, rerankers, retrievers, entity recognisers, observers.

A registry is passed explicitly. ``discover`` adds what a folder of Python files or the installed packages offer, if asked to:
each offers a function ``register(registry)``.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import metadata
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Registry:
    """Named additions, applied in the order of their registration."""

    signals: dict[str, tuple[Callable[[], Column], float]] = field(default_factory=dict)
    rerankers: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame], str]] = field(default_factory=dict)
    retrievers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    recognizers: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    observers: dict[str, list[Callable[..., None]]] = field(default_factory=dict)
    #: From a text column to the entities that a language model finds; null where it finds nothing usable, then the rules hold.
    extractor: Callable[[Column], Column] | None = None

    def signal(self, name: str, column: Callable[[], Column], weight: float = 0.0) -> None:
        """A score over the columns of candidates: a built-in expression, or a pandas UDF for what has none. Weight 0 only shows it."""
        self.signals[name] = (column, weight)

    def reranker(self, name: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> None:
        """A function over the bounded rows of one query."""
        self.rerankers[name] = (function, schema)

    def retriever(self, name: str, function: Callable[[DataFrame], DataFrame]) -> None:
        """A function from understood queries to (query_id, id, distance)."""
        self.retrievers[name] = function

    def recognizer(self, name: str, function: Callable[[Column], Column]) -> None:
        """A function from a text column to an array of further entities."""
        self.recognizers[name] = function

    def observe(self, event: str, callback: Callable[..., None]) -> None:
        """Called when a plan is built: before_ and after_ recall, store, feedback, evaluate."""
        self.observers.setdefault(event, []).append(callback)

    def discover(self, folder: str | None = None, group: str | None = None) -> list[str]:
        """Let the files of a folder, or the entry points of a group, register their additions; returns their names."""
        found = []
        for path in sorted(Path(folder).glob("*.py")) if folder else []:
            spec = importlib.util.spec_from_file_location(f"lodestone_plugin_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            module.register(self)
            found.append(path.stem)
        for point in metadata.entry_points(group=group) if group else []:
            point.load()(self)
            found.append(point.name)
        return found

    def unregister(self, name: str) -> None:
        for kind in (self.signals, self.rerankers, self.retrievers, self.recognizers):
            kind.pop(name, None)

    def notify(self, event: str, *args) -> None:
        for f in self.observers.get(event, []):
            f(*args)

    def add_signals(self, rows: DataFrame) -> DataFrame:
        """Candidates with a column for each signal, and the base score raised by the weighted ones."""
        for name, (column, weight) in self.signals.items():
            rows = rows.withColumn(name, column())
            if weight:
                rows = rows.withColumn("base", F.round(F.col("base") + F.coalesce(F.col(name), F.lit(0.0)) * weight, 6))
        return rows

    def rerank(self, rows: DataFrame) -> DataFrame:
        for function, schema in self.rerankers.values():
            rows = rows.groupBy("query_id").applyInPandas(function, schema)
        return rows

    def entities(self, text: Column, found: Column) -> Column:
        if self.extractor is not None:
            found = F.coalesce(self.extractor(text), found)
        for f in self.recognizers.values():
            found = F.array_union(found, F.coalesce(f(text), F.array().cast("array<string>")))
        return found
