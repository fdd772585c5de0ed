"""The registry of ranking signals: weights by type of query, switched on and off, checked, saved and loaded."""

from __future__ import annotations

import copy
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import vocab


class SignalRegistry:
    """Weights of the signals; a signal that is off counts as having the weight 0."""

    def __init__(self, signals: dict | None = None):
        self.weights: dict[str, dict[str, float]] = copy.deepcopy(vocab.SIGNALS if signals is None else signals)
        self.off: set[str] = set()
        self.off_for: set[tuple[str, str]] = set()

    def register(self, name: str, default: float, **by_type: float) -> None:
        self.weights[name] = {"default": default, **by_type}

    def unregister(self, name: str) -> None:
        self.weights.pop(name, None)

    def enable(self, name: str, kind: str | None = None) -> None:
        self.off_for.discard((name, kind)) if kind else self.off.discard(name)

    def disable(self, name: str, kind: str | None = None) -> None:
        self.off_for.add((name, kind)) if kind else self.off.add(name)

    def set_weight(self, name: str, weight: float, kind: str | None = None) -> None:
        self.weights[name][kind or "default"] = weight

    def weight(self, name: str, kind: str = "general") -> float:
        if name in self.off or (name, kind) in self.off_for:
            return 0.0
        of = self.weights.get(name)
        return of.get(kind, of["default"]) if of else 0.0

    def active(self, kind: str = "general", least: float = 0.001) -> dict[str, float]:
        """The signals worth computing for a type of query."""
        return {n: w for n in self.weights if (w := self.weight(n, kind)) > least}

    def normalized(self, kind: str = "general") -> dict[str, float]:
        """The active weights, summing to 1."""
        own = self.active(kind)
        total = sum(own.values()) or 1.0
        return {n: w / total for n, w in own.items()}

    def problems(self) -> list[str]:
        """What is wrong with the weights; empty if nothing."""
        out = []
        for name, of in self.weights.items():
            if "default" not in of:
                out.append(f"{name} has no default weight")
            out += [f"{name} has the weight {w} for {kind}" for kind, w in of.items() if not 0 <= w <= 1]
            out += [f"{name} has a weight for the unknown type {kind}" for kind in of if kind != "default" and kind not in vocab.MEMORY_TYPES]
        return out

    def save(self, path: str) -> None:
        state = {"weights": self.weights, "off": sorted(self.off), "off_for": sorted(map(list, self.off_for))}
        Path(path).write_text(json.dumps(state, indent=1))

    @classmethod
    def load(cls, path: str) -> SignalRegistry:
        state = json.loads(Path(path).read_text())
        out = cls(state["weights"])
        out.off, out.off_for = set(state["off"]), {tuple(x) for x in state["off_for"]}
        return out

    @classmethod
    def from_table(cls, weights: DataFrame) -> SignalRegistry:
        """A registry with the weights (signal, weight) of a table, such as those after an adaptation, in place of the defaults; at most one row a signal."""
        out = cls()
        for r in weights.where(F.col("signal").isin(*out.weights)).select("signal", "weight").limit(len(out.weights)).collect():
            out.weights[r.signal] = {"default": r.weight}
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(signal, kind, weight) of all signals and types."""
        rows = [(n, k, self.weight(n, k)) for n in sorted(self.weights) for k in vocab.MEMORY_TYPES]
        return spark.createDataFrame(rows, "signal string, kind string, weight double")
