"""Cutting oversized texts into overlapping pieces at natural boundaries.

A word is a maximal run of characters other than space, tab, line feed and
carriage return. A natural boundary lies between two words whose separating
whitespace holds a line break, or follows ``.``, ``!`` or ``?``. A text of more
than ``max_words`` words is cut so that no piece has more than ``max_words``
words and every piece after the first begins with the last ``overlap`` words of
the piece before.

Method: dynamic programming over the boundary positions. The cost of a cut is
its penalty (a paragraph break costs least, then a line break, a sentence end,
and a cut inside a sentence by far the most), to which comes the squared
imbalance of the piece against the even size. Cuts inside a sentence are states
only where some stretch between neighbouring boundaries is longer than a piece
can carry forward; natural cuts are always preferred to them.

Only long texts leave the JVM; they are spread evenly beforehand. Defined cases:
null texts and texts within the limit give no rows in ``split_texts`` (they are
one piece as they are); repeated rows are cut separately.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import spread

MAX_WORDS = 128
OVERLAP = 16
#: Penalties of a cut: paragraph break, line break, sentence end, inside a sentence.
PENALTIES = (0.0, 0.05, 0.2, 1000.0)

_WORD = re.compile(r"[^ \t\n\r]+")


def boundaries(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans of the words, and for each word but the last the kind of cut after it (an index of PENALTIES)."""
    spans = [m.span() for m in _WORD.finditer(text)]
    kinds = np.full(max(0, len(spans) - 1), 3, np.int8)
    for i in range(len(spans) - 1):
        end, begin = spans[i][1], spans[i + 1][0]
        gap = text[end:begin]
        breaks = gap.replace("\r\n", "\n").replace("\r", "\n").count("\n")
        kinds[i] = 0 if breaks > 1 else 1 if breaks else 2 if text[end - 1] in ".!?" else 3
    return spans, kinds


def is_forced(kinds: np.ndarray, max_words: int = MAX_WORDS) -> bool:
    """Whether some stretch without a natural boundary has more than max_words words."""
    at = np.concatenate([[-1], np.flatnonzero(kinds < 3), [len(kinds)]])
    return bool(np.diff(at).max(initial=0) > max_words)


def plan(kinds: np.ndarray, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> list[int]:
    """Numbers of words before each cut, in order, without 0 and the total."""
    n = len(kinds) + 1
    if n <= max_words:
        return []
    fresh = max_words - overlap
    natural = np.flatnonzero(kinds < 3) + 1
    marks = np.concatenate([[0], natural, [n]])
    wide = np.flatnonzero(np.diff(marks) > fresh)
    inside = [np.arange(marks[i] + 1, marks[i + 1]) for i in wide]
    states = np.unique(np.concatenate([marks, *inside])).astype(np.int64)
    pieces = 1 + -(-(n - max_words) // fresh)
    even = (n + overlap * (pieces - 1)) / pieces
    penalty = np.zeros(len(states))
    penalty[1:-1] = np.array(PENALTIES)[kinds[states[1:-1] - 1]]
    best = np.full(len(states), np.inf)
    best[0] = 0.0
    back = np.zeros(len(states), np.int64)
    for j in range(1, len(states)):
        i = np.searchsorted(states, states[j] - max_words)
        # a piece after the first also carries the overlap, and must add at least one word
        new = states[j] - states[i:j]
        size = new + np.where(states[i:j] > 0, np.minimum(overlap, states[i:j]), 0)
        cost = np.where(size <= max_words, best[i:j] + ((size - even) / max_words) ** 2, np.inf)
        k = int(np.argmin(cost))
        # the first piece holds the whole overlap of the second
        if np.isfinite(cost[k]) and (states[j] >= overlap or j == len(states) - 1):
            best[j], back[j] = cost[k] + penalty[j], i + k
    cuts, j = [], len(states) - 1
    while back[j] > 0:
        j = back[j]
        cuts.append(int(states[j]))
    return cuts[::-1]


def split(text: str, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, str]], bool]:
    """Pieces as (first word, number of words, text), and whether a stretch forced a cut inside it."""
    spans, kinds = boundaries(text)
    n = len(spans)
    if not n:
        return [], False
    cuts = [0, *plan(kinds, max_words, overlap), n]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        first = max(0, a - overlap) if a else 0
        out.append((first, b - first, text[spans[first][0] : spans[b - 1][1]]))
    return out, is_forced(kinds, max_words)


def long_texts(df: DataFrame, id_col: str, text_col: str, max_words: int) -> DataFrame:
    """The rows whose text has more than max_words words; counted in the JVM on the whole text."""
    text = F.col(text_col).cast("string")
    # a text of n words holds at least n - 1 separating characters: cheap first, exact after it
    separators = F.length(text) - F.length(F.translate(text, " \t\n\r", ""))
    words = F.size(F.filter(F.split(text, "[ \t\n\r]+"), lambda w: w != ""))
    return spread(df.select(id_col, text_col)).where(separators >= max_words).where(words > max_words).select(F.col(id_col).cast("long").alias("id"), text.alias("text"))


def split_texts(df: DataFrame, id_col: str = "id", text_col: str = "text", max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece_no, first_word, n_words, piece, forced) of every text of more than max_words words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"]):
                pieces, forced = split(text, max_words, overlap)
                rows += [(i, k, first, size, piece, int(forced)) for k, (first, size, piece) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["id", "piece_no", "first_word", "n_words", "piece", "forced"])

    schema = "id long, piece_no long, first_word long, n_words long, piece string, forced long"
    return long_texts(df, id_col, text_col, max_words).mapInPandas(run, schema)
