"""Texts that were cut off by a field limit or in mid-transfer.

Method: a logistic regression over hashed features, trained on the corpus itself.
Intact texts are the negatives; the same texts, cut at random places, are the
positives. Features describe the closing characters, the closing word, the last
line against the line before it, open brackets and tags over the whole text, and
the length against its source's limit. Every text is then scored.

What is learnt from all texts: the limit of each source (a length among
its largest, in characters or bytes, that suspiciously many of its texts have), and how
often each text's closing word occurs inside texts anywhere; a word cut in two
occurs hardly ever. Only the weights are fitted on a bounded sample: the texts of
about ``TRAIN_TEXTS`` ids drawn by hash, and ``CUTS`` cuts of each. As some of the
supposedly intact ones were cut as well, those at their source's limit are left
out, and those that look cut after a fit are left out of the next, twice.

The texts are read twice: once for their features, lengths, hashes and artificial cuts, once
to count words. Everything else works on those narrow rows; nothing is collected but the
bounded sample.

Defined cases: null, empty and blank texts are complete; equal texts of one source
get equal scores, so a repost of a cut text is cut; a null source is a source of
its own; with fewer than 20 training texts everything counts as complete.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import utf8, windows8
from lodestone.operators.skew import join_groups
from lodestone.session import cut_lineage, spread

#: Texts that the weights are fitted on, about, and cuts of each.
TRAIN_TEXTS = 12_000
CUTS = 3
#: Size of the hashed feature space; the last CLOSING are for the frequency of the closing word.
DIM = 1 << 17
CLOSING = 256
#: A source has a limit if one of its largest lengths is shared by at least this many texts and this share of them.
LIMIT_TEXTS, LIMIT_SHARE = 4, 0.004
#: A text cut at a number of bytes, but not inside a character, is up to so much shorter.
BYTE_SLACK = 3
#: Texts this much below a limit may have been cut at a word before it.
NEAR = 24

#: Supposedly intact training texts of a higher estimate are left out of the next fit; estimates from THRESHOLD on count as cut.
DOUBT, THRESHOLD = 0.25, 0.5

_WORD = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")
_TAG = re.compile(r"<([A-Za-z][A-Za-z0-9]*)(?=[ >])")
_K1, _K2, _K3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_ALL = (1 << 64) - 1
_CLASS = {c: "9" for c in "0123456789"} | {c: "_" for c in " \t\r\n "} | {c: c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~…"}


def _shape(s: str) -> str:
    """Classes of characters, runs of one class once."""
    out, last = [], ""
    for c in s:
        k = _CLASS.get(c) or ("A" if c.isupper() else "a" if c.isalpha() else "*")
        if k != last:
            out.append(k)
            last = k
    return "".join(out)


def word_hash(word: bytes) -> int:
    """As word_counts hashes words: by the first and last 8 bytes and the length."""
    n = len(word)
    first = int.from_bytes(word[:8], "little")
    second = int.from_bytes(word[-8:], "little") if n > 8 else 0
    return (first * _K1 ^ second * _K2 ^ n * _K3) & _ALL


def features(text: str) -> tuple[list[str], list[str], int, int]:
    """Names of the features of a text, what its length against the limit is combined with, the hash of its closing word, and the sort of that word."""
    t = text.rstrip()
    tail = t[-200:]
    cut = t.rfind("\n") + 1
    last = t[cut:]
    before = t[t.rfind("\n", 0, cut - 1) + 1 : cut - 1] if cut else ""
    head = t.lstrip()[:1]
    kind = head if head in "{[<" else "a"
    end = tail[-1:]
    endc = _shape(end)
    dots = "…" if end == "…" else "..." if tail.endswith("...") else ""
    if dots:
        stem = tail[: -len(dots)].rstrip()
        endc = dots + ("." if stem[-1:] in ".!?" else "_" if stem != tail[: -len(dots)] else "a")
    else:
        stem = tail
    close = stem.rstrip("\"')]}*_")
    inner = close[-1:]
    found = _WORD.findall(stem[-80:])
    word = found[-1] if found else ""
    prior = found[-2] if len(found) > 1 else ""
    bare = stem.endswith(word) and bool(word)
    words = len(last.split())
    tagged = bare and stem[: len(stem) - len(word)].endswith("#")
    alone = bare and cut > 0 and words == 1
    start, line_end = _shape(last[:16])[:5], _shape(before[-1:])
    lead = _shape(before[:16])[:5]
    shape_end = _shape(tail[-16:])
    parens = t.count("(") - t.count(")")
    square, curly, tags = t.count("[") - t.count("]"), t.count("{") - t.count("}"), t.count("<") - t.count(">")
    quotes = last.count('"') % 2
    # the first tag that is opened closes a whole page
    tag = _TAG.search(t)
    article = bool(tag) and not t.endswith(f"</{tag.group(1)}>")
    sign = lambda x: (x > 0) - (x < 0)
    capital = "A" if word[:1].isupper() else "9" if word[:1].isdigit() else "a"
    two = "A" if prior[:1].isupper() else "9" if prior[:1].isdigit() else "a"
    out = [
        "bias",
        "e1" + endc,
        "e2" + tail[-2:],
        "e3" + tail[-3:],
        "in" + inner + endc,
        "s4" + shape_end[-4:],
        "s7" + shape_end[-7:],
        "kind" + kind + endc,
        f"bal{kind}{sign(parens)}{sign(square)}{sign(curly)}{sign(tags)}",
        f"bale{endc}{sign(parens)}{quotes}",
        f"tag{article}{kind}",
        f"q{quotes}{endc}{kind}",
        "line" + start + "|" + endc,
        "line2" + start + "|" + line_end + "|" + endc,
        "same" + str(start == lead) + line_end + "|" + endc,
        "full" + _shape(last)[-24:] if len(last) < 120 else "full",
        "words" + str(min(words, 12)) + endc,
        "words2" + str(min(words, 6)) + start + endc,
        "pre" + before[-10:] + "|" + str(min(words, 3)) + endc,
        "first" + last[:4] + endc,
        f"tok{tagged}{alone}{line_end}{capital}",
        "lw" + word + str(bare),
        "lw2" + prior.lower() + " " + word.lower(),
        "suf" + word[-3:] + str(bare),
        "cap" + two + capital + str(bare) + endc,
        "wl" + str(min(len(word), 14)) + capital + str(bare),
        "space" + text[len(t) :][:2] + endc,
        "lone" + str(cut > 0) + line_end + str(min(words, 4)) + capital + endc,
    ]
    sort = 3 if not word else 4 if tagged else 5 if alone else 2 if word[-1].isdigit() else 1 if word[0].isupper() else 0
    beside = ["", "e" + endc, "b" + str(bare) + capital, "i" + inner, "k" + kind + endc]
    return out, beside, word_hash(word.encode()) if word else 0, sort * 2 + (not bare)


def _hashed(names: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh32_intdigest(x) % (DIM - CLOSING) for x in names]


def limit_features(beside: list[str], state: str) -> list[int]:
    """The hashed features of how a text's length stands to its source's limit (at, near, under)."""
    return _hashed(["lim" + state + x for x in beside])


def _state(chars: Column, size: Column, most_chars: Column, most_bytes: Column) -> Column:
    """How a length stands to the limits of its source, in characters and in bytes."""
    by = lambda at, most, slack: F.when(at >= most - NEAR, F.when(at >= most - slack, "at").otherwise("near"))
    return F.coalesce(by(chars, most_chars, 0), by(size, most_bytes, BYTE_SLACK), F.lit("under"))


def limits(df: DataFrame) -> DataFrame:
    """(source, chars, bytes): the limits of the sources; null where a source has none."""
    return _limits(df.where(F.trim("text") != "").select("source", F.length("text").alias("chars"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("h")))


def _limits(rows: DataFrame) -> DataFrame:
    """(source, chars, bytes) from (source, chars, size, h) of each text."""

    def spike(col: str) -> DataFrame:
        sizes = rows.groupBy("source", F.col(col).alias("v")).agg(F.count("*").alias("n"), (F.min("h") != F.max("h")).alias("several"))
        tops = sizes.groupBy(F.col("source").alias("s")).agg(F.max("v").alias("top"), F.sum("n").alias("all"))
        high = sizes.join(tops, F.col("source").eqNullSafe(F.col("s"))).where(F.col("v") >= F.col("top") * 0.8)
        best = high.groupBy("source").agg(F.max_by(F.struct("v", "n", "several", "all"), F.struct("n", "v")).alias("x"), F.sum("n").alias("high"))
        is_limit = F.col("x.several") & (F.col("x.n") >= LIMIT_TEXTS) & (F.col("x.n") >= F.col("x.all") * LIMIT_SHARE)
        return best.select("source", F.when(is_limit, F.col("x.v")).alias("v"), F.col("x.n").alias("n"))

    chars = spike("chars").select("source", F.col("v").alias("chars"), F.col("n").alias("nc"))
    size = spike("size").select("source", F.col("v").alias("bytes"), F.col("n").alias("nb"))
    joined = chars.join(size, chars["source"].eqNullSafe(size["source"])).drop(size["source"])
    by_chars = F.col("chars").isNotNull() & (F.col("bytes").isNull() | (F.col("nc") * 1.25 >= F.col("nb")))
    return joined.select("source", F.when(by_chars, F.col("chars")).alias("chars"), F.when(~by_chars, F.col("bytes")).alias("bytes"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): how often each word stands inside texts, their closing words left out."""
    letter = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        letter[a:b] = True
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: list[np.ndarray] = []
            counts: list[np.ndarray] = []
            for a in range(0, batch.num_rows, 1000):
                data, offsets = utf8(batch.column(0).slice(a, 1000))
                size = int(offsets[-1])
                inside = letter[data[:size]]
                edge = np.zeros(size + 1, bool)
                edge[offsets] = True
                prev = np.concatenate([[False], inside[:-1]])
                begin = np.flatnonzero(inside & (~prev | edge[:-1]))
                after = np.concatenate([inside[1:], [False]])
                end = np.flatnonzero(inside & (~after | edge[1:])) + 1
                # the last word of each text
                closing = np.searchsorted(begin, offsets[1:]) - 1
                keep = np.ones(len(begin), bool)
                keep[closing[closing >= 0]] = False
                begin, n = begin[keep], (end - begin)[keep]
                words = windows8(data)
                first = words[begin] & masks[np.minimum(n, 8)]
                second = np.where(n > 8, words[np.maximum(begin + n - 8, 0)], np.uint64(0))
                h = first * np.uint64(_K1) ^ second * np.uint64(_K2) ^ n.astype(np.uint64) * np.uint64(_K3)
                u, c = np.unique(h, return_counts=True)
                total.append(u)
                counts.append(c)
            if not total:
                continue
            u, back = np.unique(np.concatenate(total), return_inverse=True)
            c = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((u >> np.uint64(1)).astype(np.int64)), pa.array(c)], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


_MADE = "doc_id long, source string, role int, state string, chars int, size int, h long, dots boolean, word long, sort int, x array<int>, beside array<string>"


def _examples(step: int):
    """The features of each text (role 0; 1 if drawn for training) and of artificial cuts of the drawn ones (2; 3 for whole ones at the limit).

    state is only known of artificial cuts; chars, size, h and dots are those of the whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["doc_id", "source", "role", "state", "chars", "size", "h", "dots", "word", "sort", "x", "beside"]
        for batch in batches:
            out: list[tuple] = []
            for doc, text, source, draw in zip(*(c.to_pylist() for c in batch.columns)):
                if not text.strip():
                    continue
                raw = text.encode()
                whole = (len(text), len(raw), xxhash.xxh3_64_intdigest(raw) >> 1, text.rstrip()[-1:] in ".…")

                def add(role: int, state: str | None, t: str, doc=doc, source=source, whole=whole):
                    own, beside, word, sort = features(t)
                    out.append((doc, source, role, state, *whole, word >> 1, sort, _hashed(own), beside))

                train = draw % step == 0
                add(int(train), None, text)
                if not train or len(text) < 20:
                    continue
                rng = random.Random(draw)
                if rng.random() < 0.05:
                    add(3, "at", text)
                for _ in range(CUTS):
                    p = rng.randrange(max(5, len(text) // 20), len(text))
                    left, right = text[:p], text[p:]
                    style = rng.random()
                    if style > 0.75:
                        left = left[: max(left.rfind(" "), left.rfind("\n"), 0)].rstrip(" ,;:-")
                    bare = left.rstrip()
                    if len(bare) < 3 or bare[-1] in ".!?…" or right[:1] in "\r\n" or not right.strip() or left[-1:] == "\n":
                        continue
                    if style > 0.75:
                        left += "…" if rng.random() < 0.5 else "..."
                        at = "near"
                    else:
                        at = "at" if style < 0.4 else "under"
                    add(2, at, left)
            if out:
                cols = list(zip(*out))
                flat = np.array(cols[10], np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds)], lists, pa.array(cols[11], pa.list_(pa.string()))], names)

    return run


def fit(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, rounds: int = 120, decay: float = 2e-5, rate: float = 0.25) -> np.ndarray:
    """Weights of a logistic regression over rows of feature numbers, by full-batch Adam."""
    w, m, v = np.zeros(DIM) if start is None else start.copy(), np.zeros(DIM), np.zeros(DIM)
    flat, n = x.ravel(), len(x)
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
        g = np.bincount(flat, weights=np.repeat((p - y) / n, x.shape[1]), minlength=DIM) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8) * (1 - i / (rounds + 1))
    return w


def _complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the features of their length against the limit added to the others."""
    for batch in batches:
        if batch.num_rows:
            more = np.array([limit_features(b, s) for s, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())], np.int32)
            x = np.concatenate([batch.column(5).flatten().to_numpy().reshape(batch.num_rows, -1), more], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], ["doc_id", "source", "role", "x"])


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """(doc_id, source, p): the estimated probability that each text is cut; blank texts give no row."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    rows = spread(rows.where(F.trim("text") != ""))
    total = df.count()
    step = max(1, round(total / train_texts))
    drawn = rows.withColumn("draw", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 40)))
    made = cut_lineage(drawn.mapInArrow(_examples(step), _MADE))
    texts = made.where("role < 2")
    # one row a source; sources are many at most as texts, so they are joined and not collected
    sized = texts.groupBy("source").agg(F.count("*").alias("n_source"))
    most = cut_lineage(sized.join(_limits(texts).withColumnsRenamed({"source": "s", "chars": "most_chars", "bytes": "most_bytes"}), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))))
    keyed = made.withColumn("own", F.col("source")).withColumn("source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")))
    placed = join_groups(keyed, most, ["source"], "n_source", total, "h")
    is_at = _state(F.col("chars"), F.col("size"), F.col("most_chars"), F.col("most_bytes"))
    placed = placed.withColumn("is_at", is_at).withColumn("whole", (F.col("is_at") != "at") & ~((F.col("is_at") == "near") & F.col("dots")))
    placed = placed.where("role < 2 OR whole").withColumns({"role": F.when(F.col("whole"), F.col("role")).otherwise(0), "state": F.coalesce("state", "is_at")})
    placed = placed.select("doc_id", F.col("own").alias("source"), "role", "state", "h", "word", "sort", "x", "beside")
    closing = made.groupBy("word").agg(F.count("*").alias("k"))
    known = closing.join(word_counts(rows), "word", "left").select("word", "k", F.coalesce("n", F.lit(0)).alias("n"))
    # frequency on a log scale, apart for each sort of closing words
    level = (F.lit(DIM - CLOSING) + F.col("sort") * 16 + F.least(F.lit(15), F.floor(F.log2(F.col("n") + 1)))).cast("int")
    met = join_groups(placed, known, ["word"], "k", total, "h").select("doc_id", "source", "role", "state", "beside", F.array_append("x", level).alias("x"))
    rated = cut_lineage(met.mapInArrow(_complete, "doc_id long, source string, role int, x array<int>"))
    sample = rated.where("role > 0").orderBy("doc_id", "role", "x").select("role", "x").toArrow()  # bounded by train_texts
    role = sample.column(0).to_numpy()
    if (role == 1).sum() < 20 or (role == 2).sum() < 20:
        return rated.where("role < 2").select("doc_id", "source", F.lit(0.0).alias("p"))
    x = sample.column(1).combine_chunks().flatten().to_numpy().reshape(len(role), -1)
    y = (role == 2).astype(float)
    w = fit(x, y)
    for _ in range(2):
        looks_cut = (y == 0) & (w[x].sum(1) > np.log(DOUBT / (1 - DOUBT)))
        w = fit(x[~looks_cut], y[~looks_cut], w, rounds=60)
    sent = spark.sparkContext.broadcast(w.astype(np.float32))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
                p = 1 / (1 + np.exp(-np.clip(sent.value[at].sum(1), -30, 30).astype(np.float64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], ["doc_id", "source", "p"])

    return rated.where("role < 2").select("doc_id", "source", "x").mapInArrow(rate, "doc_id long, source string, p double")


def by_source(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, n, n_cut, share): how many texts of each source are cut; blank texts count as complete."""
    cut = score(df, id_col, text_col, source_col).where(F.col("p") >= THRESHOLD).groupBy("source").agg(F.count("*").alias("n_cut"))
    all_rows = df.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.count("*").alias("n"))
    n_cut = F.coalesce("n_cut", F.lit(0)).cast("long")
    return all_rows.join(cut, all_rows["s"].eqNullSafe(cut["source"]), "left").select(F.col("s").alias("source"), "n", n_cut.alias("n_cut"), F.round(n_cut / F.col("n"), 6).alias("share"))
