"""Pairs of texts that share most of their words, found without comparing all pairs.

Similarity is the Jaccard measure of the sets of words, a word being a maximal run
of letters and digits of the lower-cased text. Texts of fewer than ``min_words``
distinct words take no part.

Method: multi-index hashing.

1. Texts with the same set of words are collapsed into one representative.
2. A representative's fingerprint has ``segments`` segments of ``symbols`` 8-bit
   symbols; a symbol comes from the least hash of its words under one hash
   function, so two texts agree in a symbol with the probability of their
   similarity. The Hamming distance of two fingerprints counts differing symbols.
3. In each segment the Hamming ball of radius 1 is enumerated: one key per symbol
   left out. Two segments at distance 0 or 1, and no others (but for 1 in 256 a
   symbol), share such a key.
4. Texts that meet in the table of a key are candidates, and the complete distance
   of their sets of words decides.

At similarity s a segment of 8 meets with s^8 + 8 s^7 (1 - s): 0.37 at 3/4 and 0.50
at 0.8, so 16 segments find 99.93 % of the pairs at the bound itself and 99.999 % at
0.8; unrelated texts at 0.1 meet with a probability of 1e-5.

A key that very many texts share (texts of one template) is found on a sample and its
texts meet by blocks; nothing is dropped.

Pairs of copies: all pairs between and within sets of equal words come out, those of
large ones by blocks. ``classes`` gives the membership instead: the class and the number
of links of every text, computed on representatives without listing the pairs of copies.
With the option ``expand`` more than so many rows of equal text count as one, and each is
paired with the smallest id instead; ``stars`` gives the rows it stands for.

Defined cases: null and short texts are in no pair; equal rows are copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.skew import PAIR_ROWS, frequent, join_groups, pairs_within
from lodestone.session import cut_lineage, spread

MIN_WORDS = 20
#: Least similarity, as a fraction: shared words times [1] >= all words times [0].
SIMILARITY = (3, 4)
SYMBOLS, SEGMENTS = 8, 16
#: Texts on which keys that very many texts share are looked for.
SAMPLE = 10_000
#: Rows of one text up to which all their pairs come out; None: always.
EXPAND = None

_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> set[str]:
    return set(_WORDS.findall(text.lower()))


def word_sets(df: DataFrame, id_col: str = "id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, k1, k2, words) of each text of enough words: the hashes of its words in order, and two sums over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes: dict[str, int] = {}
        for batch in batches:
            ids, sets = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                if len(found) < min_words:
                    continue
                if len(hashes) > 1_000_000:
                    hashes.clear()
                row = []
                for w in found:
                    h = hashes.get(w)
                    if h is None:
                        h = hashes[w] = xxhash.xxh3_64_intdigest(w)
                    row.append(h)
                ids.append(i)
                sets.append(np.sort(np.array(row, np.uint64)))
            if not ids:
                continue
            flat = np.concatenate(sets)
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            k1 = np.add.reduceat(flat, at[:-1])
            mixed = (flat ^ (flat >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            k2 = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), at[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(k1.view(np.int64)),
                    pa.array(k2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64))),
                ],
                ["id", "k1", "k2", "words"],
            )

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where((F.length("text") >= 2 * min_words - 1) & F.col("id").isNotNull())
    return spread(rows).mapInArrow(run, "id long, k1 long, k2 long, words array<long>")


def ball_keys(reps: DataFrame, symbols: int = SYMBOLS, segments: int = SEGMENTS, seed: int = 5) -> DataFrame:
    """(key, id): the keys of the radius-1 balls around all segments of each fingerprint."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, symbols * segments, dtype=np.uint64) | np.uint64(1)
    shifts = rng.integers(0, 1 << 63, symbols * segments, dtype=np.uint64)
    weights = rng.integers(1, 1 << 63, (symbols, segments), dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy().view(np.uint64)
            offsets = np.asarray(lists.offsets)
            at = (offsets[:-1] - offsets[0]).astype(np.int64)
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0)
            for s in range(segments):
                sym = np.empty((n, symbols), np.uint64)
                for j in range(symbols):
                    p = s * symbols + j
                    mixed = flat * factors[p] + shifts[p]
                    mixed ^= mixed >> np.uint64(31)
                    least = np.minimum.reduceat(mixed, at)
                    sym[:, j] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
                parts = (sym + np.uint64(1)) * weights[:, s]
                parts ^= parts >> np.uint64(33)
                parts *= np.uint64(0xFF51AFD7ED558CCD)
                whole = parts.sum(axis=1)
                for j in range(symbols):
                    left = (whole - parts[:, j]) ^ np.uint64((s << 8 | j) * 0x9FB21C651E98DF25 & (1 << 64) - 1)
                    left = (left ^ (left >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), ids], ["key", "id"])

    return reps.select("id", "words").mapInArrow(run, "key long, id long")


def representative_pairs(reps: DataFrame, total: int, similarity: tuple[int, int] = SIMILARITY, symbols: int = SYMBOLS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b): the similar pairs among (id, words) with different sets of words, a < b; ``total`` is about the number of rows."""
    keys = ball_keys(reps, symbols, segments)
    # the keys of a sample show which ones must be spread
    step = max(1, -(-total // SAMPLE))
    drawn = reps.where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(step)) == 0)
    hot = cut_lineage(frequent(ball_keys(drawn, symbols, segments), "key", total, step, 2 * PAIR_ROWS)) if total > 2 * PAIR_ROWS else None
    if hot is None or hot.isEmpty():
        left, right = keys.select("key", F.col("id").alias("a")), keys.select("key", F.col("id").alias("b"))
        candidates = left.join(right, "key").where("a < b").select("a", "b").distinct()
    else:
        # fewer than 1000 times the keys of one text
        marked = cut_lineage(keys.join(F.broadcast(hot), "key", "left"))
        cold = marked.where("n IS NULL")
        left, right = cold.select("key", F.col("id").alias("a")), cold.select("key", F.col("id").alias("b"))
        spread_out = pairs_within(marked.where("n IS NOT NULL"), "key", "n", "id").toDF("a", "b")
        candidates = left.join(right, "key").where("a < b").select("a", "b").unionByName(spread_out).distinct()
    # word sets are long: never broadcast them
    both = candidates.join(reps.select(F.col("id").alias("a"), F.col("words").alias("wa")).hint("merge"), "a").join(
        reps.select(F.col("id").alias("b"), F.col("words").alias("wb")).hint("merge"), "b"
    )
    shared = F.size(F.array_intersect("wa", "wb"))
    least, whole = similarity
    return both.where(shared * (whole + least) >= (F.size("wa") + F.size("wb")) * least).select("a", "b")


def stars(df: DataFrame, id_col: str = "id", text_col: str = "text", min_words: int = MIN_WORDS, expand: int | None = EXPAND) -> DataFrame:
    """(id, first): the rows of equal text that ``similar_pairs`` gives as a star, each with the smallest id; none without ``expand``."""
    if expand is None:
        return df.sparkSession.createDataFrame([], "id long, first long")
    taking = word_sets(df, id_col, text_col, min_words).select("id")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.sha2(F.col(text_col).cast("string"), 256).alias("text"))
    rows = cut_lineage(rows.join(taking, "id", "left_semi"))
    groups = cut_lineage(rows.groupBy("text").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") > expand))
    return join_groups(rows, groups, ["text"], "n", rows.count(), "id").select("id", "first")


def similar_pairs(
    df: DataFrame, id_col: str = "id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY, min_words: int = MIN_WORDS, expand: int | None = EXPAND
) -> DataFrame:
    """(id_a, id_b): all pairs of similar texts, the smaller id first."""
    sets = cut_lineage(word_sets(df, id_col, text_col, min_words))
    if expand is None:
        return _all_pairs(sets, similarity)
    found = cut_lineage(stars(df, id_col, text_col, min_words, expand))
    left_out = found.where("id <> first")
    star = left_out.select(F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    return _all_pairs(cut_lineage(sets.join(left_out, "id", "left_anti")), similarity).unionByName(star)


def _collapsed(sets: DataFrame, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups (rep, n), members (id, rep, n), similar pairs (a, b) of representatives) of materialised word sets."""
    total = sets.count()
    groups = cut_lineage(sets.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    members = cut_lineage(join_groups(sets.select("id", "k1", "k2"), groups, ["k1", "k2"], "n", total, "id").select("id", "rep", "n"))
    reps = sets.select("id", "words").join(groups.select(F.col("rep").alias("id")), "id", "left_semi")
    return groups, members, representative_pairs(reps, total, similarity)


def _all_pairs(sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(id_a, id_b): all pairs of similar texts among materialised word sets."""
    groups, members, pairs = _collapsed(sets, similarity)
    # the blocks of a large set's rows meet the blocks of the other's
    blocks = F.ceil(F.col("n") / PAIR_ROWS).cast("int")
    sizes = groups.select("rep", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    listed = members.select("rep", "id", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    x, y = (listed.select(F.col("rep").alias(r), F.col("block").alias(b), F.col("id").alias(i)) for r, b, i in (("a", "i", "x"), ("b", "j", "y")))
    tasks = pairs.join(sizes.select(F.col("rep").alias("a"), F.col("block").alias("i")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("block").alias("j")), "b")
    across = tasks.join(x, ["a", "i"]).join(y, ["b", "j"]).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return pairs_within(members, "rep", "n", "id").unionByName(across)


def classes(df: DataFrame, id_col: str = "id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, class_id, links): the smallest id that each text is connected with over similar texts, and its number of similar texts.

    Texts of too few words have a class of their own and no links; rows without an id are left out.
    """
    from lodestone.llm.names import components

    sets = cut_lineage(word_sets(df, id_col, text_col, min_words))
    groups, members, pairs = _collapsed(sets, similarity)
    pairs = cut_lineage(pairs)
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ends.join(groups.select(F.col("rep").alias("b"), F.col("n").alias("m")), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("m").alias("across"))
    roots = components(pairs).select(F.col("node").alias("rep"), "root")
    known = groups.join(links, "rep", "left").join(roots, "rep", "left")
    known = known.select("rep", "n", F.coalesce("root", "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("across", F.lit(0))).alias("links"))
    of = join_groups(members.select("id", "rep"), known, ["rep"], "n", sets.count(), "id").select("id", "class_id", "links")
    every = df.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    return every.join(of, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
