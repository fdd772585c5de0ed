"""Inverted index, BM25, TF-IDF, and boolean and phrase search over whole corpora and batches of queries.

All searches take texts (id, text), which are analysed once, or an ``Index`` built before.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.skew import join_spread
from lodestone.session import cut_lineage, spread

#: A word is frequent in more texts than this, and in more than one text in FREQUENT_SHARE.
FREQUENT_DF = 1_000
FREQUENT_SHARE = 1_000
#: Postings that one task of a search holds, and queries that it answers.
SHARD_POSTINGS = 4_000_000
BLOCK_QUERIES = 50_000
#: Texts that one task of ``boolean_or`` holds, few enough for a dictionary of their ids in a file, queries that it answers together, pairs that it gives out at a time.
SHARD_TEXTS = 100_000
ANY_QUERIES = 200_000
OUT_ROWS = 25_000
#: Values that go round while the other of a pair stays, few enough to recur many times in a page of a file; fewer texts than FEW stay themselves.
CYCLE = 248
FEW = 64
#: Bits of the table of hashes by which most words that nobody asks for are left out before an exchange.
WANTED_BITS = 1 << 20


def tokens(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, tokens, dl) of each text that has a word."""
    return spread(docs).select(F.col(id_col).alias("id"), T.words(F.col(text_col)).alias("tokens")).withColumn("dl", F.size("tokens")).where("dl > 0")


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, dl, tf): how often each word occurs in each text."""
    return tokens(docs, id_col, text_col).select("id", "dl", F.explode("tokens").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def positions(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, pos): the places of each word, from 0."""
    return tokens(docs, id_col, text_col).select("id", F.posexplode("tokens").alias("pos", "term"))


def document_frequency(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    return tokens(docs, id_col, text_col).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, query_id: str, text_col: str, stopwords: list[str]) -> DataFrame:
    """(query_id, term, qtf): the words of each query but stop words, with their number."""
    stop = T.listed(stopwords) if stopwords else F.array().cast("array<string>")
    terms = F.filter(T.words(F.col(text_col)), lambda w: ~F.array_contains(stop, w))
    return queries.select(F.col(query_id).alias("query_id"), F.explode(terms).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


class Index:
    """Stored postings (term, id, dl, tf) and the one-row statistics (n_docs, avgdl) of a corpus."""

    def __init__(self, postings: DataFrame, stats: DataFrame):
        self.postings, self.stats = postings, stats

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> Index:
        toks = cut_lineage(tokens(docs, id_col, text_col))
        words = toks.select("id", "dl", F.explode("tokens").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
        return cls(words, toks.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))

    def narrow(self, terms: DataFrame) -> Index:
        """The part of the index that queries (query_id, term, qtf) need, materialised."""
        return Index(cut_lineage(self.postings.join(terms.select("term").distinct(), "term", "left_semi")), cut_lineage(self.stats))

    def save(self, path: str) -> None:
        """Write the index; the postings are sorted by word within files, so that a search reads few row groups."""
        self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"))


def _maybe(words: DataFrame) -> Callable[[Column], Column]:
    """A test for the words (term): true for all of them and, as a table of WANTED_BITS decides by hash, for a few others."""
    spark, at = words.sparkSession, F.pmod(F.xxhash64("term"), F.lit(WANTED_BITS))
    bits = words.select(at.alias("at")).select(F.expr("at div 64 AS n"), F.expr("shiftleft(1L, cast(at % 64 AS int)) AS x"))
    bits = bits.unionByName(spark.range(WANTED_BITS // 64).select(F.col("id").alias("n"), F.lit(0).cast("long").alias("x"))).groupBy("n").agg(F.bit_or("x").alias("x"))
    known = bits.agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("x")).select(F.col("x.x").alias("x")).scalar()

    def test(word: Column) -> Column:
        h = F.pmod(F.xxhash64(word), F.lit(WANTED_BITS))
        return F.call_function("shiftright", F.get(known, F.shiftright(h, 6).cast("int")), (h % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test


def _matched(docs: DataFrame | Index, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The query's postings, their document frequencies, and the one-row statistics of the corpus."""
    wanted = terms.select("term").distinct()
    may = _maybe(wanted)
    if isinstance(docs, Index):
        tf, stats = cut_lineage(docs.postings.where(may(F.col("term"))).join(wanted, "term", "left_semi")), docs.stats
    else:
        toks = cut_lineage(tokens(docs))
        stats = toks.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
        tf = cut_lineage(toks.select("id", "dl", F.explode("tokens").alias("term")).where(may(F.col("term"))).join(wanted, "term", "left_semi").groupBy("term", "id", "dl").agg(F.count("*").alias("tf")))
    return tf, tf.groupBy("term").agg(F.count("*").alias("df")), stats


def top_k(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best of each query by rounded score, then id, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _bm25_parts(docs: DataFrame | Index, terms: DataFrame, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    """The weights (query_id, term, w, df, n_docs) of the queries' words, and the gains (term, id, gain) of the texts."""
    tf, df, stats = _matched(docs, terms)
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = terms.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (F.col("qtf") * idf).alias("w"), "df", "n_docs")
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return weights, tf.crossJoin(F.broadcast(stats)).select("term", "id", gain.alias("gain"))


def _summed(weights: DataFrame, gains: DataFrame) -> DataFrame:
    """(query_id, id, score): the sums of weight times gain, of every text that shares a word with a query."""
    hits = join_spread(weights.select("query_id", "term", "w"), gains, "term", "id").select("query_id", "id", (F.col("w") * F.col("gain")).alias("gain"))
    # few rows meet in one (query, text), so one exchange by query serves the sum and the ranking after it
    return hits.repartition("query_id").groupBy("query_id", "id").agg(F.round(F.sum("gain"), 6).alias("score"))


def _unpacked(texts: pa.Table) -> tuple[pa.Array, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The ids of a shard in order, and by word the places of its texts among them and their gains."""
    ids = texts["ids"].combine_chunks()
    ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    known, at = np.unique(ids.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    gains = texts["gains"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return pa.array(known, type=ids.type.value_type), {t: (at[i:j], gains[i:j]) for t, i, j in zip(texts["term"].to_pylist(), ends, ends[1:], strict=False)}


def _best_of_block(k: int):
    """The search of one block of queries in one shard of the texts, both packed, as a function of Arrow tables."""

    def order(scores: np.ndarray) -> np.ndarray:
        return np.floor(scores * 1e6 + 0.5)

    def first(scores: np.ndarray) -> np.ndarray:
        """The places of the k best by rounded score, then place."""
        if len(scores) <= k:
            return np.arange(len(scores))
        key = order(scores)
        least = np.partition(key, len(key) - k)[len(key) - k]
        above = np.flatnonzero(key > least)
        return np.sort(np.concatenate([above, np.flatnonzero(key == least)[: k - len(above)]]))

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        known, place = _unpacked(texts)
        none = (np.empty(0, np.int64), np.empty(0))
        # queries with the same frequent words read the long lists once
        alike = defaultdict(list)
        for n, (often, seldom) in enumerate(zip(asked["often"].to_pylist(), asked["seldom"].to_pylist(), strict=True)):
            alike[tuple((x["term"], x["w"]) for x in often)].append((n, seldom))
        rows, found, scores = [], [], []
        total, seen = np.zeros(len(known)), np.zeros(len(known), bool)
        for often, queries in alike.items():
            total[:] = 0
            for t, w in often:
                o, g = place.get(t, none)
                total[o] += w * g
            some = np.flatnonzero(total) if often else none[0]
            # a text without a seldom word is among the best of a query only if it is among those of its frequent words
            some = some[first(total[some])]
            for n, seldom in queries:
                lists = [(*place.get(x["term"], none), x["w"]) for x in seldom]
                own = np.unique(np.concatenate([none[0], *[o for o, _, _ in lists]]))
                score = total[own]
                for o, g, w in lists:
                    score[np.searchsorted(own, o)] += w * g
                seen[own] = True
                rest = some[~seen[some]]
                seen[own] = False
                both, score = np.concatenate([own, rest]), np.concatenate([score, total[rest]])
                if len(both) > k:
                    best = np.lexsort((both, -order(score)))[:k]
                    both, score = both[best], score[best]
                rows.append(np.full(len(both), n))
                found.append(both)
                scores.append(score)
        rows, found, scores = (np.concatenate(x) if x else none[0] for x in (rows, found, scores))
        return pa.table({"query_id": asked["query_id"].take(pa.array(rows.astype(np.int64))), "id": known.take(pa.array(found.astype(np.int64))), "score": pa.array(scores.astype(float))})

    return run


def _all_of_block(texts: pa.Table, asked: pa.Table) -> pa.Table:
    """The texts with all words of each query of a block: the shortest list is looked up in the longer ones."""
    known, place = _unpacked(texts)
    place = {t: np.sort(o) for t, (o, _) in place.items()}
    rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n, seldom in enumerate(asked["seldom"].to_pylist()):
        lists = sorted((place.get(x["term"], found[0]) for x in seldom), key=len)
        own = lists[0]
        for o in lists[1:]:
            if not len(own):
                break
            own = own[o[np.minimum(np.searchsorted(o, own), len(o) - 1)] == own]
        rows.append(np.full(len(own), n))
        found.append(own)
    rows, found = (pa.array(np.concatenate(x).astype(np.int64)) for x in (rows, found))
    return pa.table({"query_id": asked["query_id"].take(rows), "id": known.take(found)})


def _meet(packed: DataFrame, gains: DataFrame, run, scored: str, shard: int) -> DataFrame:
    """What ``run`` finds for blocks of materialised queries (query_id, often, seldom) in shards of materialised gains (term, id, gain).

    Queries with the same frequent words are in one block. A word's list goes, packed, to the blocks that ask for it.
    """
    blocks = max(2 * packed.sparkSession.sparkContext.defaultParallelism, packed.count() // BLOCK_QUERIES)
    shards = max(1, -(-gains.count() // shard))
    asked = packed.withColumn("block", F.pmod(F.xxhash64(F.when(F.size("often") > 0, F.to_json("often")).otherwise(F.col("query_id").cast("string"))), F.lit(blocks)).cast("int"))
    needed = asked.select("block", F.explode(F.concat("often", "seldom")).alias("x")).select("block", "x.term").distinct()
    lists = gains.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy("shard", "term")
    lists = lists.agg(F.collect_list(F.struct("id", "gain")).alias("x")).select("shard", "term", F.col("x.id").alias("ids"), F.col("x.gain").alias("gains"))
    texts = lists.join(needed, "term").select("block", "shard", "term", "ids", "gains")
    asked = asked.select("query_id", "often", "seldom", F.col("block").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"))
    schema = f"query_id {dict(packed.dtypes)['query_id']}, id {dict(gains.dtypes)['id']}{scored}"
    return texts.groupBy("block", "shard").cogroup(asked.groupBy("_block", "_shard")).applyInArrow(run, schema)


def _best(weights: DataFrame, gains: DataFrame, k: int, frequent: int = FREQUENT_DF, shard: int = SHARD_POSTINGS) -> DataFrame:
    """``top_k`` of ``_summed`` without a row for each query and text that share a word; weights and gains are above 0.

    The texts of frequent words are summed once for all queries that have the same of them; a query then adds its seldom
    words. Blocks of queries meet shards of texts, of which each gives its k best.
    """
    limit = F.greatest(F.lit(frequent), F.col("n_docs") / FREQUENT_SHARE)
    word = F.struct("term", "w")
    packed = weights.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("df") > limit, word))).alias("often"), F.array_sort(F.collect_list(F.when(F.col("df") <= limit, word))).alias("seldom")
    )
    found = _meet(cut_lineage(packed), gains, _best_of_block(k), ", score double", shard)
    return top_k(found.withColumn("score", F.round("score", 6)), k)


def bm25(docs: DataFrame | Index, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) of every text that shares a word with a query; repeated words of a query count repeatedly."""
    return _summed(*_bm25_parts(docs, terms, k1, b))


def bm25_best(docs: DataFrame | Index, terms: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, **sizes: int) -> DataFrame:
    """(query_id, id, score, rank): the k best texts of each query by ``bm25``."""
    return _best(*_bm25_parts(docs, terms, k1, b), k, **sizes)


def bm25_isolated(docs: DataFrame, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) where each query has texts (query_id, id, text) of its own, and statistics of those alone."""
    toks = cut_lineage(docs.select("query_id", "id", T.words(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens")).where("dl > 0"))
    stats = toks.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    words = toks.select("query_id", "id", "dl", F.explode("tokens").alias("term")).join(terms, ["query_id", "term"]).groupBy("query_id", "term", "qtf", "id", "dl").agg(F.count("*").alias("tf"))
    words = cut_lineage(words)
    df = words.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return words.join(df, ["query_id", "term"]).join(stats, "query_id").groupBy("query_id", "id").agg(F.round(F.sum(gain), 6).alias("score"))


def _tfidf_parts(docs: DataFrame | Index, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    tf, df, stats = _matched(docs, terms)
    size = terms.groupBy("query_id").agg(F.count("*").alias("q_terms"))
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    weights = terms.join(df, "term").join(size, "query_id").crossJoin(F.broadcast(stats)).select("query_id", "term", (idf / F.col("q_terms")).alias("w"), "df", "n_docs")
    return weights, tf.select("term", "id", (F.col("tf") / F.col("dl")).alias("gain"))


def tfidf(docs: DataFrame | Index, terms: DataFrame) -> DataFrame:
    """(query_id, id, score): the mean over a query's distinct words of their share of the text times their rarity."""
    return _summed(*_tfidf_parts(docs, terms))


def tfidf_best(docs: DataFrame | Index, terms: DataFrame, k: int, **sizes: int) -> DataFrame:
    """(query_id, id, score, rank): the k best texts of each query by ``tfidf``."""
    return _best(*_tfidf_parts(docs, terms), k, **sizes)


def scores_of(pairs: DataFrame, docs: DataFrame | Index, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, tfidf): ``bm25`` and ``tfidf`` of the given pairs (query_id, id) that share a word, without those of other pairs."""
    tf, df, stats = _matched(docs, terms)
    rarity = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    own = F.struct("term", rarity.alias("idf"), gain.alias("gain"), (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("rarity"), (F.col("tf") / F.col("dl")).alias("share"))
    texts = tf.join(pairs.select("id").distinct(), "id", "left_semi").join(df, "term").crossJoin(F.broadcast(stats)).groupBy("id").agg(F.collect_list(own).alias("_own"))
    asked = terms.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "qtf"))).alias("_asked"))
    met = pairs.select("query_id", "id").join(asked, "query_id").join(texts, "id")
    met = met.select("query_id", "id", F.size("_asked").alias("_n"), F.transform("_own", lambda x: F.struct(x.alias("x"), F.col("_asked")[x["term"]].alias("qtf"))).alias("_own"))
    met = met.withColumn("_own", F.filter("_own", lambda y: y["qtf"].isNotNull())).where(F.size("_own") > 0)
    total = lambda part: F.round(F.aggregate("_own", F.lit(0.0), lambda s, y: s + part(y["x"], y["qtf"])), 6)
    score, tfidf = total(lambda x, qtf: qtf * x["idf"] * x["gain"]), total(lambda x, qtf: x["rarity"] / F.col("_n") * x["share"])
    return met.select("query_id", "id", score.alias("score"), tfidf.alias("tfidf"))


def _crossed(rows: np.ndarray, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of both, in pieces: one comes in runs while the other goes round in cycles of CYCLE at most, which files pack to little.

    Files pack values by eights, so cycles are of whole eights; what is left over goes in runs instead.
    """
    turned = len(found) < min(FEW, len(rows))
    runs, turns = (found, rows) if turned else (rows, found)
    even = len(turns) // 8 * 8
    for part in np.split(turns[:even], range(CYCLE, even, CYCLE)) if even else []:
        step = max(1, OUT_ROWS // len(part))
        for i in range(0, len(runs), step):
            some = runs[i : i + step]
            piece = np.repeat(some, len(part)), np.tile(part, len(some))
            yield piece[::-1] if turned else piece
    rest = turns[even:]
    if len(rest) and len(runs) >= 8:
        yield from _crossed(*((rest, runs) if turned else (runs, rest)))
    elif len(rest):
        piece = np.repeat(runs, len(rest)), np.tile(rest, len(runs))
        yield piece[::-1] if turned else piece


def _any_of_block(place: list[np.ndarray], n: int, asked: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (query, text) that share a word, once each: queries as words, most frequent first, in a shard of n texts, words as the places of theirs.

    Queries that begin with the same words share the texts of the last of these that have none of those before it.
    """
    order = sorted(range(len(asked)), key=[x.tolist() for x in asked].__getitem__)
    seen, rows = np.zeros(n, bool), np.array(order, np.int32)
    todo: list[tuple] = [(0, len(order), 0)]
    while todo:
        at, end, depth = todo.pop()
        if at is None:  # the texts of a word are left
            seen[end] = False
            continue
        while at < end and len(asked[order[at]]) == depth:
            at += 1
        if at == end:
            continue
        words = asked[order[at]]
        if at + 1 == end:
            new = np.unique(np.concatenate([place[w] for w in words[depth:]]))
            if len(new := new[~seen[new]]):
                yield from _crossed(rows[at:end], new)
            continue
        to = at + 1
        while to < end and asked[order[to]][depth] == words[depth]:
            to += 1
        new = place[words[depth]]
        new = new[~seen[new]]
        todo.append((to, end, depth))
        if len(new):
            yield from _crossed(rows[at:to], new)
            seen[new] = True
            todo.append((None, new, depth))
        todo.append((at, to, depth + 1))


def _any_of_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts with any word of each query, of one shard: its postings (id, term) come first, then the queries (query_id, words)."""
    words, held, place = [], [], None

    def answers() -> Iterator[pa.RecordBatch]:
        asked = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        queries, lists = asked["query_id"].combine_chunks(), asked["words"].combine_chunks()
        codes = pc.fill_null(pc.index_in(lists.flatten(), terms.dictionary), -1).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))[codes >= 0]
        codes = rank[codes[codes >= 0]]
        codes = codes[np.lexsort((codes, owner))]
        asked = np.split(codes, np.searchsorted(owner, np.arange(1, len(lists))))

        def given(pieces: list[tuple[np.ndarray, np.ndarray]], some: bool = False) -> pa.RecordBatch:
            """The pieces, or of some of them whole eights of pairs; the others stay."""
            at = [np.concatenate(x) for x in zip(*pieces, strict=True)]
            pieces.clear()
            if some:
                n = len(at[0]) // 8 * 8
                pieces.append(tuple(x[n:] for x in at))
                at = [x[:n] for x in at]
            return pa.record_batch({"query_id": queries.take(pa.array(at[0])), "id": known.take(pa.array(at[1]))})

        # pieces of whole eights stay in step if others, gathered, come as eights too
        even, odd = [[], 0], [[], 0]
        for piece in _any_of_block(place, len(known), asked):
            to = odd if len(piece[0]) % 8 else even
            to[0].append(piece)
            to[1] += len(piece[0])
            if to[1] >= OUT_ROWS:
                yield given(to[0], to is odd)
                to[1] = 0
        for pieces, _ in (even, odd):
            if pieces:
                yield given(pieces)

    for batch in batches:
        n = batch.num_rows - (pc.sum(batch["asks"]).as_py() or 0)
        if n:
            words.append(batch.slice(0, n).select(["id", "term"]))
        asked = batch.slice(n).select(["query_id", "words"])
        if not words or not asked.num_rows:
            continue
        if place is None:
            table = pa.Table.from_batches(words)
            ids, terms = (table[c].combine_chunks().dictionary_encode("encode") for c in ("id", "term"))
            known = ids.dictionary
            pairs = np.unique(terms.indices.to_numpy().astype(np.int64) * len(known) + ids.indices.to_numpy())
            place = np.split((pairs % len(known)).astype(np.int32), np.searchsorted(pairs, np.arange(1, len(terms.dictionary)) * len(known)))
            often = np.argsort([-len(x) for x in place], kind="stable")
            place, rank = [place[t] for t in often], np.argsort(often)
        held.append(asked)
        if sum(x.num_rows for x in held) >= ANY_QUERIES:
            yield from answers()
    if held:
        yield from answers()


def boolean_or(docs: DataFrame | Index, terms: DataFrame, shard: int = SHARD_TEXTS) -> DataFrame:
    """(query_id, id): texts with any word of the query.

    Every query goes to every shard of the texts, which gives its pairs once each; so pairs are written nowhere before they come out.
    They come out so that files of them are small.
    """
    may = _maybe(terms.select("term").distinct())
    if isinstance(docs, Index):
        n, words = docs.stats.first()["n_docs"], docs.postings.select("id", "term")
    else:
        n, words = docs.count(), tokens(docs).select("id", F.explode(F.array_distinct("tokens")).alias("term"))
    cores = terms.sparkSession.sparkContext.defaultParallelism
    shards = cores * max(2, -(-n // (shard * cores)))
    kinds = dict(terms.dtypes) | dict(words.dtypes)
    asked = terms.groupBy("query_id").agg(F.collect_set("term").alias("words"))
    given = words.where(may(F.col("term"))).select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "term")
    rows = given.unionByName(asked.select("query_id", "words", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")), allowMissingColumns=True)
    return rows.repartitionById(shards, "shard").sortWithinPartitions("asks").mapInArrow(_any_of_shard, f"query_id {kinds['query_id']}, id {kinds['id']}")


def boolean_and(docs: DataFrame | Index, terms: DataFrame, known_only: bool = False, shard: int = SHARD_POSTINGS) -> DataFrame:
    """(query_id, id): texts with all words of the query; with known_only words that occur nowhere are ignored."""
    tf, df, _ = _matched(docs, terms)
    rows = terms.select("query_id", "term").join(df.withColumn("known", F.lit(1)), "term", "left").groupBy("query_id")
    word = F.struct("term")
    asked = rows.agg(F.count("*").alias("n"), F.count("known").alias("known"), F.collect_list(F.when(F.col("known") == 1, word)).alias("seldom")).where("known > 0")
    asked = (asked if known_only else asked.where("known = n")).select("query_id", F.filter("seldom", lambda x: F.lit(False)).alias("often"), "seldom")
    return _meet(cut_lineage(asked), tf.select("term", "id", F.lit(1.0).alias("gain")), _all_of_block, "", shard)


def phrase_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(words, id, hits) of texts that hold the words of a phrase (words) in a row; hits counts the places.

    Only places that may hold a word of some phrase count; runs of such places are taken as wholes and compared with the phrases.
    """
    once = phrases.select("words").where(F.size("words") > 0).distinct()
    places = positions(docs).where(_maybe(once.select(F.explode("words").alias("term")))(F.col("term")))
    each = places.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("x")).crossJoin(F.broadcast(once.select(F.size("words").alias("n")).distinct()))
    each = each.where("size(x) >= n").select("id", "x", "n", F.explode(F.sequence(F.lit(1), F.size("x") - F.col("n") + 1)).alias("i"))
    runs = each.where(F.element_at("x", F.col("i") + F.col("n") - 1)["pos"] - F.element_at("x", F.col("i"))["pos"] == F.col("n") - 1)
    return runs.select("id", F.slice("x", F.col("i"), F.col("n"))["term"].alias("words")).join(once, "words").groupBy("words", "id").agg(F.count("*").alias("hits"))


def phrase_search(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, id, hits) of texts that hold the words of ``phrases.words`` in a row; hits counts the places."""
    return phrase_hits(docs, phrases).join(phrases.distinct(), "words").groupBy("query_id", "id").agg(F.sum("hits").alias("hits"))
