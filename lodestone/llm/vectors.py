"""The k nearest vectors of every vector, by multiprobe p-stable hashing.

* Of equal vectors only the first k + 1 are indexed and only the first is searched for,
  since the others have the same list. A vector that a third of all rows share is thus
  searched once.
* Each of ``tables`` hash tables is a tree of p-stable hash functions
  ``floor((a . v + b) / w)`` with Gaussian ``a`` from a common pool. The upper part is fitted
  on at most ``SAMPLE`` vectors; then all vectors are counted, and every bucket that
  holds more than twice ``bucket`` is split by a further function, whose ``w`` comes from mean
  and deviation of the bucket's own projections, until none is left. Buckets thus have
  the same size at any number of vectors, and the work for one vector does not grow.
* Each vector visits its own bucket and up to ``probes`` perturbed ones of each
  table, in estimated order of success: by the sum of squared distances to the boundaries that
  the perturbation set crosses (sets of one and of two), as a neighbour at distance r crosses
  a boundary at distance x with the probability that a normal variable of deviation r exceeds x.
  Sets beyond ``REACH`` r are not visited.
* Neighbouring buckets are searched by one task, so a vector is sent once for all
  its visits there. Distances are computed in blocks; a bucket that cannot be split and is larger
  than ``BLOCK`` is worked off exactly by several tasks, each with a block of
  queries and a block of vectors. Nothing is capped.
* The candidates of all visits are merged and ranked by exact distance in double.

Defined cases: null embeddings, those of another length and those with a null or
NaN inside take no part; of several rows of one id the smallest embedding counts;
equal distances rank the smaller id first; with k or fewer other vectors all come
out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.skew import join_groups
from lodestone.session import cut_lineage

#: Most vectors that the upper hash functions are fitted on.
SAMPLE = 20_000
#: Most vectors or queries in one block of distances.
BLOCK = 8_192
#: Vectors and visits of the buckets that one task searches, about.
GROUP = 120_000
#: So many more than k are kept until the exact distances are known.
SLACK = 4
#: Perturbation sets farther than this many neighbour distances are not visited.
REACH = 2.5
#: Hash functions of one table; nodes of its tree share them.
POOL = 256


class Tree:
    """One table: the hash function of each node, and the node that each bucket of a function leads to."""

    def __init__(self, dim: int, rng: np.random.Generator):
        self.pool = rng.standard_normal((POOL, dim))
        self.rng = rng
        self.fn: list[int] = []
        self.b: list[float] = []
        self.w: list[float] = []
        self.low: list[int] = []
        self.kids: list[list[int]] = []  # node number, or -1 - leaf
        self.leaves = 0
        self.root = 0

    @classmethod
    def fit(cls, sample: np.ndarray, leaf: float, scale: float, rng: np.random.Generator, tries: int = 12) -> Tree:
        tree = cls(sample.shape[1], rng)
        tree.root = tree._grow(sample, leaf, scale, tries, 0)
        return tree.freeze()

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _node(self, fn: int, b: float, w: float, low: int) -> int:
        for listed, x in ((self.fn, fn), (self.b, b), (self.w, w), (self.low, low), (self.kids, [])):
            listed.append(x)
        return len(self.fn) - 1

    def _grow(self, x, leaf, scale, tries, depth) -> int:
        if len(x) <= leaf or depth >= 24:
            return self._leaf()
        best = None
        for fn in self.rng.integers(0, POOL, tries).tolist():
            p = x @ self.pool[fn]
            w = 1.5 * float(p.std())
            if w <= 1e-12:
                continue
            for b in self.rng.uniform(0, w, 4):
                at = (p + b) / w
                edge = np.abs(at - np.round(at)) * w
                code = np.floor(at)
                most = np.unique(code, return_counts=True)[1].max()
                # few points near a boundary, and no bucket that keeps nearly all
                bad = float((edge < scale).mean()) + (1.0 if most > 0.8 * len(x) else 0.0)
                if best is None or bad < best[0]:
                    best = (bad, fn, float(b), w)
        if best is None:
            return self._leaf()
        _, fn, b, w = best
        code = np.floor((x @ self.pool[fn] + b) / w).astype(np.int64)
        node = self._node(fn, b, w, int(code.min()))
        self.kids[node] = [self._grow(x[code == c], leaf, scale, tries, depth + 1) for c in range(int(code.min()), int(code.max()) + 1)]
        return node

    def split(self, stats: dict[int, tuple[int, int, float, float, float, float]]) -> bool:
        """Split leaves by (function, n, sum, sum of squares, least, greatest) of their vectors' projections; whether any could be."""
        parents = {k: (node, i) for node, kids in enumerate(self.kids) for i, k in enumerate(kids) if k < 0}
        done = False
        for leaf, (fn, n, total, squares, least, most) in stats.items():
            w = 1.5 * float(np.sqrt(max(0.0, squares / n - (total / n) ** 2)))
            if w <= 1e-9 * max(1.0, abs(least), abs(most)):
                continue
            b = float(self.rng.uniform(0, w))
            low, high = int(np.floor((least + b) / w)), int(np.floor((most + b) / w))
            if low == high:
                continue
            node = self._node(fn, b, w, low)
            # the first bucket keeps the number of the leaf
            self.kids[node] = [-1 - leaf] + [self._leaf() for _ in range(high - low)]
            if -1 - leaf in parents:
                above, i = parents[-1 - leaf]
                self.kids[above][i] = node
            else:
                self.root = node
            done = True
        self.freeze()
        return done

    def freeze(self) -> Tree:
        n = max(1, len(self.fn))
        self.FN, self.LOW = np.array(self.fn or [0]), np.array(self.low or [0])
        self.B, self.W = np.array(self.b or [0.0]), np.array(self.w or [1.0])
        self.LEN = np.array([len(k) for k in self.kids] or [1])
        self.KIDS = np.zeros((n, int(self.LEN.max())), np.int64)
        for i, k in enumerate(self.kids):
            self.KIDS[i, : len(k)] = k
        return self

    def order(self) -> list[int]:
        """The leaves from left to right, so that neighbours stand together."""
        out, stack = [], [self.root]
        while stack:
            x = stack.pop()
            if x < 0:
                out.append(-1 - x)
            else:
                stack += reversed(self.kids[x])
        return out

    def descend(self, x: np.ndarray, rows: np.ndarray, node: np.ndarray, margins: list | None = None) -> np.ndarray:
        """The leaf of each of ``rows`` of x below its node; margins collects (places, nodes, slots, down, up) of each level."""
        node = node.copy()
        while True:
            at_rows = np.flatnonzero(node >= 0)
            if not len(at_rows):
                return -node - 1
            at = node[at_rows]
            p = (np.einsum("ij,ij->i", x[rows[at_rows]], self.pool[self.FN[at]]) + self.B[at]) / self.W[at]
            slot = np.clip(np.floor(p).astype(np.int64) - self.LOW[at], 0, self.LEN[at] - 1)
            if margins is not None:
                rest = p - (slot + self.LOW[at])
                margins.append((at_rows, at, slot, np.abs(rest) * self.W[at], np.abs(1 - rest) * self.W[at]))
            node[at_rows] = self.KIDS[at, slot]

    def _crossings(self, margins: list, so_far: np.ndarray, reach: float):
        """(places, nodes beyond, scores) of all boundaries that may still be crossed."""
        places, nodes, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for r, at, slot, down, up in margins:
            for step, far in ((-1, down), (1, up)):
                total = so_far[r] + far * far
                ok = (slot + step >= 0) & (slot + step < self.LEN[at]) & (total < reach * reach)
                places.append(r[ok])
                nodes.append(self.KIDS[at[ok], slot[ok] + step])
                score.append(total[ok])
        return np.concatenate(places), np.concatenate(nodes), np.concatenate(score)

    def visits(self, x: np.ndarray, probes: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own leaf of each row, rows of the probes, leaves of the probes)."""
        every, margins = np.arange(len(x)), []
        own = self.descend(x, every, np.full(len(x), self.root, np.int64), margins)
        rows, nodes, score = self._crossings(margins, np.zeros(len(x)), reach)
        keep = _first(rows, score, probes)
        rows, nodes, score = rows[keep], nodes[keep], score[keep]
        # sets of two: below the boundary that was crossed another one is
        margins = []
        leaves = self.descend(x, rows, nodes, margins)
        at, more, both = self._crossings(margins, score, reach)
        rows2 = rows[at]
        merged_rows, merged = np.concatenate([rows, rows2]), np.concatenate([score, both])
        keep = _first(merged_rows, merged, probes)
        one, two = keep[keep < len(rows)], keep[keep >= len(rows)] - len(rows)
        return own, np.concatenate([rows[one], rows2[two]]), np.concatenate([leaves[one], self.descend(x, rows2[two], more[two])])


def _first(rows: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` least scores of each row."""
    order = np.lexsort((score, rows))
    ordered = rows[order]
    return order[np.arange(len(rows)) - np.searchsorted(ordered, ordered) < most]


def fit(sample: np.ndarray, total: int, tables: int, bucket: int, k: int, seed: int = 7) -> tuple[list[Tree], float]:
    """The trees, and the estimated distance of a k-th neighbour."""
    rng = np.random.default_rng(seed)
    some = sample[: min(500, len(sample))]
    sq = (sample**2).sum(1)
    d = np.sqrt(np.maximum(0, (some**2).sum(1)[:, None] + sq[None] - 2 * some @ sample.T))
    d.sort(axis=1)
    scale = float(np.median(d[:, min(k, d.shape[1] - 1)])) if len(some) else 0.0
    leaf = max(16.0, bucket * len(sample) / max(1, total))
    return [Tree.fit(sample, leaf, scale / 2, rng) for _ in range(tables)], scale


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def least(d: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` least of each row with their places, in no order; of equal ones at the bound those of the smaller places."""
    if d.shape[1] <= most:
        return d, np.broadcast_to(at, d.shape)
    near = np.argpartition(d, most - 1, axis=1)[:, :most]
    kept = np.take_along_axis(d, near, 1)
    bound = kept.max(1)
    tied = np.flatnonzero(((d <= bound[:, None]).sum(1) > most) & np.isfinite(bound))
    every = np.broadcast_to(at, d.shape)
    if len(tied):
        near[tied] = np.lexsort((every[tied], d[tied]), axis=1)[:, :most]
        kept[tied] = np.take_along_axis(d[tied], near[tied], 1)
    return kept, np.take_along_axis(every, near, 1)


def closer(queries: np.ndarray, index: np.ndarray, places: np.ndarray, d: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists (d, at) of the queries after a bucket: the least distances, but for the square of the query, and their places."""
    sq, most = (index**2).sum(1), d.shape[1]
    out_d, out_at = np.empty_like(d), np.empty_like(at)
    for a in range(0, len(queries), 512):
        b = slice(a, a + 512)
        near = least(sq[None] - 2 * (queries[b] @ index.T), places[None], most)
        out_d[b], out_at[b] = least(*(np.concatenate(pair, axis=1) for pair in zip((d[b], at[b]), near)), most)
    return out_d, out_at


def ranked(vec: np.ndarray, ids: np.ndarray, rows: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, ids) of the k nearest of the listed places by exact distance, then id; padded by inf and -1."""
    out_d, out_i = np.full((len(rows), k), np.inf), np.full((len(rows), k), -1, np.int64)
    for a in range(0, len(rows), 2048):
        b = slice(a, a + 2048)
        exact = np.where(at[b] >= 0, ((vec[rows[b], None, :] - vec[at[b]]) ** 2).sum(2), np.inf)
        found = np.where(at[b] >= 0, ids[at[b]], -1)
        best = np.lexsort((found, exact), axis=1)[:, :k]
        out_d[b], out_i[b] = np.take_along_axis(exact, best, 1), np.take_along_axis(found, best, 1)
    return out_d, out_i


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _buckets(vectors: DataFrame, sample: np.ndarray, total: int, k: int, dim: int, tables: int, probes: int, bucket: int):
    """(broadcast trees, reach, own and visiting vectors of each leaf by tree), no leaf of more than twice ``bucket`` if it can be split."""
    spark = vectors.sparkSession
    trees, scale = fit(sample, total, tables, bucket, k)
    reach = REACH * scale
    while True:
        sent = spark.sparkContext.broadcast(trees)  # one node for each few buckets, so below a thousandth of the vectors

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seen = [(np.zeros(t.leaves, np.int64), np.zeros(t.leaves, np.int64)) for t in sent.value]
            for batch in batches:
                x = _matrix(batch.column(1), dim)
                for t, (own_n, visit_n) in zip(sent.value, seen):
                    own, _, leaves = t.visits(x, probes, reach)
                    own_n += np.bincount(own, minlength=t.leaves)
                    visit_n += np.bincount(own, minlength=t.leaves) + np.bincount(leaves, minlength=t.leaves)
            for n, (own_n, visit_n) in enumerate(seen):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own_n), n)), pa.array(np.arange(len(own_n))), pa.array(own_n), pa.array(visit_n)], ["t", "leaf", "own", "visits"])

        counted = vectors.select("id", "vec").mapInArrow(count, "t long, leaf long, own long, visits long").groupBy("t", "leaf").agg(F.sum("own").alias("own"), F.sum("visits").alias("visits")).collect()
        sizes = [(np.zeros(t.leaves, np.int64), np.zeros(t.leaves, np.int64)) for t in trees]
        for r in counted:
            sizes[r.t][0][r.leaf], sizes[r.t][1][r.leaf] = r.own, r.visits
        large = [np.flatnonzero(own > 2 * bucket) for own, _ in sizes]
        if not any(map(len, large)):
            return sent, reach, sizes
        rng = np.random.default_rng(sum(t.leaves for t in trees))
        chosen = [np.full(t.leaves, -1) for t in trees]
        for fn, leaves in zip(chosen, large):
            fn[leaves] = rng.integers(0, POOL, len(leaves))

        def project(batches: Iterator[pa.RecordBatch], sent=sent, chosen=chosen) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), dim)
                for n, (t, fn) in enumerate(zip(sent.value, chosen)):
                    own = t.descend(x, np.arange(len(x)), np.full(len(x), t.root, np.int64))
                    rows = np.flatnonzero(fn[own] >= 0)
                    if len(rows):
                        p = pd.Series(np.einsum("ij,ij->i", x[rows], t.pool[fn[own[rows]]])).groupby(own[rows]).agg(["count", "sum", lambda s: (s * s).sum(), "min", "max"])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), n)), pa.array(p.index.to_numpy()), *[pa.array(p.iloc[:, c].to_numpy(float)) for c in range(5)]], ["t", "leaf", "n", "s", "s2", "a", "b"])

        measured = vectors.select("id", "vec").mapInArrow(project, "t long, leaf long, n double, s double, s2 double, a double, b double").groupBy("t", "leaf").agg(*[F.sum(c).alias(c) for c in ("n", "s", "s2")], F.min("a").alias("a"), F.max("b").alias("b")).collect()
        stats: list[dict] = [{} for _ in trees]
        for r in measured:
            stats[r.t][r.leaf] = (int(chosen[r.t][r.leaf]), r.n, r.s, r.s2, r.a, r.b)
        if not any([t.split(s) for t, s in zip(trees, stats)]):
            return sent, reach, sizes


def knn(vectors: DataFrame, k: int = 10, dim: int = 64, tables: int = 4, probes: int = 12, bucket: int = 500) -> DataFrame:
    """(id, near): the k nearest, itself among them, of each row of (id, vec, ask) with ask, as structs of (d, id) in order."""
    spark = vectors.sparkSession
    total = vectors.count()
    step = max(1, -(-total // SAMPLE))
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(step)) == 0).orderBy("id").limit(2 * SAMPLE).select("vec").toArrow()
    sample = _matrix(drawn.column(0).combine_chunks(), dim) if drawn.num_rows else np.zeros((0, dim))
    sent, reach, sizes = _buckets(vectors, sample, total, k, dim, tables, probes, bucket)
    # where each leaf is searched: with its neighbours, or alone in blocks
    plan = []
    for t, (own, visits) in zip(sent.value, sizes):
        of_index, of_query = np.maximum(1, -(-own // BLOCK)), np.maximum(1, -(-visits // BLOCK))
        group, at, filled = np.zeros(t.leaves, np.int64), 0, 0
        for leaf in t.order():
            alone = of_index[leaf] * of_query[leaf] > 1
            if alone or filled + own[leaf] + visits[leaf] > GROUP:
                at, filled = at + 1, 0
            group[leaf], filled = at, GROUP if alone else filled + own[leaf] + visits[leaf]
        plan.append((of_index, of_query, group))
    cut = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids, ask = _matrix(batch.column(1), dim), batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            every = np.arange(len(x))
            for n, t in enumerate(sent.value):
                own, rows, leaves = t.visits(x, probes, reach)
                of_index, of_query, group = cut.value[n]
                asked = ask[rows]
                q_rows, q_leaf = np.concatenate([every[ask], rows[asked]]), np.concatenate([own[ask], leaves[asked]])
                parts = []
                for role, r, leaf in ((0, every, own), (1, q_rows, q_leaf)):
                    mine, other = (of_index, of_query) if role == 0 else (of_query, of_index)
                    block, times = spread[r] % mine[leaf], other[leaf]
                    r, leaf, block = np.repeat(r, times), np.repeat(leaf, times), np.repeat(block, times)
                    turn = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
                    i, q = (block, turn) if role == 0 else (turn, block)
                    parts.append((((n << 24 | group[leaf]) << 16 | i) << 16 | q, r, np.where(role == 0, leaf, -1), np.where(role == 1, leaf, -1)))
                key, r, index, visit = (np.concatenate(c) for c in zip(*parts))
                # one row for each vector and task, with the leaf it lies in and those it visits there
                order = np.lexsort((visit, r, key))
                key, r, index, visit = key[order], r[order], index[order], visit[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (r[1:] != r[:-1])])
                first = np.flatnonzero(new)
                lies = np.maximum.reduceat(index, first)
                asks = visit >= 0
                lists = _lists(np.add.reduceat(asks.astype(np.int64), first), pa.array(visit[asks].astype(np.int32)))
                for a in range(0, len(first), 10_000):
                    some = pa.array(r[first[a : a + 10_000]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[first[a : a + 10_000]]), batch.column(0).take(some), pa.array(lies[a : a + 10_000].astype(np.int32)), lists.slice(a, 10_000), batch.column(1).take(some)],
                        ["key", "id", "leaf", "visits", "vec"],
                    )

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("id")
        vec, ids = _matrix(group.column("vec").combine_chunks(), dim), group.column("id").to_numpy()
        lies = group.column("leaf").to_numpy()
        lists = group.column("visits").combine_chunks()
        rows = np.repeat(np.arange(len(ids)), np.diff(np.asarray(lists.offsets)))
        leaves = lists.flatten().to_numpy()
        held, asked = np.argsort(lies, kind="stable"), np.argsort(leaves, kind="stable")
        lies, leaves = lies[held], leaves[asked]
        d, at = np.full((len(ids), k + SLACK), np.inf), np.full((len(ids), k + SLACK), -1, np.int64)
        for leaf in np.unique(leaves).tolist():
            own, q = held[slice(*np.searchsorted(lies, [leaf, leaf + 1]))], rows[asked[slice(*np.searchsorted(leaves, [leaf, leaf + 1]))]]
            if len(own):
                d[q], at[q] = closer(vec[q], vec[own], own, d[q], at[q])
        some = np.flatnonzero((at >= 0).any(1))
        d, near = ranked(vec, ids, some, at[some], k)
        keep = near >= 0
        n = keep.sum(1)
        return pa.table({"id": ids[some], "d": _lists(n, pa.array(d[keep])), "near": _lists(n, pa.array(near[keep]))})

    placed = vectors.select("id", "vec", "ask").mapInArrow(place, "key long, id long, leaf int, visits array<int>, vec array<float>")
    found = placed.groupBy("key").applyInArrow(search, "id long, d array<double>, near array<long>")
    merged = found.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list(F.arrays_zip(F.col("d"), F.col("near").alias("id"))))).alias("all"))
    # a neighbour found by several visits stands next to itself
    once = F.filter("all", lambda x, i: (i == 0) | (x != F.get("all", i - 1)))
    return merged.select("id", F.slice(once, 1, k).alias("near"))


def embeddings(rows: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec) of each id with a whole embedding."""
    vec = F.col(vec_col).cast("array<float>")
    whole = (F.size(vec) == dim) & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v))
    return rows.where(F.col(id_col).isNotNull()).where(whole).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vec).alias("vec"))


def nearest_lists(vectors: DataFrame, k: int = 10, dim: int = 64, **search) -> DataFrame:
    """(id, near): the k nearest others of each row of (id, vec), as structs of (d, id) in order. vectors is materialised."""
    total = vectors.count()
    # Spark limits the ranks before the exchange, so a vector with very many rows stays small there
    ranked = vectors.withColumn("rn", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("rn") <= k + 1)
    indexed = cut_lineage(ranked.select("id", "vec", (F.col("rn") == 1).alias("ask")))
    near = cut_lineage(knn(indexed, k + 1, dim, **search))
    # all other rows of a vector have the list of its first
    copied = vectors.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = join_groups(vectors, cut_lineage(copied), ["vec"], "n", total, "id").where("id <> rep").select("id", "rep", "n")
    lists = near.withColumnRenamed("id", "rep").join(copied.select("rep", "n"), "rep")
    theirs = join_groups(copies.drop("n"), lists, ["rep"], "n", total, "id").select("id", "near")
    return near.unionByName(theirs).select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))


def neighbour_pairs(rows: DataFrame, id_col: str = "memory_id", vec_col: str = "embedding", k: int = 10, dim: int = 64, **search) -> DataFrame:
    """(id_a, id_b): pairs of which either is among the k nearest of the other, the smaller id first."""
    vectors = cut_lineage(embeddings(rows, id_col, vec_col, dim))
    pairs = nearest_lists(vectors, k, dim, **search).select("id", F.explode("near.id").alias("other"))
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def recall(rows: DataFrame, id_col: str = "memory_id", vec_col: str = "embedding", k: int = 10, dim: int = 64, every: int = 100, **search) -> DataFrame:
    """(queries, wanted, found, recall): the lists of all ids divisible by ``every`` against exact search over all vectors."""
    from lodestone.operators.vector import knn as exact

    vectors = cut_lineage(embeddings(rows, id_col, vec_col, dim))
    stated = F.pmod("id", F.lit(every)) == 0
    got = nearest_lists(vectors, k, dim, **search).where(stated).select(F.col("id").alias("query_id"), F.explode("near.id").alias("id"))
    named = vectors.withColumnRenamed("vec", "embedding")
    true = exact(named, named.where(stated).withColumnRenamed("id", "query_id"), k + 1).where("id <> query_id")
    true = true.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k).select("query_id", "id")
    hits = true.join(got.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("wanted"), 6))
