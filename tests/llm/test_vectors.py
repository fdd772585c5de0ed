import random

import numpy as np

from lodestone.llm import vectors


def test_buckets_are_split_by_their_own_counts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SAMPLE", 40)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(1500, 4)) * 512) / 512
    df = spark.createDataFrame([(i, [float(c) for c in v], True) for i, v in enumerate(x)], "id long, vec array<float>, ask boolean")
    sent, _, sizes = vectors._buckets(df, x[:40], len(x), 5, 4, 2, 4, 20)
    for tree, (own, visits) in zip(sent.value, sizes):
        assert own.max() <= 40 and own.sum() == len(x) and sorted(tree.order()) == list(range(tree.leaves)) and (visits >= own).all()
    found = vectors.recall(df.withColumnRenamed("id", "memory_id").withColumnRenamed("vec", "embedding"), k=5, dim=4, every=10, tables=3, probes=12, bucket=60).first()
    assert found.queries == 150 and found.wanted == 750 and found.recall >= 0.97


def test_equal_vectors_cannot_be_split_and_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "GROUP", 30)
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(3)) for _ in range(2)]) for i in range(300)]
    df = spark.createDataFrame(rows, "memory_id long, embedding array<float>")
    got = {tuple(r) for r in vectors.neighbour_pairs(df, k=4, dim=2, bucket=5).collect()}
    assert got == brute(rows, 4)


def brute(rows, k):
    out = set()
    for a, x in rows:
        near = sorted((sum((p - q) ** 2 for p, q in zip(x, y)), b) for b, y in rows if b != a)[:k]
        out |= {(min(a, b), max(a, b)) for _, b in near}
    return out


def test_perturbation_sets_come_in_order_of_their_distance():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    tree = vectors.Tree.fit(x, 10, 0.1, rng)
    own, rows, leaves = tree.visits(x, 6, 10.0)
    assert np.bincount(rows, minlength=400).max() <= 6
    assert all(leaf != own[r] for r, leaf in zip(rows, leaves))
    # among the visits of two crossings some lead where one crossing does not
    _, few, one = tree.visits(x, 1, 10.0)
    assert set(zip(few.tolist(), one.tolist())) <= set(zip(rows.tolist(), leaves.tolist()))
