import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import packing, tokens

ODD = [
    None,
    "",
    " ",
    "\n\n\t  ",
    "a",
    "Hello world",
    "don't  stop\n\nnow   please",
    "日本語のテキスト" * 400,
    "x" * 5000,
    "word " * 3000,
    "a b" + " " * 600 + "c d",
    "emoji 🙂👍🏽 flags 🇩🇪 <|endoftext|> end",
    " line sep \x85 x",
    "ends with space ",
    "1234567890 " * 500,
]


def ids_of(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk string")
    return {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, **options).collect()}


def test_odd_texts_are_encoded_exactly(spark):
    enc = tokens.encoder()
    got = ids_of(spark, ODD)
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(ODD)}


def test_small_chunks_and_copies_are_repaired_exactly(spark):
    rng = random.Random(3)
    words = ["alpha", "beta's", "gamma,", "δέλτα", "日本", "  ", "\n", "x" * 40, "1,204.50", "🙂"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 200))) for _ in range(120)]
    texts += texts[:40] + [texts[0] + " tail", "head " + texts[1]] + ["same text everywhere"] * 300
    enc = tokens.encoder()
    assert ids_of(spark, texts, chunk_bytes=32) == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_counts_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in tokens.count_tokens(df).collect())
    assert got == [(-1, 1), (1, 3), (1, 3), (2, 0)]
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_chunks_depend_on_content_only():
    data = "".join(chr(97 + (i * 7919) % 26) for i in range(5000)).encode()
    padded = lambda b: np.frombuffer(b + b"\0" * 16, np.uint8).copy()
    one = tokens.chunk_ends(padded(data), np.array([0, len(data)]), 64)
    two = tokens.chunk_ends(padded(b"prefix" + data), np.array([0, len(data) + 6]), 64)
    assert set(one) <= {x - 6 for x in two}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=200))
def test_assignment_respects_the_capacity(sizes):
    s = np.array(sorted(sizes, reverse=True))
    slot = packing.assign(s, 100)
    load = np.bincount(slot, weights=s)
    assert load.max() <= 100
    # no two containers could be merged but for the order they were filled in: first-fit quality
    assert len(load) <= 2 * -(-s.sum() // 100) + 1


def test_packing_places_each_text_once_and_cuts_only_oversized_ones(spark):
    rows = [(i, n) for i, n in enumerate([5000, 2048, 2047, 1, 0, 300] + [40] * 500)] + [(7, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long")).collect()
    load, parts = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.container_id] += r.n_tokens
        parts[r.doc_id].append((r.start_token, r.n_tokens))
    assert max(load.values()) <= 2048
    assert sorted(parts[0]) == [(0, 2048), (2048, 2048), (4096, 904)]
    assert all(len(v) == 1 for k, v in parts.items() if k not in (0,))
    assert 4 not in parts and sum(load.values()) == sum(n for _, n in rows if n)
    assert sum(load.values()) / (len(load) * 2048) > 0.9
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_chunks_of_very_many_texts_are_salted_and_exact(spark, monkeypatch):
    monkeypatch.setattr(tokens, "PLACES", 30)
    monkeypatch.setattr(tokens, "SAMPLE", 100)
    shared = " ".join(f"common{i}" for i in range(60))
    texts = [shared + f" tail {i}" if i % 3 == 0 else f"text {i} " * 5 for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    salts = tokens._salts(df, 64)
    assert salts and max(salts.values()) > 1
    enc = tokens.encoder()
    assert ids_of(spark, texts, chunk_bytes=64) == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_fill_of_containers(spark):
    packed = packing.pack(spark.createDataFrame([(i, 1000) for i in range(9)] + [(9, 48)], "doc_id long, n_tokens long"))
    assert tuple(packing.fill(packed).first()) == (5, 9048, round(9048 / 10240, 6), 5, 0)
    assert packing.fill(packed.limit(0)).first().containers == 0
