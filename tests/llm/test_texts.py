import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import splitting, truncation


def check_pieces(text, pieces, max_words=128, overlap=16):
    words = text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    at = 0
    for k, (first, size, piece) in enumerate(pieces):
        got = [w for w in piece.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        assert got == words[first : first + size] and size <= max_words
        assert first == (0 if k == 0 else at - overlap)
        at = first + size
    assert at == len(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 150), st.sampled_from([". ", "\n", "\n\n", "! ", " ", "?\r\n"])), min_size=1, max_size=12))
def test_pieces_cover_the_text_with_overlap(parts):
    text = "".join(" ".join(["word"] * n) + sep for n, sep in parts)
    pieces, forced = splitting.split(text)
    check_pieces(text, pieces)
    stretches = [s.split() for s in text.replace(". ", ".\n").replace("! ", "!\n").replace("\r", "\n").split("\n")]
    assert forced == any(len(s) > 128 for s in stretches)


def test_natural_boundaries_are_preferred():
    text = " ".join(["a b c d e f g h i."] * 60)
    for first, size, piece in splitting.split(text)[0]:
        assert piece.endswith("i.")


def test_split_texts_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "w " * 128), (4, "w " * 129), (5, ("x y. " * 40 + "\n") * 3), (4, "w " * 129), (6, " \t\n" * 300), (7, "v " * 400)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "id long, text string, piece int")
    got = splitting.split_texts(df).collect()
    assert {(r.id, r.forced) for r in got} == {(4, 1), (5, 0)}
    assert sum(r.id == 4 for r in got) == 4
    assert splitting.split_texts(df.limit(0)).count() == 0


def sentences(rng, n):
    names = ["Anna", "Bertram", "Clementine", "Dorothea"]
    things = ["umbrella", "telescope", "wallet", "mattress", "lantern", "calendar"]
    return " ".join(f"{rng.choice(names)} lent the {rng.choice(things)} to {rng.choice(names)} before {rng.randrange(1, 28)} March." for _ in range(n))


def test_cut_texts_are_found(spark):
    rng = random.Random(4)
    rows, cut = [], set()
    for i in range(1500):
        text, source = sentences(rng, rng.randrange(2, 9)), f"s{i % 3}"
        if source == "s0" and len(text) > 200:
            text = text[:200]
            if text.rstrip()[-1] != ".":
                cut.add(i)
        elif i % 29 == 0:
            text = text[: rng.randrange(30, len(text) - 2)].rstrip()
            if text[-1] != ".":
                cut.add(i)
        rows.append((i, text, source, 1.0))
    rows += [(5000, None, "s0", 1.0), (5001, "", None, 1.0), (5002, "  \n", "s1", 1.0), (5003, sentences(rng, 3), None, 1.0), (5004, "x" * 60_000, "s2", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, p double")
    got = {r.doc_id for r in truncation.score(df).where("p >= 0.5").collect()} - {5004}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.05 * len(cut)
    report = {r.source: r for r in truncation.by_source(df).collect()}
    assert report["s0"].share > 0.5 > report["s1"].share and report[None].n == 2
    assert truncation.score(df.limit(0)).count() == 0


def test_limits_in_characters_and_bytes(spark):
    rows = [("c", "a" * 50 + str(i % 10)) for i in range(30)] + [("c", "b" * i) for i in range(1, 45)]
    rows += [("n", "d" * i) for i in range(1, 60)]
    rows += [("b", ("é" * (i % 20) + "a" * 100).encode()[:90].decode("utf-8", "ignore")) for i in range(40)]
    found = {r.source: (r.chars, r.bytes) for r in truncation.limits(spark.createDataFrame(rows, "source string, text string")).collect()}
    assert found["c"] == (51, None) and found["n"] == (None, None) and found["b"][1] == 90


def test_word_counts_leave_closing_words_out(spark):
    df = spark.createDataFrame([("the cat sat",), ("the cat",), ("",), (None,)], "text string")
    got = {r.word: r.n for r in truncation.word_counts(df.where("text IS NOT NULL")).collect()}
    key = lambda w: truncation.word_hash(w) >> 1
    assert got == {key(b"the"): 2, key(b"cat"): 1}
    assert np.isfinite(truncation.fit(np.zeros((4, 2), int), np.array([0.0, 1.0, 0.0, 1.0]), rounds=3)).all()
