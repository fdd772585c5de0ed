import json
import random
import re

import numpy as np

from lodestone.llm import formatting, names, neardup, vectors


def brute_neighbours(rows, k):
    vec = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 4 and all(x is not None for x in v):
            vec[i] = min(vec.get(i, v), v)
    out = set()
    for a, x in vec.items():
        near = sorted((sum((p - q) ** 2 for p, q in zip(x, y)), b) for b, y in vec.items() if b != a)[:k]
        out |= {(min(a, b), max(a, b)) for _, b in near}
    return out


def test_neighbours_match_brute_force_with_copies_nulls_and_skew(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-6, 7)) for _ in range(4)]) for i in range(150)]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(80)]  # a third shares one vector
    rows += [(5, rows[5][1]), (2000, None), (2001, []), (2002, [1.0]), (None, [0.0] * 4), (2003, [1.0, None, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "memory_id long, embedding array<float>, rep string")
    got = {tuple(r) for r in vectors.neighbour_pairs(df, k=5, dim=4, bucket=40, probes=8).collect()}
    want = brute_neighbours(rows, 5)
    assert len(got & want) >= 0.97 * len(want) and got <= {(a, b) for a, b in got if a < b}
    exact = {tuple(r) for r in vectors.neighbour_pairs(df, k=5, dim=4).collect()}  # one bucket: exact
    assert exact == want


def test_neighbours_of_few_rows_and_of_none(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "memory_id long, embedding array<float>")
    assert [tuple(r) for r in vectors.neighbour_pairs(df, k=10, dim=2).collect()] == [(1, 2)]
    assert vectors.neighbour_pairs(df.limit(0), dim=2).count() == 0
    assert vectors.neighbour_pairs(df.limit(1), dim=2).count() == 0


def test_oversized_buckets_are_worked_off_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-50, 50, 4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "memory_id long, embedding array<float>")
    assert {tuple(r) for r in vectors.neighbour_pairs(df, k=3, dim=4).collect()} == brute_neighbours(rows, 3)


def test_similar_texts_match_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = rng.sample(vocabulary, rng.randrange(20, 60))
        texts.append(" ".join(base))
        for _ in range(2):
            edited = base[:]
            for _ in range(rng.randrange(0, 8)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rng.shuffle(edited)
            texts.append(" ".join(edited))
    texts += [None, "", "short text", texts[0], texts[0].upper() + "!", "ÄÖ " * 30, "word_with_underscore " * 30, "x" * 100_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, text string, words string")
    got = [tuple(r) for r in neardup.similar_pairs(df).collect()]
    sets = {i: set(re.findall(r"[^\W_]+", t.lower())) for i, t in enumerate(texts) if t}
    sets = {i: s for i, s in sets.items() if len(s) >= 20}
    want = {(a, b) for a in sets for b in sets if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and set(got) == want
    assert neardup.similar_pairs(df.limit(0)).count() == 0


def test_large_sets_of_copies_are_paired_with_their_first(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(i, text) for i in range(20)], "id long, text string")
    got = {tuple(r) for r in neardup.similar_pairs(df, expand=10).collect()}
    assert got == {(0, i) for i in range(1, 20)}


def test_copies_in_other_formatting(spark):
    rows = [
        "Hello, World!", "hello   world", "HELLO\nworld", "Hello Welt", None, "", "?!", "---",
        "name: Ann\ncity: Rome\njob: cook", "job=cook; city=rome; name=ANN;", '{"Name": "ann", "city": "Rome", "job": "cook"}', "name: Ann | city: Rome",
        '{"a": 1, "b": null}', '{"b": "", "A": "1"}', '{"a": 1', "a 1", "Straße", "STRASSE", "x" * 50_000, "X" * 50_000 + ".",
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "id long, text string, h1 int")
    got = {tuple(r) for r in formatting.copies(df).collect()}
    assert got == {(0, 1), (0, 2), (8, 9), (8, 10), (12, 13), (14, 15), (16, 17), (18, 19)}
    assert formatting.copies(df.limit(0)).count() == 0
    counts = {r.first_id: r.n_copies for r in formatting.records(df).collect()}
    assert counts[0] == 3 and counts[8] == 3 and counts[3] == 1


def test_what_is_an_object(spark):
    rows = ['{"a": 1}', '{"a": 1} {"b": 2}', "{'a': 1}", '{"a": "}x"}', '{"A": "x"}', '{"a": 1.50, "b": [1, {"c": 2}]}', '{"b": [1, {"c": 2}], "a": 1.50}']
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    assert {tuple(r) for r in formatting.copies(df).collect()} == {(3, 4), (5, 6)}


def test_hot_groups_of_copies_are_whole(spark, monkeypatch):
    from lodestone.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    rows = [(i, "the same") for i in range(60)] + [(100 + i, f"text {i}") for i in range(60)]
    got = {tuple(r) for r in formatting.copies(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {(0, i) for i in range(1, 60)}


FORMS = [("Robert", "Bob"), ("Robert", "Rob"), ("Richard", "Dick"), ("Susannah", "Sue"), ("Deborah", "Deb"), ("Margaret", "Peggy"), ("Harold", "Hal")]


def same(spark, rows):
    df = spark.createDataFrame([(i, n, t, a, "k") for i, (n, t, a) in enumerate(rows)], "id long, name string, entity_type string, aliases array<string>, kind string")
    forms = spark.createDataFrame(FORMS, "given_name string, short_form string")
    return {tuple(r) for r in names.same_entity(df, forms).collect()}


def test_people_under_many_spellings(spark):
    rows = [
        ("Robert Toduzitapa", "person", None), ("TODUZITAPA, BOB", "PERSON", []), ("Robrt Toduzitapa", None, None), ("Mr Robert C. Toduzi-Tapa", "unknown", ["client"]), ("Robert Toduzitápa", "person", None),
        ("Richard Toduzitapa", "person", None), ("R. Toduzitapa", "person", ["Dick"]), ("R.Toduzitapa", "person", None),
        ("Susannah Gofemevasu", "person", ["Sue Fezohuhuso"]), ("Susannah Fezohuhuso", "person", ["client"]), ("Fezohuhsuo Susannah", "person", []), (None, "person", ["Robert Toduzitapa"]), ("", "person", None),
    ]
    got = same(spark, rows)
    robert, richard, susannah = {0, 1, 2, 3, 4}, {5, 6}, {8, 9, 10}
    assert got == {(a, b) for group in (robert, richard, susannah) for a in group for b in group if a < b}


def test_organisations_and_places(spark):
    rows = [
        ("Kemotumuli Consulting Company", "organization", None), ("Kemotumuli Cons. & Co", "organization", None), ("the KEMOTMULI consulting", None, None), ("Consulting Kemotumuli Co.", "unknown", None),
        ("Kemotumuli Robotics GmbH", "organization", None), ("Kemotumuli Robo.", "organization", ["HQ"]),
        ("Port Sokapineve", "place", None), ("Pt. Sokapineve", "place", None), ("Sokapineve, Port", "unknown", None), ("Mount Sokapineve", "place", None), ("Sokapineve (North)", "place", None), ("N. Sokapineve", "place", None),
    ]
    groups = ({0, 1, 2, 3}, {4, 5}, {6, 7, 8}, {10, 11})
    assert same(spark, rows) == {(a, b) for g in groups for a in g for b in g if a < b}


def test_no_entities(spark):
    assert same(spark, [(None, None, None)]) == set()


def test_edits():
    assert names.edits("dosukebuke", "dosuekbuke") == 1 and names.edits("abc", "abd") == 1 and names.edits("abc", "xyz") == 3


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("z1", "z2")], "a string, b string")
    roots = {r.node: r.root for r in names.components(edges).collect()}
    assert {roots[f"n{i:02d}"] for i in range(21)} == {"n00"} and roots["z2"] == "z1"
    assert json.dumps(sorted(roots)[:1])
