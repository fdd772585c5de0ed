"""Pairs of groups larger than what is joined in one piece."""

import random

from lodestone.llm import names, neardup
from lodestone.operators import skew


def test_all_pairs_of_a_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(skew, "PAIR_ROWS", 7)
    rows = [("big", 40, i) for i in range(40)] + [("small", 3, i) for i in range(100, 103)] + [("one", 1, 200)]
    got = [tuple(r) for r in skew.pairs_within(spark.createDataFrame(rows, "k string, n long, id long"), "k", "n", "id").collect()]
    want = {(a, b) for g in (range(40), range(100, 103)) for a in g for b in g if a < b}
    assert len(got) == len(want) and set(got) == want


def test_large_entities_come_out_with_all_their_pairs(spark):
    spellings = ("Robert Toduzitapa", "TODUZITAPA, Robert", "Mr Robert Toduzitapa")
    rows = [(i, spellings[i % 3] + " " * (i // 3), "person", None) for i in range(1_101)]
    df = spark.createDataFrame(rows, "id long, name string, entity_type string, aliases array<string>")
    forms = spark.createDataFrame([("Robert", "Bob")], "given_name string, short_form string")
    found = names.same_entity(df, forms)
    assert found.count() == 1_101 * 1_100 // 2 and found.where("id_a >= id_b").count() == 0


def test_large_sets_of_equal_words_come_out_with_all_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(skew, "PAIR_ROWS", 90)
    monkeypatch.setattr(neardup, "PAIR_ROWS", 90)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.sample(base, 30)) for _ in range(270)] + [" ".join(base[:-1] + [x]) for x in ("x", "y")] + [" ".join(base)] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [tuple(r) for r in neardup.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) == len(texts) * (len(texts) - 1) // 2
    # with expand only the equal texts are one, here the last twenty, and stars tells which
    few = {tuple(r) for r in neardup.similar_pairs(df, expand=10).collect()}
    assert few == {(a, b) for a, b in got if b <= 272} | {(272, i) for i in range(273, 292)} | {(a, 272) for a in range(272)}
    assert {tuple(r) for r in neardup.stars(df, expand=10).collect()} == {(i, 272) for i in range(272, 292)}
    # taken apart again, they give all pairs
    first = {i: f if f is not None else i for i, f in ((r.id, r.first) for r in neardup.stars(df, expand=10).collect())}
    assert {(a, b) for a, b in got if (min(first.get(a, a), first.get(b, b)), max(first.get(a, a), first.get(b, b))) in few or first.get(a, a) == first.get(b, b)} == set(got)


def test_rows_with_none_of_the_known_readings_are_linked_to_each_other(spark):
    rows = [(1, "Margaret Rujamajasi"), (2, "Daniel Rujamajasi"), (3, "rujamajasi w."), (4, "W.Rujamajasi")]
    df = spark.createDataFrame([(i, n, "person", None) for i, n in rows], "id long, name string, entity_type string, aliases array<string>")
    forms = spark.createDataFrame([("William", "Bill"), ("Winifred", "Win"), ("Margaret", "Peggy"), ("Daniel", "Dan")], "given_name string, short_form string")
    assert [tuple(r) for r in names.same_entity(df, forms).collect()] == [(3, 4)]


def test_texts_of_one_template_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(skew, "PAIR_ROWS", 20)
    monkeypatch.setattr(neardup, "PAIR_ROWS", 20)
    frame = [f"t{i}" for i in range(60)]
    # a third of all texts share most of their words, and so the keys of many segments
    texts = [" ".join(frame + [f"own{i}"]) for i in range(80)] + [" ".join(f"x{i}y{j}" for j in range(30)) for i in range(160)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [tuple(r) for r in neardup.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(80) for b in range(a + 1, 80)}


def test_classes_and_links(spark):
    base = [f"w{i}" for i in range(40)]
    chain = [" ".join(base[i * 4 :] + [f"z{j}" for j in range(i * 4)]) for i in range(4)]
    texts = [chain[0], chain[0] + "!", *chain[1:], "too short", None, " ".join(f"q{i}" for i in range(25))]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, chain[0], 0)], "id long, text string, class_id int")
    got = {r.id: (r.class_id, r.links) for r in neardup.classes(df.where("id IS NOT NULL")).collect()}
    pairs = [tuple(r) for r in neardup.similar_pairs(df.where("id IS NOT NULL")).collect()]
    links = {i: sum(i in p for p in pairs) for i in range(len(texts))}
    assert {i: n for i, (_, n) in got.items()} == links
    assert {c for i, (c, _) in got.items() if i < 5} == {0} and [got[i] for i in (5, 6, 7)] == [(5, 0), (6, 0), (7, 0)]
