"""Names outside any list: vocabulary, abbreviations and spellings come from the rows themselves."""

from lodestone.llm import names
from tests.llm.test_pairs import same


def test_vocabulary_and_abbreviations_are_learnt(spark):
    rows = [
        ("Veldan Ceramics Ltd", "organization", None), ("Veldan Cer. Ltd", "organization", None), ("Veldan Ceram.", "organization", ["head office"]), ("Veldan Ceram.", None, None),
        ("Veldan Plumbing Inc", "organization", ["head office"]), ("Plumbing Veldan", "organization", None),
        ("Fort Oskarin", "place", None), ("Ft. Oskarin", "place", None), ("Oskarin, Fort", None, None),
    ]
    assert same(spark, rows) == {(a, b) for g in ((0, 1, 2, 3), (4, 5), (6, 7, 8)) for a in g for b in g if a < b}


def test_close_surnames_are_different_people(spark):
    rows = [("Robert Lane", "person", None)] * 2 + [("Robert Lake", "person", None)] * 2 + [("Robert Amber", "person", None), ("Robert Mbera", "person", None)]
    assert same(spark, rows) == {(0, 1), (2, 3)}


def test_frequent_spellings_stay_and_rare_ones_are_rewritten(spark):
    rows = [("Robert Johansson", "person", None)] * 6 + [("Robert Johanson", "person", None)] * 6 + [("Robert Johnansson", "person", None)]
    groups = ([*range(6), 12], range(6, 12))
    assert same(spark, rows) == {(a, b) for g in groups for a in g for b in g if a < b}


def test_parts_words_run_together_and_words_left_out(spark):
    rows = [("Nane Lukene Textiles", "organization", None), *[("Nanelukene Textiles", "organization", None)] * 2, ("Nane-lukene Textiles AG", "organization", None)]
    rows += [*[("Mirova Dental Care", "organization", None)] * 2, ("Mirova DentalCare", "organization", None), ("Mirova Dental", "organization", None), ("Mirova G.m.b.H.", "organization", None)]
    assert same(spark, rows) == {(a, b) for g in (range(4), range(4, 8)) for a in g for b in g if a < b}


def test_rarity_decides_between_readings(spark):
    # ten of eleven sure rows with an R are Robert: the initial is his; of a surname with two of each it is nobody's
    rows = [("Robert Toduzitapa", "person", None)] * 10 + [("Richard Toduzitapa", "person", None), ("R. Toduzitapa", "person", None)]
    rows += [("Robert Hufofukivo", "person", None)] * 2 + [("Richard Hufofukivo", "person", None)] * 2 + [("R. Hufofukivo", "person", None)]
    groups = ([*range(10), 11], (12, 13), (14, 15))
    assert same(spark, rows) == {(a, b) for g in groups for a in g for b in g if a < b}


def test_long_names_and_general_aliases(spark):
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400))
    rows = [(long, "organization", None), (long.upper(), "organization", None), ("y" * 50_000, "place", None), ("Y" * 50_000, "place", None)]
    rows += [("Alpha Tools", "organization", ["main office"]), ("Beta Tools", "organization", ["main office"])]
    assert same(spark, rows) == {(0, 1), (2, 3)}


def test_members_tell_the_entity_of_each_row(spark):
    rows = [("Robert Toduzitapa", "person", None), ("Toduzitapa, Bob", "person", None), ("Mount Sokapineve", "place", None), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, name string, entity_type string, aliases array<string>")
    forms = spark.createDataFrame([("Robert", "Bob")], "given_name string, short_form string")
    assert {tuple(r) for r in names.members(df, forms).collect()} == {(0, 0, 2), (1, 0, 2), (2, 2, 1)}


def test_recall_and_precision_on_generated_entities(spark):
    import random

    rng = random.Random(11)
    made = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n)).capitalize()

    def typo(w):
        i = rng.randrange(1, len(w) - 1)
        return rng.choice((w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + rng.choice("aeiou") + w[i:]))

    given = {"Robert": ["Bob", "Rob"], "Margaret": ["Peggy"], "Susannah": ["Sue"], "Harold": ["Hal"], "Deborah": ["Deb"], "Richard": ["Dick"]}
    trades, short = ["Carpentry", "Glassworks", "Drainage", "Upholstery", "Masonry"], ["Carp.", "Glassw.", "Drng", "Uph.", "Msnry"]
    rows, truth = [], []
    families, cores = [made(5) for _ in range(40)], [made(5) for _ in range(40)]
    for e, family in enumerate(families):
        for first in rng.sample(sorted(given), 2):
            nick = rng.choice(given[first])
            forms = [f"{first} {family}", f"{family}, {first}", f"{nick} {family}", f"{first} {typo(family)}", f"Dr. {first} Q. {family}", f"{first.upper()} {family.upper()}"]
            rows += [(f, "person", None) for f in forms]
            truth += [("p", family, first)] * len(forms)
    for core in cores:
        for t in rng.sample(range(5), 2):
            forms = [f"{core} {trades[t]} Ltd", f"{trades[t]} {core}", f"{core} {short[t]} Inc.", f"{typo(core)} {trades[t]} GmbH", f"the {core} {trades[t]} & Co", f"{core.lower()} {trades[t].lower()} limited"]
            rows += [(f, rng.choice(("organization", "organization", None)), None) for f in forms]
            truth += [("o", core, t)] * len(forms)
    got = same(spark, rows)
    want = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if truth[a] == truth[b]}
    assert len(got & want) >= 0.99 * len(want) and len(got & want) >= 0.99 * len(got), (len(want), len(got), len(got & want))
