"""Rows that name the same person, organisation or place under different spellings.

Method: canonical rewriting. Every name and alias is parsed into words (case and accents folded) and rewritten by rules:

* titles, articles, legal forms (``Inc``, ``& Co``, ``G.m.b.H.``) and middle initials are dropped;
* token order: a person is a given name and a surname in any order, an organisation or
  place is a set of words in any order;
* a given name becomes all full names it may stand for: itself, those whose short
  form it is, those it begins (``Ken.``, ``K.``), or the one it is a misspelling of;
* the parts of a divided word are joined, and words run together divided, whichever is rarer;
* a misspelt word becomes the more frequent spelling that is one edit (from eight
  letters on two edits) away; spellings are found by an equi-join of their forms with
  letters left out. A spelling that is itself frequent is never rewritten;
* an abbreviation (``Hdw``, ``Cons.``, ``Jct``) becomes the longer word that holds its
  letters in order and stands beside the same other words elsewhere in the corpus;
* a word may be left out (``Dental`` for ``Dental Care``), if two words are left.

Nothing but the short forms of given names, titles, articles and legal forms is given:
the vocabulary, the spellings and the abbreviations are those of the corpus.

The exploded forms meet in equi-joins. A rewriting is scored by its rarity: of all rows
whose name has this rewriting, the share that has the canonical name in question. A form
that several canonical names share says little and is not linked; one that only one of
them has (a share of SURE or more) is. The forms of a row narrow each other down (an
alias ``Hal`` tells what ``H.`` means), and a row that has two canonical names joins them.

All pairs within an entity come out; those of a large one are made by blocks of its rows.

Defined cases: rows with a null name are in no pair; null and empty aliases are ignored,
and so are general ones: those of a person without a known given name, those of
others that do not hold the rarest word of the name. An unknown type is inferred from
the words of rows of known type. Words of more than MOST_LETTERS letters are not respelt, and names
of more than MOST_WORDS words are only compared as wholes. Equal names are the same entity.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.skew import join_groups, pairs_within
from lodestone.session import cut_lineage

TITLES = {"mr", "mrs", "ms", "mx", "miss", "dr", "prof", "professor", "sir", "rev", "hon", "jr", "sr", "phd", "md"}
LEGAL = {"inc", "incorporated", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "llc", "plc", "llp", "ag", "kg", "bv", "nv"}
FILLERS = {"the", "and", "of", "for", "und", "et", "y"}
KINDS = ("person", "organization", "place")
#: A reading counts if it has at least this share of the rows that a form may stand for.
SURE = 0.9
#: Longer words are not respelt, names of more words not rewritten word by word.
MOST_LETTERS, MOST_WORDS = 40, 16
#: Most short forms of given names that are sent to all executors.
MOST_FORMS = 200_000
#: Least share of its contexts in which an undotted abbreviation must meet the word it stands for.
ABBREVIATED = 0.3

_TOKEN = re.compile(r"[a-z]+\.?")
_INITIALS = re.compile(r"\b(?:[a-z]\.){2,}[a-z]?\b\.?")


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def deletions(word: str, most: int) -> set[str]:
    """The word and what is left of it without up to ``most`` letters."""
    out, edge = {word}, {word}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return out


def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


class Words:
    """A vocabulary with look-up of misspellings."""

    def __init__(self, words):
        self.known = set(words)
        self.near: dict[str, set[str]] = defaultdict(set)
        for w in self.known:
            for d in deletions(w, 1):
                self.near[d].add(w)

    def misspelt(self, token: str) -> str | None:
        """The word that the token is one edit away from."""
        if not 4 <= len(token) <= MOST_LETTERS:
            return None
        found = {w for d in deletions(token, 1) for w in self.near.get(d, ()) if len(w) > 3 and edits(token, w, 1) <= 1}
        return min(found) if found else None


class Rules:
    """The rewriting rules of given names and legal forms, with the table of short forms in use."""

    def __init__(self, forms: list[tuple[str, str]]):
        self.short: dict[str, set[str]] = defaultdict(set)
        self.full: set[str] = set()
        for given, short in forms:
            if given:
                self.full.add(fold(given))
                if short:
                    self.short[fold(short)].add(fold(given))
        self.starts: dict[str, set[str]] = defaultdict(set)
        for g in self.full:
            for i in range(1, len(g) + 1):
                self.starts[g[:i]].add(g)
        for s, gs in self.short.items():
            for i in range(2, len(s) + 1):
                self.starts[s[:i]] |= gs
        self.given_words, self.short_words, self.legal = Words(self.full), Words(self.short), Words(LEGAL)

    def given(self, token: str, dot: bool) -> tuple[int, set[str]] | None:
        """(rank, full names) that a token may stand for as a given name; a low rank is a sure one."""
        if token in self.full:
            return 0, {token}
        if len(token) > 1 and dot and (found := self.short.get(token, set()) | self.starts.get(token, set())):
            return 1, set(found)
        if token in self.short:
            return 1, set(self.short[token])
        if near := self.given_words.misspelt(token):
            return 2, {near}
        if len(token) == 1:
            return 3, set(self.starts.get(token, ())) or {token}
        if near := self.short_words.misspelt(token):
            return 4, set(self.short[near])
        return None

    def person(self, folded: str) -> tuple[str, list[str], int] | None:
        """(surname, given names it may be, rank); None if there are no two parts."""
        comma, right = folded.partition(",")[1:]
        tokens = [(t.rstrip("."), t.endswith(".")) for t in _TOKEN.findall(folded)]
        tokens = [t for t in tokens if t[0] not in TITLES]
        behind = {t.rstrip(".") for t in _TOKEN.findall(right)} if comma else None
        if len(tokens) < 2:
            return None
        best = None
        for i, (token, dot) in enumerate(tokens[:MOST_WORDS]):
            if behind is not None and token not in behind:
                continue
            found = self.given(token, dot)
            if found and (best is None or found[0] < best[0]):
                best = (found[0], i, found[1])
        if best is None:
            i = len(tokens) - 1 if comma else 0
            best = (9, i, {tokens[i][0]})
        core = "".join(t for k, (t, _) in enumerate(tokens) if k != best[1] and len(t) > 1)
        return (core, sorted(best[2]), best[0]) if core else None

    def thing(self, folded: str) -> tuple[list[str], bool]:
        """(words, whether there is a legal form) of an organisation or place; a word keeps its dot."""
        joined = _INITIALS.sub(lambda m: x if (x := m.group().replace(".", "")) in LEGAL else m.group(), folded)
        joined = re.sub(r"(?<=[a-z])-(?=[a-z])", "", joined)
        words, legal = [], False
        for t in _TOKEN.findall(joined):
            bare = t.rstrip(".")
            if bare in LEGAL or len(bare) > 5 and self.legal.misspelt(bare):
                legal = True
            elif bare not in FILLERS:
                words.append(t)
        return words, legal


_FORM = "id long, n int, typed string, legal boolean, words array<string>, core string, may array<string>, rank int"


def forms(entities: DataFrame, rules, id_col: str, name_col: str, type_col: str, alias_col: str) -> DataFrame:
    """(id, n, typed, legal, words, core, may, rank): the parsed forms of each row; n is 0 for its name.

    words are those of an organisation or place; core and may the surname and given names of a person.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Rules = rules.value
        for pdf in batches:
            out = []
            for i, name, typed, aliases in zip(pdf["id"], pdf["name"], pdf["kind"], pdf["aliases"]):
                typed = (typed or "").strip().lower()
                hints, texts = [], [name]
                for a in aliases if aliases is not None else []:
                    tokens = _TOKEN.findall(fold(a)) if a else []
                    # a lone given name among the aliases narrows the given name of the others
                    if len(tokens) == 1:
                        found = own.given(tokens[0].rstrip("."), tokens[0].endswith("."))
                        if found and found[0] <= 1:
                            hints.append(found[1])
                    elif tokens:
                        texts.append(a)
                for n, text in enumerate(texts):
                    folded = fold(text).replace("&", " and ").replace("'", "")
                    person = own.person(folded)
                    # general aliases have no given name in them
                    if n and person and (person[2] > 4 or person[2] == 3 and len(person[1]) == 1 and person[1][0] not in own.full):
                        person = None
                    core, may, rank = person or (None, [], None)
                    for h in hints:
                        may = sorted(set(may) & h) or may
                    words, legal = own.thing(folded)
                    out.append((i, n, typed if typed in KINDS else None, legal, words, core, may, rank))
            yield pd.DataFrame(out, columns=["id", "n", "typed", "legal", "words", "core", "may", "rank"]).astype({"rank": "Int32"})

    rows = entities.where(F.col(name_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(name_col).cast("string").alias("name"), F.col(type_col).cast("string").alias("kind"), F.col(alias_col).cast("array<string>").alias("aliases")
    )
    return rows.mapInPandas(run, _FORM)


def _bare(word: Column) -> Column:
    return F.rtrim(word, F.lit("."))


def kinds(parsed: DataFrame, total: int) -> DataFrame:
    """(id, kind): the stated kind; else organisation if there is a legal form; else the kind whose rows have the words of this one."""
    rows = parsed.groupBy("id").agg(F.max("typed").alias("typed"), F.max("legal").alias("legal"), F.min("rank").alias("rank"))
    rows = rows.withColumn("kind", F.coalesce("typed", F.when(F.col("legal"), F.lit("organization"))))
    sure = rows.where("kind IS NOT NULL").select("id", "kind")
    words = parsed.select("id", "n", F.explode(F.transform(F.slice("words", 1, MOST_WORDS), _bare)).alias("word"))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    known = words.where("n = 0").join(sure, "id").groupBy("word").agg(F.count("*").alias("size"), *counts)
    open_rows = rows.where("kind IS NULL").select("id", "rank")
    seen = join_groups(words.join(open_rows, "id"), known, ["word"], "size", total, "id")
    evidence = seen.groupBy("id").agg(*[F.sum(F.log((F.col(k) + 0.1) / (F.col("size") + 0.3))).alias(k) for k in KINDS])
    told = open_rows.join(evidence, "id", "left")
    # a given name speaks for a person
    person = F.coalesce("person", F.lit(0.0)) + F.when(F.col("rank") <= 2, 2.0).otherwise(0.0)
    score = F.greatest(F.struct(person.alias("s"), F.lit(2), F.lit("person").alias("kind")), *[F.struct(F.coalesce(k, F.lit(0.0)).alias("s"), F.lit(i), F.lit(k).alias("kind")) for i, k in enumerate(KINDS[1:])])
    return sure.unionByName(told.select("id", score["kind"].alias("kind")))


def spellings(counted: DataFrame) -> DataFrame:
    """(kind, word, n, best): for each word the frequent spelling it is a misspelling of, else itself.

    Edits allowed: none below 3 letters, 1 below 8, else 2. A spelling is only rewritten if it is rare beside
    the other one: of 3 letters a twentieth as frequent, then a quarter, from 8 letters on a third; from 6
    letters on also if it is that of one row, from 8 letters on of two.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, w in zip(pdf["kind"], pdf["word"]):
                most = 0 if len(w) < 3 or len(w) > MOST_LETTERS else 1 if len(w) < 8 else 2
                out += [(f"{k}|{d}", w) for d in deletions(w, most)]
            yield pd.DataFrame(out, columns=["form", "word"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = []
            for a, b in zip(pdf["id_a"], pdf["id_b"]):
                most = 1 if min(len(a), len(b)) < 8 else 2
                near.append(edits(a, b, most) <= most)
            yield pdf[near]

    # one explosion serves the sizes of the forms and their pairs; alone-standing forms fall away
    exploded = cut_lineage(counted.select("kind", "word").mapInPandas(explode, "form string, word string"))
    sizes = exploded.groupBy("form").agg(F.count("*").alias("n")).where("n > 1")
    met = join_groups(exploded, sizes, ["form"], "n", exploded.count(), "word")
    pairs = pairs_within(met, "form", "n", "word", "form").select(F.substring_index("form", "|", 1).alias("kind"), "id_a", "id_b").distinct()
    near = pairs.mapInPandas(verify, "kind string, id_a string, id_b string")
    both = near.select("kind", F.col("id_a").alias("word"), F.col("id_b").alias("other")).unionByName(near.select("kind", F.col("id_b").alias("word"), F.col("id_a").alias("other")))
    both = both.join(counted.select("kind", "word", "n"), ["kind", "word"]).join(counted.select("kind", F.col("word").alias("other"), F.col("n").alias("m")), ["kind", "other"])
    size = F.least(F.length("word"), F.length("other"))
    rare = F.when(size < 4, F.col("n") * 20 <= F.col("m")).when(size < 6, F.col("n") * 4 <= F.col("m")).when(size < 8, F.col("n") <= F.greatest(F.lit(1), F.col("m") / 4)).otherwise(F.col("n") <= F.greatest(F.lit(2), F.col("m") / 3))
    better = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("word")))
    best = both.where(rare & better).groupBy("kind", "word").agg(F.max_by("other", F.struct("m", "other")).alias("best"))
    step = cut_lineage(counted.join(best, ["kind", "word"], "left").select("kind", "word", "n", F.coalesce("best", "word").alias("best")))
    # a misspelling of a misspelling
    onward = step.select("kind", F.col("word").alias("best"), F.col("best").alias("further")).where("best <> further")
    return step.join(onward, ["kind", "best"], "left").select("kind", "word", "n", F.coalesce("further", "best").alias("best"))


def abbreviations(names: DataFrame) -> DataFrame:
    """(kind, ctx, t, w): what the abbreviation ``t`` beside the word ``ctx`` stands for, learnt from (kind, words).

    A longer word that holds the letters of ``t`` in order is a candidate if it stands beside the same word
    somewhere. Its rarity score is its share of all contexts that ``t`` has in common with any candidate.
    """
    beside = names.select("kind", F.explode("words").alias("ctx"), "words").select("kind", "ctx", F.explode("words").alias("word")).where("ctx <> word").distinct()
    beside = cut_lineage(beside.withColumns({"bare": _bare(F.col("word")), "first": F.substring("word", 1, 1)}))
    dotted = F.endswith("word", F.lit("."))
    vowels = F.length("bare") - F.length(F.translate("bare", "aeiou", ""))
    short = beside.where(dotted | ((vowels <= 1) & F.length("bare").between(2, 5))).select("kind", "ctx", "first", F.col("word").alias("t"), F.col("bare").alias("bt"))
    whole = beside.where(~dotted & (F.length("word") > 2)).select("kind", "ctx", "first", F.col("word").alias("w"))
    inside = F.rlike("w", F.concat(F.lit("^"), F.regexp_replace("bt", "(.)", "$1.*")))
    meet = cut_lineage(short.join(whole, ["kind", "ctx", "first"]).where((F.length("w") > F.length("bt")) & inside).select("kind", "ctx", "t", "bt", "w"))
    support = meet.groupBy("kind", "t", "bt", "w").agg(F.count("*").alias("s"))
    met = support.groupBy("kind", "t").agg(F.sum("s").alias("all"))
    seen = short.groupBy("kind", "t").agg(F.count("*").alias("contexts"))
    share = F.col("s") / F.col("all") + F.when(F.startswith("w", "bt"), 0.05).otherwise(0.0)
    known = support.join(met, ["kind", "t"]).join(seen, ["kind", "t"]).where(F.endswith("t", F.lit(".")) | (F.col("s") >= ABBREVIATED * F.col("contexts"))).select("kind", "t", "w", share.alias("share"))
    here = meet.select("kind", "ctx", "t", "w", F.lit(1.0).alias("here"))
    scored = short.join(known, ["kind", "t"]).join(here, ["kind", "ctx", "t", "w"], "left").withColumn("score", F.col("share") * F.coalesce("here", F.lit(0.2)))
    return scored.groupBy("kind", "ctx", "t").agg(F.max(F.struct("score", "w")).alias("x")).select("kind", "ctx", "t", "x.w", "x.score")


def canonical(names: DataFrame, spelt: DataFrame, total: int) -> DataFrame:
    """(kind, raw, words): the canonical words of each distinct (kind, raw) of organisations and places.

    raw holds the words as typed; names of more than MOST_WORDS words keep them.
    """
    few = names.where(F.size("raw") <= MOST_WORDS)
    each = few.select("kind", "raw", "rows", F.posexplode("raw").alias("pos", "word"))
    after = F.lead("word").over(Window.partitionBy("kind", "raw").orderBy("pos"))
    each = cut_lineage(each.withColumn("after", after).withColumn("both", F.concat("word", "after")).withColumn("salt", F.xxhash64("raw")))
    respelt = spelt.select("kind", "word", "n", "best")
    own = join_groups(each.select("kind", "raw", "pos", "word", "salt"), respelt, ["kind", "word"], "n", total, "salt").select("kind", "raw", "pos", F.col("best").alias("one"))
    # two words and the same letters as one word: what is rarer becomes the other
    pairs = each.where("both IS NOT NULL").groupBy("kind", F.col("both").alias("word")).agg(F.sum("rows").alias("pairs"), F.max(F.struct("rows", "word", "after")).alias("x"))
    pairs = pairs.join(respelt, ["kind", "word"]).select("kind", "word", "pairs", "n", F.when(F.col("n") >= F.col("pairs"), F.col("best")).alias("joined"), F.array("x.word", "x.after").alias("parts"))
    whole = join_groups(each.where("both IS NOT NULL").select("kind", "raw", "pos", F.col("both").alias("word"), "salt"), pairs.where("joined IS NOT NULL"), ["kind", "word"], "pairs", total, "salt").select("kind", "raw", "pos", "joined")
    parted = join_groups(each.select("kind", "raw", "pos", "word", "salt"), pairs.where("joined IS NULL"), ["kind", "word"], "n", total, "salt").select("kind", "raw", "pos", "parts")
    on = ["kind", "raw", "pos"]
    mapped = each.join(own, on, "left").join(whole, on, "left").join(parted, on, "left")
    parts = F.when(F.col("joined").isNotNull(), F.array("joined")).when(F.col("parts").isNotNull(), F.col("parts")).otherwise(F.array(F.coalesce("one", "word")))
    listed = mapped.groupBy("kind", "raw").agg(F.sort_array(F.collect_list(F.struct("pos", parts.alias("parts"), F.col("joined").isNotNull().alias("two")))).alias("all"))
    # the second part of a joined word goes
    left = F.filter("all", lambda x, i: (i == 0) | ~F.coalesce(F.get("all", i - 1)["two"], F.lit(False)))
    spelled = cut_lineage(listed.select("kind", "raw", F.array_distinct(F.flatten(F.transform(left, lambda x: x["parts"]))).alias("words")))
    means = abbreviations(spelled)
    pieces = spelled.select("kind", "raw", F.explode("words").alias("t"), "words").select("kind", "raw", "t", F.explode("words").alias("ctx")).where("t <> ctx")
    full = pieces.join(means, ["kind", "ctx", "t"]).groupBy("kind", "raw", "t").agg(F.max(F.struct("score", "w")).alias("x"))
    full = full.groupBy("kind", "raw").agg(F.map_from_entries(F.collect_list(F.struct("t", "x.w"))).alias("means"))
    done = spelled.join(full, ["kind", "raw"], "left")
    words = F.array_sort(F.array_distinct(F.transform("words", lambda w: F.coalesce(F.col("means")[w], _bare(w)))))
    long = names.where(F.size("raw") > MOST_WORDS).select("kind", "raw", F.array_sort(F.array_distinct(F.transform("raw", _bare))).alias("words"))
    return done.select("kind", "raw", words.alias("words")).unionByName(long)


def completed(counted: DataFrame) -> DataFrame:
    """(kind, words, whole): names (kind, words, n) with a word left out, and the one longer name they stand for."""
    longer = counted.where(F.size("words").between(3, MOST_WORDS)).select("kind", F.col("words").alias("whole"), F.col("n").alias("m"))
    gaps = longer.select("kind", "whole", "m", F.explode("whole").alias("gone")).select("kind", "whole", "m", F.array_remove("whole", F.col("gone")).alias("words"))
    met = counted.join(gaps, ["kind", "words"]).groupBy("kind", "words", "n").agg(F.max(F.struct("m", "whole")).alias("x"), F.sum("m").alias("all"))
    return met.where((F.col("x.m") >= SURE * F.col("all")) & (F.col("n") <= 2 * F.col("x.m"))).select("kind", "words", F.col("x.whole").alias("whole"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's connected component, by hash-to-minimum rounds."""
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        over = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = roots.join(over, "node").join(jump, "root", "left")
        after = cut_lineage(after.select("node", F.least("root", "seen", F.coalesce("top", "root")).alias("root"), F.col("root").alias("old")))
        moved = after.where("root <> old").limit(1).count()
        roots = after.select("node", "root")
        if not moved:
            return roots


def _people(parsed: DataFrame, spelt: DataFrame, total: int) -> DataFrame:
    """(id, key, one): the surname and given name of each person's row, in canonical spelling."""
    spelt = spelt.where("kind = 'person'").select(F.col("word").alias("core"), F.col("n").alias("size"), "best")
    same = join_groups(parsed.where("core IS NOT NULL").select("id", "n", "core", "may"), spelt, ["core"], "size", total, "id").select("id", "n", F.col("best").alias("core"), "may")
    # narrow the readings of one row and surname down, its name first
    listed = same.groupBy("id", "core").agg(F.sort_array(F.collect_list(F.struct("n", "may"))).alias("all"))
    empty = F.array().cast("array<string>")

    def narrower(acc, x):
        both = F.array_intersect(acc, x["may"])
        return F.when(F.size(acc) == 0, x["may"]).when(F.size(both) > 0, both).otherwise(acc)

    rows = cut_lineage(listed.select("id", "core", F.aggregate("all", empty, narrower).alias("may")))
    # how many rows of a surname have which given name beyond doubt
    sure = rows.where(F.size("may") == 1).groupBy("core", F.get("may", F.lit(0)).alias("one")).agg(F.count("*").alias("n"))
    known = rows.groupBy("core").agg(F.count("*").alias("size")).join(sure.groupBy("core").agg(F.map_from_entries(F.collect_list(F.struct("one", "n"))).alias("known")), "core", "left")
    met = join_groups(rows, known, ["core"], "size", total, "id")
    # rarity: of the rows of this surname that the form may stand for, the share of each reading
    readings = F.filter(F.transform("may", lambda m: F.struct(F.coalesce(F.col("known")[m], F.lit(0)).alias("n"), m.alias("m"))), lambda x: x["n"] > 0)
    best = F.array_max(readings)
    among = F.aggregate(readings, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    one = (
        F.when(F.size("may") == 1, F.get("may", F.lit(0)))
        .when(F.size(readings) == 0, F.concat_ws("/", F.lit("?"), F.col("may")))
        .when(best["n"] >= SURE * among, best["m"])
    )
    return met.select("id", F.concat_ws("|", F.lit("person"), "core", one).alias("key"), one.alias("one")).where("one IS NOT NULL")


def _things(parsed: DataFrame, spelt: DataFrame, total: int) -> DataFrame:
    """(id, key, one): the canonical words of each organisation's or place's forms."""
    rows = parsed.where((F.size("words") > 1) | (F.col("n") == 0)).select("id", "n", "kind", F.col("words").alias("raw"))
    names = cut_lineage(rows.groupBy("kind", "raw").agg(F.count("*").alias("rows")))
    told = cut_lineage(names.join(canonical(names, spelt, total), ["kind", "raw"]))
    forms_of = cut_lineage(join_groups(rows, told, ["kind", "raw"], "rows", total, "id").select("id", "n", "kind", "words").where(F.size("words") > 0))
    # an alias must hold the rarest word of its row's name
    often = told.select("kind", F.explode("words").alias("word"), "rows").groupBy("kind", "word").agg(F.sum("rows").alias("often"))
    rarest = told.select("kind", "words", F.explode("words").alias("word")).distinct().join(often, ["kind", "word"]).groupBy("kind", "words").agg(F.min(F.struct("often", "word")).alias("x"), F.sum("often").alias("bound"))
    named = join_groups(forms_of.where("n = 0"), rarest.select("kind", "words", F.col("x.word").alias("rarest"), "bound"), ["kind", "words"], "bound", total, "id").select("id", "rarest")
    kept = forms_of.join(named, "id").where((F.col("n") == 0) | F.array_contains("words", F.col("rarest"))).select("id", "kind", "words").distinct()
    counted = cut_lineage(kept.groupBy("kind", "words").agg(F.count("*").alias("n")))
    wholes = counted.join(completed(counted), ["kind", "words"], "left")
    read = join_groups(kept, wholes, ["kind", "words"], "n", total, "id").select("id", "kind", F.coalesce("whole", "words").alias("words"))
    return read.select("id", F.concat_ws("|", "kind", F.concat_ws(" ", "words")).alias("key"), F.lit("").alias("one")).distinct()


def resolve(
    entities: DataFrame, short_forms: DataFrame, id_col: str = "id", name_col: str = "name", type_col: str = "entity_type", alias_col: str = "aliases"
) -> DataFrame:
    """(id, entity): the entity of each row whose name could be resolved. short_forms: (given_name, short_form), at most MOST_FORMS rows."""
    spark = entities.sparkSession
    listed = short_forms.select("given_name", "short_form").limit(MOST_FORMS + 1).collect()
    if len(listed) > MOST_FORMS:
        raise ValueError(f"more than {MOST_FORMS} short forms of given names")
    rules = spark.sparkContext.broadcast(Rules([tuple(r) for r in listed]))
    parsed = cut_lineage(forms(entities, rules, id_col, name_col, type_col, alias_col))
    total = parsed.count()
    parsed = parsed.join(kinds(parsed, total), "id")
    words = F.expr("CASE WHEN kind = 'organization' THEN filter(words, w -> length(rtrim('.', w)) > 1) ELSE words END")
    parsed = cut_lineage(parsed.withColumn("words", words))
    things, people = parsed.where("kind <> 'person'"), parsed.where("kind = 'person'")
    plain = F.filter("words", lambda w: ~F.endswith(w, F.lit(".")))
    every = things.where(F.size("words") <= MOST_WORDS).select("id", "kind", F.explode(plain).alias("word")).unionByName(people.select("id", "kind", F.col("core").alias("word")).where("word IS NOT NULL"))
    counted = cut_lineage(every.distinct().groupBy("kind", "word").agg(F.count("*").alias("n")))
    spelt = cut_lineage(spellings(counted))
    keyed = cut_lineage(_people(people, spelt, total).unionByName(_things(things, spelt, total)))
    # one row under two names joins them; of persons, if it is the same given name
    twice = keyed.select("id", F.col("key").alias("a"), "one").join(keyed.select("id", F.col("key").alias("b"), "one"), ["id", "one"]).where("a < b").select("a", "b").distinct()
    roots = components(twice)
    entity = keyed.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("id", F.coalesce("root", "key").alias("entity")).distinct()
    # a row that can be read in several ways is read as most rows are
    sized = entity.groupBy("entity").agg(F.count("*").alias("n"))
    return join_groups(entity, sized.withColumn("size", F.col("n")), ["entity"], "n", total, "id").groupBy("id").agg(F.max_by("entity", F.struct("size", "entity")).alias("entity"))


def members(entities: DataFrame, short_forms: DataFrame, **columns) -> DataFrame:
    """(id, first_id, n): the membership of each row that could be resolved; n counts the rows of its entity."""
    found = cut_lineage(resolve(entities, short_forms, **columns))
    groups = found.groupBy("entity").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    return join_groups(found, groups, ["entity"], "n", found.count(), "id").select("id", "first_id", "n")


def same_entity(entities: DataFrame, short_forms: DataFrame, **columns) -> DataFrame:
    """(id_a, id_b): all pairs of rows of one entity, the smaller id first."""
    return pairs_within(members(entities, short_forms, **columns), "first_id", "n", "id")
