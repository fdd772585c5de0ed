"""A generated world of people: what is remembered of them, and questions about it, the same in any order of tasks.

Everything follows from hashes of the seed, the person and the kind of fact, so each row can be made on its own.
Persons have thirteen attributes, friends, at most one spouse, a parent, a colleague and a boss, and a move, a change of
job and an appointment; some sentences carry a cue of importance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SYLLABLES = "ba de fi go lu ma ne pi ro su ta ve wi zo ka jo".split()
#: The words that values are made of.
WORDS = {
    "job": "baker nurse pilot teacher welder gardener plumber architect chemist florist tailor surveyor".split(),
    "food": "tacos ramen pizza curry soup salad lasagne falafel sushi goulash".split(),
    "vehicle": "truck van bicycle scooter tractor hatchback sedan motorcycle".split(),
    "colour": "red blue green white black silver".split(),
    "pet": "dog cat parrot hamster rabbit tortoise".split(),
    "hobby": "chess pottery sailing knitting archery astronomy climbing gardening".split(),
    "trait": "patient curious cheerful stubborn quiet generous witty careful".split(),
    "education": "biology history physics law music economics medicine engineering".split(),
    "month": "January March May July September November".split(),
}
#: How each attribute is said.
SENTENCES = {
    "city": "lives in {}.", "job": "works as a {}.", "food": "likes {}.", "vehicle": "drives a {}.", "pet": "owns a {}.", "phone": "has the phone number {}.",
    "birthday": "has a birthday on {}.", "address": "has the address {}.", "hobby": "enjoys {} as a hobby.", "traits": "is a {} person.",
    "email": "has the email {}.", "education": "studies {}.", "experience": "has {} years of experience.",
}
ASKED = ("city", "job", "food", "vehicle")
CUES = ("Remember this:", "Important:", "Don't forget:", "Noteworthy:")
#: Most sentences about one person; ids are person * SLOTS + slot.
SLOTS = 64


class World:
    def __init__(self, spark: SparkSession, people: int, seed: int = 42):
        self.spark, self.people, self.seed = spark, people, seed

    def draw(self, n: int | Column, *keys) -> Column:
        """A number below n from the seed and the keys."""
        keys = [F.lit(k) if isinstance(k, str) else k for k in keys]
        return F.pmod(F.xxhash64(F.lit(self.seed), *keys), F.lit(n) if isinstance(n, int) else n).cast("long")

    def word(self, kind: str, *keys) -> Column:
        return F.element_at(F.lit(WORDS[kind]), (self.draw(len(WORDS[kind]), kind, *keys) + 1).cast("int"))

    def made(self, syllables: int, *keys) -> Column:
        """A made-up name of so many syllables."""
        parts = [F.element_at(F.lit(_SYLLABLES), (self.draw(len(_SYLLABLES), f"syllable{i}", *keys) + 1).cast("int")) for i in range(syllables)]
        return F.initcap(F.concat(*parts))

    def name(self, person: Column) -> Column:
        """First names recur; a surname holds the person's number in syllables, so that full names do not."""
        digits = [F.element_at(F.lit(_SYLLABLES), (F.pmod(F.floor(person / 16**i), F.lit(16)) + 1).cast("int")) for i in range(5)]
        return F.concat_ws(" ", self.made(2, "first", self.draw(60, "first of", person)), F.initcap(F.concat(*digits)))

    def city(self, *keys) -> Column:
        return F.concat(self.made(3, "city", self.draw(40, "city of", *keys)), F.lit("ville"))

    def value(self, attribute: str, p: Column) -> Column:
        number = lambda low, high, *k: (self.draw(high - low, *k, p) + low).cast("string")
        return {
            "city": lambda: self.city("home", p),
            "job": lambda: self.word("job", p),
            "food": lambda: self.word("food", p),
            "vehicle": lambda: F.concat_ws(" ", self.word("colour", p), self.word("vehicle", p)),
            "pet": lambda: F.concat_ws(" ", self.word("pet", p), F.lit("named"), self.made(2, "pet", p)),
            "phone": lambda: F.concat_ws("-", number(200, 999, "phone a"), number(1000, 9999, "phone b")),
            "birthday": lambda: F.concat_ws(" ", self.word("month", p), number(1, 28, "day")),
            "address": lambda: F.concat_ws(" ", number(1, 200, "house"), self.made(3, "street", p), F.lit("Street")),
            "hobby": lambda: self.word("hobby", p),
            "traits": lambda: F.concat_ws(" and ", self.word("trait", p), self.word("trait", F.lit("second"), p)),
            "email": lambda: F.concat(F.lower(self.made(3, "mail", p)), F.lit("@example.org")),
            "education": lambda: self.word("education", p),
            "experience": lambda: number(1, 40, "years"),
        }[attribute]()

    def base(self) -> DataFrame:
        """(person_id, name)."""
        return self.spark.range(self.people).select(F.col("id").alias("person_id"), self.name(F.col("id")).alias("name"))

    def facts(self) -> DataFrame:
        """(person_id, name, attribute, value, text): thirteen attributes of each person."""
        p = F.col("person_id")
        each = [F.struct(F.lit(a).alias("attribute"), self.value(a, p).alias("value"), F.lit(s).alias("say")) for a, s in SENTENCES.items()]
        rows = self.base().select("person_id", "name", F.explode(F.array(*each)).alias("f"))
        return rows.select("person_id", "name", "f.attribute", "f.value", F.concat_ws(" ", "name", F.replace("f.say", F.lit("{}"), F.col("f.value"))).alias("text"))

    def relations(self) -> DataFrame:
        """(person_id, name, relation, other_id, other, text): friends, spouses, parents, colleagues and bosses."""
        p, n = F.col("person_id"), F.lit(self.people)
        other = lambda *k: F.pmod(p + 1 + self.draw(max(1, self.people - 1), *k, p), n)  # noqa: E731  never the person itself
        pairs = [
            F.struct(F.lit("friend").alias("relation"), other("friend 1").alias("other_id"), F.lit("is a friend of").alias("say")),
            F.struct(F.lit("friend").alias("relation"), other("friend 2").alias("other_id"), F.lit("is a friend of").alias("say")),
            # neighbours by number are couples, a third of all
            F.struct(F.lit("married").alias("relation"), F.when(self.draw(3, "couple", F.floor(p / 2)) == 0, p + 1 - 2 * F.pmod(p, F.lit(2))).alias("other_id"), F.lit("is married to").alias("say")),
            F.struct(F.lit("child_of").alias("relation"), F.when(self.draw(4, "child", p) == 0, other("parent")).alias("other_id"), F.lit("is a child of").alias("say")),
            F.struct(F.lit("works_with").alias("relation"), F.when(self.draw(2, "colleague", p) == 0, other("colleague of")).alias("other_id"), F.lit("works with").alias("say")),
            F.struct(F.lit("boss_of").alias("relation"), F.when(self.draw(3, "boss", p) == 0, other("boss of")).alias("other_id"), F.lit("is the boss of").alias("say")),
        ]
        rows = self.base().select("person_id", "name", F.explode(F.array(*pairs)).alias("r")).where((F.col("r.other_id") < n) & (F.col("r.other_id") != p))
        rows = rows.dropDuplicates(["person_id", "r"]).select("person_id", "name", "r.relation", "r.other_id", "r.say").withColumn("other", self.name(F.col("other_id")))
        return rows.select("person_id", "name", "relation", "other_id", "other", F.concat(F.concat_ws(" ", "name", "say", "other"), F.lit(".")).alias("text"))

    def events(self) -> DataFrame:
        """(person_id, name, event, value, year, text): moves, changes of job, appointments, achievements and what is told against a fact."""
        p = F.col("person_id")
        year = lambda k: (self.draw(20, "year", k, p) + 2000).cast("string")
        each = [
            ("moved", self.city("moved", p), F.lit("moved to {} in {y}."), 3),
            ("new_job", self.word("job", F.lit("new"), p), F.lit("became a {} in {y}."), 3),
            ("appointment", self.word("month", F.lit("visit"), p), F.lit("has a dentist appointment in {} {y}."), 4),
            ("achievement", self.word("hobby", F.lit("won"), p), F.lit("won a {} contest in {y}."), 5),
            ("contradiction", self.word("food", F.lit("not"), p), F.lit("said in {y} not to eat {} any more."), 6),
        ]
        rows = [F.struct(F.lit(k).alias("event"), F.when(self.draw(every, "has", k, p) == 0, v).alias("value"), year(k).alias("year"), say.alias("say")) for k, v, say, every in each]
        rows = self.base().select("person_id", "name", F.explode(F.array(*rows)).alias("e")).where("e.value IS NOT NULL")
        said = F.replace(F.replace("e.say", F.lit("{y}"), F.col("e.year")), F.lit("{}"), F.col("e.value"))
        return rows.select("person_id", "name", "e.event", "e.value", "e.year", F.concat_ws(" ", "name", said).alias("text"))

    def memories(self, cued: int = 10) -> DataFrame:
        """(id, text, kind): all sentences; every so-many-th carries a cue of importance at its start, its end or in front of its last word."""
        told = self.facts().select("person_id", F.col("attribute").alias("kind"), "text")
        told = told.unionByName(self.relations().select("person_id", F.col("relation").alias("kind"), "text")).unionByName(self.events().select("person_id", F.col("event").alias("kind"), "text"))
        # the slot of a sentence is its place among those of its person
        listed = told.groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("kind", "text"))).alias("all")).select("person_id", F.posexplode("all").alias("slot", "x"))
        return listed.select((F.col("person_id") * SLOTS + F.col("slot")).alias("id"), with_cue(F.col("x.text"), self.seed, cued).alias("text"), F.col("x.kind").alias("kind"))

    def edges(self) -> DataFrame:
        """(id, memory_id, source, relation, target, weight): the relations as edges of the entity graph."""
        mem = self.memories(0).select("id", "text")
        return self.relations().join(mem, "text").select("id", F.col("id").alias("memory_id"), F.col("name").alias("source"), "relation", F.col("other").alias("target"), F.lit(1.0).alias("weight"))

    def questions(self) -> DataFrame:
        """(question_id, query_text, expected, expected_ids, family): attributes, relations, two steps, times, summaries, and two without an answer."""
        facts, p = self.facts(), F.col("person_id")
        attribute = facts.where(F.col("attribute").isin(*ASKED)).select(F.concat(F.lit("What is the "), F.col("attribute"), F.lit(" of "), F.col("name"), F.lit("?")).alias("q"), F.col("value").alias("expected"), F.lit("attribute").alias("family"))
        asked = {"friend": "Who is a friend of {}?", "married": "Who is married to {}?", "works_with": "Who works with {}?"}
        say = F.lit(None).cast("string")
        for kind, text in asked.items():
            say = F.when(F.col("relation") == kind, F.lit(text)).otherwise(say)
        rel = self.relations()
        relation = rel.where(say.isNotNull()).groupBy("name", "relation").agg(F.min("other").alias("expected")).select(F.replace(say, F.lit("{}"), F.col("name")).alias("q"), "expected", F.lit("relationship").alias("family"))
        boss = rel.where((F.col("relation") == "friend") & (F.pmod(p, F.lit(2)) == 0)).groupBy("person_id", "name").agg(F.min_by("other_id", "other_id").alias("other_id"))
        home = facts.where("attribute = 'city'").select(F.col("person_id").alias("other_id"), F.col("value").alias("expected"))
        hop = boss.join(home, "other_id").select(F.concat(F.lit("Where does a friend of "), F.col("name"), F.lit(" live?")).alias("q"), "expected", F.lit("multi_hop").alias("family"))
        times = {"moved": "When did {} move?", "new_job": "When did {} change jobs?", "achievement": "When did {} win a contest?"}
        when = F.lit(None).cast("string")
        for kind, text in times.items():
            when = F.when(F.col("event") == kind, F.lit(text)).otherwise(when)
        temporal = self.events().where(when.isNotNull()).select(F.replace(when, F.lit("{}"), F.col("name")).alias("q"), F.col("year").alias("expected"), F.lit("temporal").alias("family"))
        summary = self.base().where(p < 10).select(F.concat(F.lit("Summarise what is known about "), F.col("name")).alias("q"), F.col("name").alias("expected"), F.lit("summary").alias("family"))
        none = self.spark.createDataFrame([("Who discovered the lost continent?", None, "unanswerable"), ("What is the meaning of the seventh seal?", None, "unanswerable")], "q string, expected string, family string")
        rows = attribute.unionByName(relation).unionByName(hop).unionByName(temporal).unionByName(summary).unionByName(none)
        return rows.select(F.xxhash64("family", "q").alias("question_id"), F.col("q").alias("query_text"), "expected", F.array().cast("array<string>").alias("expected_ids"), "family")

    def truth(self) -> DataFrame:
        """One row a person with the attributes that are asked for."""
        return self.facts().groupBy(F.col("name").alias("person")).pivot("attribute", ["food", "vehicle", "city", "job", "phone", "birthday"]).agg(F.first("value"))

    def export(self, folder: str) -> None:
        """Memories as JSON and text, questions as JSON, the truth as CSV and the counts as JSON."""
        mem, questions = self.memories(), self.questions()
        mem.select("text").write.mode("overwrite").json(f"{folder}/benchmark_memories.json")
        mem.select("text").write.mode("overwrite").text(f"{folder}/benchmark_memories.txt")
        questions.select(F.col("query_text").alias("query"), "expected").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/benchmark_questions.json")
        self.truth().write.mode("overwrite").option("header", "true").csv(f"{folder}/benchmark_truth.csv")
        kinds = mem.groupBy("kind").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("stats"), F.sum("n").alias("memories"))
        kinds.select(F.lit(self.people).alias("people"), "memories", F.lit(questions.count()).alias("questions"), "stats").write.mode("overwrite").json(f"{folder}/benchmark_summary.json")


def with_cue(text: Column, seed: int, every: int) -> Column:
    """A text with a cue of importance, if its hash says so: at the start, at the end, in the middle, or after the first sentence."""
    if not every:
        return text
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("cue"), text), F.lit(every * 4 * len(CUES)))
    cue = F.element_at(F.lit(list(CUES)), (F.pmod(draw, F.lit(len(CUES))) + 1).cast("int"))
    bare = F.rtrim(F.regexp_replace(cue, ":$", ""))
    where = F.pmod(F.floor(draw / len(CUES)), F.lit(4))
    words = F.split(text, " ")
    half = F.floor(F.size(words) / 2).cast("int")
    middle = F.concat_ws(" ", F.concat_ws(" ", F.slice(words, 1, half)), F.concat(F.lit("("), F.lower(bare), F.lit(")")), F.concat_ws(" ", F.slice(words, half + 1, F.size(words))))
    after = F.regexp_replace(text, r"^(.*?[.!?])(\s|$)", F.concat(F.lit("$1 "), bare, F.lit(".$2")))
    cut = F.when(where == 0, F.concat_ws(" ", cue, text)).when(where == 1, F.concat(text, F.lit(" ("), F.lower(bare), F.lit(")"))).when(where == 2, middle).otherwise(after)
    return F.when(F.floor(draw / (4 * len(CUES))) == 0, cut).otherwise(text)
