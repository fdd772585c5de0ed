"""Copies that differ only in white space, case, punctuation or the order of fields.

Method: every field of a record, its name and its value brought to their letters
and digits, is hashed on its own; the hashes are combined by a commutative sum, so
the order of fields does not matter and nothing is sorted. A text that is no list
of fields is one field without a name. Records are grouped by the fingerprint, and
each copy's fields are compared with those of its group's first record by set
difference in both directions.

Fields come from a JSON object, or from a text of three or more ``key: value`` or
``key=value`` parts between ``;``, ``|`` or line breaks (empty parts ignored).

Case is ignored by full folding (``ß`` equals ``SS``). Defined cases: null texts
and texts without a letter or digit are in no group; a repeated field counts once;
a null or empty JSON value is an empty value; broken JSON is plain text; equal
rows are copies of each other, whatever their other columns hold.

At scale: the texts are read and normalised once; the first aggregation carries only
fingerprints and combines on the map side, so a group with a third of all rows stays
small there; only the fields of repeated fingerprints are exchanged, and the comparison
joins such groups over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.skew import join_groups
from lodestone.session import cut_lineage

#: Most repeated fingerprints that are sent to all executors (32 bytes each).
MOST_SENT = 100_000
_MASK = (1 << 62) - 1
_BREAKS = "[;|\\r\\n\\x0b\\x0c\\x{85}\\x{2028}\\x{2029}]+"
_FIELD = "(?s)^[^:=]*[\\p{L}\\p{N}][^:=]*[:=].*$"


#: Letters that stand for several once their case is ignored.
_FOLDED = (("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def letters(text: Column) -> Column:
    """The letters and digits of a text, case folded."""
    low = F.lower(F.upper(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", "")))
    full = low
    for one, several in _FOLDED:
        full = F.replace(full, F.lit(one), F.lit(several))
    return F.when(F.rlike(low, F.lit("[ßﬀ-ﬆ]")), full).otherwise(low)


def fields(text: Column) -> Column:
    """The distinct fields, each as its name and value with a colon between; null if the text is no list of fields."""
    trimmed = F.trim(F.regexp_replace(text, "^\\s+|\\s+$", ""))
    parsed = F.when(F.startswith(trimmed, F.lit("{")) & F.endswith(trimmed, F.lit("}")), F.from_json(trimmed, "map<string,string>", {"allowSingleQuotes": "false"}))
    # the parser stops after the first object: what stands behind it makes the text no object
    size = F.aggregate(F.map_entries(parsed), F.lit(0), lambda n, e: n + F.length(letters(e["key"])) + F.length(letters(F.coalesce(e["value"], F.lit("null")))))
    tail = F.rlike(trimmed, F.lit(r"\}\s*[^\s\]},]")) & (size < F.length(letters(trimmed)))
    parsed = F.when(~tail, parsed)
    of_json = F.transform(F.map_entries(parsed), lambda e: F.concat(letters(e["key"]), F.lit(":"), letters(F.coalesce(e["value"], F.lit("")))))
    parts = F.filter(F.split(text, _BREAKS), lambda p: F.trim(p) != "")
    listed = (F.size(parts) >= 3) & F.forall(parts, lambda p: F.rlike(p, F.lit(_FIELD)))
    of_list = F.transform(
        parts, lambda p: F.concat(letters(F.regexp_substr(p, F.lit("^[^:=]*"))), F.lit(":"), letters(F.regexp_replace(p, "^[^:=]*[:=]", "")))
    )
    likely = F.rlike(text, F.lit("(?s)[:=].*[;|\\r\\n\\x0b\\x0c\\x{85}\\x{2028}\\x{2029}].*[:=]"))
    return F.array_distinct(F.coalesce(of_json, F.when(likely & listed, of_list)))


def _combined(parts: Column, seed: int) -> Column:
    """A commutative 62-bit hash of a set of strings."""
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: (acc + F.xxhash64(F.lit(seed), x).bitwiseAND(_MASK)).bitwiseAND(_MASK))


def fingerprints(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, parts, h1, h2) of every text with a letter or digit."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.rlike("text", F.lit("[\\p{L}\\p{N}]")) & F.col("id").isNotNull())
    rows = rows.select("id", F.coalesce(fields(F.col("text")), F.array(letters(F.col("text")))).alias("parts"))
    return rows.select("id", "parts", _combined(F.col("parts"), 1).alias("h1"), _combined(F.col("parts"), 2).alias("h2"))


def _verified(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((first_id, n) of each group of equal fingerprints, (first_id, copy_id) of all verified copies)."""
    rows = cut_lineage(fingerprints(df, id_col, text_col))
    groups = cut_lineage(rows.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("n")))
    repeated = groups.where("n > 1")
    total, many = rows.count(), repeated.count()
    # the fields of single texts go nowhere; the list is sent whole only up to its checked size
    if many <= MOST_SENT:
        members = rows.join(F.broadcast(repeated), ["h1", "h2"])
    else:
        members = join_groups(rows, repeated, ["h1", "h2"], "n", total, "id")
    members = cut_lineage(members)
    firsts = members.where("id = first_id").select("h1", "h2", "n", "first_id", F.col("parts").alias("first_parts")).dropDuplicates(["h1", "h2"])
    compared = cut_lineage(join_groups(members.drop("n", "first_id"), firsts, ["h1", "h2"], "n", total, "id").select("id", "first_id", "h1", "h2", "parts", _equal("parts", "first_parts").alias("same")))
    found = compared.where("same AND id <> first_id").select("first_id", F.col("id").alias("copy_id"))
    # other fields under the same fingerprint, if that ever happens: equal ones among themselves
    odd = compared.where("NOT same").select("id", F.array_sort("parts").alias("parts"))
    first = odd.groupBy("parts").agg(F.min("id").alias("first_id"))
    apart = odd.join(first, "parts")
    groups = groups.select("first_id", "n").unionByName(first.select("first_id", F.lit(1).cast("long").alias("n")))
    return groups, found.unionByName(apart.where("id <> first_id").select("first_id", F.col("id").alias("copy_id")))


def _equal(one: str, other: str) -> Column:
    return (F.size(F.array_except(one, other)) == 0) & (F.size(F.array_except(other, one)) == 0)


def copies(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(first_id, copy_id): every copy with the smallest id of its group."""
    return _verified(df, id_col, text_col)[1]


def records(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(first_id, n_copies): one row per distinct memory with the verified number of its copies, itself counted."""
    groups, found = _verified(df, id_col, text_col)
    counted = found.groupBy("first_id").agg(F.count("*").alias("more"))
    # a group of one needs no look-up
    several = groups.where("n > 1").join(counted, "first_id", "left").select("first_id", (F.coalesce("more", F.lit(0)) + 1).alias("n_copies"))
    apart = counted.join(groups.where("n > 1").select("first_id"), "first_id", "left_anti").select("first_id", (F.col("more") + 1).alias("n_copies"))
    single = groups.where("n = 1").select("first_id").join(apart.select("first_id"), "first_id", "left_anti").select("first_id", F.lit(1).cast("long").alias("n_copies"))
    return several.unionByName(apart).unionByName(single)
