"""Registry of the queries of the training-data operators and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import formatting, names, neardup, packing, splitting, tokens, truncation, vectors
from lodestone.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of memories of which either is among the 10 nearest of the other."""
    return vectors.neighbour_pairs(table(spark, sf, "candidates"))


def p1_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The lists of all ids divisible by 100 against exact search over all vectors."""
    return vectors.recall(table(spark, sf, "candidates"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of rows that name the same person, organisation or place."""
    return names.same_entity(table(spark, sf, "entities"), table(spark, sf, "given_name_forms"))


def p2_members(spark: SparkSession, sf: str) -> DataFrame:
    """The first row and the number of rows of each row's entity."""
    return names.members(table(spark, sf, "entities"), table(spark, sf, "given_name_forms"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of memories that share at least 3/4 of their words."""
    return neardup.similar_pairs(table(spark, sf, "memories"))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of near-duplicates of each memory, and its number of links."""
    return neardup.classes(table(spark, sf, "memories"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every copy of a memory in another formatting, with the first of its group."""
    return formatting.copies(table(spark, sf, "memories"))


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row per distinct memory with the number of its copies."""
    return formatting.records(table(spark, sf, "memories"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The oversized memories, and whether a stretch of theirs had to be cut inside."""
    pieces = splitting.split_texts(table(spark, sf, "memories"))
    return pieces.where("piece_no = 0").select("id", "forced")


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of the oversized memories, in order."""
    return splitting.split_texts(table(spark, sf, "memories"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return tokens.encode_corpus(table(spark, sf, "documents"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The documents assigned to containers of 2,048 tokens."""
    return packing.pack(tokens.count_tokens(table(spark, sf, "documents")))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are, against the least number that could hold all tokens."""
    return packing.fill(p7_containers(spark, sf))


_P5_FOUND = r"""
WITH stretches AS (
  SELECT id, unnest(string_split_regex(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), '[\r\n]+')) AS stretch
  FROM memories
), sizes AS (
  SELECT id, len(regexp_extract_all(stretch, '[^ \t\r\n]+')) AS words FROM stretches
)
SELECT id, CAST(CASE WHEN max(words) > 128 THEN 1 ELSE 0 END AS BIGINT) AS forced
FROM sizes GROUP BY id HAVING sum(words) > 128
"""


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that were cut off."""
    return truncation.score(table(spark, sf, "documents")).where(f"p >= {truncation.THRESHOLD}").select("doc_id").distinct()


def p8_sources(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source cuts its documents off."""
    return truncation.by_source(table(spark, sf, "documents"))


_P3_FOUND = r"""
WITH sets AS (
  SELECT id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS words FROM memories
), long_sets AS (SELECT id, words FROM sets WHERE len(words) >= 20)
SELECT a.id AS id_a, b.id AS id_b
FROM long_sets a JOIN long_sets b ON a.id < b.id
 AND 4 * len(a.words) >= 3 * len(b.words) AND 4 * len(b.words) >= 3 * len(a.words)
WHERE 7 * len(list_intersect(a.words, b.words)) >= 3 * (len(a.words) + len(b.words))
"""


_P4_FIELDS = r"""
WITH shown AS (SELECT id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM memories WHERE regexp_matches(text, '[\p{L}\p{N}]')),
parts AS (
  SELECT id, text, body, CASE WHEN starts_with(body, '{') AND ends_with(body, '}') AND json_valid(body) THEN body END AS object,
    list_filter(string_split_regex(text, '[;|\r\n\x0b\x0c]+'), lambda p: trim(p) <> '') AS pieces FROM shown
), told AS (
  SELECT id, CASE
    WHEN object IS NOT NULL THEN list_transform(json_keys(object), lambda k: LETTERS(k) || ':' || LETTERS(coalesce(json_extract_string(object, '$."' || k || '"'), '')))
    WHEN len(pieces) >= 3 AND len(list_filter(pieces, lambda p: NOT regexp_matches(p, '(?s)^[^:=]*[\p{L}\p{N}][^:=]*[:=]'))) = 0
      THEN list_transform(pieces, lambda p: LETTERS(regexp_extract(p, '^[^:=]*')) || ':' || LETTERS(regexp_replace(p, '(?s)^[^:=]*[:=]', '')))
    ELSE [LETTERS(text)] END AS fields FROM parts
), named AS (SELECT id, list_sort(list_distinct(fields)) AS fields, min(id) OVER (PARTITION BY list_sort(list_distinct(fields))) AS first_id FROM told)
"""
#: The letters and digits of a text in one case; full case folding is left to the operator's own tests.
_LETTERS = r"lower(upper(regexp_replace(\1, '[^\p{L}\p{N}]+', '', 'g')))"


def _p4_sql(rest: str) -> str:
    sql = _P4_FIELDS.replace("LETTERS(k)", _LETTERS.replace("\\1", "k")).replace("LETTERS(text)", _LETTERS.replace("\\1", "text"))
    for inner in ("coalesce(json_extract_string(object, '$.\"' || k || '\"'), '')", "regexp_extract(p, '^[^:=]*')", "regexp_replace(p, '(?s)^[^:=]*[:=]', '')"):
        sql = sql.replace(f"LETTERS({inner})", _LETTERS.replace("\\1", inner))
    return sql + rest


_P3_CLASSES = f"""
WITH RECURSIVE pairs AS ({_P3_FOUND}), ends AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach AS (SELECT a AS id, a AS root FROM ends UNION SELECT e.b, r.root FROM reach r JOIN ends e ON e.a = r.id),
roots AS (SELECT id, min(root) AS class_id FROM reach GROUP BY 1), links AS (SELECT a AS id, count(*) AS links FROM ends GROUP BY 1)
SELECT m.id, coalesce(class_id, m.id) AS class_id, coalesce(links, 0) AS links FROM memories m LEFT JOIN roots USING (id) LEFT JOIN links USING (id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_recall": p1_recall,
        "p2_found": p2_found,
        "p2_members": p2_members,
        "p3_found": p3_found,
        "p3_classes": p3_classes,
        "p4_found": p4_found,
        "p4_records": p4_records,
        "p5_found": p5_found,
        "p5_pieces": p5_pieces,
        "p6_ids": p6_ids,
        "p7_containers": p7_containers,
        "p7_fill": p7_fill,
        "p8_found": p8_found,
        "p8_sources": p8_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _P3_FOUND,
        "p3_classes": _P3_CLASSES,
        "p4_found": _p4_sql("SELECT first_id, id AS copy_id FROM named WHERE id <> first_id"),
        "p4_records": _p4_sql("SELECT first_id, count(*) AS n_copies FROM named GROUP BY 1"),
        "p5_found": _P5_FOUND,
    }
