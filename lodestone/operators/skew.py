"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more rows than this, and more than one row in HOT_SHARE of all.
HOT_ROWS = 10_000
HOT_SHARE = 1_000
#: Rows of a group whose pairs are made in one piece.
PAIR_ROWS = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], n: str, total: int, spread: str) -> DataFrame:
    """Inner join of ``rows`` with one row per key; ``groups.n`` counts the key's rows.

    Rows of hot keys are spread over salts by the column ``spread``, and the row of
    the group is repeated for each salt. Fewer than HOT_SHARE keys can be hot, since
    each holds more than that share of all rows, so the list of hot keys that is
    broadcast has a proven bound.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    salts = F.when(F.col(n) > limit, F.ceil(F.col(n) / limit)).otherwise(F.lit(1)).cast("int")
    hot = F.broadcast(groups.where(F.col(n) > limit).select(*on, salts.alias("_salts")))
    left = rows.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1)).cast("long")).cast("int")).drop("_salts")
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def join_spread(left: DataFrame, right: DataFrame, on: str, spread: str) -> DataFrame:
    """Inner join on one column, of which both sides may have many rows a value; ``right`` is materialised.

    Rows of ``right`` with a hot value are spread over salts by the column ``spread``, and rows of ``left`` are
    repeated for each salt of their value. Fewer than HOT_SHARE values can be hot, so their list may be broadcast.
    """
    limit = max(HOT_ROWS, right.count() // HOT_SHARE)
    hot = F.broadcast(right.groupBy(on).agg(F.ceil(F.count("*") / limit).cast("int").alias("_salts")).where("_salts > 1"))
    salts = F.coalesce("_salts", F.lit(1))
    many = right.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts.cast("long")).cast("int")).drop("_salts")
    few = left.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return few.join(many, [on, "_salt"]).drop("_salt")


def pairs_within(rows: DataFrame, key: str, n: str, id_col: str, keep: str | None = None) -> DataFrame:
    """(id_a, id_b): all pairs of rows (key, n, id) of one key, id_a < id_b; ``n`` counts the key's rows, or estimates them.

    The rows of a large group are spread over blocks by their id, and block meets block,
    so that no key of the join has more than about PAIR_ROWS rows on either side.
    With ``keep`` the key comes out as a further column of that name.
    """
    blocks = F.ceil(F.col(n) / PAIR_ROWS).cast("int")
    own = rows.where(F.col(n) > 1).select(F.col(key).alias("_key"), F.col(id_col).alias("_id"), blocks.alias("_blocks"), F.pmod(F.xxhash64(id_col), blocks).cast("int").alias("_own"))
    left = own.select("_key", F.col("_id").alias("_x"), F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_j"))
    right = own.select("_key", F.col("_id").alias("_y"), F.explode(F.sequence(F.lit(0), "_own")).alias("_i"), F.col("_own").alias("_j"))
    met = left.join(right, ["_key", "_i", "_j"]).where("_i < _j OR _x < _y")
    return met.select(*([F.col("_key").alias(keep)] if keep else []), F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b"))


def frequent(sampled: DataFrame, key: str, of: int, step: int, least: int) -> DataFrame:
    """(key, n): the keys that a sample of one in ``step`` of ``of`` sources shows to have at least ``least`` rows, with their estimated number.

    Only keys in more than one of HOT_SHARE sampled sources count, so with m keys a source there are fewer than m * HOT_SHARE.
    A key that the sample misses is merely not spread; results do not depend on it.
    """
    bound = max(4, -(-least // step), of // step // HOT_SHARE)
    return sampled.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= bound).select(key, (F.col("n") * step).alias("n"))
