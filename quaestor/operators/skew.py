"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least this share of the rows, and this many of them.
HOT_SHARE, HOT_ROWS = 0.01, 20_000


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE, least: int = HOT_ROWS) -> list[str]:
    """The keys that hold a large share of ``rows``, most frequent first.

    The counts combine map-side; at most ``1 / share`` keys can reach the share, so no more
    than that many come to the driver.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    first = counts.orderBy(F.desc("_n"), key).limit(int(1 / share)).collect()
    if not first or first[0]["_n"] < least:
        return []
    total = rows.count()
    return [r[key] for r in first if r["_n"] >= max(least, share * total)]


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, hot: list[str], salts: int = 16) -> DataFrame:
    """Left join on ``key`` (unique in ``right``) that splits the ``hot`` keys of ``left``.

    Only the hot keys' right rows are repeated, once per salt; without hot keys it is a plain
    join. Null keys match nothing. The right key comes out as ``_right_key``.
    """
    right = right.withColumnRenamed(key, "_right_key")
    if not hot:
        return left.join(right, F.col(key) == F.col("_right_key"), "left")
    salt = F.pmod(F.xxhash64(F.col(spread_by)), F.lit(salts)).cast("int")
    spread = F.col(key).isin(*hot) | F.col(key).isNull()
    left_s = left.withColumn("_salt", F.when(spread, salt).otherwise(F.lit(0)))
    copies = F.when(F.col("_right_key").isin(*hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right_s = right.withColumn("_right_salt", F.explode(copies))
    on = (F.col(key) == F.col("_right_key")) & (F.col("_salt") == F.col("_right_salt"))
    return left_s.join(right_s, on, "left").drop("_salt", "_right_salt")
