"""Joins that stay balanced when one key holds a third of all rows.

A key is *heavy* when it holds more rows than one task should: ``ROWS_PER_TASK``, or
``1 / MAX_HEAVY`` of all rows where that is more.  There are at most ``MAX_HEAVY``
such keys whatever the data volume, so their list has a proven bound and may be
collected and broadcast.  The rows of a heavy key are spread over as many salts as
it takes to bring each below the limit; the unique side of the join is repeated
once per salt, at most ``MAX_HEAVY`` rows more in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 100_000
MAX_HEAVY = 200_000


def heavy_limit(total: int) -> int:
    """Rows from which a key is heavy, of ``total`` rows."""
    return max(ROWS_PER_TASK, total // MAX_HEAVY)


def heavy_keys(counts: DataFrame, key: str, n: str, total: int) -> list[tuple]:
    """[(key, salts)] of the keys of the pre-aggregated ``counts`` that are heavy among
    ``total`` rows.

    ``counts`` holds one row per key.  At most ``MAX_HEAVY`` keys come back; null keys
    are never heavy.  An empty table gives an empty list.
    """
    limit = heavy_limit(total)
    rows = counts.where(F.col(key).isNotNull() & (F.col(n) >= limit)).select(key, F.ceil(F.col(n) / limit).cast("int")).collect()
    return [tuple(r) for r in rows]


def heavy_frame(df: DataFrame, key: str, heavy: list[tuple]) -> DataFrame:
    """(key, _salts) of the heavy keys, for a broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(heavy, f"`{key}` {df.schema[key].dataType.simpleString()}, _salts int"))


def join_unique(big: DataFrame, unique: DataFrame, key: str, heavy: list[tuple], how: str = "left", by: list[str] | None = None) -> DataFrame:
    """``big`` joined with ``unique`` (one row per key) in one shuffle, heavy keys salted.

    The salt is a hash of the columns ``by`` (all of ``big`` by default), so a lost task
    that runs again gives every row its old place.  Rows with a null key keep nulls
    (``left``) or drop out (``inner``).  Columns of ``unique`` other than ``key`` must not clash.
    """
    if not heavy:
        return big.join(unique, key, how)
    h = heavy_frame(big, key, heavy)
    salt = F.pmod(F.xxhash64(*(by or big.columns)), F.coalesce("_salts", F.lit(1))).cast("int")
    left = big.join(h, key, "left").withColumn("_salt", salt).drop("_salts")
    right = unique.join(h, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


#: former name
left_join_unique = join_unique
