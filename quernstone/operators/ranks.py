"""Running totals and ranks over a global order, without a task that holds it all.

The rows are range-sorted into buckets whose number grows with the data; bucket
totals are summed in a table of at most ``MAX_BUCKETS`` rows per group, and only rows
of one bucket meet in one task.  Ties fall into one bucket only as far as all columns
of the order are equal, so an order that ends in an id spreads any of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.session import cut_lineage

ROWS_PER_BUCKET, MAX_BUCKETS = 20_000, 20_000


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column], within: list[str] | None = None) -> DataFrame:
    """``df`` with a column per entry of ``sums``: the total of its expression over the rows of
    the group (columns ``within``, where null is a group) up to and with the row, in ``order``."""
    within = within or []
    names = list(sums)
    d = df.withColumns({f"_v{i}": sums[n] for i, n in enumerate(names)})
    n = max(1, min(MAX_BUCKETS, df.count() // ROWS_PER_BUCKET))
    # cut off from the sampling of the range sort: a bucket's number must not change when a task runs again
    d = cut_lineage(d.repartitionByRange(n, *order).withColumn("_b", F.spark_partition_id()))
    totals = d.groupBy(*within, "_b").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(names))])
    before = W.partitionBy(*within).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(
        *[F.col(c).alias(f"_w{j}") for j, c in enumerate(within)], F.col("_b").alias("_b2"), *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(names))]
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_w{j}")) for j, c in enumerate(within)], F.col("_b") == F.col("_b2"))
    inside = W.partitionBy(*within, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = d.join(base, same).withColumns({n: F.col(f"_s{i}") + F.sum(f"_v{i}").over(inside) for i, n in enumerate(names)})
    return out.select(*df.columns, *names)
