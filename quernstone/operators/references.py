"""References to records that do not exist (problem 7).

Skew-aware split.  References are pre-aggregated per table, key and period, which
reduces the rows of a hot key map-side to one group per period.  Groups of keys that
are heavy (see :mod:`quernstone.operators.skew`) are checked against a broadcast of
their referents, the groups of all other keys take a shuffle join that keeps those
without a match in time, and both parts are united.  A group lies wholly at or after
its referent's arrival, wholly before it, or is *mixed*; only records of groups that
hold orphans are looked at one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.skew import heavy_frame, heavy_keys, join_unique
from quernstone.session import cut_lineage

GROUP = ("table_name", "k", "period")


def reference_key(c: Column | str) -> Column:
    """Key form of a reference: surrounding white space and letter case are
    disregarded; null and empty mean "no reference" and give null."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(k != "", k)


def references(tables: dict[str, DataFrame], id_col: str = "id", ref_col: str = "request_id", at_col: str = "created_at") -> DataFrame:
    """One row per stored reference: (table_name, record_id, k, at, period).

    ``period`` is the month of ``at``, empty where the time is null.
    """
    parts = [
        df.select(
            F.lit(name).alias("table_name"),
            F.col(id_col).alias("record_id"),
            reference_key(ref_col).alias("k"),
            F.col(at_col).alias("at"),
            F.coalesce(F.date_format(at_col, "yyyy-MM"), F.lit("")).alias("period"),
        ).where(F.col("k").isNotNull())
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def first_seen(referents: DataFrame, id_col: str = "id", at_col: str = "created_at") -> DataFrame:
    """(k, first_at): the earliest arrival of each referent; redelivered rows count once."""
    return (
        referents.select(reference_key(id_col).alias("k"), F.col(at_col).alias("first_at"))
        .where(F.col("k").isNotNull())
        .groupBy("k")
        .agg(F.min("first_at").alias("first_at"))
    )


def orphan_groups(refs: DataFrame, referents: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """((table_name, k, period, n_rows, first_at, state), heavy keys).

    ``state`` is ``all``, ``none`` or ``mixed``: which records of the group come before
    their referent.  A group without a referent, or whose referent has no time, is ``all``.
    """
    pre = cut_lineage(refs.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_rows"), F.min("at").alias("lo"), F.max("at").alias("hi")))
    per_key = pre.groupBy("k").agg(F.sum("n_rows").alias("n"))
    heavy = heavy_keys(per_key, "k", "n", pre.agg(F.sum("n_rows")).first()[0] or 0)
    seen = first_seen(referents)
    if heavy:
        h = heavy_frame(pre, "k", heavy).drop("_salts")
        # at most one row per heavy key
        hot = pre.join(h, "k").join(F.broadcast(seen.join(h, "k")), "k", "left")
        groups = hot.unionByName(pre.join(h, "k", "left_anti").join(seen, "k", "left"))
    else:
        groups = pre.join(seen, "k", "left")
    first = F.col("first_at")
    state = F.when(first.isNull() | (first > F.col("hi")), "all").when(first <= F.col("lo"), "none").otherwise("mixed")
    return groups.select(*GROUP, "n_rows", "first_at", state.alias("state")), heavy


def _records(refs: DataFrame, groups: DataFrame, heavy: list[tuple]) -> DataFrame:
    """Records of ``groups`` that come before their referent; those of heavy keys are salted."""
    key = F.concat_ws(" ", "table_name", "period", "k").alias("g")
    salts: list[tuple] = []
    if heavy:  # of a heavy key there is one group per table and month
        salts = [tuple(r) for r in groups.join(heavy_frame(refs, "k", heavy), "k").select(key, "_salts").collect()]
    rows = join_unique(refs.select("table_name", "record_id", "period", "at", key), groups.select(key, "first_at"), "g", salts, "inner", ["record_id", "at"])
    return rows.where(F.col("first_at").isNull() | (F.col("first_at") > F.col("at")))


def orphan_records(refs: DataFrame, referents: DataFrame) -> DataFrame:
    """(table_name, record_id) of every reference whose referent is not there at or
    before the record's own time.

    Nulls: a null or blank reference is none; a null time of the record counts as
    an orphan only if the referent never arrives; a referent whose times are all
    null is never there.  Redelivered records come out once.  Empty tables give
    no rows.
    """
    groups, heavy = orphan_groups(refs, referents)
    return _records(refs, groups.where("state <> 'none'"), heavy).select("table_name", "record_id").distinct()


def orphan_counts(refs: DataFrame, referents: DataFrame) -> DataFrame:
    """(table_name, period, n_references, n_orphans), each record id counted once (once
    per key and period, if its versions differ).

    Counts come from the groups; only records of mixed groups are looked at one by one.
    """
    once = cut_lineage(refs.distinct())
    groups, heavy = orphan_groups(once, referents)
    groups = cut_lineage(groups)
    orphans = F.when(F.col("state") == "all", F.col("n_rows")).otherwise(0)
    mixed = _records(once, groups.where("state = 'mixed'"), heavy)
    return (
        groups.select("table_name", "period", F.col("n_rows").alias("r"), orphans.cast("long").alias("o"))
        .unionByName(mixed.select("table_name", "period", F.lit(0).cast("long").alias("r"), F.lit(1).cast("long").alias("o")))
        .groupBy("table_name", "period")
        .agg(F.sum("r").alias("n_references"), F.sum("o").alias("n_orphans"))
    )
