"""Mixing sources to target weights (problem 9).

Weighted fair queueing.  The documents of a source queue in shuffled order; a
document's virtual finish time is the source's cumulative tokens divided by the
source's target weight.  Repeats of a source queue behind its earlier pass.  All
documents are range-sorted by virtual finish time and the stream is truncated at
the total budget, so at every point of it the sources' shares follow the weights.

Both running sums are two-level: the order is cut into buckets whose number grows
with the data, bucket totals are summed in a table of bounded size, and only rows
of one bucket meet in one task.  A source that holds a third of all rows spreads
over all buckets.  The buckets of the global order are those of a range sort by
virtual finish time, so they hold about equally many rows whatever the budget.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.session import cut_lineage, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS_PER_BUCKET = 20_000


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every document; null and empty texts have 0 tokens.

    The vocabulary file (under 1 MB, fixed) is read once by the driver and sent along.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        pairs = (line.split() for line in ranks.value.splitlines() if line)
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    t = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col))).mapInArrow(
        run, f"doc_id {t}, source string, tokens bigint"
    )


def _buckets(n: int) -> int:
    return max(16, 1 << math.ceil(math.log2(max(1, n / ROWS_PER_BUCKET))))


def running_sum(df: DataFrame, within: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """``out``: running total of ``value`` within the groups ``within``, in the order of
    (``bucket``, ``order``).  The table of bucket totals has one row per group and bucket."""
    totals = df.groupBy(*within, bucket).agg(F.sum(value).alias("_t"))
    before = W.partitionBy(*within).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*within, bucket, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*within, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(base, [*within, bucket]).withColumn(out, F.col("_base") + F.sum(value).over(inside)).drop("_base")


class Mix:
    """A mix of ``docs`` by ``targets`` (source, target_share, max_repeats).

    ``budget`` is the total number of tokens.  By default it is the largest total at
    which every source that has both documents and a target meets its share within
    its repeats; with a larger budget sources that run out fall short and the others
    go on.  Targets of sources without documents are left out of the shares' sum and
    reported with a share of 0; documents of sources without a target, with null
    source or without tokens are not used.  Of targets with a null or non-positive
    share, or repeats below 1, nothing is used.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17, vocabulary: str = VOCABULARY, **cols: str) -> None:
        self.targets = targets.where("source is not null").groupBy("source").agg(
            F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
        )
        usable = self.targets.where("target_share > 0 and max_repeats >= 1")
        counted = token_counts(docs, vocabulary=vocabulary, **cols).where("tokens > 0").join(usable, "source")
        self.tokens = cut_lineage(counted.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")))
        self.sources = self.tokens.groupBy("source").agg(
            F.sum("tokens").alias("src_tokens"), F.count(F.lit(1)).alias("n_available"),
            F.first("target_share").alias("share"), F.first("max_repeats").alias("cap"),
        )
        # one row from the driver's point of view: the virtual time at which the first source runs out
        limit, weight, self.n_docs, cap_total = self.sources.agg(
            F.min(F.col("src_tokens") * F.col("cap") / F.col("share")), F.sum("share"), F.sum("n_available"), F.sum(F.col("src_tokens") * F.col("cap")),
        ).first()
        self.limit = limit or 0
        self.empty = limit is None
        if self.empty:
            limit = weight = cap_total = 0
        self.budget = int(limit * weight) if budget is None else min(int(budget), int(cap_total))
        # no document that finishes later than this can be in the first `budget` tokens
        self.horizon = limit if budget is None else None

    def stream(self) -> DataFrame:
        """(doc_id, source, copy_no, tokens, finish, position): the chosen documents in
        global order of virtual finish time; ``position`` is the running token total."""
        n = self.n_docs or 0
        bits = _buckets(n).bit_length() - 1
        queue = self.tokens.withColumn("b", F.shiftrightunsigned("h", 64 - bits))
        queue = running_sum(queue, ["source"], "b", ["h", "doc_id"], "tokens", "cum")
        queue = queue.join(self.sources.select("source", "src_tokens"), "source")
        copies = F.col("max_repeats")
        if self.horizon is not None:
            copies = F.least(copies, F.ceil(F.lit(float(self.horizon)) * F.col("target_share") / F.col("src_tokens")).cast("int"))
        copy = queue.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)))
        copy = copy.withColumn("finish", (F.col("copy_no") * F.col("src_tokens") + F.col("cum")) / F.col("target_share"))
        if self.horizon is not None:
            copy = copy.where(F.col("finish") <= F.lit(float(self.horizon)) * 1.000001)
        # the range sort is cut off from its sampling: a bucket's number must not change when a task runs again
        rows = self.sources.agg(F.sum(F.col("n_available") * F.col("cap"))).first()[0] or 0
        sorted_ = copy.repartitionByRange(_buckets(rows), "finish", "source", "doc_id", "copy_no")
        copy = cut_lineage(sorted_.withColumn("b2", F.spark_partition_id()))
        ordered = running_sum(copy.withColumn("_all", F.lit(1)), ["_all"], "b2", ["finish", "source", "doc_id", "copy_no"], "tokens", "position")
        return ordered.where(F.col("position") <= self.budget).select("doc_id", "source", "copy_no", "tokens", "finish", "position")

    def chosen(self) -> DataFrame:
        """(doc_id, source, tokens, repeats) of every chosen document."""
        return self.stream().groupBy("doc_id", "source").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).cast("int").alias("repeats"))

    def shares(self) -> DataFrame:
        """One row per target: target and actual share, documents, tokens and repeats used, and
        whether the source is the one that limits the default budget (all its documents go in
        as often as they may)."""
        reach = self.sources.select("source", (F.col("src_tokens") * F.col("cap") / F.col("share")).alias("_reach"))
        limits = F.coalesce(F.col("_reach") <= F.lit(float(self.limit)), F.lit(False))
        used = self.chosen().groupBy("source").agg(
            F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("repeats_used")
        )
        total = used.agg(F.sum("n_tokens").alias("_total"))
        return (
            self.targets.join(used, "source", "left")
            .join(reach, "source", "left")
            .join(F.broadcast(total), F.lit(True), "left")  # one row
            .select(
                "source", "target_share", "max_repeats",
                F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
                F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
                F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"),
                F.round(F.coalesce(F.col("n_tokens") / F.col("_total"), F.lit(0.0)), 6).alias("actual_share"),
                limits.alias("limits_budget"),
            )
        )
