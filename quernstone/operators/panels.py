"""Operational panels over the log tables.  Every function aggregates map-side; ids that
were delivered again count once (``current``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.config import LEVELS
from quernstone.functions.text import severity_of
from quernstone.session import cut_lineage


def current(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per id of ``df``: redeliveries are united, and where they differ the row
    with the severest decision or level, then the greatest row, stands."""
    rank = [c for c in ("decision", "level") if c in df.columns]
    keys = [F.coalesce(severity_of(F.col(c)), F.lit(-1)).alias(f"_s_{c}") for c in rank]
    rest = [c for c in df.columns if c != id_col]
    best = df.groupBy(id_col).agg(F.max(F.struct(*keys, *rest)).alias("b"))
    return best.select(id_col, *[F.col(f"b.{c}").alias(c) for c in rest])


def recent(df: DataFrame, hours: int | None, now: Column | None = None, at: str = "created_at") -> DataFrame:
    """Rows of the last ``hours`` before ``now``; null times drop out; None keeps all rows."""
    if hours is None:
        return df
    now = F.current_timestamp() if now is None else now
    return df.where(F.col(at) >= now - F.make_interval(hours=F.lit(hours)))


def decision_counts(requests: DataFrame) -> DataFrame:
    """Requests per decision: all five levels, zeros kept, other values dropped."""
    levels = requests.sparkSession.createDataFrame([(i, x) for i, x in enumerate(LEVELS)], "ord int, decision string")
    n = requests.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(n, "decision", "left").select("decision", F.coalesce("n", F.lit(0)).alias("n"))


def confidence_histogram(requests: DataFrame, bins: int = 20) -> DataFrame:
    """Right-closed bins of width 1/bins over 0..1, the lowest includes 0; values outside and
    nulls drop out, empty bins stay.  A bin found by rounding is moved where its edges say so."""
    c = F.col("confidence")
    guess = F.greatest(F.ceil(c * bins), F.lit(1)).cast("int")
    fixed = F.when(c > guess / F.lit(float(bins)), guess + 1).when((guess > 1) & (c <= (guess - 1) / F.lit(float(bins))), guess - 1).otherwise(guess)
    counts = requests.where(c.between(0.0, 1.0)).groupBy(fixed.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = requests.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    left = F.when(F.col("bin") == 1, F.lit("-0.00")).otherwise(F.format_string("%.2f", (F.col("bin") - 1) / F.lit(float(bins))))
    label = F.concat(left, F.lit("–"), F.format_string("%.2f", F.col("bin") / F.lit(float(bins))))
    return grid.join(counts, "bin", "left").select("bin", label.alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def layer_level_pivot(detections: DataFrame) -> DataFrame:
    """Detections with a request per layer, one column per known level, missing ones 0, and the rest as ``other``."""
    known = F.col("level").isin(*LEVELS)
    has = F.col("request_id").isNotNull()
    return detections.groupBy("layer").agg(
        *[F.count(F.when(has & (F.col("level") == x), 1)).alias(x) for x in LEVELS], F.count(F.when(has & ~F.coalesce(known, F.lit(False)), 1)).alias("other")
    )


def top_triggers(detections: DataFrame, top: int = 15) -> DataFrame:
    """Most frequent trigger tokens, trimmed and in lower case; broken lists count nothing; ties by token."""
    tok = F.lower(F.trim("t"))
    return (
        detections.select(F.explode(F.from_json("trigger_tokens", "array<string>")).alias("t"))
        .select(tok.alias("token"))
        .where("token <> ''")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(top)
    )


def top_attributed(attributions: DataFrame, top: int = 15) -> DataFrame:
    """Tokens with the greatest sum of attribution scores; ties by token."""
    v = F.try_parse_json("tokens")
    v = F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)
    items = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda i: F.schema_of_variant(i).startswith("OBJECT"))
    pairs = F.transform(items, lambda i: F.struct(F.try_variant_get(i, "$.token", "string").alias("token"), F.try_variant_get(i, "$.score", "double").alias("score")))
    return (
        attributions.select(F.explode(pairs).alias("p"))
        .select(F.lower(F.trim("p.token")).alias("token"), F.col("p.score").alias("score"))
        .where("token <> '' and score is not null")
        .groupBy("token")
        .agg(F.round(F.sum("score"), 4).alias("score"))
        .orderBy(F.desc("score"), "token")
        .limit(top)
    )


def potential_fp_rate(requests: DataFrame, detections: DataFrame) -> DataFrame:
    """Allowed requests with a detection / requests with a decision; null when either side is empty.
    ``of_flagged`` divides by the flagged requests instead."""
    flagged = detections.select(F.col("request_id").alias("id")).where("id is not null").distinct().withColumn("_f", F.lit(True))
    j = requests.where("decision is not null").join(flagged, "id", "left")
    hit = F.col("_f").isNotNull()
    both = F.count(F.when(hit & (F.col("decision") == "allow"), 1))
    return j.agg(
        F.round(F.when(F.count(F.when(hit, 1)) > 0, both / F.nullif(F.count(F.lit(1)), F.lit(0))), 6).alias("fp_rate"),
        F.round(both / F.nullif(F.count(F.when(hit, 1)), F.lit(0)), 6).alias("of_flagged"),
    )


def kpis(requests: DataFrame) -> DataFrame:
    """One row, also for an empty table."""
    n = F.count(F.lit(1))
    blocked = F.count(F.when(F.col("decision") == "block", 1))
    return requests.agg(
        n.alias("n_requests"), blocked.alias("n_blocked"), F.round(blocked / F.greatest(n, F.lit(1)), 6).alias("blocked_share"),
        F.count(F.when(F.col("decision").isin("sanitize", "exclude"), 1)).alias("n_mitigated"),
        F.count(F.when(F.col("canary_hit"), 1)).alias("n_canary_hits"),
        F.round(F.avg("latency_ms"), 4).alias("mean_latency_ms"),
    )


def count_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def recent_rows(df: DataFrame, limit: int = 50, columns: tuple = ("id", "created_at", "request_id", "layer", "level", "confidence")) -> DataFrame:
    """The newest rows, ties by id; only columns that exist.  Top-k, no full sort."""
    cols = [c for c in columns if c in df.columns]
    return df.select(*cols).orderBy(F.desc("created_at"), "id").limit(limit)


def latency_from_exposition(lines: DataFrame, name: str = "pipeline_layer_duration_seconds", label: str = "layer") -> DataFrame:
    """(layer, mean_ms) from metrics text: sum / count * 1000 where count > 0, last sample wins."""
    pat = rf'^{name}_(sum|count)\{{[^}}]*{label}="([^"]*)"[^}}]*\}}\s+([-+0-9.eE]+)'
    got = lines.select(
        F.regexp_extract("line", pat, 1).alias("what"), F.regexp_extract("line", pat, 2).alias(label),
        F.regexp_extract("line", pat, 3).try_cast("double").alias("v"), "line_no",
    ).where("what <> '' and v is not null")
    last = got.groupBy(label, "what").agg(F.max_by("v", "line_no").alias("v"))
    counts = last.where("what = 'count' and v > 0").select(label, F.col("v").alias("n"))
    sums = last.where("what = 'sum'").select(label, F.col("v").alias("s"))
    return counts.join(sums, label, "left").select(label, F.round(F.coalesce("s", F.lit(0.0)) / F.col("n") * 1000, 4).alias("mean_ms"))


def with_top_tokens(attributions: DataFrame, top: int = 5) -> DataFrame:
    """Adds ``top_tokens``: the first tokens of the list, in its order; empty for broken lists."""
    v = F.try_parse_json("tokens")
    v = F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)
    items = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda i: F.schema_of_variant(i).startswith("OBJECT"))
    names = F.transform(F.slice(items, 1, top), lambda i: F.coalesce(F.try_variant_get(i, "$.token", "string"), F.lit("")))
    return attributions.withColumn("top_tokens", F.coalesce(F.array_join(names, ", "), F.lit("")))


def counters(requests: DataFrame, detections: DataFrame, names: tuple[str, str, str, str] = ("requests_total", "detections_total", "upstream_errors_total", "canary_hits_total")) -> DataFrame:
    """(name, labels, n) of all counters: requests by path, method and decision, detections by
    level and layer, upstream errors by status (column ``upstream_status``, where there is one),
    canary hits."""
    label = lambda *cols: F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in cols])
    out = requests.groupBy(F.lit(names[0]).alias("name"), label("path", "method", "decision").alias("labels")).agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(detections.groupBy(F.lit(names[1]).alias("name"), label("level", "layer").alias("labels")).agg(F.count(F.lit(1)).alias("n")))
    if "upstream_status" in requests.columns:
        bad = requests.where("upstream_status >= 400")
        out = out.unionByName(bad.groupBy(F.lit(names[2]).alias("name"), F.concat(F.lit('code="'), F.col("upstream_status").cast("string"), F.lit('"')).alias("labels")).agg(F.count(F.lit(1)).alias("n")))
    return out.unionByName(requests.agg(F.lit(names[3]).alias("name"), F.lit("").alias("labels"), F.count(F.when(F.col("canary_hit"), 1)).alias("n")))


BUCKETS_MS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500)


def cumulative_buckets(df: DataFrame, value: str, by: list[str], edges: tuple = BUCKETS_MS) -> DataFrame:
    """Histogram in exposition form: per group the counts at or below each edge, count and sum."""
    return df.groupBy(*by).agg(
        *[F.count(F.when(F.col(value) <= e, 1)).alias(f"le_{e}") for e in edges], F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total")
    )


def exposition(counts: DataFrame, name: str, labels: list[str], value: str = "n") -> DataFrame:
    """Metrics text lines of a counter."""
    parts = [F.concat(F.lit(f'{x}="'), F.coalesce(F.col(x), F.lit("")), F.lit('"')) for x in labels]
    return counts.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string")).alias("line"))


def traffic(df: DataFrame, width: str = "1 day", at: str = "created_at") -> DataFrame:
    """Rows per tumbling window (an extension, not a panel of old)."""
    return df.groupBy(F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


EVENTS_PER_PARTITION = 200_000


def alert_cooldown(events: DataFrame, seconds: int = 30, min_level: str = "block", at: str = "created_at", id_col: str = "id") -> DataFrame:
    """(fired_at, id): of the events at or above ``min_level``, in order of time and id,
    those at least ``seconds`` after the last one that fired.

    Whether an alert fires depends on the one that fired before.  The events are
    range-sorted by time; every partition is read as a stream that remembers only the last
    time it fired at.  What a partition begins with is the last time of those before
    it: all start with what is known, in parallel, and start again as long as some beginning
    has changed, which ends after two or three rounds, as runs soon meet, and after as
    many rounds as there are partitions at most.  Only one time per partition comes to the driver.
    Events without a time never fire; an unknown ``min_level`` means exclude.
    """
    floor = F.coalesce(severity_of(F.lit(min_level)), F.lit(3))
    ok = events.where((F.coalesce(severity_of(F.col("level")), F.lit(0)) >= floor) & F.col(at).isNotNull())
    short = ok.select(F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(id_col).cast("string").alias("id"))
    n = max(1, min(2_000, short.count() // EVENTS_PER_PARTITION))
    # cut off from the sampling of the range sort, so that a partition keeps its rows
    parts = cut_lineage(short.repartitionByRange(n, "t", "id").sortWithinPartitions("t", "id").withColumn("p", F.spark_partition_id()))
    gap = seconds * 1_000_000

    def fired(begin: dict[int, int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: int | None = None
            first = True
            for b in batches:
                times = b.column(0).to_numpy(zero_copy_only=False)
                keep, i = [], 0
                if first and len(times):
                    first, last = False, begin.get(b.column(2)[0].as_py())
                while i < len(times):
                    if last is not None and times[i] - last < gap:
                        i = int(np.searchsorted(times, last + gap))
                        continue
                    keep.append(i)
                    last = int(times[i])
                    i += 1
                yield b.take(pa.array(keep, pa.int64()))

        return parts.mapInArrow(run, "t bigint, id string, p int")

    begin: dict[int, int] = {}
    while True:
        last = {r.p: r.t for r in fired(begin).groupBy("p").agg(F.max("t").alias("t")).collect()}
        known: dict[int, int] = {}
        latest = None
        for p in range(parts.rdd.getNumPartitions()):
            if latest is not None:
                known[p] = latest
            latest = last.get(p, latest)
        if known == begin:
            return fired(begin).select(F.timestamp_micros("t").alias("fired_at"), "id")
        begin = known
