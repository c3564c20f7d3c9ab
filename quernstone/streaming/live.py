"""Structured-Streaming plans over the log tables and requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.config import EngineConfig
from quernstone.operators import detect, retrain, segments
from quernstone.sources import readers
from quernstone.sources.rules import RuleSource


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", at: str = "created_at") -> DataFrame:
    """Rows per tumbling window; rows later than the watermark drop out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", at: str = "ts", key: str = "user_id") -> DataFrame:
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, id_col: str = "id", late: str = "2 days", at: str = "created_at") -> DataFrame:
    """Redelivered rows once, with state bounded by the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([id_col])


def screen(requests: DataFrame, rules, cfg: EngineConfig | None = None) -> DataFrame:
    """Heuristic result per request of a batch (id, request_body)."""
    return detect.fold_requests(detect.score_segments(segments.explode_segments(requests), rules, "content", cfg), cfg)


def screening_query(stream: DataFrame, source: RuleSource, sink: Callable[[DataFrame, int], None], checkpoint: str, cfg: EngineConfig | None = None):
    """Starts a query that screens each micro-batch with the rules as they are then (a changed
    rule file takes effect at the next batch) and hands the results to ``sink``."""

    def batch(df: DataFrame, epoch: int) -> None:
        sink(screen(df, source.rules(), cfg), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cooldown(alerts: DataFrame, seconds: int = 30, at: str = "created_at", late: str = "10 minutes") -> DataFrame:
    """Alerts (id, level, ``at``) of a stream that fire, at least ``seconds`` after the one before:
    (id, fired_at).  One cooldown for all, so one small state: the last time fired at.  Events of a
    batch are taken in order of time; one that comes after a later one fired waits for none."""
    gap = seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        for t, i in zip(rows["t"], rows["id"]):
            if last is None or t - last >= gap:
                last = int(t)
                out.append((i, last))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["id", "t"])

    # first of each cooldown's length and batch is all that can matter next to the state's own
    short = alerts.withWatermark(at, late).select(F.lit(0).alias("k"), "id", F.unix_micros(F.col(at).cast("timestamp")).alias("t")).where("t is not null")
    fired = short.groupBy("k").applyInPandasWithState(step, "id string, t bigint", "last bigint", "append", "NoTimeout")
    return fired.select("id", F.timestamp_micros("t").alias("fired_at"))


def collect_query(stream: DataFrame, source: RuleSource, queue_path: str, checkpoint: str, cfg: EngineConfig | None = None):
    """Starts a query that screens each micro-batch (id, created_at, request_body) and appends the
    borderline texts to the queue table: collected as the requests come, each text and label
    once while pending, up to the queue's limit.  A batch that runs again after a failure finds
    its rows pending already and adds none."""
    cfg = cfg or EngineConfig()

    def batch(df: DataFrame, epoch: int) -> None:
        decisions = screen(df, source.rules(), cfg).withColumnRenamed("level", "decision")
        found = retrain.collect_candidates(decisions, segments.explode_segments(df), cfg)
        rows = found.join(df.select(F.col("id").alias("request_id"), "created_at"), "request_id").select(
            F.sha2(F.concat_ws(":", "request_id", F.col("idx").cast("string")), 256).alias("id"), "created_at", "text", F.lit("injection").alias("label"), F.lit("pipeline").alias("source"),
            "request_id", "confidence", "decision", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("meta"), F.struct("created_at", "request_id", "idx").alias("ord"),
        )
        queue = readers.read_log_table(df.sparkSession, *queue_path.rsplit("/", 1))
        retrain.enqueue(rows, queue, cfg).drop("ord").write.mode("append").parquet(f"{queue_path}.parquet")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tee(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Every micro-batch to several sinks."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.persist()
        try:
            for s in sinks:
                s(df, epoch)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
