"""Sinks: log rows, datasets, reports, alerts, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.config import EngineConfig
from quernstone.functions.text import severity_of


def request_log_rows(requests: DataFrame, cfg: EngineConfig | None = None) -> DataFrame:
    """Rows for ``request_logs``: model cut to 128 characters, bodies to the column's limit."""
    cfg = cfg or EngineConfig()
    return requests.select(
        F.col("request_id").alias("id"), "created_at", F.lit("POST").alias("method"), "path", F.left("model", F.lit(128)).alias("model"), "decision", "confidence",
        "canary_token", "canary_hit", "latency_ms", F.left("request_body", F.lit(cfg.max_body)).alias("request_body"),
    )


def append(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("append").parquet(f"{root}/{name}.parquet")


def write_requests(requests: DataFrame, detections: DataFrame, root: str) -> None:
    """Request rows and their detections."""
    append(request_log_rows(requests), root, "request_logs")
    append(detections, root, "detections")


def attribution_rows(attributions: DataFrame, decisions: DataFrame | None = None, limit: int = 512) -> DataFrame:
    """Rows for ``attributions``: text cut to the column's limit, the classifier as layer where none
    is named, and the request's confidence as score where ``decisions`` are given."""
    if decisions is not None:
        c = decisions.select("request_id", F.col("confidence").alias("_c"))
        attributions = attributions.join(c, "request_id", "left").withColumn("score", F.col("_c")).drop("_c")
    return attributions.withColumn("text", F.left("text", F.lit(limit))).withColumn("layer", F.coalesce(F.col("layer"), F.lit("classifier")))


def mark_canary_hits(logs: DataFrame, hits: DataFrame) -> DataFrame:
    """Keyed update as an overlay: canary_hit, decision block, confidence 1."""
    h = hits.select(F.col("request_id").alias("id")).distinct().withColumn("_h", F.lit(True))
    j = logs.join(h, "id", "left")
    hit = F.col("_h").isNotNull()
    return (
        j.withColumn("canary_hit", hit | F.coalesce("canary_hit", F.lit(False)))
        .withColumn("decision", F.when(hit, "block").otherwise(F.col("decision")))
        .withColumn("confidence", F.when(hit, 1.0).otherwise(F.col("confidence")))
        .select(*logs.columns)
    )


def dataset_lines(examples: DataFrame) -> DataFrame:
    """(split, value): a JSON line per example."""
    return examples.select("split", F.to_json(F.struct("text", "label", "source")).alias("value"))


def write_dataset(examples: DataFrame, path: str) -> None:
    """train and val as JSONL, one folder each (``split=train``, ``split=val``)."""
    dataset_lines(examples).write.mode("overwrite").partitionBy("split").text(path)


def holdout_digest(holdout: DataFrame) -> DataFrame:
    """SHA-256 over all lines in order of item number.  Lines are joined in one row: for the
    frozen holdout of fixed size only."""
    line = F.to_json(F.struct("item_no", "source", "label", "text"))
    ordered = holdout.select(F.struct("item_no", line.alias("line")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return ordered.select(F.sha2(F.concat(F.array_join(F.transform("x", lambda r: r.line), "\n"), F.lit("\n")), 256).alias("sha256"), F.size("x").alias("n"))


def alert_rows(events: DataFrame, min_level: str = "block") -> DataFrame:
    """Webhook payloads of events at or above a level; an unknown level never alerts, an
    unknown minimum means exclude."""
    floor = F.coalesce(severity_of(F.lit(min_level)), F.lit(3))
    hit = events.where(F.coalesce(severity_of(F.col("level")), F.lit(0)) >= floor)
    return hit.select("request_id", "level", F.to_json(F.struct(F.concat(F.lit("["), F.upper("level"), F.lit("] request "), "request_id").alias("text"), "level", "request_id", "confidence")).alias("payload"))


def delivered(responses: DataFrame) -> DataFrame:
    """A delivery is fine below status 400."""
    return responses.withColumn("ok", F.coalesce(F.col("status") < 400, F.lit(False)))


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def write_registry(registry: DataFrame, path: str) -> None:
    registry.orderBy("created_at", "version").coalesce(1).write.mode("overwrite").json(path)
