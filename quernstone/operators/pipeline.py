"""The layer chain: normalizer, heuristic, classifier, decision, as one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.config import EngineConfig
from quernstone.functions.normalizer import normalized
from quernstone.operators import decide, detect
from quernstone.operators import segments as segments_of
from quernstone.sources.rules import Rule

EMPTY_MARK = "[EMPTY]"


class Scorer(Protocol):
    """Scores a list of texts between 0 and 1, one number each."""

    def __call__(self, texts: list[str]) -> list[float]: ...


class Layer(Protocol):
    """A custom layer: segments (request_id, idx, tag, role, content, normalized) to results
    (request_id, layer, ordinal, confidence, level, triggers, flagged_segment)."""

    name: str

    def apply(self, segments: DataFrame, cfg: EngineConfig) -> DataFrame: ...


def score_texts(segments: DataFrame, load: Callable[[], Scorer], cfg: EngineConfig | None = None, text: str = "content") -> DataFrame:
    """Adds ``score``: a pluggable model in Arrow batches.

    ``load`` runs once per worker.  Blank texts are scored as ``[EMPTY]``.  A model that
    cannot be loaded, fails, or returns another number of scores gives 1.0 when failing
    closed, else 0.0.
    """
    cfg = cfg or EngineConfig()
    size, failed = cfg.classifier_batch, 1.0 if cfg.fail_mode == "closed" else 0.0

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:  # any failure of foreign model code is a layer failure
            model = None
        for b in batches:
            texts = [t if isinstance(t, str) and t.strip() else EMPTY_MARK for t in b]
            out: list[float] = []
            for i in range(0, len(texts), size):
                part = texts[i : i + size]
                try:
                    got = list(model(part)) if model else []
                except Exception:
                    got = []
                out += [float(x) for x in got] if len(got) == len(part) else [failed] * len(part)
            yield pd.Series(out, dtype="float64")

    return segments.withColumn("score", F.pandas_udf(run, T.DoubleType())(F.col(text)))


def failed_layer(requests: DataFrame, layer: str, ordinal: int, cfg: EngineConfig, reason: str) -> DataFrame:
    """One result per request (request_id) for a layer that failed: block with confidence 1 when
    failing closed, else allow; the output guard never blocks by failing."""
    level, confidence = decide.failure_result(layer, cfg)
    return requests.select(
        "request_id", F.lit(layer).alias("layer"), F.lit(ordinal).alias("ordinal"), F.lit(confidence).alias("confidence"), F.lit(level).alias("level"),
        F.array(F.lit(f"layer error (fail-{cfg.fail_mode}): {reason}")).alias("triggers"), F.lit(None).cast("int").alias("flagged_segment"),
    )


def run_chain(requests: DataFrame, rules: list[Rule], cfg: EngineConfig | None = None, load_model: Callable[[], Scorer] | None = None, custom: list[Layer] | None = None, secret: str | None = None) -> DataFrame:
    """The whole chain for requests (id, request_body): (request_id, decision, confidence,
    deciding_layer, triggers, flagged_segment, canary_token, upstream).

    ``decision_on`` off leaves every request allowed, its results unused; ``output_guard_on`` off
    leaves out the canary.  Blocked requests have neither canary nor upstream segments.  Requests
    without segments are allowed.
    """
    cfg = cfg or EngineConfig()
    segmented = segments_of.with_segments(requests.select(F.col("id").alias("request_id"), "request_body"))
    d = decide.decide(run_layers(segments_of.exploded(segmented), rules, cfg, load_model, custom), cfg)
    if not cfg.decision_on:
        d = d.select("request_id", F.lit("allow").alias("decision"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("deciding_layer"), F.array().cast("array<string>").alias("triggers"), F.lit(None).cast("int").alias("flagged_segment"))
    j = segmented.drop("request_body").join(d, "request_id", "left").withColumn("decision", F.coalesce("decision", F.lit("allow"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    out = decide.rewrite_segments(j, segments_of.request_nonce(F.col("request_id"), secret=secret))
    token = F.when(F.col("decision") != "block", segments_of.canary_token(F.col("request_id"), cfg.canary_length, secret)) if cfg.output_guard_on else F.lit(None).cast("string")
    out = out.withColumn("canary_token", token)
    if cfg.output_guard_on:
        out = out.withColumn("upstream", segments_of.inject_canary(F.col("upstream"), F.col("canary_token")))
    return out.drop("segments")


def run_layers(segments: DataFrame, rules: list[Rule], cfg: EngineConfig | None = None, load_model: Callable[[], Scorer] | None = None, custom: list[Layer] | None = None) -> DataFrame:
    """Results of all layers that are switched on, ready for :func:`decide.decide`.

    Requests that the heuristic blocks never reach the classifier: Python functions are not
    lazy inside a projection, so the undecided requests are filtered first (anti join on
    the few blocked ones).
    """
    cfg = cfg or EngineConfig()
    text = segments.withColumn("normalized", normalized(F.col("content")) if cfg.normalizer_on else F.col("content"))
    results: list[DataFrame] = []
    blocked = None
    if cfg.heuristic_on:
        h = detect.fold_requests(detect.score_both(text, rules, cfg), cfg)
        blocked = h.where("level = 'block'").select("request_id")
        results.append(h.select("request_id", F.lit("heuristic").alias("layer"), F.lit(0).alias("ordinal"), "confidence", "level", "triggers", "flagged_segment"))
    if cfg.classifier_on and load_model is not None:
        open_segments = text if blocked is None else text.join(blocked, "request_id", "left_anti")
        c = detect.classify_requests(score_texts(open_segments, load_model, cfg, "normalized"), cfg)
        results.append(c.select("request_id", F.lit("classifier").alias("layer"), F.lit(1).alias("ordinal"), "confidence", "level", F.col("previews").alias("triggers"), F.col("best_idx").alias("flagged_segment")))
    for k, layer in enumerate(custom or (), 2):
        try:
            got = layer.apply(text, cfg).select(*decide.RESULT_COLUMNS).withColumn("ordinal", F.lit(k))
        except Exception as e:  # any failure of a foreign layer's plan
            got = failed_layer(segments.select("request_id").distinct(), layer.name, k, cfg, str(e)[:200])
        results.append(got)
    if not results:
        return segments.sparkSession.createDataFrame([], "request_id string, layer string, ordinal int, confidence double, level string, triggers array<string>, flagged_segment int")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
