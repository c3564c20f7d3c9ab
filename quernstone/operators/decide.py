"""Layer results to one decision per request, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.config import EngineConfig
from quernstone.functions.text import level_for, severity_of

RESULT_COLUMNS = ("request_id", "layer", "ordinal", "confidence", "level", "triggers", "flagged_segment")


def decide(results: DataFrame, cfg: EngineConfig | None = None) -> DataFrame:
    """(request_id, decision, confidence, deciding_layer, triggers, flagged_segment).

    Each result's level is re-derived from its confidence, but an explicit block
    stays one.  The highest (severity, confidence) wins, the earliest layer on ties;
    nothing at ``log`` or above gives allow with confidence 0.  The flagged segment is
    that of the first layer that names one.  Unites by partial aggregation.
    """
    cfg = cfg or EngineConfig()
    level = F.when(F.col("level") == "block", "block").otherwise(level_for(F.col("confidence"), cfg))
    r = results.withColumn("_l", level).withColumn("_s", severity_of(F.col("_l")))
    best = F.max(F.struct(F.col("_s").alias("s"), F.col("confidence").alias("c"), (-F.col("ordinal")).alias("o"), F.col("_l").alias("l"), F.col("layer").alias("layer"), F.col("triggers").alias("t")))
    flag = F.min(F.when(F.col("flagged_segment").isNotNull(), F.struct(F.col("ordinal").alias("o"), F.col("flagged_segment").alias("f"))))
    d = r.groupBy("request_id").agg(best.alias("b"), flag.alias("f"))
    acts = F.col("b.s") >= 1
    return d.select(
        "request_id",
        F.when(acts, F.col("b.l")).otherwise("allow").alias("decision"),
        F.when(acts, F.col("b.c")).otherwise(0.0).alias("confidence"),
        F.when(acts, F.col("b.layer")).alias("deciding_layer"),
        F.when(acts, F.col("b.t")).otherwise(F.array().cast("array<string>")).alias("triggers"),
        F.col("f.f").alias("flagged_segment"),
    )


def failure_result(layer: str, cfg: EngineConfig) -> tuple[str, float]:
    """(level, confidence) of a layer that failed.  A failing output guard never blocks:
    by then the decision has been made."""
    return ("block", 1.0) if cfg.fail_mode == "closed" and layer != "output_guard" else ("allow", 0.0)


def rewrite_segments(df: DataFrame, nonce: Column) -> DataFrame:
    """Adds ``upstream``: excluded segments dropped, flagged or external ones wrapped.

    ``df``: (segments, decision, flagged_segment).  exclude drops the flagged segment;
    sanitize wraps it if it is external, else all external ones; otherwise all external
    content is wrapped; block gives null.
    """
    from quernstone.operators.segments import spotlight

    flagged = F.col("flagged_segment")
    kept = F.when(F.col("decision") == "exclude", F.filter("segments", lambda s: flagged.isNull() | (s.idx != flagged))).otherwise(F.col("segments"))
    flagged_external = F.exists("segments", lambda s: (s.idx == flagged) & s.tag.isin("RET", "TOOL"))
    only = F.when((F.col("decision") == "sanitize") & F.coalesce(flagged_external, F.lit(False)), flagged)
    df = df.withColumn("_k", kept).withColumn("_o", only)
    return df.withColumn("upstream", F.when(F.col("decision") != "block", spotlight(F.col("_k"), nonce, F.col("_o")))).drop("_k", "_o")


def canary_hits(outputs: DataFrame, text: str = "response_body", canary: str = "canary_token") -> DataFrame:
    """Adds ``leaked``: the canary stands in the output.  Null or empty canaries never leak."""
    return outputs.withColumn("leaked", F.coalesce((F.col(canary) != "") & F.contains(F.col(text), F.col(canary)), F.lit(False)))


def apply_leaks(decisions: DataFrame, leaks: DataFrame) -> DataFrame:
    """Requests whose output leaked are blocked with confidence 1 (left join overlay)."""
    hit = leaks.select("request_id").distinct().withColumn("_hit", F.lit(True))
    j = decisions.join(hit, "request_id", "left")
    h = F.coalesce("_hit", F.lit(False))
    return j.withColumn("decision", F.when(h, "block").otherwise(F.col("decision"))).withColumn("confidence", F.when(h, 1.0).otherwise(F.col("confidence"))).withColumn("canary_hit", h).drop("_hit")


def detection_rows(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``detections``: every result above allow, and the decision layer's own."""
    own = decisions.where("decision <> 'allow'").select(
        "request_id", F.lit("decision").alias("layer"), F.col("decision").alias("level"), "confidence", F.to_json("triggers").alias("trigger_tokens")
    )
    return results.where("level <> 'allow'").select("request_id", "layer", "level", "confidence", F.to_json("triggers").alias("trigger_tokens")).unionByName(own)


def blocked_response(decisions: DataFrame, cfg: EngineConfig | None = None, results: DataFrame | None = None) -> DataFrame:
    """Status, headers (their prefix is a parameter) and body of blocked requests; with ``results``
    the body holds the results of all layers, in their order."""
    prefix = (cfg or EngineConfig()).header_prefix
    if results is not None:
        row = F.struct("ordinal", "layer", "level", "confidence", "triggers")
        per = results.join(decisions.where("decision = 'block'").select("request_id"), "request_id", "left_semi").groupBy("request_id").agg(F.sort_array(F.collect_list(row)).alias("_r"))
        layers = F.transform("_r", lambda r: F.struct(r.layer.alias("layer"), r.level.alias("level"), r.confidence.alias("confidence"), r.triggers.alias("triggers")))
        with_layers = decisions.join(per, "request_id", "left").withColumn("layer_results", layers)
        error = F.struct(F.lit("request_blocked").alias("type"), "decision", "confidence", "triggers", "layer_results")
    else:
        with_layers, error = decisions, F.struct(F.lit("request_blocked").alias("type"), "decision", "confidence", "triggers")
    return with_layers.where("decision = 'block'").select(
        "request_id",
        F.lit(403).alias("status"),
        F.create_map(F.lit(f"{prefix}-decision"), F.col("decision"), F.lit(f"{prefix}-confidence"), F.format_number("confidence", 4)).alias("headers"),
        F.to_json(F.struct(error.alias("error"))).alias("body"),
    )


def body_error(body: Column) -> Column:
    """Why a request body is refused: not JSON, not an object, or no list of messages; null if fine."""
    v = F.try_parse_json(body)
    kind = F.schema_of_variant(v)
    m = F.schema_of_variant(F.try_variant_get(v, "$.messages", "variant"))
    return F.when(v.isNull(), "invalid json").when(~kind.startswith("OBJECT"), "body must be an object").when(m.isNull() | ~m.startswith("ARRAY"), "messages must be a list")


def completion_error(body: Column) -> Column:
    """Why a completion request's body is refused: not JSON, or no object with a prompt; null if fine."""
    v = F.try_parse_json(body)
    has = F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), "prompt")
    return F.when(v.isNull(), "invalid JSON body").when(~F.coalesce(has, F.lit(False)), "prompt is required")


def request_error(message: Column, request_id: Column, status: Column) -> Column:
    """struct<status, body> of a request that is refused (400) or on which the chain failed (503)."""
    kind = F.when(status < 500, "invalid_request_error").otherwise("proxy_error")
    body = F.to_json(F.struct(F.struct(message.alias("message"), kind.alias("type")).alias("error"), request_id.alias("request_id")))
    return F.struct(status.alias("status"), body.alias("body"))


def responses(requests: DataFrame, decisions: DataFrame, cfg: EngineConfig | None = None, completion_paths: tuple = ("/v1/completions",)) -> DataFrame:
    """(request_id, status, body) of every request (id, path, request_body[, upstream_status,
    response_body]): refused bodies 400, requests without a decision 503 (the chain failed),
    blocked ones 403, failing upstreams with their own status and what they said, else 200 and
    the upstream's body."""
    error = F.when(F.col("path").isin(*completion_paths), completion_error(F.col("request_body"))).otherwise(body_error(F.col("request_body")))
    r = requests.withColumnRenamed("id", "request_id").withColumn("_e", error)
    j = r.join(decisions.select("request_id", "decision"), "request_id", "left").join(blocked_response(decisions, cfg).select("request_id", F.col("body").alias("_blocked")), "request_id", "left")
    status = F.coalesce(F.col("upstream_status"), F.lit(200)) if "upstream_status" in requests.columns else F.lit(200)
    said = F.col("response_body") if "response_body" in requests.columns else F.lit(None).cast("string")
    refused, failed = request_error(F.col("_e"), F.col("request_id"), F.lit(400)), request_error(F.lit("request pipeline failed"), F.col("request_id"), F.lit(503))
    ok = F.struct(status.alias("status"), F.when(status >= 400, upstream_error(status, said, F.col("request_id"))).otherwise(said).alias("body"))
    out = F.when(F.col("_e").isNotNull(), refused).when(F.col("decision").isNull(), failed).when(F.col("decision") == "block", F.struct(F.lit(403).alias("status"), F.col("_blocked").alias("body"))).otherwise(ok)
    return j.select("request_id", out.alias("r")).select("request_id", "r.status", "r.body")


def upstream_error(status: Column, body: Column, request_id: Column) -> Column:
    """Body passed on from a failing upstream: a JSON object as it is, else its text, cut to
    2,000 characters, within an error."""
    is_obj = F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT")
    text = F.to_json(F.struct(F.coalesce(F.left(body, F.lit(2000)), F.lit("")).alias("error"), request_id.alias("request_id")))
    return F.when(status >= 400, F.when(F.coalesce(is_obj, F.lit(False)), body).otherwise(text))
