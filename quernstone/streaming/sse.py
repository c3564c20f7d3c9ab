"""Model output as event streams: reassembly, and canary search across chunk borders."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: bytes kept besides the canary's own length
TAIL_SLACK = 32


def sse_text(stream: Column) -> Column:
    """Text of an event stream: the contents of all ``data:`` lines that hold JSON, in order.

    ``choices[].delta.content`` is a string or a list of parts with text, else
    ``choices[].text``.  ``[DONE]`` and broken lines are skipped.  Native throughout.
    """
    lines = F.filter(F.split(F.regexp_replace(stream, "\r\n", "\n"), "\n"), lambda x: x.startswith("data:"))
    docs = F.transform(lines, lambda x: F.try_parse_json(F.trim(F.substring(x, F.lit(6), F.length(x)))))
    choices = F.flatten(F.transform(F.filter(docs, lambda d: d.isNotNull()), lambda d: F.coalesce(F.try_variant_get(d, "$.choices", "array<variant>"), F.array().cast("array<variant>"))))

    def text(c: Column) -> Column:
        content = F.try_variant_get(c, "$.delta.content", "variant")
        kind = F.coalesce(F.schema_of_variant(content), F.lit("VOID"))
        parts = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
        return (
            F.when(kind == "STRING", F.try_variant_get(content, "$", "string"))
            .when(kind.startswith("ARRAY"), F.array_join(parts, ""))
            .otherwise(F.coalesce(F.try_variant_get(c, "$.text", "string"), F.lit("")))
        )

    return F.array_join(F.transform(choices, text), "")


def reassemble(chunks: DataFrame) -> DataFrame:
    """(request_id, text) of byte chunks (request_id, seq, payload) cut anywhere, also inside
    a character.  Broken bytes become replacement characters; null payloads are empty."""
    ordered = chunks.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.hex("payload").alias("h")))).alias("c"))
    raw = F.unhex(F.array_join(F.transform("c", lambda x: F.coalesce(x.h, F.lit(""))), ""))
    return ordered.select("request_id", sse_text(F.make_valid_utf8(raw.cast("string"))).alias("text"))


def first_leak(chunks: DataFrame, canaries: DataFrame) -> DataFrame:
    """(request_id, leak_seq): the chunk in which the canary is complete, null if it never is.
    Chunks before it may be forwarded, it and later ones not."""
    length = F.coalesce(F.octet_length("payload"), F.lit(0))
    upto = chunks.withColumn("_upto", F.sum(length).over(W.partitionBy("request_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))
    ordered = upto.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", F.hex("payload").alias("h")))).alias("c"), F.sort_array(F.collect_list(F.struct("_upto", "seq"))).alias("ends")
    )
    j = ordered.join(canaries.select("request_id", F.decode(F.encode("canary", "UTF-8"), "ISO-8859-1").alias("k")), "request_id")
    joined = F.unhex(F.array_join(F.transform("c", lambda x: F.coalesce(x.h, F.lit(""))), ""))
    at = F.instr(F.decode(joined, "ISO-8859-1"), F.col("k"))  # a character per byte
    end = at - 1 + F.length("k")
    hit = F.array_min(F.transform(F.filter("ends", lambda e: e["_upto"] >= end), lambda e: e.seq))
    return j.select("request_id", F.when((at > 0) & (F.length("k") > 0), hit).alias("leak_seq"))


#: bytes of one line that are kept until it ends; a longer line is searched as bytes only
MAX_LINE = 1 << 20
STATE = "tail binary, line binary, text string, leaked boolean, told boolean"
OUT = "request_id string, seq bigint, forward boolean, leaked boolean, event string"


def error_event(kind: str, message: str, request_id: str, **more) -> str:
    """An error as an event of the stream, and the stream's end."""
    error = {"type": kind, **more, "message": message}
    return "data: " + json.dumps({"error": error, "request_id": request_id}, ensure_ascii=False) + "\n\ndata: [DONE]\n\n"


def _delta(line: bytes) -> str:
    """Text that a data line adds to the output; other lines add none."""
    if not line.startswith(b"data:"):
        return ""
    try:
        event = json.loads(line[5:].decode("utf-8", "replace"))
        out = []
        for c in event.get("choices") or []:
            content = (c.get("delta") or {}).get("content")
            if isinstance(content, str):
                out.append(content)
            elif isinstance(content, list):
                out += [p.get("text") or "" for p in content if isinstance(p, dict)]
            else:
                out.append(c.get("text") or "")
        return "".join(out)
    except (ValueError, AttributeError, TypeError):
        return ""


def canary_guard(stream: DataFrame, keep_minutes: int = 15, at: str = "at") -> DataFrame:
    """Streaming guard over chunks (request_id, seq, payload, canary[, at]): (request_id, seq,
    forward, leaked, event).

    Two searches run.  The bytes: the last ``len(canary) + TAIL_SLACK`` of a request are kept,
    so a canary cut by chunk or batch borders is found; from that chunk on nothing is
    forwarded and ``event`` of that chunk is the error event that ends the stream.  The text:
    data lines are put together as they come, so a canary spread over events is found;
    it shows with the chunk that ends the stream (``[DONE]``), whose event is then the error.
    The state of a request goes with the end of its stream, or once the watermark is
    ``keep_minutes`` past its last chunk (its time ``at``, or that of the batch).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        columns = ["request_id", "seq", "forward", "leaked", "event"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        tail, line, text, leaked, told = state.get if state.exists else (b"", b"", "", False, False)
        tail, line, in_text, ended = bytes(tail), bytes(line), False, False
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, payload, canary in zip(rows["seq"], rows["payload"], rows["canary"]):
            mark, chunk = (canary or "").encode(), bytes(payload or b"")
            tail += chunk
            raw = bool(mark) and mark in tail
            *whole, line = (line + chunk).replace(b"\r\n", b"\n").split(b"\n")
            line = line if len(line) <= MAX_LINE else b""
            text += "".join(map(_delta, whole))
            in_text = in_text or bool(canary) and canary in text
            ended = ended or any(x.strip() == b"data: [DONE]" for x in whole) or line.strip() == b"data: [DONE]"
            leaked = leaked or raw or (ended and in_text)
            event = error_event("blocked", "Response stopped: it gave away a hidden marker", key[0], code="output_guard") if leaked and not told else None
            told = told or leaked
            out.append((key[0], int(seq), not leaked, leaked, event))
            tail, keep = tail[-(len(mark) + TAIL_SLACK) :], len(canary or "") + TAIL_SLACK
            text = text[-keep:] if not in_text else canary
        if ended and not leaked:
            state.remove()
        else:
            state.update((tail, line, text, leaked, told))
            state.setTimeoutTimestamp(max(int(rows["ms"].max()), state.getCurrentWatermarkMs()) + keep_minutes * 60_000)
        yield pd.DataFrame(out, columns=columns)

    timed = stream if at in stream.columns else stream.withColumn(at, F.current_timestamp())
    timed = timed.withWatermark(at, "1 minute").select("request_id", "seq", "payload", "canary", F.unix_millis(at).alias("ms"), at)
    return timed.groupBy("request_id").applyInPandasWithState(step, OUT, STATE, "append", "EventTimeTimeout")


def closing_event(outputs: DataFrame) -> DataFrame:
    """Adds ``http_status`` and ``event`` to outputs (request_id, status, message, leaked): how a
    stream ends whose upstream failed.  ``status`` is null or 200 where all went well, the
    upstream's status, ``timeout`` (504) or anything else (502); a leak ends it whatever the status."""
    code = F.col("status").try_cast("int")
    kind = F.when(code >= 400, "upstream_error").when(F.col("status") == "timeout", "upstream_timeout").when(F.col("status").isNotNull() & code.isNull(), "proxy_error")
    leaked = F.coalesce("leaked", F.lit(False))
    error = F.when(leaked, F.struct(F.lit("blocked").alias("type"), F.lit("Response stopped: it gave away a hidden marker").alias("message"))).when(
        kind.isNotNull(), F.struct(kind.alias("type"), F.coalesce("message", F.lit("")).alias("message"))
    )
    event = F.concat(F.lit("data: "), F.to_json(F.struct(error.alias("error"), "request_id")), F.lit("\n\ndata: [DONE]\n\n"))
    http = F.when(leaked, 200).when(code >= 400, code).when(F.col("status") == "timeout", 504).when(kind.isNotNull(), 502).otherwise(200)
    return outputs.withColumn("http_status", http).withColumn("event", F.when(error.isNotNull(), event))
