"""Readers: log tables, JSONL corpora, holdouts, benchmark formats, metrics text, event streams."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.text import py_strip
from quernstone.operators.retrain import REGISTRY_SCHEMA, dataset_label

SCHEMAS = {
    "request_logs": "id string, created_at timestamp, method string, path string, model string, upstream_model string, decision string, confidence double, "
    "canary_token string, canary_hit boolean, latency_ms int, request_body string, response_body string",
    "detections": "id string, request_id string, created_at timestamp, layer string, level string, confidence double, trigger_tokens string, detail string",
    "attributions": "id string, request_id string, created_at timestamp, layer string, method string, model string, score double, text string, tokens string",
    "retrain_queue": "id string, created_at timestamp, text string, label string, source string, request_id string, confidence double, decision string, status string, meta string",
}


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_log_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A log table; a missing one is empty with its schema."""
    try:
        return spark.read.schema(T._parse_datatype_string(SCHEMAS[name])).parquet(f"{root}/{name}.parquet")
    except AnalysisException:
        return empty(spark, SCHEMAS[name])


def sync_url(url: str) -> str:
    """JDBC-style URL of an asynchronous driver's URL."""
    for drv in ("+aiosqlite", "+asyncpg", "+psycopg"):
        url = url.replace(drv, "")
    return url


def read_jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, lower=None, upper=None, parts: int = 16) -> DataFrame:
    """A log table of a database; with a numeric or time column the read is split in ranges."""
    r = spark.read.format("jdbc").option("url", url if url.startswith("jdbc:") else "jdbc:" + sync_url(url)).option("dbtable", name)
    if column is not None:
        r = r.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return r.load()


def _first_truthy(v: Column, keys: tuple) -> Column:
    return F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in keys])


def coerce_example(v: Column, source: Column) -> Column:
    """struct<text,label,source> of a corpus record, null if it has no text or label.

    text: first non-empty of text, prompt, content, request; label: first key present of
    label, is_injection, attack, so that an explicit null is not replaced.
    """
    text = F.left(py_strip(_first_truthy(v, ("text", "prompt", "content", "request"))), F.lit(4096))
    raw = F.lit(None).cast("variant")
    for k in ("attack", "is_injection", "label"):
        x = F.try_variant_get(v, f"$.{k}", "variant")
        raw = F.when(x.isNotNull(), x).otherwise(raw)
    label = dataset_label(F.try_variant_get(raw, "$", "string"))
    return F.when((text != "") & label.isNotNull(), F.struct(text.alias("text"), label.alias("label"), F.coalesce(F.try_variant_get(v, "$.source", "string"), source).alias("source")))


def read_corpora(spark: SparkSession, path: str) -> DataFrame:
    """(text, label, source, file_name, line_no) of JSONL files (one or a folder of them).

    Blank lines, broken lines and lines that are no object are left out; a missing path
    is empty.  The file's name without suffix is the source.  First-wins order of files is
    that of their names; of lines that of ``line_no``, which grows along a file (it is a line's place
    in the scan, which splits a file in order).
    """
    out = "text string, label int, source string, file_name string, line_no decimal(38,0)"
    glob = path if path.endswith(".jsonl") or "*" in path else os.path.join(path, "*.jsonl")
    try:
        place = F.col("_metadata.file_block_start").cast("decimal(38,0)") * F.lit(1 << 33).cast("decimal(38,0)") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        lines = spark.read.text(glob).select("value", F.col("_metadata.file_name").alias("file_name"), place.cast("decimal(38,0)").alias("line_no"))
    except AnalysisException:
        return empty(spark, out)
    v = F.try_parse_json("value")
    stem = F.regexp_replace("file_name", r"\.jsonl$", "")
    rows = lines.where(F.trim("value") != "").withColumn("v", v).where(F.schema_of_variant("v").startswith("OBJECT"))
    got = rows.select(coerce_example(F.col("v"), stem).alias("e"), "file_name", "line_no").where("e is not null")
    return got.select("e.*", "file_name", F.col("line_no").cast("decimal(38,0)").alias("line_no"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(text, label, source) of a written split; broken lines are left out."""
    return read_corpora(spark, path).drop("file_name", "line_no")


def read_holdout(spark: SparkSession, path: str) -> DataFrame:
    """Strict: a broken line raises when the rows are read."""
    return spark.read.schema("id int, source string, label int, text string").option("mode", "FAILFAST").json(path)


def read_goals_csv(spark: SparkSession, path: str, source: str = "advbench") -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"').select(F.col("goal").alias("text"), F.lit(1).alias("label"), F.lit(source).alias("source"))


def read_jailbreaks(spark: SparkSession, path: str, source: str = "jbb") -> DataFrame:
    """Prompts of ``jailbreaks[]`` that did jailbreak."""
    schema = "jailbreaks array<struct<prompt:string,jailbroken:boolean>>"
    j = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("jailbreaks").alias("j"))
    return j.where("j.jailbroken and j.prompt is not null").select(F.col("j.prompt").alias("text"), F.lit(1).alias("label"), F.lit(source).alias("source"))


def instruction_text(instruction: Column, more: Column) -> Column:
    """Instruction and input, non-blank ones joined by a line break."""
    keep = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws("\n", keep(instruction), keep(more))


def read_instructions(spark: SparkSession, path: str, source: str = "alpaca", max_chars: int = 4000) -> DataFrame:
    """Benign examples of an instruction set (instruction, input) in parquet: both joined, white space collapsed."""
    df = spark.read.parquet(path)
    more = F.coalesce(F.col("input").cast("string"), F.lit("")) if "input" in df.columns else F.lit("")
    text = F.left(F.regexp_replace(py_strip(instruction_text(F.coalesce("instruction", F.lit("")), more)), r"(?U)\s+", " "), F.lit(max_chars))
    return df.select(text.alias("text"), F.lit(0).alias("label"), F.lit(source).alias("source")).where("text <> ''")


def read_labelled(spark: SparkSession, path: str, source: str = "pi", max_chars: int = 4000) -> DataFrame:
    """Labelled prompts (text, label) in parquet; blank texts and null labels are left out."""
    text = F.left(F.regexp_replace(py_strip(F.col("text")), r"(?U)\s+", " "), F.lit(max_chars))
    return spark.read.parquet(path).select(text.alias("text"), F.col("label").cast("int").alias("label"), F.lit(source).alias("source")).where("text <> '' and label is not null")


def read_exposition(spark: SparkSession, path: str) -> DataFrame:
    """(line, line_no) of scraped metrics text; a missing file is empty."""
    try:
        return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("line_no"))
    except AnalysisException:
        return empty(spark, "line string, line_no bigint")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The model registry; a missing or broken file is empty."""
    try:
        df = spark.read.schema(T._parse_datatype_string(REGISTRY_SCHEMA)).json(path, mode="DROPMALFORMED")
        return df.where("version is not null")
    except AnalysisException:
        return empty(spark, REGISTRY_SCHEMA)


def read_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)
