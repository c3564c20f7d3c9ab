"""SQL functions of the engine for use in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quernstone.config import EngineConfig
from quernstone.functions.normalizer import _series
from quernstone.operators.detect import RULE_WEIGHT
from quernstone.operators.segments import segments_sql
from quernstone.sources.rules import Rule, load_rules


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, cfg: EngineConfig | None = None, rules: list[Rule] | None = None) -> None:
    """Registers ``normalize_text`` (Arrow), ``rule_score(text, tag)`` with the rules given (those
    of the package by default), ``shannon_entropy``, ``rot13`` and ``decision_level`` as native SQL
    functions, and the table function ``explode_segments(body)``: (idx, tag, role, content)."""
    cfg = cfg or EngineConfig()
    rules = load_rules() if rules is None else rules
    whens = " ".join(f"WHEN t RLIKE {_quoted(r.java)} THEN {r.weight}D" for r in sorted(rules, key=lambda r: -r.weight))
    best = f"CASE {whens} ELSE 0D END" if rules else "0D"
    weight = " ".join(f"WHEN '{k}' THEN {v}D" for k, v in RULE_WEIGHT.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rule_score(t STRING, tag STRING) RETURNS DOUBLE RETURN {best} * CASE tag {weight} ELSE 1D END")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION explode_segments(body STRING) RETURNS TABLE (idx INT, tag STRING, role STRING, content STRING) RETURN
        SELECT s.idx, s.tag, s.role, s.content FROM (SELECT explode({segments_sql('body')}) AS s)"""
    )
    spark.udf.register("normalize_text", F.pandas_udf(_series, StringType()))
    spark.sql(
        r"""CREATE OR REPLACE TEMPORARY FUNCTION shannon_entropy(t STRING) RETURNS DOUBLE RETURN
        CASE WHEN length(t) > 0 THEN aggregate(regexp_extract_all(array_join(array_sort(split(t, '')), ''), '(?s)((.)\\2*)', 1), 0D, (a, r) -> a - (length(r) / length(t)) * log2(length(r) / length(t))) ELSE 0D END"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION rot13(t STRING) RETURNS STRING RETURN
        translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION decision_level(c DOUBLE) RETURNS STRING RETURN
        CASE WHEN c >= {cfg.threshold_block} THEN 'block' WHEN c >= {cfg.threshold_exclude} THEN 'exclude' WHEN c >= {cfg.threshold_sanitize} THEN 'sanitize' WHEN c >= {cfg.threshold_log} THEN 'log' ELSE 'allow' END"""
    )
