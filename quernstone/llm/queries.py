"""Queries of the llm problems, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import cuts, dedup, leaks, lookalike, mixing, pii, sentences, splits
from quernstone.session import cut_lineage, table


def _redacted(spark: SparkSession, d: str) -> DataFrame:
    logs = pii.redact(table(spark, d, "request_logs"), "id", ["request_body", "response_body"], "request_logs")
    return logs.unionByName(pii.redact(table(spark, d, "retrain_queue"), "id", ["text"], "retrain_queue"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(_redacted(spark, d))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every field with placeholders in place of its items, redelivered rows once."""
    return _redacted(spark, d).dropDuplicates(["table_name", "record_id", "field_name"]).withColumn(
        "pii_types", F.array_join("pii_types", ",")
    )


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Fields that hold items, per table, field and type."""
    return p1_found(spark, d).groupBy("table_name", "field_name", "pii_type").agg(F.count(F.lit(1)).alias("n_fields"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    queue = table(spark, d, "retrain_queue")
    return dedup.copies(dedup.keyed(queue), queue.count())  # the count comes from the files' footers


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """One record per group with its number of copies."""
    queue = table(spark, d, "retrain_queue")
    kept = dedup.groups(queue.select(F.col("id").cast("string")), cut_lineage(p2_found(spark, d)))
    return kept.join(queue.select("id", "text", "label", "source"), "id")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return cuts.judged(
        {
            "retrain_queue": (table(spark, d, "retrain_queue"), "id", "text", "source"),
            "attributions": (table(spark, d, "attributions"), "id", "text", "method"),
            "feedback_reports": (table(spark, d, "feedback_reports"), "feedback_id", "text", "channel"),
        }
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("is_cut").select("table_name", "record_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Rate of cuts per source, method and channel."""
    return (
        _judged(spark, d)
        .groupBy("table_name", F.col("grp").alias("source"))
        .agg(F.count(F.lit(1)).alias("n_texts"), F.count(F.when(F.col("is_cut"), 1)).alias("n_cut"), *[F.count(F.when(F.col("evidence") == e, 1)).alias(f"n_{e}") for e in ("limit", "mark", "word")])
        .withColumn("cut_rate", F.round(F.col("n_cut") / F.col("n_texts"), 6))
    )


def _forms(spark: SparkSession, d: str, with_text: bool = False) -> DataFrame:
    queue = lookalike.forms(table(spark, d, "retrain_queue"), "id", "text", "retrain_queue", with_text)
    return queue.unionByName(lookalike.forms(table(spark, d, "dataset_examples"), "example_id", "text", "dataset_examples", with_text))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look(_forms(spark, d))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its one consistent form."""
    return _forms(spark, d, True).select("table_name", F.col("id").alias("record_id"), "form")


def p4_readable(spark: SparkSession, d: str) -> DataFrame:
    """Every text cleaned and to read on: Cyrillic words keep or regain their letters."""
    return _forms(spark, d, True).select("table_name", F.col("id").alias("record_id"), "readable")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return splits.overlaps(table(spark, d, "dataset_examples"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs ordered by plain comparison, one train and one val example each."""
    a, b = F.col("val_id"), F.col("train_id")
    return _overlaps(spark, d).select(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id")).distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.report(_overlaps(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "holdout_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaks per source of the document and source of the item."""
    docs, items = table(spark, d, "documents"), table(spark, d, "holdout_items")
    found = p8_found(spark, d)
    return (
        found.join(docs.select("doc_id", F.col("source").alias("doc_source")), "doc_id")
        .join(items.select("item_id", F.col("source").alias("item_source")), "item_id")
        .groupBy("doc_source", "item_source")
        .agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("item_id").alias("n_items"))
    )


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return _mix(spark, d).chosen()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares."""
    return _mix(spark, d).shares()


def p9_stream(spark: SparkSession, d: str) -> DataFrame:
    """The mix as one globally sorted stream."""
    return _mix(spark, d).stream().orderBy("position")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences themselves, numbered within their document."""
    from pyspark.sql import Window as W

    docs = table(spark, d, "documents")
    spans = p10_found(spark, d)
    nr = F.row_number().over(W.partitionBy("doc_id").orderBy("start_pos")) - 1
    return spans.withColumn("sentence_no", nr).join(docs.select("doc_id", "text"), "doc_id").select(
        "doc_id", "sentence_no", F.expr("substring(text, start_pos + 1, end_pos - start_pos)").alias("sentence")
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p4_readable": p4_readable,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_stream": p9_stream,
    "p10_found": p10_found,
    "p10_sentences": p10_sentences,
}
# The oracle of problem 4 goes character by character with tables of its own, by code point.
_P4_PAIRS = (
    "0430a 0435e 043Eo 0440p 0441c 0443y 0445x 0456i 0457ï 0455s 0458j 04BBh 0501d 051Bq 051Dw 04CFl 0475v 0451ë 0410A 0412B 0415E 04173 "
    "041AK 041CM 041DH 041EO 0420P 0421C 0422T 0423Y 0425X 0406I 0407Ï 0405S 0408J 051AQ 051CW 04C0I 04AEY 0474V 0401Ë "
    "03BFo 03B9i 03BDv 03C1p 03C5u 0391A 0392B 0395E 0396Z 0397H 0399I 039AK 039CM 039DN 039FO 03A1P 03A4T 03A5Y 03A7X "
    "0585o 057Du 0570h 0578n 0581g 0555O 054FS 054DU 053CL 0261g 0131i 0251a 217Cl 2160I 2164V 2169X 216CL 216DC 216ED 216FM 2170i 2174v 2179x 217Dc 217Ed 217Fm 2010- 2011-"
).split()
_P4_MAP = "MAP {" + ", ".join(f"'{chr(int(x[:4], 16))}': '{x[4:]}'" for x in _P4_PAIRS) + "}"
_P4_CHAR = f"""CASE WHEN u < 128 THEN c WHEN u BETWEEN 65281 AND 65374 THEN chr(CAST(u - 65248 AS INT)) WHEN u IN (160, 5760, 8239, 8287, 12288) OR u BETWEEN 8192 AND 8202 THEN ' '
  WHEN u IN (173, 847, 1564, 4447, 4448, 6068, 6069, 12644, 65279, 65440) OR u BETWEEN 6155 AND 6158 OR u BETWEEN 8203 AND 8207 OR u BETWEEN 8234 AND 8238 OR u BETWEEN 8288 AND 8292 OR u BETWEEN 8294 AND 8303 OR u BETWEEN 65024 AND 65039 THEN ''
  WHEN u BETWEEN 64256 AND 64262 THEN ['ff', 'fi', 'fl', 'ffi', 'ffl', 'st', 'st'][u - 64255] ELSE coalesce(({_P4_MAP})[c], c) END"""
_P4_SQL = f"""WITH t AS (SELECT 'retrain_queue' AS table_name, id, text AS t FROM retrain_queue WHERE text IS NOT NULL UNION ALL SELECT 'dataset_examples', example_id, text FROM dataset_examples WHERE text IS NOT NULL),
m AS (SELECT c, {_P4_CHAR} AS x FROM (SELECT DISTINCT c, unicode(c) AS u FROM (SELECT unnest(regexp_extract_all(nfc_normalize(t), '(?s).')) AS c FROM t))),
mm AS (SELECT map_from_entries(list((c, x))) AS mm FROM m),
f AS (SELECT table_name, id, trim(regexp_replace(nfc_normalize(array_to_string(list_transform(regexp_extract_all(nfc_normalize(t), '(?s).'), lambda c: mm[c]), '')), '\\s+', ' ', 'g')) AS form,
  trim(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g'), E' \\t\\r\\n') AS raw FROM t, mm)"""

ORACLES: dict[str, str] = {
    "p4_found": f"{_P4_SQL} SELECT DISTINCT a.table_name, a.id AS left_id, b.id AS right_id FROM f a JOIN f b ON a.table_name = b.table_name AND a.form = b.form AND a.raw <> b.raw AND a.id < b.id",
    "p4_forms": f"{_P4_SQL} SELECT table_name, id AS record_id, form FROM f",
}
