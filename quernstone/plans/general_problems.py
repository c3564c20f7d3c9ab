"""Queries of the general (non-llm) data problems: nested records, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import nested, references as refs
from quernstone.session import table

REFERRING = ("detections", "attributions", "retrain_queue")


def _nested_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {name: table(spark, d, name) for name in nested.COLUMNS}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Supertype keys of all children."""
    return nested.all_children(_nested_tables(spark, d), typed=False).select(*nested.KEYS)


def p5_variants(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of every child kind, with their numbers of children."""
    kids = nested.all_children(_nested_tables(spark, d))
    shape = F.substring_index("variant", "#", 1)
    return kids.groupBy("table_name", "child_kind", "parent_kind", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n_children"))


def _subtype(table_name: str, kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        kids = nested.children(table(spark, d, table_name), table_name, nested.COLUMNS[table_name][0])
        out = nested.subtype_table(kids, kind).drop("variant")
        return out.withColumns({c: F.round(c, 9) for c, (_, t) in nested.SUBTYPES[kind].items() if t == "double"})

    query.__name__ = f"p5_{kind}s"
    return query


def p5_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Elements of every array at any path of the request bodies, per path and level."""
    kids = nested.array_children(table(spark, d, "request_logs").select("id", "request_body").distinct(), "request_body")
    return kids.groupBy("path", "parent_path").agg(F.count(F.lit(1)).alias("n_elements"), F.countDistinct("record_id").alias("n_records"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return refs.references({t: table(spark, d, t) for t in REFERRING})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return refs.orphan_records(_refs(spark, d), table(spark, d, "request_logs")).select("table_name", "record_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    out = refs.orphan_counts(_refs(spark, d), table(spark, d, "request_logs"))
    return out.withColumn("orphan_rate", F.round(F.col("n_orphans") / F.col("n_references"), 6))


QUERIES = {
    "p5_found": p5_found,
    "p5_variants": p5_variants,
    "p5_arrays": p5_arrays,
    **{f"p5_{k}s": _subtype(t, k) for t, (_, kinds) in nested.COLUMNS.items() for k in kinds},
    "p7_found": p7_found,
    "p7_report": p7_report,
}

_REFS_SQL = """
WITH seen AS (
  SELECT lower(trim(id)) AS k, min(created_at) AS first_at FROM request_logs
  WHERE trim(id) <> '' GROUP BY 1),
refs AS (
  SELECT 'detections' AS table_name, id AS record_id, lower(trim(request_id)) AS k, created_at FROM detections
  UNION ALL SELECT 'attributions', id, lower(trim(request_id)), created_at FROM attributions
  UNION ALL SELECT 'retrain_queue', id, lower(trim(request_id)), created_at FROM retrain_queue),
judged AS (
  SELECT table_name, record_id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS period,
         (first_at IS NULL OR first_at > created_at) AS orphan
  FROM refs LEFT JOIN seen USING (k) WHERE k <> '')
"""



def _read(table_name: str, column: str) -> str:
    """id, j: the column's JSON, a JSON string read as the JSON in it."""
    inner = f"{column}->>'$'"
    return (
        f"SELECT id, CASE WHEN json_type({column}) = 'VARCHAR' THEN CASE WHEN json_valid({inner}) THEN CAST({inner} AS JSON) END ELSE CAST({column} AS JSON) END AS j "
        f"FROM {table_name} WHERE json_valid({column})"
    )


def _items(source: str, value: str, path: str, keep: str) -> str:
    """Rows (keep, v, i) of an array at ``path``, a single value as element 0."""
    return (
        f"SELECT {keep}, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS i FROM (SELECT {keep}, CASE json_type({value}, '{path}') WHEN 'ARRAY' THEN json_extract({value}, '{path}[*]') "
        f"ELSE [json_extract({value}, '{path}')] END AS l FROM {source} WHERE json_type({value}, '{path}') IS NOT NULL)"
    )


_P5_CTE = f"""
WITH r AS ({_read("request_logs", "request_body")}), d AS ({_read("detections", "detail")}), a AS ({_read("attributions", "tokens")}),
ro AS (SELECT * FROM r WHERE json_type(j) = 'OBJECT'), dx AS (SELECT * FROM d WHERE json_type(j) = 'OBJECT'),
m AS ({_items("ro", "j", "$.messages", "id")}), mo AS (SELECT id, v AS mv, i AS o FROM m WHERE json_type(v) = 'OBJECT'),
p AS ({_items("(SELECT * FROM mo WHERE json_type(mv, '$.content') IN ('ARRAY', 'OBJECT'))", "mv", "$.content", "id, o")}), c AS ({_items("mo", "mv", "$.tool_calls", "id, o")}),
s AS ({_items("dx", "j", "$.per_segment", "id")}), so AS (SELECT id, v AS sv, i AS o FROM s WHERE json_type(v) = 'OBJECT'), t AS ({_items("so", "sv", "$.triggers", "id, o")}),
x AS ({_items("(SELECT * FROM dx WHERE json_type(j, '$.xai') = 'OBJECT')", "j", "$.xai.tokens", "id")}),
k AS ({_items("a", "j", "$", "id")}),
u AS (
  SELECT 'request_logs' AS table_name, id, 'message' AS child_kind, i AS outer_idx, -1 AS inner_idx, v FROM m UNION ALL SELECT 'request_logs', id, 'part', o, i, v FROM p
  UNION ALL SELECT 'request_logs', id, 'tool_call', o, i, v FROM c UNION ALL SELECT 'detections', id, 'segment', i, -1, v FROM s UNION ALL SELECT 'detections', id, 'trigger', o, i, v FROM t
  UNION ALL SELECT 'detections', id, 'xai_token', i, -1, v FROM x UNION ALL SELECT 'attributions', id, 'token', i, -1, v FROM k),
w AS (SELECT DISTINCT table_name, id AS record_id, child_kind, CASE child_kind WHEN 'part' THEN 'message' WHEN 'tool_call' THEN 'message' WHEN 'trigger' THEN 'segment' ELSE 'record' END AS parent_kind,
  CAST(outer_idx AS INT) AS outer_idx, CAST(inner_idx AS INT) AS inner_idx, v FROM u WHERE json_type(v) <> 'NULL')
"""
_P5_SQL = _P5_CTE + "SELECT table_name, record_id, child_kind, outer_idx, inner_idx FROM w"


def _type_sql(v: str) -> str:
    return f"CASE json_type({v}) WHEN 'ARRAY' THEN 'arr' WHEN 'OBJECT' THEN 'obj' WHEN 'VARCHAR' THEN 'str' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' ELSE 'num' END"


_VARIANTS_SQL = f"""{_P5_CTE}, z AS (SELECT table_name, child_kind, parent_kind, CASE json_type(v)
  WHEN 'OBJECT' THEN '{{' || array_to_string(list_transform(list_sort(json_keys(v)), lambda f: f || ':' || {_type_sql("json_extract(v, '/' || f)")}), ',') || '}}'
  WHEN 'ARRAY' THEN '[' || array_to_string(list_sort(list_distinct(list_transform(json_extract(v, '$[*]'), lambda e: {_type_sql("e")}))), '|') || ']' ELSE {_type_sql("v")} END AS shape FROM w)
SELECT table_name, child_kind, parent_kind, shape, count(*) AS n_children FROM z GROUP BY ALL"""


def _subtype_sql(kind: str) -> str:
    def col(name: str, path: tuple, t: str) -> str:
        text = f"v->>'$.{'.'.join(path)}'" if path else "v->>'$'"
        return f"round(TRY_CAST({text} AS DOUBLE), 9) AS {name}" if t == "double" else f"TRY_CAST({text} AS {'INT' if t == 'int' else 'VARCHAR'}) AS {name}"

    cols = ", ".join(col(c, path, t) for c, (path, t) in nested.SUBTYPES[kind].items())
    return f"{_P5_CTE} SELECT table_name, record_id, outer_idx, inner_idx, parent_kind, {cols} FROM w WHERE child_kind = '{kind}'"


ORACLES = {
    "p5_found": _P5_SQL,
    "p5_variants": _VARIANTS_SQL,
    **{f"p5_{k}s": _subtype_sql(k) for k in nested.KINDS},
    "p7_found": _REFS_SQL + "SELECT DISTINCT table_name, record_id FROM judged WHERE orphan",
    "p7_report": _REFS_SQL
    + """SELECT table_name, period, count(*) AS n_references, CAST(count(*) FILTER (orphan) AS BIGINT) AS n_orphans,
         round(count(*) FILTER (orphan) / count(*), 6) AS orphan_rate
         FROM (SELECT table_name, record_id, any_value(period) AS period, bool_or(orphan) AS orphan FROM judged GROUP BY 1, 2)
         GROUP BY 1, 2""",
}
