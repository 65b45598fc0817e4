"""Queries of the core operators: name -> (spark, directory) -> DataFrame, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoweft.operators import proximity, schema_drift

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


P1_SQL = r"""
WITH own AS (
  SELECT p.dataset, p.file_seq, p.record_no, p.id, '' AS l, j.key AS key, j.type AS jt, j.value AS v, -1 AS pos
  FROM gers_target_schema_probe p, json_each(CAST(p.payload AS JSON)) j
), elements AS (
  SELECT o.dataset, o.file_seq, o.record_no, o.id, o.key AS l, e.value AS ev, CAST(e.id AS BIGINT) AS pos
  FROM own o, json_each(CASE WHEN o.jt = 'ARRAY' THEN o.v ELSE CAST('[]' AS JSON) END) e
  WHERE o.jt = 'ARRAY' AND e.type = 'OBJECT'
), inner_keys AS (
  SELECT e.dataset, e.file_seq, e.record_no, e.id, e.l, j.key AS key, j.type AS jt, j.value AS v, e.pos
  FROM elements e, json_each(e.ev) j
), every AS (
  SELECT * FROM own UNION ALL SELECT * FROM inner_keys
), kinds AS (
  SELECT *, CASE WHEN jt = 'VARCHAR' THEN 'text' WHEN jt IN ('BIGINT','UBIGINT','HUGEINT') THEN 'whole' WHEN jt = 'DOUBLE' THEN 'decimal'
                 WHEN jt = 'BOOLEAN' THEN 'boolean' WHEN jt = 'ARRAY' THEN 'list' WHEN jt = 'OBJECT' THEN 'object' END AS kind
  FROM every
), counts AS (
  SELECT dataset, file_seq, l, key, count(kind) AS n,
         count(*) FILTER (WHERE kind = 'text') AS c1, count(*) FILTER (WHERE kind = 'whole') AS c2, count(*) FILTER (WHERE kind = 'decimal') AS c3,
         count(*) FILTER (WHERE kind = 'boolean') AS c4, count(*) FILTER (WHERE kind = 'list') AS c5, count(*) FILTER (WHERE kind = 'object') AS c6
  FROM kinds GROUP BY ALL
), fields AS (
  SELECT *, CASE WHEN greatest(c1,c2,c3,c4,c5,c6) = 0 THEN NULL WHEN c1 = greatest(c1,c2,c3,c4,c5,c6) THEN 'text' WHEN c2 = greatest(c1,c2,c3,c4,c5,c6) THEN 'whole'
                 WHEN c3 = greatest(c1,c2,c3,c4,c5,c6) THEN 'decimal' WHEN c4 = greatest(c1,c2,c3,c4,c5,c6) THEN 'boolean' WHEN c5 = greatest(c1,c2,c3,c4,c5,c6) THEN 'list' ELSE 'object' END AS prevailing
  FROM counts
), pairs AS (
  SELECT DISTINCT a.dataset, a.file_seq FROM fields a JOIN fields b ON a.dataset = b.dataset AND a.file_seq = b.file_seq + 1
), kept AS (
  SELECT a.dataset, a.file_seq, a.key FROM fields a JOIN fields b ON a.dataset = b.dataset AND a.file_seq = b.file_seq + 1 AND a.key = b.key AND a.l = '' AND b.l = ''
  WHERE a.prevailing = 'list' AND b.prevailing = 'list'
), both_files AS (
  SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.file_seq, b.file_seq + 1) AS file_seq, coalesce(a.l, b.l) AS l, coalesce(a.key, b.key) AS key,
         a.key IS NOT NULL AS is_now, b.key IS NOT NULL AS was, a.n, b.prevailing AS before,
         CASE b.prevailing WHEN 'text' THEN a.c1 WHEN 'whole' THEN a.c2 WHEN 'decimal' THEN a.c3 WHEN 'boolean' THEN a.c4 WHEN 'list' THEN a.c5 WHEN 'object' THEN a.c6 END AS as_before
  FROM fields a FULL JOIN fields b ON a.dataset = b.dataset AND a.file_seq = b.file_seq + 1 AND a.l = b.l AND a.key = b.key
), comparable AS (
  SELECT c.* FROM both_files c JOIN pairs p ON c.dataset = p.dataset AND c.file_seq = p.file_seq
  WHERE c.l = '' OR EXISTS (SELECT 1 FROM kept k WHERE k.dataset = c.dataset AND k.file_seq = c.file_seq AND k.key = c.l)
), gone AS (SELECT * FROM comparable WHERE NOT is_now), fresh AS (SELECT * FROM comparable WHERE NOT was),
per_id AS (
  SELECT dataset, file_seq, l, key, id, record_no, string_agg(pos || ':' || CAST(v AS VARCHAR), '|' ORDER BY pos) AS s
  FROM kinds WHERE kind IS NOT NULL GROUP BY ALL
), per_file_id AS (
  SELECT dataset, file_seq, l, key, id, arg_min(s, record_no) AS s FROM per_id GROUP BY ALL
), score AS (
  SELECT g.dataset, g.file_seq, g.l, g.key AS old_key, f.key AS new_key, count(*) FILTER (WHERE replace(a.s, ' ', '') = replace(b.s, ' ', '')) AS eq, count(*) AS n
  FROM gone g JOIN fresh f ON g.dataset = f.dataset AND g.file_seq = f.file_seq AND g.l = f.l
  JOIN per_file_id a ON a.dataset = g.dataset AND a.file_seq = g.file_seq - 1 AND a.l = g.l AND a.key = g.key
  JOIN per_file_id b ON b.dataset = f.dataset AND b.file_seq = f.file_seq AND b.l = f.l AND b.key = f.key AND a.id = b.id
  GROUP BY ALL
), renamed AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, file_seq, l, old_key ORDER BY eq DESC, new_key) AS i,
                        row_number() OVER (PARTITION BY dataset, file_seq, l, new_key ORDER BY eq DESC, old_key) AS k FROM score WHERE 2 * eq > n) WHERE i = 1 AND k = 1
), changes AS (
  SELECT dataset, file_seq, l, key, 'added' AS change_kind FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.dataset = f.dataset AND r.file_seq = f.file_seq AND r.l = f.l AND r.new_key = f.key)
  UNION ALL
  SELECT dataset, file_seq, l, key, 'removed' FROM gone f WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.dataset = f.dataset AND r.file_seq = f.file_seq AND r.l = f.l AND r.old_key = f.key)
  UNION ALL
  SELECT dataset, file_seq, l, new_key, 'renamed' FROM renamed
  UNION ALL
  SELECT dataset, file_seq, l, key, 'retyped' FROM comparable WHERE is_now AND was AND before IS NOT NULL AND 2 * (n - as_before) > n
)
SELECT dataset, CAST(file_seq AS BIGINT) AS file_seq, CASE WHEN l = '' THEN key ELSE l || '.' || key END AS field, change_kind FROM changes
"""


@query("p1_found", P1_SQL)
def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Every change of a file against the one before it."""
    changes = schema_drift.schema_changes(table(spark, directory, "gers_target_schema_probe"))
    return changes.select("dataset", "file_seq", "field", "change_kind")


@query("p1_table")
def p1_table(spark: SparkSession, directory: str) -> DataFrame:
    """All records in the one schema that the lattice fold gives."""
    return schema_drift.consistent_table(table(spark, directory, "gers_target_schema_probe"))


@query("p3_found")
def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Linked records within 75 m and the area around each location."""
    return proximity.nearby(table(spark, directory, "gers_user_input"), table(spark, directory, "gers_output"), table(spark, directory, "division_area"))


P3_NEAR_SQL = """
    SELECT DISTINCT u.record_id, o.record_id AS other_id
    FROM gers_user_input u JOIN gers_output o
      ON o.gers_match_distance_m BETWEEN 0 AND 75
     AND sqrt(pow((o.longitude - u.longitude) * 111320.0 * cos(radians((o.latitude + u.latitude) / 2.0)), 2) + pow((o.latitude - u.latitude) * 110540.0, 2)) <= 75
    WHERE u.record_id IS NOT NULL AND o.record_id IS NOT NULL
      AND isfinite(u.longitude) AND isfinite(u.latitude) AND u.longitude BETWEEN -180 AND 180 AND u.latitude BETWEEN -90 AND 90
      AND isfinite(o.longitude) AND isfinite(o.latitude) AND o.longitude BETWEEN -180 AND 180 AND o.latitude BETWEEN -90 AND 90
    """


@query("p3_near", P3_NEAR_SQL)
def p3_near(spark: SparkSession, directory: str) -> DataFrame:
    """The part of p3_found that plain SQL can express."""
    found = p3_found(spark, directory)
    return found.where("relation = 'near'").select("record_id", "other_id")
FLAGSHIP = "link_places"
