"""Tracing linked ids to their upstream sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.functions import provenance
from geoweft.options import TraceOptions


def trace_ids(df: DataFrame, column: str | None = None) -> DataFrame:
    """Distinct non-blank ids of a column, by default the first of gers_id and id. Ids that differ in case or outer spaces
    alone are one; the least spelling in code-point order stands for them."""
    have = {c.lower(): c for c in df.columns}
    name = column or have.get("gers_id") or have.get("id")
    if name is None:
        raise ValueError("no column gers_id or id")
    value = F.col(name).cast("string")
    return df.where(F.trim(value) != "").groupBy(F.lower(F.trim(value)).alias("_k")).agg(F.min(value).alias("gers_id")).select("gers_id")


def trace_sources(ids: DataFrame, bridge: DataFrame, options: TraceOptions | None = None) -> DataFrame:
    """gers_id, dataset, record_id, update_time, theme, type, source_url, ordered, at most options.limit rows, or all if it is None.

    theme and type are compared in the scan of bridge (partition columns prune files). The ids have no size bound, so the
    planner decides by size which side is broadcast.
    """
    o = options or TraceOptions()
    rows = bridge.where((F.col("theme") == o.theme) & (F.col("type") == o.type_))
    rows = rows.select(F.col("id").cast("string").alias("_id"), *[F.col(c).cast("string").alias(c) for c in ("record_id", "update_time", "dataset", "theme", "type")])
    distinct = ids.select(F.col("gers_id").cast("string").alias("gers_id")).where(F.trim("gers_id") != "").distinct()
    found = distinct.join(rows, F.col("gers_id") == F.col("_id")).select("gers_id", "dataset", "record_id", "update_time", "theme", "type", provenance.osm_url(F.col("dataset"), F.col("record_id")).alias("source_url"))
    found = found.orderBy(F.col("gers_id").asc_nulls_last(), F.col("dataset").asc_nulls_last(), F.col("record_id").asc_nulls_last(), F.col("update_time").asc_nulls_last())
    return found if o.limit is None else found.limit(o.limit)


def enrich_trace(trace: DataFrame) -> DataFrame:
    """Adds edit_url, edit_platform, contribution_url and edit_instructions; a non-blank source_url stays. A trace that has
    edit_url is returned as it is."""
    if "edit_url" in trace.columns:
        return trace
    dataset, record = F.col("dataset"), F.col("record_id")
    edit = provenance.loose_edit_url(dataset, record)
    return (
        trace.withColumn("source_url", F.when(F.trim("source_url") != "", F.col("source_url")).otherwise(edit)).withColumn("edit_url", edit)
        .withColumn("edit_platform", provenance.platform(F.trim(dataset))).withColumn("contribution_url", provenance.contribution_url(dataset)).withColumn("edit_instructions", provenance.instructions(dataset))
    )


def dataset_counts(trace: DataFrame) -> DataFrame:
    """dataset, n: spellings that differ in case are one, named by the least; blanks are skipped; most frequent first."""
    named = trace.where(F.trim("dataset") != "")
    counted = named.groupBy(F.lower("dataset").alias("_k")).agg(F.min("dataset").alias("dataset"), F.count("*").alias("n"))
    return counted.select("dataset", "n").orderBy(F.desc("n"), "dataset")


def dataset_summary(trace: DataFrame, items: int = 4) -> str:
    """The most frequent datasets in one line."""
    rows = dataset_counts(trace).limit(items).collect()
    return " • ".join(f"{r.dataset}: {r.n:,}" for r in rows) or "No upstream source mappings were returned yet."
