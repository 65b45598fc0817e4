"""The N best items of every group by descending score bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.session import cut

#: Shares of all items above the lower edge of each band but the last, which is open. Speed only.
BAND_SHARES = (0.05, 0.3)


def latest_candidates(candidates: DataFrame) -> DataFrame:
    """One row per (record_id, overture_id): that with the latest scored_at, out if its score is null or NaN.

    Rows with a null record_id are no candidates; a null overture_id is a value of its own. A null scored_at is the earliest.
    Rows of one candidate with the same latest time count by the better place in the order of rank_order.
    """
    better = F.struct(F.coalesce(F.col("scored_at"), F.timestamp_seconds(F.lit(-62135596800))).alias("t"), F.coalesce(F.when(~F.isnan("gers_match_score"), F.col("gers_match_score")), F.lit(float("-inf"))).alias("s"), (-F.coalesce("distance_m", F.lit(float("inf")))).alias("d"))
    row = F.struct("gers_match_score", "distance_m", "overture_name")
    last = candidates.where(F.col("record_id").isNotNull()).groupBy("record_id", "overture_id").agg(F.max_by(row, better).alias("r"))
    return last.select("record_id", "overture_id", "r.*").where(F.col("gers_match_score").isNotNull() & ~F.isnan("gers_match_score"))


def rank_order() -> list[Column]:
    """Score descending, then distance, name and id ascending (nulls last, strings by code points)."""
    return [F.desc("gers_match_score"), F.asc_nulls_last("distance_m"), F.asc_nulls_last("overture_name"), F.asc_nulls_last("overture_id")]


def top_n_by_bands(items: DataFrame, group: str, score: str, order: list[Column], n: int) -> DataFrame:
    """items with ``rank`` 1..n in each group by order, whose first key must be score descending without nulls.

    The items are written to the shared folder once, apart by score band (range partitions by approximate quantiles, so the
    edges may lie anywhere without changing the result). Bands are taken from the top: groups that higher bands have filled
    with n items are anti-joined away, the rest of a band is kept and counted per group with map-side partial counts. So of
    each group at most n - 1 items and one boundary band are left, in which the exact order incl. ties decides; per task no
    more than n items of a group are passed on (the limit on the row number is pushed below the shuffle), so no task holds
    a whole hot group. An empty table gives no rows; a null group is a group.
    """
    if n < 1:
        raise ValueError("n must be positive")
    edges = items.approxQuantile(score, [1 - s for s in BAND_SHARES], 0.01)
    band = reduce(lambda rest, e: F.when(F.col(score) >= e[1], e[0]).otherwise(rest), reversed(list(enumerate(edges))), F.lit(len(edges)))
    written = cut(items.withColumn("_band", band))
    kept, counts = [], None
    for b in range(len(edges) + 1):
        rows = written.where(F.col("_band") == b)
        if counts is not None:
            filled = counts.groupBy(group).agg(F.sum("_n").alias("_n")).where(F.col("_n") >= n)
            filled = filled.select(F.col(group).alias("_g"))
            rows = rows.join(filled, F.col(group).eqNullSafe(F.col("_g")), "left_anti")
        kept.append(rows)
        if b < len(edges):
            here = written.where(F.col("_band") == b).groupBy(group).agg(F.count("*").alias("_n"))
            counts = here if counts is None else counts.unionByName(here)
    rest = reduce(DataFrame.unionByName, kept).drop("_band")
    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))


def best_candidates(candidates: DataFrame, n: int = 3) -> DataFrame:
    """(record_id, candidate_rank, overture_id) of the n best candidates of each record, whatever the stored rank says."""
    best = top_n_by_bands(latest_candidates(candidates), "record_id", "gers_match_score", rank_order(), n)
    return best.select("record_id", F.col("rank").alias("candidate_rank"), "overture_id")
