"""Queries of the llm operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.llm import addresses, bpe, confusables, entity_match, mixing, pii, top_n
from geoweft.session import cut

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


@query("p2_found")
def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """The place of every record that has one."""
    links = entity_match.match_entities(table(spark, directory, "gers_user_input"), table(spark, directory, "gers_output"))
    return entity_match.best_links(links).select("record_id", "gers_id")


@query("p2_links")
def p2_links(spark: SparkSession, directory: str) -> DataFrame:
    """Every candidate link with its marginal probability."""
    return entity_match.match_entities(table(spark, directory, "gers_user_input"), table(spark, directory, "gers_output"))


@query(
    "p5_found",
    """
    WITH latest AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY record_id, overture_id ORDER BY scored_at DESC NULLS LAST, gers_match_score DESC NULLS LAST, distance_m) AS i
        FROM gers_candidates WHERE record_id IS NOT NULL) WHERE i = 1 AND gers_match_score IS NOT NULL
    )
    SELECT record_id, CAST(r AS BIGINT) AS candidate_rank, overture_id FROM (
      SELECT record_id, overture_id, row_number() OVER (PARTITION BY record_id ORDER BY gers_match_score DESC, distance_m ASC NULLS LAST, overture_name ASC NULLS LAST, overture_id ASC NULLS LAST) AS r FROM latest)
    WHERE r <= 3
    """,
)
def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """The three best candidates of every record."""
    return top_n.best_candidates(table(spark, directory, "gers_candidates"), 3)


def _names(spark: SparkSession, directory: str) -> DataFrame:
    users = table(spark, directory, "gers_user_input").select(F.lit("gers_user_input").alias("table_name"), "record_id", F.col("name").alias("text"))
    output = table(spark, directory, "gers_output").select(F.lit("gers_output").alias("table_name"), "record_id", F.col("overture_name").alias("text"))
    return users.unionByName(output)


@query("p6_found")
def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    """Records whose name isn't in plain form."""
    odd = confusables.not_plain(_names(spark, directory).where("record_id is not null"), "text")
    return odd.select("table_name", "record_id").distinct()


@query("p6_plain")
def p6_plain(spark: SparkSession, directory: str) -> DataFrame:
    """Every name with its plain form and skeleton."""
    return confusables.unify_text(_names(spark, directory), "text").select("table_name", "record_id", F.col("text").alias("name"), "plain", "skeleton")


@query("p6_groups")
def p6_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Originals grouped by equal skeleton."""
    return confusables.skeleton_groups(_names(spark, directory), "text")


@query("p7_ids")
def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encoded_corpus(table(spark, directory, "documents"))


@query("p7_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_decoded(spark: SparkSession, directory: str) -> DataFrame:
    """Every text decoded from its ids."""
    return bpe.round_trip(table(spark, directory, "documents"))


@query("p8_mix")
def p8_mix(spark: SparkSession, directory: str) -> DataFrame:
    """Documents of the mix with their number of uses."""
    return mixing.mix(table(spark, directory, "documents"), table(spark, directory, "mix_targets"))[0]


@query("p8_report")
def p8_report(spark: SparkSession, directory: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.mix(table(spark, directory, "documents"), table(spark, directory, "mix_targets"))[1]


@query("p4_found")
def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of records whose addresses denote one location."""
    return addresses.same_location(table(spark, directory, "gers_user_input"), table(spark, directory, "gers_output"))


@query("p4_members")
def p4_members(spark: SparkSession, directory: str) -> DataFrame:
    """The class of records that denote one location, with the number of links, for every record with an address."""
    return addresses.location_members(table(spark, directory, "gers_user_input"), table(spark, directory, "gers_output"))


@query("p4_resolved")
def p4_resolved(spark: SparkSession, directory: str) -> DataFrame:
    """The location that every address record denotes."""
    records = addresses.address_records(table(spark, directory, "gers_user_input"), table(spark, directory, "gers_output"))
    return addresses.resolve(cut(records))


@query("p9_found")
def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    """Every place of personal information."""
    return pii.pii_places(table(spark, directory, "documents"), table(spark, directory, "given_names"))


@query("p9_redacted")
def p9_redacted(spark: SparkSession, directory: str) -> DataFrame:
    """Every text with typed placeholders."""
    return pii.redacted(table(spark, directory, "documents"), table(spark, directory, "given_names"))
