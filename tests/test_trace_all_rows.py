from pyspark.sql import functions as F

from geoweft.plans import reference


def test_registered_traces_have_no_limit(spark, tmp_path):
    n = 250_001
    spark.createDataFrame([("g",)], "gers_id string").write.parquet(str(tmp_path / "gers_output.parquet"))
    text = {"id": F.lit("g"), "record_id": F.col("i").cast("string"), "update_time": F.lit("2024"), "dataset": F.lit("Meta"), "theme": F.lit("places"), "type": F.lit("place")}
    spark.range(n).select(F.col("id").alias("i")).select(*[v.alias(k) for k, v in text.items()]).write.parquet(str(tmp_path / "gers_bridge.parquet"))
    assert reference.trace_dataset_counts(spark, str(tmp_path)).first().n == n
    assert reference.trace_sources(spark, str(tmp_path)).count() == n == reference.trace_enriched(spark, str(tmp_path)).count()
