"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "geoweft", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; every setting can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the application, once; they may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="geoweft-")  # on the driver alone, which serves the file to the executors
    source = os.path.join(folder, "source")
    shutil.copytree(package, os.path.join(source, os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "geoweft-package"), "zip", source))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent *and* the master is a single JVM (tests) a folder of this machine is used;
    on a cluster a machine-local folder would be lost with its executor, so the absence is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"geoweft-checkpoint-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", "file://" + folder)
    return "file://" + folder


def _cuts(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/cuts-{spark.sparkContext.applicationId}"


def clear_cuts(spark: SparkSession) -> None:
    """Removes the tables that cut() wrote in this application, once no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_cuts(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_cleaned: set[str] = set()


def _clear_at_exit(spark: SparkSession) -> None:
    """The tables of an application go when its driver ends, as long as the session still stands then."""
    app = spark.sparkContext.applicationId
    if app in _cleaned:
        return
    _cleaned.add(app)

    def clear() -> None:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc and spark.sparkContext.applicationId == app:
                clear_cuts(spark)

    atexit.register(clear)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with a lineage that begins at a table written to the shared folder.

    Used where a result has several consumers or a loop would grow the plan; the files survive lost executors.
    """
    spark = df.sparkSession
    _clear_at_exit(spark)
    path = f"{_cuts(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the cluster has cores, for work in Python that costs far more than reading.

    A small table is often one file and so one task. Tables that are read in more partitions than there are cores, as large
    ones are, come back as they are, so nothing large is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def grows(df: DataFrame) -> DataFrame:
    """df as a side of an equi-join that grows with the input: the join is a sort-merge join, so no side comes to the driver.

    The planner judges a table by its compressed bytes, for some columns by a share of them, and broadcasts tables that are
    hundreds of times its threshold when decoded.
    """
    return df.hint("merge")
