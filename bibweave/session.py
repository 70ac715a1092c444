"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "bibweave", cpus: str | int = "*", **extra) -> SparkSession:
    """A local session with the settings the tests and the bench use; on a cluster, pass your own session instead."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if here not in os.environ.get("PYTHONPATH", "").split(os.pathsep):  # Python workers import the package wherever the job starts
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [here, os.environ.get("PYTHONPATH")]))
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | {k: str(v) for k, v in extra.items()}
    return SparkSession.builder.config(map=conf).getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset (tests, local runs) a temporary one is set for the session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="bibweave-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys over all shuffle partitions. For steps that cost far more time than bytes: adaptive execution and the
    scan's splits go by bytes alone, and would leave a small table to one core."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows in memory take up to so many times the bytes that Spark expects from their packed files, more where strings are derived from them.
UNPACKED = 16


def not_sent(df: DataFrame) -> DataFrame:
    """df as a side of joins that goes to all executors by way of the driver only where it is small when unpacked, too. Spark goes by
    the bytes of the files alone, and would send a catalog of a million works as soon as its file is below the limit."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.hint("merge") if 0 < most < expected * UNPACKED else df


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own below the shared scratch folder; nothing is made yet."""
    return os.path.join(scratch_root(spark), "bibweave", uuid.uuid4().hex, name)


#: Has Spark delete a query's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared scratch folder and reads it back: cuts the lineage and survives lost executors. What its
    making shuffled goes when it is written."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
