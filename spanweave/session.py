"""A session with the settings the library expects, and the folder its executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: AQE re-plans joins and skew at run time; Arrow carries the few vectorised functions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session; keyword settings use __ for the dots of their names."""
    builder = SparkSession.builder.appName("spanweave")
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a local session has one of its own
    and a cluster raises, as its executors share no other folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    held = getattr(spark, "_spanweave_dir", None)
    if held is None:
        held = tempfile.mkdtemp(prefix="spanweave-")
        atexit.register(shutil.rmtree, held, True)
        spark._spanweave_dir = held
    return held


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, so that what is read
    several times is computed once and outlives an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spanweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
