"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratica.session import ensure_checkpoints


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where none is set (local tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    ensure_checkpoints(spark)
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """The folder below the shared one that holds all that this application has stored."""
    return f"{shared_dir(spark)}/stratica-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{own_folder(spark)}/{kind}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a finished write are deleted at once, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here, survives lost executors and leaves no shuffle files."""
    spark = df.sparkSession
    folder = new_folder(spark, kind)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def delete_path(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_stored(spark: SparkSession) -> None:
    """Delete all that this application has stored, once no result that reads it is needed any more."""
    delete_path(spark, own_folder(spark))


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing reads them any more."""
    for df in frames:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_path(df.sparkSession, name)
