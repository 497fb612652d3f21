"""One place for the session settings that the library is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold at any size: adaptive plans, UTC clocks, Arrow batches of bounded rows.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "stratica", **conf: str) -> SparkSession:
    """A session with the defaults; a cluster's own settings (``conf``) win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; one of our own only in local sessions that have none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not configured:
        import tempfile

        configured = "file://" + tempfile.mkdtemp(prefix="spark-stratica-")
    context.setCheckpointDir(configured)
