"""Session settings and the shared folder that lineage cuts are written to."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "reviewlab", cores: str | int = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Work per row is costly here, so a small shuffle still uses all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # Sums over vectors of a few hundred dimensions stay in generated code.
        .config("spark.sql.codegen.maxFields", "400")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder named by the session.

    Only a local session may fall back to a folder of its own: a machine-local
    folder would be lost with an executor on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="reviewlab-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return spark.conf.get("spark.checkpoint.dir", None) or named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, so a lost executor cannot change it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
