"""Session helpers: table loading and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables: what the session names in spark.checkpoint.dir.

    A folder of our own is set only where none is configured, and only for a local master, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="latticequarry-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` and cut its lineage with a reliable checkpoint in checkpoint_dir, so that a lost executor loses nothing.

    Its files go when the result is no longer referenced, in sessions made by build_session.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(df) and its number of rows, counted while the checkpoint is written, so that no job of its own is needed."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def spread(df: DataFrame) -> DataFrame:
    """`df` in at least as many partitions as there are cores, for steps that cost far more than a shuffle.

    Inputs that already have enough partitions aren't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def build_session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session with the settings the engine expects (AQE, Arrow, UTC)."""
    return (
        SparkSession.builder.master(master)
        .appName("latticequarry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
