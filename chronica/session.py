"""Session helpers: a local session for tests and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session in UTC for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chronica")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder shared by all executors: the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, a temporary folder is set.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="chronica-", dir=os.environ.get("TMPDIR"))
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder shared by all executors and read it back.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes the files once nothing refers to them any more.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def files_folder(spark: SparkSession, name: str) -> str:
    """A new folder for the files of one job, below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def locate(spark: SparkSession, argument: str | None, variable: str, patterns: list[str], required: list[str]) -> str:
    """The data folder: the argument, else the environment variable, else the first match of the patterns that holds all required tables."""
    from glob import glob

    tried = [p for p in (argument, os.environ.get(variable)) if p] or [m for p in patterns for m in sorted(glob(p))]
    for folder in tried:
        if all(table_file(folder, name) for name in required):
            return folder
    raise FileNotFoundError(f"no folder with {', '.join(required)} among {tried}")


def table_file(folder: str, name: str) -> str | None:
    """The file of a table in a local folder: compressed CSV before plain CSV before Parquet, or None."""
    for ending in (".csv.gz", ".csv", ".parquet"):
        if os.path.exists(f"{folder}/{name}{ending}"):
            return f"{folder}/{name}{ending}"
    return None
