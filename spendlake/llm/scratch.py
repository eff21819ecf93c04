"""Tables written between jobs, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """A new folder name below `spark.checkpoint.dir`.

    Where that setting is unset, as in tests, a folder of this machine serves, but only if all tasks run on it too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spendlake-")
    return f"{base.rstrip('/')}/spendlake-{uuid.uuid4().hex}"


class Tables:
    """Stored tables of one operator, and their removal once nothing reads them any more."""

    def __init__(self) -> None:
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def store(self, df: DataFrame) -> DataFrame:
        out, path = _written(df)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables; only after whatever reads them is stored itself."""
        for table in tables:
            found, path = self.paths.pop(id(table))
            hadoop = found.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(found.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark, path = df.sparkSession, folder(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """Write a DataFrame once and read it back: lineage is cut and a lost executor costs no recomputation.

    The job's shuffle files are of no use once the table is there; Spark is told to remove them.
    """
    return _written(df)[0]
