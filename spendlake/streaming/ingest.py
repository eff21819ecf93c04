"""Incremental loads with Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions
from ..sources.files import missing_days, remove, stored_files

#: Columns of a batch's rows that name the file they come from.
FILE = {"_file": "file_path", "_length": "file_size", "_modified": "file_modification_time"}


def ingest_daily(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, manifest: str) -> None:
    """Load the CSV files that landed below `source` since the last run, each exactly once, with a manifest row for each file.

    A batch has a folder of its own for its rows and one for its manifest, and the checkpoint fixes which files it
    holds, so a batch that is run again after a failure replaces what it left before. Manifest rows follow from the
    rows that were written. A file without rows gets none; `unloaded` lists it.
    """
    stream = spark.readStream.option("header", True).option("recursiveFileLookup", True).schema(schema).csv(source)
    stream = stream.select("*", *(F.col(f"_metadata.{c}").alias(name) for name, c in FILE.items()))

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={number}")
        written = spark.read.schema(df.schema).parquet(f"{target}/batch={number}")
        files = written.groupBy(*FILE).agg(F.count("*").alias("n_rows"))
        files.select(F.col("_file").alias("path"), F.col("_length").alias("length"), F.col("_modified").alias("modified"), "n_rows").write.mode("overwrite").parquet(f"{manifest}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def loaded(spark: SparkSession, manifest: str) -> DataFrame:
    """`path, length, modified, n_rows, batch` of each file that was loaded."""
    return spark.read.schema("path string, length long, modified timestamp, n_rows long, batch long").parquet(manifest)


def unloaded(spark: SparkSession, source: str, manifest: str) -> DataFrame:
    """`path, dataset, length` of files in storage that have no manifest row of their length: new, changed or empty ones."""
    base = source.rstrip("/").split("/")[-1]
    relative = F.substring_index(F.url_decode("path"), f"/{base}/", -1)
    done = loaded(spark, manifest).select(relative.alias("path"), "length")
    return stored_files(spark, source).join(done, ["path", "length"], "left_anti").select("path", "dataset", "length")


def gaps(spark: SparkSession, manifest: str, first: str, last: str, dataset: str = "item") -> DataFrame:
    """Days from `first` to `last` of which no file was loaded; paths hold `dt=yyyy-MM-dd`."""
    return missing_days(loaded(spark, manifest).withColumn("dataset", F.lit(dataset)), first, last, [dataset]).select("day")


#: Flag of rows whose key has had several dates; one row of such a key stays, whatever comes later.
SEVERAL = "_several"
#: A compaction is due when the batches since the last hold this share of the table's bytes, and a bucket holds about so many bytes.
SHARE, BUCKET_BYTES = 0.25, 128 << 20


def merge_latest(spark: SparkSession, df: DataFrame, number: int, target: str, key: Sequence[str], date: str, share: float = SHARE, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Merge a batch into a table of the latest rows of each key; merging it again changes nothing.

    A batch is written as it is, a delta of its own, so what is written follows the batch and not the table. When the
    deltas hold `share` of the bytes of the base, all is rewritten as a new base, so a row is rewritten 1 / `share`
    times or so for each doubling. The base's number of files follows from its bytes. `read_latest` reads it all.
    """
    from ..operators.cleaning import resolve_revisions

    now = versions.current(spark, target) or {"base": None, "upto": -1}
    if number <= now["upto"]:
        return  # it was merged and compacted before the stream's checkpoint knew
    resolve_revisions(df.dropDuplicates().withColumn(SEVERAL, F.lit(False)), key, date, SEVERAL).write.mode("overwrite").parquet(f"{target}/delta/batch={number}")
    base = f"{target}/{now['base']}" if now["base"] else None
    deltas = sum(versions.size(spark, f"{target}/delta/{name}") for name in versions.names(spark, f"{target}/delta") if int(name.split("=")[1]) > now["upto"])
    held = versions.size(spark, base) if base else 0
    if deltas < share * held:
        return
    folder = f"base-{uuid.uuid4().hex}"
    parts = max(1, -(-(held + deltas) // bucket_bytes))
    _latest(spark, target, key, date).repartition(parts, *key).write.parquet(f"{target}/{folder}")
    versions.publish(spark, target, {"base": folder, "upto": number})
    versions.forget(spark, target, 1)
    for name in versions.names(spark, target):
        if name.startswith("base-") and name not in (folder, now["base"]):  # the one before may still be read
            remove(spark, f"{target}/{name}")
    for name in versions.names(spark, f"{target}/delta"):
        if int(name.split("=")[1]) <= now["upto"]:
            remove(spark, f"{target}/delta/{name}")


def _latest(spark: SparkSession, target: str, key: Sequence[str], date: str) -> DataFrame:
    from ..operators.cleaning import resolve_revisions

    now = versions.current(spark, target) or {"base": None, "upto": -1}
    paths = [f"{target}/delta/{name}" for name in versions.names(spark, f"{target}/delta") if int(name.split("=")[1]) > now["upto"]]
    if now["base"]:
        paths.append(f"{target}/{now['base']}")
    rows = spark.read.parquet(*paths)
    if len(paths) == 1:
        return rows
    once = rows.groupBy(*(c for c in rows.columns if c != SEVERAL)).agg(F.max(SEVERAL).alias(SEVERAL))
    return resolve_revisions(once, key, date, SEVERAL)


def read_latest(spark: SparkSession, target: str, key: Sequence[str], date: str) -> DataFrame:
    """The latest rows of each key: the base and the batches since."""
    return _latest(spark, target, key, date).drop(SEVERAL)


def keep_latest(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str, key: Sequence[str], date: str) -> None:
    """Maintain the latest rows of each key from a stream of revisions."""
    merge = lambda df, number: merge_latest(spark, df, number, target, key, date)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def hourly_counts(stream: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "1 hour") -> DataFrame:
    """Rows and sums of each hour and kind, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
