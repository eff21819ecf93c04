"""Sources and sinks: CSV with an explicit schema, Parquet by year, manifests, the star schema on disk."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import versions

STAR = ("dim_buyer", "dim_item", "dim_supplier", "dim_date", "fact_purchase")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has the path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def require(spark: SparkSession, paths: Sequence[str]) -> None:
    if missing := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError(", ".join(missing))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, malformed: str = "PERMISSIVE") -> DataFrame:
    """CSV with a header; identifiers keep their zeros because the schema says string."""
    return spark.read.option("header", True).option("mode", malformed).schema(schema).csv(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType | str, year: int, manifest: str | None = None, dataset: str = "item") -> DataFrame:
    """Write a year's CSV as Parquet under `ano=`, unless it is there; malformed rows are dropped.

    With a manifest, a row says what was done: `success` with the number of rows, counted as they were written, and the size of
    the source, `skipped_existing`, `not_found` or `error`; the last two are raised as well.
    """
    path = f"{target}/ano={year}"
    note = lambda *a: manifest and record(spark, manifest, dataset, source, *a)
    if exists(spark, path):
        note("skipped_existing")
    elif not exists(spark, source):
        note("not_found")
        raise FileNotFoundError(source)
    else:
        length = versions.size(spark, source)
        try:
            n = counted(read_csv(spark, source, schema, "DROPMALFORMED"), lambda df: df.write.parquet(path))
        except Exception:
            remove(spark, path)
            note("error", length)
            raise
        note("success", length, n)
    return spark.read.parquet(target).filter(F.col("ano") == year)


def read_years(spark: SparkSession, root: str, years: Sequence[int]) -> DataFrame:
    """Parquet of several years; raises if one is missing."""
    require(spark, [f"{root}/ano={y}" for y in years])
    return spark.read.option("basePath", root).option("mergeSchema", True).parquet(*(f"{root}/ano={y}" for y in years))


def rename_legacy(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Old names to new ones, where the new column is absent."""
    return df.withColumnsRenamed({old: new for old, new in aliases.items() if old in df.columns and new not in df.columns})


def keep_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*(n for n in names if n in df.columns))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def stored_files(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """`path, dataset, length` of the files below a folder of datasets, as storage lists them; contents are not read.

    The dataset is the folder just below `root`; paths are relative to it.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    base = root.rstrip("/").split("/")[-1]
    below = F.element_at(F.split("path", "/" + re.escape(base) + "/"), -1)
    return found.select(below.alias("path"), F.when(F.instr(below, "/") > 0, F.substring_index(below, "/", 1)).alias("dataset"), "length")


def missing_days(paths: DataFrame, first: str, last: str, datasets: Sequence[str] = ("item",)) -> DataFrame:
    """`dataset, day` from `first` to `last` without a file; `paths` hold `dataset` and a `path` with `dt=yyyy-MM-dd`."""
    asked = paths.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"), F.array(*map(F.lit, datasets)).alias("d"))
    day = F.try_to_date(F.regexp_extract("path", r"dt=(\d{4}-\d{2}-\d{2})", 1))
    there = paths.select(F.coalesce("dataset", F.lit("item")).alias("dataset"), day.alias("day")).distinct()
    return asked.select(F.explode("d").alias("dataset"), "day").join(there, ["dataset", "day"], "left_anti")


def to_load(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (`path, dataset, length`) without a successful manifest row of equal size; no dataset means item."""
    done = manifest.filter("status = 'success'").select("path", F.coalesce("dataset", F.lit("item")).alias("dataset"), "length").distinct()
    return candidates.withColumn("dataset", F.coalesce("dataset", F.lit("item"))).join(done, ["path", "dataset", "length"], "left_anti")


STATUSES = ("success", "skipped_existing", "not_found", "error")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def record(spark: SparkSession, path: str, dataset: str, file: str, status: str, length: int | None = None, rows: int | None = None) -> None:
    """Append a manifest row; the status is one of `STATUSES`."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    append_log(spark.createDataFrame([(file, dataset, status, length, rows)], MANIFEST).withColumn("at", F.current_timestamp()), path)


MANIFEST = "path string, dataset string, status string, length long, n_rows long"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows; none where there is no manifest yet."""
    return spark.read.schema(MANIFEST + ", at timestamp").json(path) if exists(spark, path) else spark.createDataFrame([], MANIFEST + ", at timestamp")


def counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write a DataFrame and return its number of rows, counted in the same pass."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def save_star(tables: Mapping[str, DataFrame], root: str, keep: int = 2) -> str:
    """Write the five tables as a new version, make it visible at once and append their numbers of rows to the build log.

    Until then, and if anything fails, readers see the version before. The newest `keep` versions stay. Returns the version's folder.
    """
    if missing := [name for name in STAR if name not in tables]:
        raise ValueError("missing tables: " + ", ".join(missing))
    spark, version = tables[STAR[0]].sparkSession, f"v-{uuid.uuid4().hex}"
    rows = [(name, counted(tables[name], lambda df, name=name: df.write.parquet(f"{root}/{version}/{name}"))) for name in STAR]
    before = [versions.read(spark, root, n)["folder"] for n in versions.numbers(spark, root)[-(keep - 1) :]] if keep > 1 else []
    versions.publish(spark, root, {"folder": version})
    log = spark.createDataFrame([(name, n, version) for name, n in rows], "table string, n_rows long, version string")
    append_log(log.withColumn("at", F.current_timestamp()).coalesce(1), f"{root}/_build_log")  # five rows
    versions.forget(spark, root, keep)
    for name in versions.names(spark, root):
        if name.startswith("v-") and name not in (version, *before):
            remove(spark, f"{root}/{name}")
    return version


def load_star(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All five tables of the current version, or FileNotFoundError."""
    version = versions.current(spark, root)
    if version is None:
        raise FileNotFoundError(root)
    require(spark, [f"{root}/{version['folder']}/{name}" for name in STAR])
    return {name: spark.read.parquet(f"{root}/{version['folder']}/{name}") for name in STAR}


def save_artifact(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a result as Parquet, CSV with a header, or JSON lines."""
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "json": writer.json, "csv": writer.option("header", True).csv}[kind](path)


def load_artifacts(spark: SparkSession, paths: Mapping[str, str], schemas: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Named results, all or none; the kind follows from the ending, identifiers keep their zeros where a schema says string."""
    require(spark, list(paths.values()))
    out = {}
    for name, path in paths.items():
        reader = spark.read.schema(schemas[name]) if schemas and name in schemas else spark.read
        out[name] = reader.option("header", True).csv(path) if path.endswith(".csv") else reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)
    return out


def count_years(spark: SparkSession, root: str, years: Sequence[int]) -> DataFrame:
    """`year, n_rows` of the years that are there; others count null."""
    there = [y for y in years if exists(spark, f"{root}/ano={y}")]
    asked = spark.createDataFrame([(y,) for y in years], "year int")
    if not there:
        return asked.withColumn("n_rows", F.lit(None).cast("long"))
    found = read_years(spark, root, there).groupBy(F.col("ano").cast("int").alias("year")).agg(F.count("*").alias("n_rows"))
    return asked.join(found, "year", "left")


def reuse(df: DataFrame, path: str) -> DataFrame:
    """The table at `path`, written first if it is not there."""
    if not exists(df.sparkSession, path):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def source_path(date, dataset, root: str):
    """Column: where a dataset's file of a day lies."""
    return F.concat(F.lit(root.rstrip("/") + "/"), dataset, F.lit("/dt="), F.date_format(date, "yyyy-MM-dd"), F.lit("/"), dataset, F.lit(".csv"))
