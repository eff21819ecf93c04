"""Versions of a dataset: folders that are written first and made visible at once by a pointer file.

Below `root/_versions` lies a file for each published version, numbered; it names the version's folder. A file is
written under another name and renamed, so readers see whole files only, and they follow the one of highest number.
What a failed writer left behind is never pointed to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER = "_versions"


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none where there is no folder."""
    fs, hadoop = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a path, 0 where there is none."""
    fs, hadoop = _files(spark, path)
    return fs.getContentSummary(hadoop).getLength() if fs.exists(hadoop) else 0


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointer files, ascending."""
    return sorted(int(n) for n in names(spark, f"{root}/{FOLDER}") if n.isdigit())


def read(spark: SparkSession, root: str, number: int) -> dict:
    """What a pointer file holds."""
    fs, path = _files(spark, f"{root}/{FOLDER}/{number}")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> dict | None:
    """What the newest pointer file holds, None without one."""
    found = numbers(spark, root)
    return read(spark, root, found[-1]) if found else None


def publish(spark: SparkSession, root: str, content: dict) -> None:
    """Make a version current. Of two writers at once one fails, and its version is not seen."""
    number = (numbers(spark, root) or [0])[-1] + 1
    fs, staged = _files(spark, f"{root}/{FOLDER}/.{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    _, final = _files(spark, f"{root}/{FOLDER}/{number}")
    if fs.exists(final) or not fs.rename(staged, final):
        fs.delete(staged, False)
        raise RuntimeError(f"version {number} of {root} was published meanwhile")


def forget(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove pointer files but the newest `keep`."""
    for number in numbers(spark, root)[:-keep]:
        fs, path = _files(spark, f"{root}/{FOLDER}/{number}")
        fs.delete(path, False)
