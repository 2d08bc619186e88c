"""Versions of a data folder: each build is a folder of its own, named by its fingerprint, and one small file points to the
present one.

A build is written beside the others, then named, then pointed to. A reader takes the pointer once and sees that version
whole, whatever is built meanwhile; a build that is killed leaves the old version in place and a folder that no one
points to. Building the same again finds its folder, with all that was derived from it. The pointer is replaced by a
rename, which is atomic on HDFS and local disks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quernel.sources import tables

POINTER = "CURRENT.json"


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) by Hadoop, so that any store that Spark reads will do."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def current(spark: SparkSession, root: str) -> dict | None:
    """What the pointer says: version, rows, fingerprint and what the build noted; None before the first."""
    fs, place = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(place):
        return None
    lines = spark.read.text(str(place.toString()), wholetext=True).first()
    return json.loads(lines[0]) if lines else None


def folder(spark: SparkSession, root: str) -> str:
    """The present version's folder."""
    found = current(spark, root)
    if found is None:
        raise ValueError(f"{root} has no version yet")
    return f"{root}/versions/{found['version']}"


def _point(spark: SparkSession, root: str, note: dict) -> None:
    fs, new = _fs(spark, f"{root}/.{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(note).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    modes = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    modes[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(_fs(spark, f"{root}/{POINTER}")[1]), modes)


def publish(spark: SparkSession, root: str, table: str, build: Callable[[], DataFrame], **note: Any) -> tuple[dict, bool]:
    """Build table into a version of its own and point to it: (what the pointer says, whether it changed).

    The version's name is the table's fingerprint, so equal tables are one version."""
    began = f"{root}/versions/.building-{uuid.uuid4().hex}"
    build().write.parquet(f"{began}/{table}")
    rows, value = tables.fingerprint(spark.read.parquet(f"{began}/{table}"))
    name = f"{rows}-{value & (1 << 128) - 1:032x}"
    fs, place = _fs(spark, began)
    named = _fs(spark, f"{root}/versions/{name}")[1]
    if fs.exists(named) or not fs.rename(place, named):
        fs.delete(place, True)  # it is there already
    found = current(spark, root)
    if found and found["version"] == name:
        return found, False
    said = {"version": name, "rows": rows, "fingerprint": value} | note
    _point(spark, root, said)
    return said, True


def discard_others(spark: SparkSession, root: str, keep: tuple[str, ...] = ()) -> list[str]:
    """Delete all versions but the present one and those to keep, and what killed builds left; their names."""
    fs, place = _fs(spark, f"{root}/versions")
    found = current(spark, root)
    stay = {found["version"] if found else None, *keep}
    gone = []
    for status in fs.listStatus(place) if fs.exists(place) else []:
        name = status.getPath().getName()
        if name not in stay and fs.delete(status.getPath(), True):
            gone.append(name)
    return sorted(gone)
