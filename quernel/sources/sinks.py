"""Writers: tables by Spark, small documents and reports atomically on the driver's disk."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, wherever it is stored."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def discard(spark: SparkSession, *paths: str) -> list[str]:
    """Delete tables that no longer hold, wherever they are stored; those that were there."""
    gone = []
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True):
            gone.append(path)
    return gone


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table doesn't have yet; how many there were. Running it again appends nothing."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        todo = df.dropDuplicates([key])
    else:
        todo = df.join(done, key, "left_anti").dropDuplicates([key])
    from quernel.session import written

    new = written(todo, "append")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def write_csv(df: DataFrame, path: str) -> None:
    """One file: for result tables of bounded size."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_text_csv(df: DataFrame, path: str) -> None:
    """Texts of any kind, as read_pairs_csv reads them: quotes doubled, white space and line ends kept. An empty text reads as null, which CSV
    doesn't tell from it. Files as tasks make them."""
    keep = {"header": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**keep).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_json(value: Any, path: str) -> None:
    """Written beside its place and moved there whole; what JSON lacks becomes text."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False, default=str)
    os.replace(temporary, path)


def markdown_table(df: DataFrame, digits: int = 4, most: int = 1000) -> str:
    """A result table of at most `most` rows as Markdown."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table has more than {most} rows")
    cell = lambda v: "n/a" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def write_report(path: str, title: str, sections: Iterable[tuple[str, DataFrame | str]]) -> None:
    parts = [f"# {title}"]
    for name, body in sections:
        parts += [f"## {name}", body if isinstance(body, str) else markdown_table(body)]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n\n".join(parts) + "\n")


def bundle(path: str, files: Iterable[str]) -> None:
    """A zip of small files for reproducing a run."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, os.path.basename(f))


def roc_figure_data(points: DataFrame, most: int = 200) -> DataFrame:
    """ROC points thinned to at most about `most` per curve, for drawing: the ends and one of each step of the x axis."""
    step = F.floor(F.col("fpr") * most)
    return points.groupBy("name", step.alias("step")).agg(F.max("tpr").alias("tpr"), F.max("fpr").alias("fpr")).drop("step")
