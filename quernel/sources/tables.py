"""Readers with declared schemas, checks and ordered fallbacks."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.sources.sinks import exists

DATASET = "id string, split string, attack_type string, goal string, passage string, query string, injection string, injection_offset struct<start:int,end:int>, label int"
SIGNALS = "sample_id string, split string, attack_type string, goal string, label int, passage_tokens int, inj_tokens int, query_tokens int, masses_json string"
PAIR_NAMES = {"passage": ("passage", "text", "context", "doc"), "query": ("query", "question", "title")}


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> DataFrame:
    """Fail before any work if columns are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_pairs_csv(spark: SparkSession, path: str, source: str | None = "local_csv") -> DataFrame:
    """passage, query and source_id from a CSV file whose columns may have other usual names.

    source: what source_id says; None: the file's own column of that name says it."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if source is None:
        require_columns(raw, ["source_id"], path)
    found = {k: next((n for n in names if n in raw.columns), None) for k, names in PAIR_NAMES.items()}
    if None in found.values():
        raise ValueError(f"{path} needs columns for passage and query; it has {', '.join(raw.columns)}")
    return raw.select(*(F.col(n).cast("string").alias(k) for k, n in found.items()), F.col("source_id") if source is None else F.lit(source).alias("source_id"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Decided records as write_csv leaves them, with their types: scores are numbers, decision is true or false."""
    raw = require_columns(spark.read.csv(path, header=True), ("sample_id", "decision"), path)
    kinds = {"label": "int", "decision": "boolean", "margin": "double"} | {c: "double" for c in raw.columns if c.startswith("s_")}
    out = raw.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in raw.columns))
    return out.withColumn("fired", F.coalesce("fired", F.lit(""))) if "fired" in out.columns else out


def first_source(candidates: Sequence[tuple[str, Callable[[], DataFrame | None]]], tell: Callable[[str], None] | None = None) -> tuple[str, DataFrame]:
    """The first candidate that gives a table with rows; tell gets what was passed over and why, and so does the error if none is left."""
    failed = []
    for name, get in candidates:
        try:
            df = get()
            if df is not None and df.limit(1).count():
                for line in failed if tell else ():
                    tell(f"passed over {line}")
                return name, df
            failed.append(f"{name}: no rows")
        except Exception as e:  # noqa: BLE001  any reader's failure means the next one's turn
            failed.append(f"{name}: {type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}")
    raise ValueError("no source has rows: " + "; ".join(failed))


def split_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a file of JSON lines: rejects has file and line of what is no object of the schema.

    Lines in are rows, rejects and blank lines; a missing file is two empty tables."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema), spark.createDataFrame([], "file string, line string")
    kept = T.StructType([*schema_of(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", r"\s", "")) != "").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    # a line cut off, of another type or no object at all is corrupt
    parsed = lines.withColumn("r", F.from_json("line", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | ~F.trim("line").startswith("{")
    return parsed.where(~bad).select(*(F.col("r")[f.name].alias(f.name) for f in schema_of(schema).fields)), parsed.where(bad).select("file", "line")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are passed over; a missing file is an empty table; a malformed line fails the job that reads it."""
    rows, rejects = split_jsonl(spark, path, schema)
    kinds = schema_of(schema).fields
    fail = F.raise_error(F.concat(F.lit("malformed line in "), "file", F.lit(": "), F.left("line", F.lit(200)))).cast("int")
    return rows.withColumn("_bad", F.lit(0)).unionByName(rejects.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in kinds), fail.alias("_bad"))).where("_bad = 0").drop("_bad")


def load_json(path: str, default: Any = None) -> Any:
    """A small document on the driver's disk."""
    if not os.path.exists(path):
        return default
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and the hash of the content of every file below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows, and a sum of row hashes that doesn't depend on their order."""
    h = F.xxhash64(*(F.to_json(F.struct(c)) for c in df.columns))
    n, s = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)"))).first()
    return n, int(s or 0)


def is_stale(df: DataFrame, stored: dict | None) -> bool:
    """Whether the stored row count or fingerprint is another one; one without a fingerprint counts by rows."""
    if not stored:
        return True
    n, s = fingerprint(df)
    return stored.get("rows") != n or stored.get("fingerprint") is not None and stored["fingerprint"] != s


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
