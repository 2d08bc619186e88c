"""Incremental extraction: only samples that have no signals yet, restartable at any point.

A stream over the sample files, triggered for what is there, keeps its place in a checkpoint folder. Each batch goes
into the tables that later stages read, by its number and without samples that other batches have, so a batch that is
run again after a failure, or samples that come twice, change nothing. Invalid samples go to a table of rejects with the
reason, never silently.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quernel.operators import spans
from quernel.session import ship, written
from quernel.sources.sinks import exists

MASS = "struct<layer:int,head:int,m_qp:double,m_qi:double,m_qq:double>"
SIGNAL_SCHEMA = f"sample_id string, masses array<{MASS}>, hidden array<struct<layer:int,vec:array<float>>>"
#: The tables of a cache. A batch of samples is a folder of each; widths are written last, so a sample without them isn't there.
MASSES = "sample_id string, layer int, head int, m_qp double, m_qi double, m_qq double, batch long"
WIDTHS = "sample_id string, w_p int, w_i int, w_q int, batch long"
HIDDEN = "sample_id string, vec array<float>, batch long, layer int"
REJECTS = "sample_id string, note string, batch long"


class SignalExtractor(Protocol):
    """What a model gives for one encoded sample, in one pass: masses (layer, head, m_qp, m_qi, m_qq) and hidden vectors (layer, vec)."""

    def __call__(self, sample_id: str, n_tokens: int, p: tuple[int, int], i: tuple[int, int], q: tuple[int, int]) -> tuple[list[tuple[int, int, float, float, float]], list[tuple[int, list[float]]]]: ...


def stub_extractor(sample_id: str, n_tokens: int, p: tuple[int, int], i: tuple[int, int], q: tuple[int, int]) -> tuple[list[tuple[int, int, float, float, float]], list[tuple[int, list[float]]]]:
    """Stands in for a model: numbers that follow from the sample alone; a layer's vector is its masses on the insertion."""
    import zlib

    r = np.random.default_rng(zlib.crc32(sample_id.encode()))
    masses = []
    for layer in range(2):
        for head in range(4):
            a = r.random(n_tokens)
            masses.append((layer, head, float(a[p[0] : p[1]].sum()), float(a[i[0] : i[1]].sum()), float(a[q[0] : q[1]].sum())))
    return masses, [(layer, [m[3] for m in masses if m[0] == layer]) for layer in range(2)]


def todo(samples: DataFrame, done: DataFrame, key: str = "sample_id") -> DataFrame:
    return samples.join(done.select(key).distinct(), key, "left_anti")


def split_valid(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    return encoded.where("valid"), encoded.where("not valid").select("sample_id", "note")


def extract(encoded: DataFrame, extractor: SignalExtractor = stub_extractor) -> DataFrame:
    """sample_id, masses and hidden of valid encoded samples, Arrow batch by Arrow batch. Write it before it is read twice."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, n, *r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                masses, hidden = extractor(s, n, (r[0], r[1]), (r[2], r[3]), (r[4], r[5]))
                out.append({"sample_id": s, "masses": [dict(zip(("layer", "head", "m_qp", "m_qi", "m_qq"), m, strict=True)) for m in masses], "hidden": [{"layer": layer, "vec": v} for layer, v in hidden]})
            yield pa.RecordBatch.from_pylist(out, schema)

    mass = pa.struct([("layer", pa.int32()), ("head", pa.int32()), ("m_qp", pa.float64()), ("m_qi", pa.float64()), ("m_qq", pa.float64())])
    schema = pa.schema([("sample_id", pa.string()), ("masses", pa.list_(mass)), ("hidden", pa.list_(pa.struct([("layer", pa.int32()), ("vec", pa.list_(pa.float32()))])))])
    ranges = [F.col(f"{t}_tok.{x}").alias(f"{t}_{x}") for t in "piq" for x in "se"]
    return encoded.where("valid").select("sample_id", "n_tokens", *ranges).mapInArrow(run, SIGNAL_SCHEMA)


def read_cache(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """masses, widths and hidden of a cache, as calibration and decisions read them; empty before the first batch."""
    tables_ = []
    for name, schema in (("masses", MASSES), ("widths", WIDTHS), ("hidden", HIDDEN)):
        there = exists(spark, f"{root}/{name}")
        df = spark.read.schema(schema).parquet(f"{root}/{name}") if there else spark.createDataFrame([], schema)
        tables_.append(df.drop("batch"))
    return tuple(tables_)


def add_batch(encoded: DataFrame, root: str, batch: int, extractor: SignalExtractor = stub_extractor) -> None:
    """Extract the samples that no other batch has, once each, and put them into the cache's tables as this batch.

    A batch that is run again replaces what it left; samples of other batches stay as they are, also when another
    batch brings them once more. Signals are written before masses and vectors are taken from them: one pass a sample."""
    spark = encoded.sparkSession
    new = encoded.dropDuplicates(["sample_id"])
    for name, schema in (("widths", WIDTHS), ("rejects", REJECTS)):
        if exists(spark, f"{root}/{name}"):
            new = todo(new, spark.read.schema(schema).parquet(f"{root}/{name}").where(F.col("batch") != batch))
    new = written(new, "new-samples")
    good, bad = split_valid(new)
    signals = written(extract(good, extractor), "extracted")
    put = lambda df, name, *by: df.write.mode("overwrite").partitionBy(*by).parquet(f"{root}/{name}/batch={batch}")
    put(signals.select("sample_id", F.explode("masses").alias("m")).select("sample_id", "m.*"), "masses")
    put(signals.select("sample_id", F.explode("hidden").alias("h")).select("sample_id", "h.*").repartition("layer"), "hidden", "layer")
    put(bad, "rejects")
    width = lambda t: (F.col(f"{t}_tok.e") - F.col(f"{t}_tok.s")).cast("int").alias(f"w_{t}")
    put(good.select("sample_id", width("p"), width("i"), width("q")), "widths")


class Progress(StreamingQueryListener):
    """Keeps what each batch of a stream did: (batch, rows, rows a second); tell is called with each."""

    def __init__(self, tell: Callable[[tuple[int, int, float]], None] | None = None) -> None:
        self.batches: list[tuple[int, int, float]] = []
        self.ended: str | None = None
        self._tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: N802  names that Spark calls
        self.ended = None

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches.append((p.batchId, p.numInputRows, p.processedRowsPerSecond))
        if self._tell:
            self._tell(self.batches[-1])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended = event.exception or "done"


def extraction_stream(spark: SparkSession, samples_path: str, schema: str, root: str, checkpoint: str, extractor: SignalExtractor = stub_extractor, prepare: Callable[[DataFrame], DataFrame] = spans.encode) -> StreamingQuery:
    """Put the signals of the samples that came since the last run into the cache at root, then stop; run it again to go on."""

    def batch(df: DataFrame, number: int) -> None:
        add_batch(prepare(df), root, number, extractor)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(samples_path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
