"""From raw documents to packed training sequences: five stages, each one of the operators in quernel.llm.

A stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents. Rows with equal
doc_id and text are one document from the second stage on; other texts under the same id, and those without one, are
documents of their own, after all with ids of their own.

Defined cases: null, empty and wordless texts are rejected by the first stage; given to the second, such rows all stay
but for repeats; the third leaves null and empty texts as they are; the fourth takes them (size 0) as their hash falls;
the last packs them as their end token alone. Ties go to the smaller id. Empty tables give empty results. Further
columns of documents, whatever their names, go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.llm import minhash, mixing, packing, quality, substring
from quernel.session import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def keyed(docs: DataFrame) -> DataFrame:
    """key and doc, the whole row, so that no column's name can clash.

    key is equal where doc_id and text are: doc_id for the text of least hash under it, for others a hash of 62 bits."""
    h = F.xxhash64("doc_id", "text")
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("first"), F.max(h).alias("last")).where("first <> last")
    several = written(several.select(F.col("doc_id").alias("id"), "first"), "several")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), h.alias("h"))
    own = F.lit(1 << 62) + F.shiftrightunsigned("h", 2)
    id_ = F.col("doc.doc_id")
    key = F.when(id_.isNotNull() & (F.col("first").isNull() | (F.col("h") == F.col("first"))), id_.cast("long")).otherwise(own)
    return rows.join(several, id_ == F.col("id"), "left").select("doc", key.alias("key"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, once if its row is repeated (of rows that differ in other columns, that of least hash)."""
    rows = keyed(docs)
    found = minhash.near_duplicates(rows.select("key", "doc.text"), key="key").where("kept").select(F.col("doc_id").alias("kept")).distinct()
    rows = rows.join(written(found, "kept"), F.col("key") == F.col("kept"), "left_semi")
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(*(F.col("doc")[c] for c in docs.columns))))
    return rows.withColumn("n", first).where("n = 1").select("doc.*")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document shares with an earlier one are cut out; n_chars follows. A document left without words goes."""
    rows = keyed(docs).select("doc", "key", "doc.text")
    cut = substring.cut_passages(rows, substring.shared_passages(rows, key="key"), key="key")
    doc = F.col("doc").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length("text").cast("long"))
    return cut.select(doc.alias("doc")).select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; repeats are rows of their own."""
    rows = keyed(docs)
    times = mixing.mix_documents(rows.select("key", "doc.text", "doc.source"), key="key").where("times > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max("times").cast("int").alias("times"))
    return rows.join(written(times, "times"), F.col("key") == F.col("id")).select("doc", F.explode(F.sequence(F.lit(1), "times"))).select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed into sequences."""
    return packing.pack_documents(docs, keep_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No stage but the fourth can be put in SQL; the tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
