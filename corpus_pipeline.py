"""Corpus pipeline: five stages over documents, each written as Parquet and read as the next one's docs.

Quality classifier, n-gram Jaccard join, benchmark decontamination, mixing and token files.

Every stage takes null and repeated ids, null, empty and very long texts, further columns (which go, as
documents have COLUMNS) and empty tables; what it does with each is in its docstring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate as leaks
from brindle.llm import mixing, quality, token_files
from brindle.llm._common import mark_probable, materialise, new_path
from brindle.llm.jaccard_join import ngram_jaccard_join
from brindle.llm.queries import END_ID, vocabulary

#: Parts an encoder keeps; its worker serves the other stages too, so fewer than by default.
KEEP_PARTS = 100_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, each row by its whole text; null and wordless texts by the
    scorer's constant.  Empty table: no rows."""
    return quality.classify(docs).where("quality_keep").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of linked documents; rows of null id stay, and so do null and
    wordless texts.  Empty table: no rows.

    Rows of one id are documents of their own: each is kept or removed by its own text, and one of rows
    equal in id and text stays.  Only texts that may have to go are joined; the others pass in one scan."""
    row = ["doc_id", "text_hash"]
    found = ngram_jaccard_join(docs.select("doc_id", "text")).where("component_class is not null").select(*row, "component_class")
    found = materialise(found.groupBy(*row, "component_class").agg(F.count("*").alias("rows")), "found")
    first = found.groupBy("component_class").agg(F.min(F.struct(*row)).alias("first"))
    gone = F.struct(*row) != F.col("first")
    marked = materialise(found.join(first, "component_class").where(gone | (F.col("rows") > 1)).select(*row, gone.alias("gone"), F.xxhash64(*row).alias("key")), "marked")
    every = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash")).withColumn("key", F.xxhash64(*row))
    every = mark_probable(every, "key", marked.select("key"), marked.count(), "maybe")
    some = every.where("maybe").join(marked.drop("key"), row, "left")
    once = some.where("not gone").dropDuplicates(row)
    return every.where("not maybe").select(*COLUMNS).unionByName(some.where("gone is null").select(*COLUMNS)).unionByName(once.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item; null and empty texts hold none.  Empty table: no rows."""
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix over a document, with the words taken; wordless ones are never taken,
    repeated rows are rows of their own, null sources are a source.  Empty table: no rows."""
    mixed = mixing.mixed_texts(docs.select(*COLUMNS))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def token_binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending document id (nulls first), read back: doc_id, start, n_tokens, ids_crc32, a row
    for each input row; null and empty texts are the end id alone.  Empty table: no rows."""
    path = new_path(spark, "tokens")
    token_files.write_token_files(docs, path, vocabulary(), END_ID, keep=KEEP_PARTS)
    return token_files.read_token_files(spark, path, digests=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_binary),
]
#: The tokenizer and the learned classifier are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
