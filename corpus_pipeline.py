"""The corpus pipeline: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from determina.llm import bwt, decontaminate, langid, minhash, pieces
from determina.llm.shared import staged


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage has cut."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown or unsure go; null and empty texts are among them.

    Rows are judged one by one, so repeated ids and rows and null ids change nothing. Extra columns
    stay; an empty table stays empty.
    """
    return langid.keep_known(docs)


def _free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores where a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the smallest id.

    A row is a document: rows that share an id are compared by their texts like any others, as if
    they had ids larger than all, so an id goes only with the texts that have a near-duplicate left.
    Documents without words and documents without an id are in no class and stay. Extra columns
    stay; an empty table stays empty.
    """
    key = _free_name("key", docs.columns)
    many = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    many = staged(many, "shared-ids")
    single, shared = docs, None
    if not many.isEmpty():
        largest = docs.agg(F.max("doc_id")).first()[0]
        single = docs.join(many, "doc_id", "left_anti").select(docs.columns)
        shared = docs.join(many, "doc_id", "left_semi").select(docs.columns)
        shared = staged(shared.withColumn(key, F.monotonically_increasing_id() + F.lit(largest) + 1), "shared-rows")
    rows = single.select(F.col("doc_id").cast("long").alias("node"), "text")
    if shared is not None:
        rows = rows.unionByName(shared.select(F.col(key).alias("node"), "text"))
    gone = minhash.near_duplicates(rows, id_col="node").where("not kept").select("node").distinct()
    if shared is None:
        return single.join(gone, F.col("doc_id") == F.col("node"), "left_anti")
    gone = staged(gone, "gone")
    left = single.join(gone, F.col("doc_id") == F.col("node"), "left_anti")
    return left.unionByName(shared.join(gone, F.col(key) == F.col("node"), "left_anti").drop(key))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes and more that begin at two places are cut out.

    Rows stay, also those whose text becomes empty; a null text stays null. Equal texts in several
    rows repeat each other, whatever their ids. Extra columns stay; an empty table stays empty.
    """
    return _measured(bwt.remove_repeats(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go.

    Null and empty texts stay as they are; rows are judged one by one, so repeated ids and rows change
    nothing. Extra columns stay; an empty table stays empty.
    """
    return _measured(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, with the text decoded from its piece ids, and ``ids``.

    Pieces write a space as U+2581, so a text that holds that character itself would come back with
    spaces; such a text stays as it was. A null text becomes empty, without ids. A table that has a
    column ``ids`` keeps it and the new one is ``ids_``. Rows that share an id, or have none, are
    coded each; an empty table stays empty.
    """
    others = [c for c in docs.columns if c != "text"]
    marked, ids = _free_name("marked", docs.columns), _free_name("ids", docs.columns)
    as_was = F.when(F.col("text").contains("\u2581"), F.col("text"))
    coded = pieces.encode(docs.select(F.struct(*others, as_was.alias(marked)).alias("id"), "text"), pieces.load_pieces(), "id")
    text = F.coalesce(F.col("id")[marked], F.col("decoded"))
    return coded.select(*((text if c == "text" else F.col("id")[c]).alias(c) for c in docs.columns), F.col("ids").alias(ids))


STAGES = [
    ("language", known_language), ("minhash", near_duplicates), ("repeats", repeated_strings),
    ("benchmark", benchmark_passages), ("pieces", piece_ids),
]

#: No stage has a SQL form on its input; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
