"""From raw documents to packed sequences: five stages, each an operator of ``lectern.llm``.

A stage takes all that the one before kept, and its decisions take effect. Extra columns pass through all stages but the last,
whatever their names. Every stage gives an empty table for an empty one, and takes rows without an id, rows that share an id, null, empty and
very long texts as its docstring says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.exact_dedup import exact_groups, normalised
from lectern.llm.near_join import near_components
from lectern.llm.packing import packed
from lectern.llm.pii import redacted
from lectern.llm.queries import VOCABULARY, documents, vocabulary
from lectern.llm.store import dropped, scratch, workspace, written
from lectern.llm.toxicity import without_toxic


def chosen(docs: DataFrame, keepers: DataFrame, keys: dict[str, Column], own: Column) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are a row of ``keepers`` (null safe); of those alike in ``keys`` and ``own`` one: the longest text, then the least, then the least row."""
    held = docs.select(F.struct("*").alias("row"), *[c.alias(f"key_{k}") for k, c in keys.items()], own.alias("own"))
    same = reduce(lambda a, b: a & b, [F.col(f"key_{k}").eqNullSafe(F.col(k)) for k in keys])
    out = held.join(keepers.hint("shuffle_hash"), same, "left_semi")
    if not keepers.groupBy(*keys).count().filter("count > 1").isEmpty():
        order = Window.partitionBy(*[f"key_{k}" for k in keys], "own").orderBy(F.length("row.text").desc(), F.col("row.text"), F.to_json("row"))
        out = out.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return out.select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score 0.3 or more; each row by its text alone, null and empty ones by the bias, rows without an id and repeated ones too."""
    return without_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), limit=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the row with the most code points, then the smallest id.

    Decided by row: of rows that share an id each stays or goes by its own text. Null, empty and all-white texts are equal. Rows without an id come last. Of rows alike in id and text one stays.
    """
    keepers = exact_groups(spark, docs).filter("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_text"))
    text = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    return chosen(docs, keepers, {"keep_id": F.col("doc_id"), "keep_text": text}, F.lit(0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component of near copies.

    An id is a document: rows that share one link as one, and stay or go together, but of those with one text one stays. Texts without words and rows without an id link with nothing and stay.
    """
    found = near_components(spark, docs)
    keepers = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("keep_id"))
    return chosen(docs, keepers, {"keep_id": F.col("doc_id")}, F.col("text"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of each span of personal data; ``n_chars`` follows the text. Every row stays; null and empty texts, and those without spans, stay as they are."""
    out = redacted(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens: the pieces of each row. A null or empty text is its end id alone; rows without an id and repeated ones are packed each."""
    return packed(spark, docs, vocabulary(VOCABULARY), size=2048, end_id=0)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("private_data", private_data), ("packing", packing)]

#: Models and token ids are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's tables go once its result is written, and its result once the next one's is."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with workspace(spark, f"work-{name}"):
            docs = written(stage(spark, docs, sf_dir), path)
        if before:
            dropped(spark, before)
        before = path
    return docs
