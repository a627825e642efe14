"""Ingest as a stream of files, and counts in fixed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import base_name
from lectern.models import CapitalTagger, Embedder, HashingEmbedder, Tagger
from lectern.plans.search import ingest_files
from lectern.sources.store import Store


def ingest_stream(spark: SparkSession, folder: str, store: Store, tenant: str, checkpoint: str, pattern: str = "*.md", embedder: Embedder | None = None, tagger: Tagger | None = None):
    """A query that ingests new text files, all of a batch in one plan: chunks, graph and vectors. A file is stored once, whatever is replayed.

    Without models, the deterministic stand-ins are taken.
    """
    embedder, tagger = embedder or HashingEmbedder(), tagger or CapitalTagger()
    files = spark.readStream.schema("value string").option("pathGlobFilter", pattern).option("wholetext", "true").text(folder)
    named = files.select(base_name(F.col("_metadata.file_path")).alias("name"), F.col("value").alias("text"))

    def put(batch: DataFrame, _: int) -> None:
        ingest_files(batch.sparkSession, store, tenant, batch, embedder, tagger)

    return named.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, time: str = "ts", by: str = "user_id", width: str = "15 minutes", late: str | None = None) -> DataFrame:
    """``by, window_start, n``: requests in fixed windows; with ``late`` a watermark, for streams."""
    df = events.withWatermark(time, late) if late else events
    return df.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("window_start"), "n")
