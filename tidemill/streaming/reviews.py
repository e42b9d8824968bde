"""The stateless operators on streams, duplicates within a watermark, and windowed aspect counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from tidemill.functions.cleaning import clean_reviews, first_text, text_key
from tidemill.operators.aspects import extract_aspects, typed_mentions
from tidemill.operators.sentences import review_sentences


def read_review_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 16, fmt: str = "parquet") -> DataFrame:
    """New files of a folder, so many per micro-batch: a chunked load that never holds more than a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def clean_stream(stream: DataFrame, min_chars: int = 20) -> DataFrame:
    return clean_reviews(stream, min_chars)


def dedupe_stream(stream: DataFrame, time: str = "ingested_at", delay: str = "30 days") -> DataFrame:
    """The first of texts that are equal but for case and outer white space, within the watermark; blank texts pass."""
    t = stream.withColumn("_tm_text", text_key(first_text("clean_text", "text", "raw_text")))
    t = t.withColumn("_tm_key", F.when(F.col("_tm_text") == "", F.concat(F.lit("\u0000"), F.col("ingest_seq"))).otherwise(F.sha2("_tm_text", 256)))
    return t.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_tm_key"]).drop("_tm_key", "_tm_text")


def mention_stream(stream: DataFrame, time: str = "ingested_at") -> DataFrame:
    """Typed aspect mentions with the review's time; no state."""
    return typed_mentions(extract_aspects(review_sentences(stream, keep=(time, "product_id", "category")), keep=(time, "product_id", "category")))


def windowed_aspects(mentions: DataFrame, time: str = "ingested_at", window: str = "1 hour", delay: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window_start, category, aspect_type, n): tumbling, or sliding, counts; later rows than the watermark are left out."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    n = mentions.withWatermark(time, delay).groupBy(w.alias("w"), "category", "aspect_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("w.start").alias("window_start"), "category", "aspect_type", "n")
