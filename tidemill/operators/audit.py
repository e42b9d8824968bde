"""Checks of results against their sources, and summary figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.cleaning import text_key


def broken_offsets(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Mentions without their sentence, or whose offsets do not cut the surface out of it; no rows when all is well."""
    s = sentences.select("sentence_id", F.col("text").alias("_tm_text")).dropDuplicates(["sentence_id"])
    t = mentions.join(s, "sentence_id", "left")
    cut = F.substring(F.col("_tm_text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return t.where(F.col("_tm_text").isNull() | (cut != F.col("surface"))).drop("_tm_text")


def map_mentions(mentions: DataFrame, surface_map: DataFrame) -> DataFrame:
    """Mentions with canonical_aspect and cluster_id of their category and surface; the surface itself and '' if unmapped."""
    m = surface_map.select(F.col("category").alias("_tm_c"), F.col("surface").alias("_tm_s"), F.col("canonical_aspect").alias("_tm_a"), F.col("cluster_id").alias("_tm_i"))
    own = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("general"))
    t = mentions.join(m, (own == F.col("_tm_c")) & (text_key(F.col("surface")) == F.col("_tm_s")), "left")
    return t.withColumns({"canonical_aspect": F.coalesce("_tm_a", text_key(F.col("surface"))), "cluster_id": F.coalesce("_tm_i", F.lit(""))}).drop("_tm_c", "_tm_s", "_tm_a", "_tm_i")


def text_lengths(df: DataFrame, by: str = "category", text: str = "clean_text") -> DataFrame:
    """(by, n, shortest, longest, mean_length) of texts that are not null."""
    n = F.length(text)
    return df.where(F.col(text).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean_length"))


def split_sizes(df: DataFrame) -> DataFrame:
    """(split, n_reviews, n_products, n_categories), distinct values each."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_reviews"), F.count_distinct("product_id").alias("n_products"), F.count_distinct("category").alias("n_categories"))


def word_count_histogram(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(F.size(F.split(F.col("surface"), r"(?U)\s+")).alias("n_words")).agg(F.count(F.lit(1)).alias("n"))


def top_clusters(clusters: DataFrame, k: int = 10) -> DataFrame:
    return clusters.orderBy(F.col("member_count").desc(), "cluster_id").limit(k)


def product_rollup(reviews: DataFrame) -> DataFrame:
    """(product_id, review_count, average_rating): ratings of -1 or null are missing."""
    r = F.when(F.col("rating") >= 0, F.col("rating"))
    return reviews.where(F.length("product_id") > 0).groupBy("product_id").agg(F.count(F.lit(1)).alias("review_count"), F.round(F.avg(r), 6).alias("average_rating"))


def product_aspect_rollup(mentions: DataFrame, by: str = "canonical_aspect") -> DataFrame:
    return mentions.groupBy("product_id", by).agg(F.count(F.lit(1)).alias("mention_count"), F.count_distinct("review_id").alias("unique_review_count"), F.round(F.avg("confidence"), 6).alias("confidence"))
