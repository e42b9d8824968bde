"""Queries and SQL of the operators on general tables (problems 2 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.hotkeys import heavy_keys, key_profile
from tidemill.operators.timestamps import normalise_timestamps
from tidemill.session import table

HEAVY = 0.03


def p2_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, shares and exact quantiles per product_id of reviews (helpful_vote) and product_aspects (confidence)."""
    parts = [("reviews", "helpful_vote"), ("product_aspects", "confidence")]
    a, b = (key_profile(table(spark, sf, t), "product_id", v).select(F.lit(t).alias("table_name"), "*") for t, v in parts)
    return a.unionByName(b)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The product_ids that hold most rows of each table."""
    a, b = (heavy_keys(table(spark, sf, t), "product_id", HEAVY).select(F.lit(t).alias("table_name"), "product_id") for t in ("reviews", "product_aspects"))
    return a.unionByName(b)


def p5_normalised(spark: SparkSession, sf: str) -> DataFrame:
    t = normalise_timestamps(table(spark, sf, "reviews"), table(spark, sf, "feeds"))
    return t.select("ingest_seq", "epoch_ms", "time_mask", "zone_version")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    t = normalise_timestamps(table(spark, sf, "reviews").select("ingest_seq", "timestamp", "source"), table(spark, sf, "feeds"))
    return t.where(F.col("epoch_ms").isNotNull()).select("ingest_seq", "epoch_ms")


QUERIES = {f.__name__: f for f in (p2_found, p2_profiles, p5_found, p5_normalised)}


def _profile_sql(name: str, value: str) -> str:
    return f"""SELECT '{name}' AS table_name, product_id, n_rows, share, prob, quantile FROM (
      SELECT product_id, count(*) AS n_rows, count(*) / (SELECT count(*) FROM {name} WHERE product_id <> '') AS share
      FROM {name} WHERE product_id <> '' GROUP BY 1) LEFT JOIN (
      SELECT product_id, prob, CAST(list_sort(vs)[CAST(greatest(1, ceil(prob * len(vs))) AS BIGINT)] AS DOUBLE) AS quantile
      FROM (SELECT product_id, list(CAST({value} AS DOUBLE)) AS vs FROM {name} WHERE product_id <> '' AND {value} IS NOT NULL GROUP BY 1),
        (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS prob)) USING (product_id)"""


SQL = {
    "p2_profiles": _profile_sql("reviews", "helpful_vote") + " UNION ALL " + _profile_sql("product_aspects", "confidence"),
    "p2_found": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, product_id FROM {t} WHERE product_id <> '' GROUP BY product_id HAVING count(*) >= 0.03 * (SELECT count(*) FROM {t} WHERE product_id <> '')"
        for t in ("reviews", "product_aspects")
    ),
}
