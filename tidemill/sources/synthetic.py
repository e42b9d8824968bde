"""A small made-up review corpus for tests and demonstrations, built from a grammar by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = {
    "Electronics": ["battery life", "screen", "keyboard", "charger"],
    "Beauty": ["scent", "texture", "pump bottle"],
    "Home": ["lid", "handle", "filter basket"],
    "Sports": ["grip", "strap", "padding"],
}
PRAISE, BLAME = ["great", "excellent", "comfortable", "sturdy"], ["terrible", "flimsy", "noisy", "useless"]
EDGE_CASES = ["", "   ", "Good", "OK", "<b>Bold</b> claim about the lid &amp; the handle", "See https://shop.example/item for the screen", "Café crème, très bon produit", "電池はとても良いです。", "Works!!! Really?! Yes...", "It weighs 3.5 kg and costs 12.99 at Dr. Hale's shop."]
DUPLICATED = 4


def estimate_rating(text: Column) -> Column:
    """5 when praise outweighs blame, 1 when blame does, else 3."""
    hits = lambda words: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w)))
    d = hits(PRAISE) - hits(BLAME)
    return F.when(d > 0, 5.0).when(d < 0, 1.0).otherwise(3.0)


def title_for(rating: Column) -> Column:
    return F.when(rating >= 4, "Very pleased").when(rating <= 2, "Let down").otherwise("It does the job")


def synthetic_reviews(spark: SparkSession, seed: int = 42, per_part: int = 8) -> DataFrame:
    """Reviews in the order of ingest_seq, which the seed shuffles; every edge case and a few exact copies are in it."""
    rows = [(c, p, i) for c, parts in PARTS.items() for p in parts for i in range(per_part)]
    t = spark.createDataFrame(rows, "category string, part string, i int")
    word = F.when(F.col("i") % 2 == 0, F.element_at(F.array(*[F.lit(w) for w in PRAISE]), F.col("i") % 4 + 1)).otherwise(F.element_at(F.array(*[F.lit(w) for w in BLAME]), F.col("i") % 4 + 1))
    t = t.select("category", F.concat(F.lit("The "), "part", F.lit(" is "), word, F.lit(" after "), F.col("i") + 2, F.lit(" weeks. I would "), F.when(F.col("i") % 2 == 0, "buy it again.").otherwise("not buy it again.")).alias("text"))
    edge = spark.createDataFrame([("Home", x) for x in EDGE_CASES], "category string, text string")
    t = t.unionByName(t.orderBy("text").limit(DUPLICATED)).unionByName(edge)
    code = F.xxhash64(F.lit(str(seed)), "category", "text", F.monotonically_increasing_id())
    from pyspark.sql import Window

    t = t.withColumn("ingest_seq", F.row_number().over(Window.orderBy(code)).cast("bigint"))  # a few hundred rows
    rating = estimate_rating(F.col("text"))
    i = F.col("ingest_seq")
    return t.select(
        F.sha2(F.concat_ws("|", F.lit("synthetic"), i), 256).alias("review_id"),
        F.concat("category", F.lit("-"), i % 5).alias("product_id"),
        F.concat("category", F.lit("-"), i % 5).alias("parent_product_id"),
        "category",
        title_for(rating).alias("title"),
        "text",
        F.col("text").alias("raw_text"),
        F.lit("").alias("clean_text"),
        rating.alias("rating"),
        (i % 3 != 0).alias("verified_purchase"),
        (i % 7).alias("helpful_vote"),
        F.format_string("2024-%02d-%02d", (i % 12 + 1).cast("int"), (i % 28 + 1).cast("int")).alias("timestamp"),
        F.lit("synthetic").alias("source"),
        "ingest_seq",
    )
