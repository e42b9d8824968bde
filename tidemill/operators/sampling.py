"""Seeded samples and splits. Order comes from the MD5 of seed and id: the same everywhere, another for another seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.cleaning import text_key
from tidemill.operators.ranks import spread_rank


def seeded_code(seed: int | str, *cols: str) -> Column:
    """The first 60 bits of MD5('seed|id...') as a uniform 63-bit code; null ids count as ''."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    return F.shiftleft(F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"), 3)


def sample_per_key(df: DataFrame, key: str | Column, most: int, seed: int | str, row_id: str = "review_id", ties: str = "ingest_seq") -> DataFrame:
    """At most ``most`` rows of each value of ``key``; null is a value of its own. Hot keys are ranked in pieces."""
    t = df.withColumns({"_tm_key": F.col(key) if isinstance(key, str) else key, "_tm_code": seeded_code(seed, row_id)})
    return spread_rank(t, ["_tm_key"], "_tm_code", [ties], "_tm_rank").where(F.col("_tm_rank") <= most).drop("_tm_key", "_tm_code", "_tm_rank")


def sample_by_category(df: DataFrame, categories: list[str] | None, most: int, seed: int | str) -> DataFrame:
    """At most ``most`` rows of each category, of the given ones or all."""
    return sample_per_key(df.where(F.col("category").isin(categories)) if categories else df, "category", most, seed)


def sample_by_product(df: DataFrame, products: list[str] | None, max_products: int, per_product: int, seed: int | str) -> DataFrame:
    """At most ``max_products`` products, the given ones that exist or a random choice, and so many rows of each."""
    ids = df.where(F.length("product_id") > 0).select("product_id").distinct()
    if products:
        rank = F.array_position(F.array(*[F.lit(p) for p in products]), F.col("product_id"))
        ids = ids.where(F.col("product_id").isin(products)).orderBy(rank)
    else:
        ids = ids.orderBy(seeded_code(seed, "product_id"), "product_id")
    return sample_per_key(df.join(F.broadcast(ids.limit(max_products)), "product_id", "left_semi"), "product_id", per_product, seed)


def rating_bucket(c: Column) -> Column:
    """0 for missing ratings, else the rating rounded half to even, from 1 to 5."""
    return F.when(c > 0, F.greatest(F.lit(1), F.least(F.lit(5), F.bround(c).cast("int")))).otherwise(F.lit(0))


def sample_by_rating(df: DataFrame, most: int, seed: int | str) -> DataFrame:
    return sample_per_key(df, rating_bucket(F.col("rating")), most, seed)


def random_sample(df: DataFrame, n: int, seed: int | str, row_id: str = "review_id", ties: str = "ingest_seq") -> DataFrame:
    """``n`` rows, or all if there are fewer: a top-n by hash, without a full sort."""
    return df.orderBy(seeded_code(seed, row_id), ties).limit(n)


def _cut(df: DataFrame, rank: str, total: str, ratios: tuple[float, float, float]) -> DataFrame:
    whole = sum(ratios)
    train = F.floor(F.col(total) * F.lit(ratios[0] / whole))
    val = F.floor(F.col(total) * F.lit(ratios[1] / whole))
    return df.withColumn("split", F.when(F.col(rank) <= train, "train").when(F.col(rank) <= train + val, "val").otherwise("test"))


def split_reviews(df: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int | str = 42, by_product: bool = True, ties: str = "ingest_seq") -> DataFrame:
    """Adds ``split``: train, val or test in the given proportions of products (or of rows).

    By product, all rows of a product share a split; null and '' products are one, called unknown. Ratios are
    normalised; counts are rounded down and the rest is test.
    """
    if not by_product:
        t = spread_rank(df.withColumn("_tm_code", seeded_code(seed, "review_id")), [], "_tm_code", [ties], "_tm_rank", total="_tm_total")
        return _cut(t, "_tm_rank", "_tm_total", ratios).drop("_tm_code", "_tm_rank", "_tm_total")
    product = F.coalesce(F.nullif(F.col("product_id"), F.lit("")), F.lit("unknown"))
    t = df.withColumn("_tm_product", product)
    ids = t.select("_tm_product").distinct().withColumn("_tm_code", seeded_code(seed, "_tm_product"))
    ids = _cut(spread_rank(ids, [], "_tm_code", ["_tm_product"], "_tm_rank", total="_tm_total"), "_tm_rank", "_tm_total", ratios)
    return t.join(ids.select("_tm_product", "split"), "_tm_product").drop("_tm_product")


def split_leaks(df: DataFrame, text: str = "clean_text", shown: int = 20) -> DataFrame:
    """(kind, split_a, split_b, n_shared, examples): review ids, product ids and texts that stand in two splits.

    Blank texts are no leak; null ids are none. Examples are the ``shown`` smallest, cut to 80 characters for texts.
    """
    parts = []
    for kind, key in (("review_id", F.col("review_id")), ("product_id", F.col("product_id")), ("text", F.nullif(text_key(F.col(text)), F.lit("")))):
        parts.append(df.select(F.lit(kind).alias("kind"), key.alias("value"), "split").where(F.col("value").isNotNull() & F.col("split").isNotNull()))
    t = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sets = t.groupBy("kind", "value").agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    pairs = sets.select("kind", "value", F.posexplode("s").alias("i", "split_a"), "s").select("kind", "value", "split_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("split_b"))
    short = F.when(F.col("kind") == "text", F.substring("value", 1, 80)).otherwise(F.col("value"))
    n = pairs.groupBy("kind", "split_a", "split_b").agg(F.count(F.lit(1)).alias("n_shared"))
    code = F.xxhash64("value").bitwiseAND(F.lit((1 << 63) - 1))
    top = spread_rank(pairs.withColumns({"code": code, "short": short}), ["kind", "split_a", "split_b"], "code", ["value"], "rank").where(F.col("rank") <= shown)
    ex = top.groupBy("kind", "split_a", "split_b").agg(F.array_sort(F.collect_list("short")).alias("examples"))
    return n.join(ex, ["kind", "split_a", "split_b"])


def unseen(df: DataFrame, known: DataFrame, key: str, n: int | None = None, seed: int | str = 42) -> DataFrame:
    """Rows whose ``key`` (product or category) is not in ``known``; ``n`` of them, chosen by hash, if given."""
    t = df.join(known.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return t if n is None else random_sample(t, n, seed)


def assert_real_only(df: DataFrame) -> DataFrame:
    """The rows; reading them fails if any comes from a synthetic source or has a synthetic origin."""
    synthetic = F.lower(F.coalesce(F.col("source"), F.lit(""))).rlike("synthetic|smoke")
    if "origin" in df.columns:
        synthetic = synthetic | (F.col("origin") == "synthetic")
    return df.withColumn("source", F.when(synthetic, F.raise_error(F.lit("synthetic rows are no training data"))).otherwise(F.col("source")))
