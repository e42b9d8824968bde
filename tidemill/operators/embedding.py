"""Feature-hashing embeddings of phrases as sparse vectors, their cosine, and a cache table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.cleaning import text_key

DIMENSION = 384
WORD_WEIGHT, GRAM_WEIGHT = 1.5, 0.8
VECTOR = "array<struct<idx: int, w: double>>"


def _slot(hexes: Column, chunks: int) -> tuple[Column, Column]:
    """The hash modulo 384 and its ninth bit, from 8-digit parts: 2 to the 32 is 256 modulo 384."""
    part = lambda i: F.conv(F.substring(hexes, 8 * i + 1, 8), 16, 10).cast("bigint")
    rest = F.lit(0).cast("bigint")
    for i in range(chunks):
        rest = (rest * 256 + part(i)) % DIMENSION
    return rest.cast("int"), F.shiftright(part(chunks - 1), 8).bitwiseAND(F.lit(1)) == 1


def phrase_features(phrase: Column) -> Column:
    """array<struct<feature, weight, idx, signed>>: words, and runs of three characters of the padded phrase."""
    s = text_key(phrase)
    words = F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")
    padded = F.concat(F.lit(" "), s, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - 2)), lambda i: F.substring(padded, i, F.lit(3)))

    def feature(x: Column, mark: str, weight: float) -> Column:
        idx, plus = _slot(F.md5(x), 4) if mark == "w" else _slot(F.sha2(x, 256), 8)
        return F.struct(F.concat(F.lit(mark), x).alias("feature"), F.lit(weight).alias("weight"), idx.alias("idx"), F.when(plus, weight).otherwise(-weight).alias("signed"))

    return F.concat(F.transform(words, lambda w: feature(w, "w", WORD_WEIGHT)), F.transform(grams, lambda g: feature(g, "g", GRAM_WEIGHT)))


def embed(df: DataFrame, phrase: str = "surface") -> DataFrame:
    """(phrase, vec): one unit vector per distinct phrase, as (idx, w) by idx; a zero vector becomes the first axis."""
    t = df.select(F.col(phrase)).where(F.col(phrase).isNotNull()).distinct()
    sums = t.select(phrase, F.explode(phrase_features(F.col(phrase))).alias("f")).groupBy(phrase, F.col("f.idx").alias("idx")).agg(F.sum("f.signed").alias("w"))
    arr = sums.groupBy(phrase).agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    unit = F.transform("v", lambda x: F.struct(x["idx"].alias("idx"), (x["w"] / F.col("n")).alias("w")))
    axis = F.array(F.struct(F.lit(0).alias("idx"), F.lit(1.0).alias("w")))
    return arr.withColumn("n", norm).select(phrase, F.when(F.col("n") > 1e-9, F.filter(unit, lambda x: x["w"] != 0)).otherwise(axis).alias("vec"))


def dense(vec: Column, dimension: int = DIMENSION) -> Column:
    """array<float> of a sparse vector."""
    m = F.map_from_entries(vec)
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(m[i], F.lit(0.0)).cast("float"))


def sparse_dot(a: Column, b: Column) -> Column:
    m = F.map_from_entries(b)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(m[x["idx"]], F.lit(0.0)))


def dense_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero or null."""
    return F.coalesce(F.try_divide(dense_dot(a, b), F.sqrt(dense_dot(a, a)) * F.sqrt(dense_dot(b, b))), F.lit(0.0))


def model_embed(df: DataFrame, encode: Callable[[list[str]], list[list[float]]], phrase: str = "surface") -> DataFrame:
    """(phrase, vec) of another encoder, scaled to length 1; a zero vector becomes the first axis."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([[float(x) for x in v] for v in encode(s.tolist())])

    t = df.select(F.col(phrase)).where(F.col(phrase).isNotNull()).distinct().withColumn("v", run.asNondeterministic()(F.col(phrase)))
    t = t.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    unit = F.filter(F.transform("v", lambda x, i: F.struct(i.alias("idx"), (x / F.greatest(F.col("n"), F.lit(1e-9))).alias("w"))), lambda x: x["w"] != 0)
    return t.select(phrase, F.when(F.col("n") > 1e-9, unit).otherwise(F.array(F.struct(F.lit(0).alias("idx"), F.lit(1.0).alias("w")))).alias("vec"))


def cached_embed(df: DataFrame, cache: str, model: str = "hashing", phrase: str = "surface", encode: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Like :func:`embed`, through a Parquet table of (model, phrase, vec) at ``cache``: only new phrases are computed.

    The table is keyed by model and phrase, so models and dimensions never mix; what several runs added at once counts once. ``encode`` computes another model's
    vectors, batch by batch in Python workers.
    """
    spark = df.sparkSession
    wanted = df.select(F.col(phrase)).where(F.col(phrase).isNotNull()).distinct()
    shape = f"model string, {phrase} string, vec {VECTOR}"
    try:
        have = spark.read.schema(shape).parquet(cache)
        new = wanted.join(have.where(F.col("model") == model), phrase, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = wanted
    fresh = embed(new, phrase) if encode is None else model_embed(new, encode, phrase)
    fresh.select(F.lit(model).alias("model"), phrase, "vec").write.mode("append").parquet(cache)
    return spark.read.schema(shape).parquet(cache).where(F.col("model") == model).join(wanted, phrase, "left_semi").groupBy(phrase).agg(F.first("vec").alias("vec"))
