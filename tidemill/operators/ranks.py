"""Ranks and running sums within keys that may hold a third of all rows.

A plain ``row_number() over (partition by key ...)`` sends a whole key to one task. Here each key is cut into
``buckets`` ranges of a uniformly distributed order code; rows are ranked inside (key, bucket) and the bucket's offset,
a running sum over at most ``buckets`` pre-aggregated rows per key, is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 63


def order_code(*cols: Column | str, seed: str = "0") -> Column:
    """A uniform non-negative BIGINT from the columns, the same for the same seed and values.

    ``xxhash64`` passes nulls over, so they are told apart by a flag.
    """
    parts = [F.lit(seed)]
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts += [c.isNull(), c]
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << BITS) - 1))


def _bucket(code: Column, buckets: int) -> Column:
    bits = buckets.bit_length() - 1
    if buckets != 1 << bits:
        raise ValueError("buckets must be a power of two")
    return F.shiftright(code, BITS - bits).cast("int")


def spread_cumulate(
    df: DataFrame, keys: list[str], code: str, ties: list[str], value: Column | None, out: str, buckets: int = 256, total: str | None = None
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` (rows, when None) over the rows of the same key up to and including each row.

    Rows are ordered by ``code`` (see :func:`order_code`), then ``ties``; equal rows share no order, so ``ties`` must
    be unique within a key for a repeatable result. Null keys form one key of their own. ``total`` adds the key's sum.
    """
    value = F.lit(1) if value is None else value
    t = df.withColumns({"_tm_v": value.cast("bigint"), "_tm_b": _bucket(F.col(code), buckets)})
    safe = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(f"_tm_k{i}") for i, k in enumerate(keys)]
    names = [f"_tm_k{i}" for i in range(len(keys))]
    t = t.select("*", *safe)
    sums = t.groupBy(*names, "_tm_b").agg(F.sum("_tm_v").alias("_tm_s"))
    w = Window.partitionBy(*names).orderBy("_tm_b")
    sums = sums.withColumn("_tm_off", F.sum("_tm_s").over(w) - F.col("_tm_s"))
    if total:
        sums = sums.withColumn(total, F.sum("_tm_s").over(Window.partitionBy(*names)))
    inner = Window.partitionBy(*names, "_tm_b").orderBy(code, *ties).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_tm_in", F.sum("_tm_v").over(inner))
    t = t.join(sums.drop("_tm_s"), [*names, "_tm_b"])
    return t.withColumn(out, F.col("_tm_off") + F.col("_tm_in")).drop(*names, "_tm_b", "_tm_v", "_tm_off", "_tm_in")


def spread_rank(df: DataFrame, keys: list[str], code: str, ties: list[str], out: str, buckets: int = 256, total: str | None = None) -> DataFrame:
    """Exact ``row_number`` from 1 within ``keys``; see :func:`spread_cumulate`."""
    return spread_cumulate(df, keys, code, ties, None, out, buckets, total)
