"""Per-key results over tables in which a few keys hold most rows.

Method: distributed exact selection. A key's rows are never brought together. Per hot key and wanted rank an interval
of values is kept; each round counts the rows inside it in a histogram of ``bins`` bins (mergeable counts, with each
bin's smallest and largest value), picks the bin that holds the rank and shrinks the interval to that bin's extremes,
until an interval is a single value. Keys of up to ``hot_rows`` rows take the same selection in one step: their
(value, count) histograms are complete, so a running sum over them resolves the ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import written

PROBS = (0.25, 0.5, 0.75)
HOT_ROWS = 10_000  # rows of one key that one task may take
SMALL = 100_000  # ranks that are broadcast; more are joined


def key_counts(df: DataFrame, key: str, empty_is_null: bool = True) -> DataFrame:
    """(key, n_rows, share): rows per key and their share of all rows that have a key.

    One pre-aggregated shuffle; null keys (and '' for strings) are no keys. An empty table gives no rows.
    """
    k = F.col(key)
    if empty_is_null and dict(df.dtypes)[key] == "string":
        df = df.where(k.isNotNull() & (k != ""))
    else:
        df = df.where(k.isNotNull())
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    total = n.agg(F.sum("n_rows").alias("_tm_total"))
    return n.crossJoin(F.broadcast(total)).select(key, "n_rows", (F.col("n_rows") / F.col("_tm_total")).alias("share"))


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """A bin number that never falls as ``v`` rises and differs for the interval's two ends.

    Intervals that span a sign change are cut by sign; wide ones of one sign by magnitude; narrow ones evenly. Each
    cut reduces the interval's size by a factor of ``bins``, so a double needs at most about ten rounds.
    """
    magnitude = lambda a, b: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.try_divide(F.ln(a) - F.ln(b[0]), F.ln(b[1]) - F.ln(b[0])) * bins).cast("int")))
    even = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.try_divide(v - lo, hi - lo) * bins).cast("int")))
    inner = (
        F.when((lo < 0) & (hi >= 0) | (lo == 0), F.signum(v).cast("int"))
        .when((lo > 0) & (hi > 4 * lo), magnitude(v, (lo, hi)))
        .when((hi < 0) & (lo < 4 * hi), -magnitude(-v, (-hi, -lo)))
        .otherwise(even)
    )
    # the ends always get bins of their own side, whatever rounding does
    inside = F.when(v <= lo, -bins - 1).when(v >= hi, bins + 1).otherwise(inner)
    return F.when(v == float("-inf"), -2 * bins).when(v == float("inf"), 2 * bins).otherwise(inside)


def _shrink(rows: DataFrame, state: DataFrame, bins: int, small: bool) -> DataFrame:
    """One round: the state (_k, prob, rank, lo, hi, first) with each interval cut to the bin that holds its rank."""
    hint = F.broadcast if small else (lambda t: t)
    spans = state.select("_k", "lo", "hi", "first").distinct()  # one histogram for all ranks within an interval
    at = rows.join(hint(spans), "_k").where(F.col("first") | F.col("_v").between(F.col("lo"), F.col("hi")))
    h = at.withColumn("b", _bin(F.col("_v"), F.col("lo"), F.col("hi"), bins)).groupBy("_k", "lo", "hi", "b").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    w = Window.partitionBy("_k", "lo", "hi").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("upto", F.sum("n").over(w))
    t = h.join(hint(state), ["_k", "lo", "hi"]).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    return t.select("_k", "prob", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"), F.lit(False).alias("first"))


def exact_quantiles(
    df: DataFrame, key: str, value: str, probs: tuple[float, ...] = PROBS, hot_rows: int = HOT_ROWS, bins: int = 1024, counts: DataFrame | None = None
) -> DataFrame:
    """(key, prob, quantile DOUBLE): the smallest value with at least ``prob`` of the key's values at or below it.

    Nulls and NaN are no values; keys without values give no rows; infinities are values. Ties and repeated rows count
    as often as they stand. Keys of more than ``hot_rows`` rows are hot: their intervals are a table of hot keys times probs,
    broadcast up to SMALL rows and joined beyond; no other key brings more than ``hot_rows`` rows into one task.
    """
    if hot_rows < 0:
        raise ValueError("hot_rows must not be below 0")
    counts = key_counts(df, key) if counts is None else counts
    v = F.col(value).cast("double")
    rows = df.select(F.col(key).alias("_k"), v.alias("_v")).where(F.col("_k").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v"))
    if dict(rows.dtypes)["_k"] == "string":
        rows = rows.where(F.col("_k") != "")
    hot = written(counts.where(F.col("n_rows") > hot_rows).select(F.col(key).alias("_k")), "hot-keys")
    n_hot = hot.count()
    small = n_hot * len(probs) <= SMALL
    hint = F.broadcast if small else (lambda t: t)
    p = F.explode(F.array(*[F.lit(float(x)) for x in probs])).alias("prob")

    cold = rows.join(hint(hot), "_k", "left_anti").groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_k").orderBy("_v")
    cold = cold.select("_k", "_v", "_n", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.sum("_n").over(Window.partitionBy("_k")).alias("_all"))
    cold = cold.select("*", p).withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("_all"))))
    cold = cold.where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
    cold = cold.select(F.col("_k").alias(key), "prob", F.col("_v").alias("quantile"))
    if not n_hot:
        return cold

    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    hot_values = rows.join(hint(hot), "_k")
    # an interval of infinities only: any finite bounds tell them apart
    ends = hot_values.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(finite), F.lit(0.0)).alias("lo"), F.coalesce(F.max(finite), F.lit(0.0)).alias("hi"))
    state = ends.select("_k", p, "n", "lo", "hi").select("_k", "prob", F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("n"))).alias("rank"), "lo", "hi", F.lit(True).alias("first"))
    state = written(state, "quantile-ranks")
    out = cold
    while True:
        state = written(_shrink(hot_values, state, bins, small), "quantile-ranks")
        out = out.unionByName(state.where(F.col("lo") == F.col("hi")).select(F.col("_k").alias(key), "prob", F.col("lo").alias("quantile")))
        state = state.where(F.col("lo") != F.col("hi"))
        if not state.take(1):
            return out


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """(key): the keys that hold at least ``share`` of the rows that have a key; null keys (and '' for strings) are none.

    By exact selection: in the order of the keys' codes, a key with such a share stands at one of the ranks a multiple
    of the share apart. Ranks at half that distance are resolved by histograms of all rows, and the few keys found there are
    counted. No table of all keys is made. An empty table gives no rows.
    """
    k = F.col(key)
    has = k.isNotNull() & (k != "") if dict(df.dtypes)[key] == "string" else k.isNotNull()
    rows = df.where(has).select(key).withColumn("_tm_code", F.xxhash64(key).bitwiseAND(F.lit((1 << 52) - 1)).cast("double"))
    everything = rows.select(F.lit(0).alias("_tm_all"), "_tm_code")
    steps = int(2 / share + 1e-9)
    ranks = exact_quantiles(everything, "_tm_all", "_tm_code", tuple(min(1.0, j * share / 2) for j in range(1, steps + 1)), hot_rows=0)
    at = ranks.select(F.col("quantile").alias("_tm_code")).distinct()  # at most 2 / share codes
    n = rows.join(F.broadcast(at), "_tm_code").groupBy(key).agg(F.count(F.lit(1)).alias("_tm_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_tm_total"))
    return n.crossJoin(F.broadcast(total)).where(F.col("_tm_n") >= F.lit(share) * F.col("_tm_total")).select(key)


def key_profile(df: DataFrame, key: str, value: str, probs: tuple[float, ...] = PROBS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, n_rows, share, prob, quantile): counts, share and exact quantiles of ``value`` for every key.

    Keys whose values are all null stay, with null ``prob`` and ``quantile``.
    """
    counts = written(key_counts(df, key), "key-counts")
    return counts.join(exact_quantiles(df, key, value, probs, hot_rows, counts=counts), key, "left")
