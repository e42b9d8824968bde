import math
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators.hotkeys import exact_quantiles, heavy_keys, key_counts, key_profile
from tidemill.operators.ranks import order_code, spread_cumulate, spread_rank

PROBS = (0.0, 0.1, 0.5, 0.9, 1.0)


def brute(rows):
    out, by = {}, {}
    for k, v in rows:
        if k and v is not None and not math.isnan(v):
            by.setdefault(k, []).append(v)
    for k, vs in by.items():
        vs.sort()
        for p in PROBS:
            out[k, p] = vs[max(1, math.ceil(p * len(vs))) - 1]
    return out


def quantiles(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, v double")
    return {(r["k"], r["prob"]): r["quantile"] for r in exact_quantiles(df, "k", "v", PROBS, **kw).collect()}


@pytest.mark.parametrize("most", [0, 9, 250, 10**6])
def test_quantiles_equal_sorting(spark, most):
    r = random.Random(7)
    values = [0.0, -0.0, 1.5, -3.25, 1e-300, -1e-300, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), None, 5.0, 5.0]
    rows = [("hot", r.choice(values + [r.gauss(0, 1e3) for _ in range(20)])) for _ in range(2000)]
    rows += [(f"k{i % 40}", r.expovariate(1)) for i in range(400)] + [("inf", float("inf"))] * 300 + [("neg", -abs(r.gauss(0, 1)) - 1e-12) for _ in range(300)]
    rows += [(None, 1.0), ("", 2.0), ("empty", None)]
    assert quantiles(spark, rows, hot_rows=most) == brute(rows)


def test_few_bins_take_more_rounds_and_give_the_same(spark):
    r = random.Random(1)
    rows = [("hot", float(r.choice([1, 2, 3, 10**9, 10**-9]) + r.random())) for _ in range(500)]
    assert quantiles(spark, rows, bins=2, hot_rows=100) == brute(rows)


def test_empty_table_and_single_values(spark):
    assert quantiles(spark, []) == {}
    assert quantiles(spark, [("a", 1.0)]) == {("a", p): 1.0 for p in PROBS}


def test_counts_and_profile_with_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1, 9, 9.0), ("a", 2, 9, 9.0), ("b", None, 9, 9.0), (None, 4, 9, 9.0), ("", 5, 9, 9.0)], "product_id string, v int, n_rows int, share double")
    n = {r["product_id"]: (r["n_rows"], round(r["share"], 6)) for r in key_counts(df, "product_id").collect()}
    assert n == {"a": (2, 0.666667), "b": (1, 0.333333)}
    p = {(r["product_id"], r["prob"]): r["quantile"] for r in key_profile(df, "product_id", "v", (0.5,)).collect()}
    assert p == {("a", 0.5): 1.0, ("b", None): None}


@pytest.mark.parametrize("share", [0.01, 0.03, 0.1, 1 / 3, 1.0])
def test_heavy_keys_equal_counting(spark, share):
    r = random.Random(5)
    keys = ["a"] * 300 + ["b"] * 100 + [f"c{i % 9}" for i in range(270)] + [f"d{i}" for i in range(300)] + ["e"] * 30
    r.shuffle(keys)
    df = spark.createDataFrame([(k, 1) for k in keys] + [(None, 1), ("", 1)] * 50, "k string, _tm_n int").withColumnRenamed("_tm_n", "n_rows")
    assert {x[0] for x in heavy_keys(df, "k", share).collect()} == {k for k in set(keys) if keys.count(k) >= share * len(keys)}
    assert heavy_keys(df.limit(0), "k", share).count() == 0
    assert {x[0] for x in heavy_keys(spark.createDataFrame([(7, 1)] * 4, "k int, n int"), "k", share).collect()} == {7}


def test_spread_rank_is_row_number(spark):
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 5}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, id long").withColumn("code", order_code("id", seed="s"))
    got = spread_rank(df, ["key"], "code", ["id"], "rank", total="n").collect()
    by = {}
    for r in got:
        by.setdefault(r["key"], []).append((r["code"], r["id"], r["rank"], r["n"]))
    for v in by.values():
        assert [x[2] for x in sorted(v)] == list(range(1, len(v) + 1)) and {x[3] for x in v} == {len(v)}
    assert sum(map(len, by.values())) == 3000


def test_spread_cumulate_sums_values(spark):
    df = spark.range(1000).withColumn("code", order_code("id")).withColumn("v", F.col("id") % 7)
    got = sorted((r["code"], r["id"], r["v"], r["upto"]) for r in spread_cumulate(df, [], "code", ["id"], F.col("v"), "upto").collect())
    at = 0
    for _, _, v, upto in got:
        at += v
        assert upto == at
