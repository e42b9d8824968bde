"""Exact and near duplicates of texts."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.cleaning import char_ngrams, first_text, text_key
from tidemill.session import forget, written

PASS_SIGNATURES, MAX_PASSES = 1 << 22, 8  # signatures are joined in passes of about so many: only one pass's shuffle is on disk at a time
BUCKETS_FROM = 0.8  # least threshold at which texts meet by buckets
PART_CHARS = 1 << 19  # characters of a batch whose n-grams are in memory at once


def exact_duplicates(df: DataFrame, order: str = "ingest_seq", texts: tuple[str, ...] = ("clean_text", "text", "raw_text")) -> DataFrame:
    """Adds ``is_duplicate``: whether an earlier row has the same text but for case and outer white space.

    Blank texts are never duplicates. The first row per key is found by a pre-aggregated minimum, so that a text that
    a third of all rows share is not brought together. ``order`` is unique.
    """
    t = df.withColumn("_tm_key", F.sha2(text_key(first_text(*texts)), 256)).withColumn("_tm_blank", text_key(first_text(*texts)) == "")
    first = t.where(~F.col("_tm_blank")).groupBy("_tm_key").agg(F.min(order).alias("_tm_first"), F.count(F.lit(1)).alias("_tm_n"))
    later = first.where(F.col("_tm_n") > 1).drop("_tm_n")
    t = t.join(later, "_tm_key", "left")
    return t.withColumn("is_duplicate", ~F.col("_tm_blank") & F.coalesce(F.col(order) > F.col("_tm_first"), F.lit(False))).drop("_tm_key", "_tm_blank", "_tm_first")


def exact_deduplicate(df: DataFrame, **kw: object) -> DataFrame:
    return exact_duplicates(df, **kw).where(~F.col("is_duplicate")).drop("is_duplicate")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct runs of n characters of each text, by rows; up to three characters have hashes of their own."""
    texts = [t.ljust(n, "\0") for t in texts]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    key, by = np.zeros(len(codes) - n + 1, np.uint64), np.uint64(1 << 21 if n <= 3 else 0x9E3779B97F4A7C15)
    for j in range(n):
        key = key * by + codes[j : len(codes) - n + 1 + j]
    row = np.repeat(np.arange(len(texts)), lens)
    inside = row[: len(key)] == row[n - 1 :]
    h, row = _mix(key[inside]), row[: len(key)][inside]
    ends = np.cumsum(lens - n + 1)
    for start, end in zip(ends - (lens - n + 1), ends, strict=True):
        h[start:end].sort()
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], row[first]


def _size_classes(threshold: float, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """(least size, buckets) per class: sets that similar are of one class or of two next to each other.

    If the smaller one is of the class, they differ in fewer n-grams than there are buckets.
    """
    low = [1]
    while low[-1] <= largest:
        low.append(math.floor(low[-1] / threshold + 1e-9) + 1)
    top = np.array(low[1:], np.int64) - 1
    return np.array(low, np.int64), np.floor(top * ((1 - threshold) / threshold) + 1e-9).astype(np.int64) + 1


def _bucket_hashes(h: np.ndarray, row: np.ndarray, classes: np.ndarray, buckets: np.ndarray) -> list[np.ndarray]:
    """Per row a hash of what each bucket of the class holds, an empty one too."""
    ends = np.cumsum(buckets)
    cell = (h >> np.uint64(20)) & np.uint64(0xFFFFFFFF)
    cell = (cell % buckets.astype(np.uint64)[row]).astype(np.int64) + (ends - buckets)[row]
    held = np.zeros(ends[-1], np.uint64)
    np.add.at(held, cell, h)
    bucket = np.arange(ends[-1]) - np.repeat(ends - buckets, buckets)
    name = _mix(((np.repeat(classes, buckets) + 1).astype(np.uint64) << np.uint64(40)) + bucket.astype(np.uint64))
    return np.split(_mix(held + name).view(np.int64), ends[:-1])


def _signed(texts: list[str], threshold: float, n: int) -> pd.DataFrame:
    h, row = _grams(texts, n)
    size = np.bincount(row, minlength=len(texts))
    low, buckets = _size_classes(threshold, int(size.max()))
    own = np.searchsorted(low, size, "right") - 1
    bit, starts = h >> np.uint64(57), np.cumsum(size) - size
    half = lambda i: np.where(bit >> np.uint64(6) == i, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
    parity = [np.bitwise_xor.reduceat(half(i), starts).view(np.int64) for i in (0, 1)]
    mine = _bucket_hashes(h, row, own, buckets[own])
    below = _bucket_hashes(h, row, own - 1, buckets[np.maximum(own - 1, 0)])
    return pd.DataFrame({"n": size.astype(np.int32), "p0": parity[0], "p1": parity[1], "n_own": buckets[own].astype(np.int32), "sigs": [np.concatenate(x) for x in zip(mine, below, strict=True)]})


def _signatures(k: Column, threshold: float, n: int) -> Column:
    """struct<n, p0, p1, n_own, sigs>: size of the set of n-grams, 128 parities of it, and the signatures by its own class, then by the one below."""

    def sign(ks: pd.Series) -> pd.DataFrame:
        texts = ks.tolist()
        part = np.cumsum(ks.str.len().to_numpy(np.int64)) // PART_CHARS if texts else np.array([], np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        parts = [_signed(texts[i:j], threshold, n) for i, j in zip(cuts, cuts[1:], strict=False) if j > i]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in ("n", "p0", "p1", "n_own", "sigs")})

    return F.pandas_udf(sign, "n int, p0 long, p1 long, n_own int, sigs array<long>").asNondeterministic()(k)


def _jaccard(a: Column, b: Column, n: int) -> Column:
    def grams(t: str) -> set[str]:
        return {t[i : i + n] for i in range(max(1, len(t) - n + 1))}

    def similar(ka: pd.Series, kb: pd.Series) -> pd.Series:
        sim = []
        for x, y in zip(ka, kb, strict=True):
            ga, gb = grams(x), grams(y)
            common = len(ga & gb)
            sim.append(common / (len(ga) + len(gb) - common))
        return pd.Series(sim, dtype="float64")

    return F.pandas_udf(similar, "double").asNondeterministic()(a, b)


def _by_buckets(t: DataFrame, threshold: float) -> list[DataFrame]:
    """Written tables (a, b) of the pairs that meet by the content of a bucket, less what sizes and parities rule out."""
    total = t.agg(F.sum("s.n")).first()[0] or 0
    n_passes = min(MAX_PASSES, 1 + int(2 * total * (1 - threshold) / threshold) // PASS_SIGNATURES)
    one = t.select("id", "s.n", "s.p0", "s.p1", "s.n_own", F.posexplode("s.sigs").alias("at", "sig"))
    one = one.select("id", "n", "p0", "p1", (F.col("at") < F.col("n_own")).alias("own"), "sig")
    near = (F.col("na") * threshold <= F.col("nb") + 1e-9) & (F.col("nb") * threshold <= F.col("na") + 1e-9)
    apart = F.bit_count(F.col("p0a").bitwiseXOR(F.col("p0b"))) + F.bit_count(F.col("p1a").bitwiseXOR(F.col("p1b")))
    near &= (F.col("a") < F.col("b")) & (F.col("owna") | F.col("ownb")) & (apart <= (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-6)

    def candidates(i: int) -> DataFrame:
        rows = one.where(F.pmod("sig", F.lit(n_passes)) == i)
        side = lambda c: rows.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}{c}") for x in ("n", "p0", "p1", "own")], "sig")
        return side("a").join(side("b"), "sig").where(near).select("a", "b").distinct()

    return [written(candidates(i), "similar-candidates") for i in range(n_passes)]


def _by_rare_grams(t: DataFrame, threshold: float) -> list[DataFrame]:
    """A written table (a, b) of the pairs that share enough of their rarest n-grams."""
    grams = t.select("id", F.explode("g").alias("gram")).select("id", F.xxhash64("gram").alias("h"))
    freq = grams.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ranked = grams.join(freq, "h").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s")).withColumn("size", F.size("s"))
    k = F.least(F.lit(8), F.floor(F.col("size") * 0.03).cast("int") + 1)
    keep = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + k
    prefix = written(ranked.select("id", "size", k.alias("k"), F.explode(F.slice("s", F.lit(1), F.least(keep, F.col("size")))).alias("x")).select("id", "size", "k", F.col("x.h").alias("h")), "ngram-prefixes")
    side = lambda c: prefix.select(F.col("id").alias(c), F.col("size").alias(f"n{c}"), F.col("k").alias(f"k{c}"), "h")
    near = (F.col("a") < F.col("b")) & (F.col("na") * threshold <= F.col("nb") + 1e-9) & (F.col("nb") * threshold <= F.col("na") + 1e-9)
    shared = side("a").join(side("b"), "h").where(near).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.least(F.first("ka"), F.first("kb")).alias("k"))
    cand = written(shared.where(F.col("n") >= F.col("k")).select("a", "b"), "similar-candidates")
    forget(prefix)
    return [cand]


def similar_pairs(df: DataFrame, threshold: float, order: str = "ingest_seq", text: str = "clean_text", n: int = 3) -> DataFrame:
    """(a, b, similarity): all pairs of distinct texts, a before b, with a Jaccard similarity of n-grams of at least ``threshold``.

    Partition filter: sets that similar differ in at most (1 - t) / (1 + t) of their summed sizes. So if the n-grams are
    spread by hash over more buckets than that, one bucket at least holds the same in both: texts meet by the hash of a
    bucket's content, not by n-grams, which all texts share. Buckets are numbered by size class; each text also stands in the
    class below, where a smaller partner may be. In the join, sizes and parities rule pairs out: one n-gram in one set only
    changes one of 128 parities.

    Under ``BUCKETS_FROM``, where a bucket would hold few n-grams or none, prefix filter: two sets that similar share at
    least k of each other's rarest |x| - ceil(t |x|) + k n-grams, for any k, and their sizes differ by a factor of at most
    t. k grows with the set, so that stock n-grams alone make no candidates; of two sets the smaller k counts.

    Candidates are verified on the whole sets. Exact copies should be removed first; a and b are values of ``order``.
    """
    keyed = df.select(F.col(order).alias("id"), text_key(F.col(text)).alias("k")).where(F.col("k") != "")
    buckets = BUCKETS_FROM <= threshold <= 1
    t = written(keyed.select("id", "k", _signatures(F.col("k"), threshold, n).alias("s") if buckets else char_ngrams(F.col("k"), n).alias("g")), "similar-texts")
    parts = _by_buckets(t, threshold) if buckets else _by_rare_grams(t, threshold)
    cand = reduce(DataFrame.union, parts).distinct() if len(parts) > 1 else parts[0]
    full = cand.join(t.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(t.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    pairs = full.select("a", "b", _jaccard(F.col("ka"), F.col("kb"), n).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    pairs = written(pairs, "similar-pairs")
    forget(t, *parts)
    return pairs


def greedy_keep(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, kept): what a pass in order keeps that drops every node similar to an earlier kept one.

    Each round keeps the nodes without an undecided earlier neighbour and drops the later neighbours of kept ones; both
    are final, so the result is that of the sequential pass.
    """
    open_pairs = written(pairs.select("a", "b").distinct(), "greedy-pairs")
    decided = None
    while open_pairs.take(1):
        ends = open_pairs.select(F.col("a").alias("id")).union(open_pairs.select("b")).distinct()
        keep = ends.join(open_pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        drop = open_pairs.join(keep.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct()
        step = written(keep.withColumn("kept", F.lit(True)).unionByName(drop.withColumn("kept", F.lit(False))), "greedy-step")
        decided = step if decided is None else decided.unionByName(step)
        gone = step.select("id")
        open_pairs = written(open_pairs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"), "greedy-pairs")
    if decided is None:
        return nodes.select("id", F.lit(True).alias("kept"))
    return nodes.join(decided, "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))


def near_duplicates(df: DataFrame, threshold: float = 0.9, order: str = "ingest_seq", text: str = "clean_text", n: int = 3) -> DataFrame:
    """Adds ``is_duplicate``: whether a pass in ``order`` would drop the row as similar to an earlier kept one.

    Blank texts are kept, and at a threshold of 1 or more nothing is dropped. Rows with the very text of an earlier row
    share its fate but are duplicates of it, so only distinct texts are joined.
    """
    if threshold >= 1.0:
        return df.withColumn("is_duplicate", F.lit(False))
    t = df.withColumn("_tm_key", F.sha2(text_key(F.col(text)), 256))
    first = written(t.where(text_key(F.col(text)) != "").groupBy("_tm_key").agg(F.min(order).alias("id")), "distinct-texts")
    reps = df.join(first.select(F.col("id").alias(order)), order)
    kept = greedy_keep(first.select("id"), similar_pairs(reps, threshold, order, text, n))
    fate = first.join(kept, "id")
    t = t.join(fate, "_tm_key", "left")
    return t.withColumn("is_duplicate", F.col("id").isNotNull() & (~F.coalesce("kept", F.lit(True)) | (F.col(order) > F.col("id")))).drop("_tm_key", "id", "kept")


def deduplicate(df: DataFrame, near: bool = False, threshold: float = 0.9, **kw: object) -> DataFrame:
    """Exact duplicates removed, then near ones if asked for."""
    t = exact_deduplicate(df, **kw)
    return near_duplicates(t, threshold).where(~F.col("is_duplicate")).drop("is_duplicate") if near else t


