"""Splits that keep related records together.

Method: components by parallel hooking and shortcutting over parent arrays held in joined tables: each round hooks every
root to its smallest neighbour, shortcuts the resulting chains by pointer jumping, and contracts the links to the new
roots. Sizes of the components then enter subset-sum bitsets by size and multiplicity, which give the split totals
closest to the wanted ones.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.graph import components
from tidemill.operators.ranks import order_code, spread_rank
from tidemill.session import written

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def product_groups(df: DataFrame, item: str = "product_id", parent: str = "parent_product_id") -> DataFrame:
    """(item, group_key): group_key is the smallest ``item`` among all linked directly or through others.

    Ids that stand only in the parent column link items but are no items.
    """
    c = components(df.select(F.col(item).alias("a"), F.col(parent).alias("b")))
    items = df.where(F.length(item) > 0).select(F.col(item).alias("node")).distinct().join(c, "node")
    keys = items.groupBy("root").agg(F.min("node").alias("group_key"))
    return items.join(keys, "root").select(F.col("node").alias(item), "group_key")


def closest_subset(sizes: dict[int, int], target: float) -> dict[int, int]:
    """How many groups of each size to take so that their total is as close to ``target`` as can be.

    Bit t of a bitset says that t records (in units of the sizes' common divisor) can be reached; multiplicities enter as
    1, 2, 4, ... copies. Ties go to the smaller total. Exact at any size: a bitset is as wide as the target and what filling
    it up with the largest groups leaves open, and those before each step are kept for one in about the root of the steps,
    the others made again.
    """
    sizes = {s: m for s, m in sizes.items() if m > 0}
    unit = math.gcd(*sizes) or 1
    items, left = [], target
    for s in sorted(sizes, reverse=True):
        m, k = sizes[s], 1
        left -= s * min(m, int(left // s))
        while m > 0:
            items.append((s, min(k, m)))
            m -= min(k, m)
            k *= 2
    want = int(target // unit)
    most = min(int((target + left) // unit) + 1, sum(s * m for s, m in sizes.items()) // unit)  # no total beyond can be closer
    limit = (1 << (most + 1)) - 1
    goal = want if 2 * (target - want * unit) <= unit else want + 1  # nothing is closer: no more steps once it is reached

    def grow(reach: int, s: int, k: int) -> int:
        by = s // unit * k
        return reach | (reach << by) & limit if by <= most else reach

    block = max(1, math.isqrt(len(items)))
    reach, kept, steps = 1, [], 0
    while steps < len(items) and not (reach >> goal) & 1:
        if steps % block == 0:
            kept.append(reach)
        reach = grow(reach, *items[steps])
        steps += 1
    below = (reach & ((1 << (want + 1)) - 1)).bit_length() - 1
    above = reach >> (want + 1)
    best = below
    if above:
        up = want + (above & -above).bit_length()
        if abs(up * unit - target) < target - below * unit:
            best = up
    taken, at = {}, best
    for n in reversed(range(len(kept))):
        if (kept[n] >> at) & 1:
            continue
        part, before = items[n * block : min(steps, (n + 1) * block)], [kept[n]]
        for s, k in part[:-1]:
            before.append(grow(before[-1], s, k))
        for (s, k), was in zip(reversed(part), reversed(before), strict=True):
            if not (was >> at) & 1:
                taken[s] = taken.get(s, 0) + k
                at -= s // unit * k
    return taken


def grouped_split(df: DataFrame, shares: dict[str, float] | None = None, seed: str = "0", item: str = "product_id", parent: str = "parent_product_id") -> DataFrame:
    """(item, group_key, n_group, split) for every item; all items of a group have the same split.

    ``n_group`` is the number of rows of ``df`` of the group. Which groups of a size go where depends on the seed only.
    Rows without an item belong to no group. The driver holds one count for each distinct group size.
    """
    shares = shares or SHARES
    groups = written(product_groups(df, item, parent), "group-keys")
    rows = df.where(F.length(item) > 0).groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    size = written(groups.join(rows, item).groupBy("group_key").agg(F.sum("n").alias("n_group")), "group-sizes")
    left = {r[0]: r[1] for r in size.groupBy("n_group").count().collect()}  # distinct sizes: at most the root of twice the rows
    total = sum(s * m for s, m in left.items())
    names = sorted(shares, key=lambda k: shares[k])
    cuts, used = [], {}
    for name in names[:-1]:
        take = closest_subset(left, shares[name] * total)
        for s, n in take.items():
            cuts.append((s, used.get(s, 0) + 1, used.get(s, 0) + n, name))
            used[s] = used.get(s, 0) + n
            left[s] -= n
    spark = df.sparkSession
    plan = spark.createDataFrame(cuts, "size bigint, from_rank bigint, to_rank bigint, split string")
    ranked = spread_rank(size.withColumn("code", order_code("group_key", seed=seed)), ["n_group"], "code", ["group_key"], "rank")
    placed = ranked.join(F.broadcast(plan), (F.col("n_group") == F.col("size")) & F.col("rank").between(F.col("from_rank"), F.col("to_rank")), "left")
    placed = placed.select("group_key", "n_group", F.coalesce("split", F.lit(names[-1])).alias("split"))
    return groups.join(placed, "group_key")
