"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import forget, written


def _any(df: DataFrame) -> bool:
    return bool(df.take(1))


def _jump(parents: DataFrame) -> DataFrame:
    """Shortcuts parent chains until each node points at its root; ``parents`` is a written table and goes with the rounds."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("over"))
        nxt = written(parents.join(up, "parent", "left").select("node", F.coalesce("over", "parent").alias("parent"), (F.col("over").isNotNull() & (F.col("over") != F.col("parent"))).alias("moved")), "group-jump")
        moved = _any(nxt.where("moved"))
        forget(parents)
        parents = nxt.select("node", "parent")
        if not moved:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every end of an edge (a, b STRING) the smallest node of its component.

    Parallel hooking and shortcutting: each round hooks every root to its smallest neighbour, shortcuts the resulting
    chains by pointer jumping, and contracts the edges to the new roots. Null or empty ends name nothing, so such an
    edge adds at most its other end. Repeated edges and loops are fine. An empty table gives no rows. Rounds grow with
    the logarithm of the number of nodes.
    """
    blank = lambda c: F.when(F.col(c) == "", None).otherwise(F.col(c)).alias(c)
    e = written(edges.select(blank("a"), blank("b")).distinct(), "group-edges")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    result = nodes.withColumn("root", F.col("node"))
    links = e.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links = written(links, "group-links")
    while _any(links):
        hook = links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent"))  # only roots that have a smaller neighbour
        top = _jump(written(hook, "group-hook"))
        up = lambda c: top.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_to"))  # noqa: E731, B023
        moved = links.join(up("hi"), "hi", "left").join(up("lo"), "lo", "left").select(F.coalesce("hi_to", "hi").alias("x"), F.coalesce("lo_to", "lo").alias("y"))
        before = links, result, top
        links = written(moved.where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "group-links")
        result = written(result.join(up("root"), "root", "left").select("node", F.coalesce("root_to", "root").alias("root")), "group-roots")
        forget(*before)  # each round's tables go when the next ones stand
    return result
