"""Cutting texts at patterns inside an expression, with the offset of every piece."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_starts(pieces: Column) -> Column:
    """array<struct<piece, start>> of an array of strings that follow each other in a text."""
    none = F.expr("CAST(array() AS array<struct<piece: string, start: int>>)")
    return F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.array_append(acc["out"], F.struct(p.alias("piece"), acc["at"].alias("start"))).alias("out")),
        lambda acc: acc["out"],
    )
