"""Casts of raw fields that never fail: what cannot be read becomes the field's default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F


def safe_string(c: Column, kind: T.DataType) -> Column:
    """The value as text, '' for null; of an array, however nested, its first leaf."""
    while isinstance(kind, T.ArrayType):
        c, kind = F.get(c, F.lit(0)), kind.elementType
    return F.coalesce(c.cast("string"), F.lit(""))


def safe_double(c: Column, kind: T.DataType, default: float = -1.0) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(default)
    return F.coalesce(c.try_cast("double"), F.lit(default))


def safe_long(c: Column, kind: T.DataType, default: int = 0) -> Column:
    """Numbers are cut towards 0; NaN, infinities and what lies outside BIGINT become the default."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(default).cast("bigint")
    d = c.try_cast("double")
    return F.coalesce(F.when(~F.isnan(d), d.try_cast("bigint")), F.lit(default).cast("bigint"))


def safe_bool(c: Column, kind: T.DataType) -> Column:
    """Booleans as they are; the strings true, yes, 1 and y in any case; numbers other than 0; all else is false."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(F.lower(c).isin("true", "yes", "1", "y"), F.lit(False))
    if isinstance(kind, T.NumericType):
        d = c.cast("double")
        return F.coalesce((d != 0) & ~F.isnan(d), F.lit(False))
    return F.lit(False)


def project_to(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """The columns of ``schema`` in its order and types: unknown columns are left out, missing ones and nulls take their default."""
    defaults = defaults or {}
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        d = defaults.get(f.name)
        out.append((c if d is None else F.coalesce(c, F.lit(d).cast(f.dataType))).alias(f.name))
    return df.select(*out)
