"""Readers of raw review exports: Parquet, CSV, JSON arrays and JSON lines, with whatever field names they use."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from tidemill.functions.casts import safe_bool, safe_double, safe_long, safe_string
from tidemill.functions.cleaning import stable_id
from tidemill.functions.lexicon import FIELD_NAMES
from tidemill.sources import files

SUFFIXES = (".parquet", ".json", ".jsonl", ".csv")
REVIEW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("review_id", "product_id", "parent_product_id", "category", "title", "text", "raw_text", "clean_text")]
    + [T.StructField("rating", T.DoubleType()), T.StructField("verified_purchase", T.BooleanType()), T.StructField("helpful_vote", T.LongType())]
    + [T.StructField("timestamp", T.StringType()), T.StructField("source", T.StringType())]
)


def discover_schema(columns: Iterable[str]) -> dict[str, str]:
    """Raw column -> field, by the exact name, or else by the name in lower case with blanks as underscores."""
    out = {}
    for c in columns:
        field = FIELD_NAMES.get(c) or FIELD_NAMES.get(c.strip().lower().replace(" ", "_"))
        if field:
            out[c] = field
    return out


def normalise(df: DataFrame, source: str = "", category: str | None = None, mapping: dict[str, str] | None = None, source_column: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows in the REVIEW schema. Unknown columns are left out; of several for one field the last with the field counts.

    ``source_column`` takes the place of ``source``; columns in ``keep`` stay beside the schema. Missing text is '', a missing rating -1, votes 0, verified false; the parent product defaults to the product.
    """
    mapping = discover_schema(df.columns) if mapping is None else mapping
    kinds = {f.name: f.dataType for f in df.schema.fields}
    have = {field: raw for raw, field in mapping.items() if raw in kinds}

    def col(field: str, cast) -> Column:  # noqa: ANN001
        if field not in have:
            return cast(F.lit(None).cast("string"), T.StringType())
        return cast(F.col(f"`{have[field]}`"), kinds[have[field]])

    text = lambda f: col(f, safe_string)
    product = text("product_id")
    t = df.select(
        product.alias("product_id"),
        F.coalesce(F.nullif(text("parent_product_id"), F.lit("")), product).alias("parent_product_id"),
        (F.lit(category) if category else text("category")).alias("category"),
        text("title").alias("title"),
        text("text").alias("text"),
        text("text").alias("raw_text"),
        F.lit("").alias("clean_text"),
        col("rating", safe_double).alias("rating"),
        col("verified_purchase", safe_bool).alias("verified_purchase"),
        col("helpful_vote", safe_long).alias("helpful_vote"),
        text("timestamp").alias("timestamp"),
        (F.lit(source) if source_column is None else source_column).alias("source"),
        *keep,
    )
    return t.select(stable_id(F.col("source"), F.col("product_id"), F.col("text"), F.col("timestamp")).alias("review_id"), "*").select(*REVIEW.names, *keep)


def discover_files(root: str) -> list[str]:
    """Files of the known formats under a folder of any file system, sorted by path; a single file may be given, its suffix in any case."""
    found = [f for f, _, _ in files.list_files(root)]
    if len(found) == 1 and found[0].rstrip("/").endswith(PurePosixPath(root).name):
        return [f for f in found if PurePosixPath(f).suffix.lower() in SUFFIXES]
    return [f for f in found if PurePosixPath(f).suffix in SUFFIXES]


def _first_sign(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return row[0][0].lstrip()[:1] if row else ""


def read_file(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files of one suffix. Of JSON lines, blank and malformed ones are left out; an array is read as a whole."""
    suffix = PurePosixPath(path if isinstance(path, str) else path[0]).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    if suffix == ".csv":
        return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    array = _first_sign(spark, path if isinstance(path, str) else path[0]) == "["
    df = spark.read.json(path, multiLine=array, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    if "_corrupt" in df.columns:
        if len(df.columns) == 1:
            return spark.createDataFrame([], T.StructType([]))
        df = spark.read.schema(T.StructType([f for f in df.schema.fields if f.name != "_corrupt"])).json(path, multiLine=array, mode="DROPMALFORMED")
    return df


def _probe(spark: SparkSession, path: str) -> tuple:
    """What files must have in common to be one scan: suffix and fields; of JSON also whether it is an array."""
    df = read_file(spark, path)
    if not df.columns:
        raise ValueError("no readable records")
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".parquet":
        df.limit(1).collect()  # a broken file shows when it is read
    return suffix, df.schema.json(), suffix.startswith(".json") and _first_sign(spark, path) == "["


def load_reviews(spark: SparkSession, root: str, max_reviews: int | None = None, category: str | None = None, source: str | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(rows in the REVIEW schema, errors): all files under ``root``; a file that cannot be read is an error, not a failure.

    Columns are discovered by file; files of one format and the same fields are one scan, whatever their number.
    ``max_reviews`` takes rows file by file in path order.
    """
    groups, errors = {}, []
    for path in discover_files(root):
        try:
            groups.setdefault(_probe(spark, path), []).append(path)
        except Exception as e:  # noqa: BLE001
            errors.append((path, f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"))
    parts = []
    for (suffix, schema, array), paths in groups.items():
        reader = spark.read.schema(T.StructType.fromJson(json.loads(schema)))
        if suffix == ".parquet":
            df = reader.parquet(*paths)
        elif suffix == ".csv":
            df = reader.csv(paths, header=True, multiLine=True, escape='"')
        else:
            df = reader.json(paths, multiLine=array, mode="DROPMALFORMED")
        own = df.columns
        df = df.select("*", F.col("_metadata.file_path").alias("_tm_file"), F.col("_metadata.file_block_start").alias("_tm_block"))
        mapping = discover_schema(own)
        rows = normalise(df, source or "", category, mapping, F.lit(source) if source else _stem(F.col("_tm_file")), ("_tm_file", "_tm_block"))
        parts.append(rows.withColumn("_tm_row", F.monotonically_increasing_id()))
    if not parts:
        return spark.createDataFrame([], REVIEW), errors
    t = reduce(DataFrame.unionByName, parts)
    if max_reviews is not None:
        t = t.orderBy("_tm_file", "_tm_block", "_tm_row").limit(max(0, max_reviews))
    return t.drop("_tm_file", "_tm_block", "_tm_row"), errors


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.regexp_replace(F.substring_index(path, "/", -1), r"\+", "%2B")), r"\.[^.]*$", "")


def load_by_category(spark: SparkSession, folders: dict[str, str], max_reviews: int | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Local exports of several categories, each forced on its rows; a category without rows is passed over."""
    parts, errors = [], []
    for i, (category, path) in enumerate(folders.items()):
        df, e = load_reviews(spark, path, max_reviews, category or "All_Beauty", f"hub/{category or 'All_Beauty'}")
        parts.append(df.withColumn("_tm_i", F.lit(i)))
        errors += e
    if not parts:
        return spark.createDataFrame([], REVIEW), errors
    t = reduce(DataFrame.unionByName, parts)
    t = t.orderBy("_tm_i").limit(max_reviews) if max_reviews is not None else t
    return t.drop("_tm_i"), errors


def chunked(df: DataFrame, size: int, order: str = "ingest_seq") -> DataFrame:
    """Adds chunk_id: consecutive runs of at most ``size`` rows by ``order``, counted without one sorted partition.

    Rows are sorted by ranges; each range's offset is the sum of those before it.
    """
    size = max(1, size)
    from tidemill.session import written

    t = written(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_tm_p", F.spark_partition_id()), "chunks")
    n = {r[0]: r[1] for r in t.groupBy("_tm_p").count().collect()}  # one row per partition
    at, offsets = 0, []
    for p in sorted(n):
        offsets.append((p, at))
        at += n[p]
    off = df.sparkSession.createDataFrame(offsets, "_tm_p int, _tm_off bigint")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("_tm_p").orderBy(order)) - 1
    t = t.join(F.broadcast(off), "_tm_p").withColumn("chunk_id", F.floor((F.col("_tm_off") + rank) / size))
    return t.drop("_tm_p", "_tm_off")


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array of records in a schema; no rows when there is no such file."""
    if not files.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def read_aliases(path: str) -> dict[str, str]:
    """String to string pairs of a flat YAML file ('key: value' lines); other lines are passed over, a missing file is empty."""
    out: dict[str, str] = {}
    for line in (files.read_text(path) or "").splitlines():
        line = line.split(" #")[0].rstrip()
        if line and not line[0].isspace() and not line.startswith("#") and ":" in line:
            k, v = (x.strip().strip("'\"") for x in line.split(":", 1))
            if k and v and not v.startswith(("[", "{")):
                out[k] = v
    return out
