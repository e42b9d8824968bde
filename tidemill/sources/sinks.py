"""Writers: result tables, metrics, markers of finished stages, errors and records as JSON."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemill.sources import files


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, replacing what was there."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines, nulls kept as fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_errors(spark: SparkSession, errors: list[tuple[str, str]], path: str) -> None:
    if errors:
        spark.createDataFrame(errors, "item string, error string").write.mode("append").json(path)


def write_json(value: dict[str, Any], path: str) -> None:
    """A small document on the file system of ``path``; the folder is made if it is not there."""
    files.write_text(json.dumps(value, indent=2, sort_keys=True, default=str), path)


def read_json(path: str) -> dict[str, Any] | None:
    """None if there is no such file or it is no JSON."""
    try:
        text = files.read_text(path)
        return None if text is None else json.loads(text)
    except (OSError, ValueError):
        return None


def mark_done(folder: str, stage: str, config_hash: str, **figures: Any) -> None:
    write_json({"stage": stage, "config_hash": config_hash, "finished_at": time.time(), **figures}, f"{folder}/DONE.json")


def is_done(folder: str, config_hash: str) -> bool:
    """Whether a marker of the same configuration stands in the folder."""
    m = read_json(f"{folder}/DONE.json")
    return m is not None and m.get("config_hash") == config_hash


def write_aliases(aliases: dict[str, str], path: str) -> None:
    files.write_text("".join(f'"{k}": "{v}"\n' for k, v in sorted(aliases.items())), path)
