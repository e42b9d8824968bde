"""Small files and listings on whatever file system Spark knows: local, HDFS or an object store."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def _open(path: str):  # noqa: ANN202
    """(file system, path) of the active session's Hadoop configuration; None without a session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        if "://" in path:
            raise ValueError(f"{path} needs an active Spark session")
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _plain(uri: str) -> str:
    return uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def exists(path: str) -> bool:
    at = _open(path)
    return Path(path).exists() if at is None else at[0].exists(at[1])


def list_files(root: str) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of all files under a folder, or of the file itself; sorted, none if there is no such path."""
    at = _open(root)
    if at is None:
        p = Path(root)
        found = [p] if p.is_file() else [f for f in p.rglob("*") if f.is_file()]
        return sorted((str(f), f.stat().st_size, int(f.stat().st_mtime * 1000)) for f in found)
    fs, p = at
    if not fs.exists(p):
        return []
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        out.append((_plain(f.getPath().toString()), f.getLen(), f.getModificationTime()))
    return sorted(out)


def read_text(path: str) -> str | None:
    """The whole of a small file; None if there is none."""
    at = _open(path)
    if at is None:
        return Path(path).read_text(encoding="utf-8") if Path(path).is_file() else None
    fs, p = at
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(text: str, path: str) -> None:
    """Replaces a small file; its folders are made if they are not there."""
    at = _open(path)
    if at is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
        return
    fs, p = at
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
