"""Duplicates hidden by white space, letter case, punctuation or the order of fields.

Method: recursive radix partitioning on canonical bytes. Records are written as canonical bytes, copies within a task
are counted at once, and buckets are cut by leading bytes: a bucket with more entries than fit is cut by further bytes,
again and again. Each bucket is then read by one task into a burst trie whose terminal nodes count.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import bounded_broadcast, partitions, written

STEP = 6  # further bytes by which an oversized bucket is cut
FIT = 16 << 20  # bytes of entries that fit one bucket
MAX_RULES = 100_000  # oversized buckets of a round that are broadcast
BURST = 64  # entries of a leaf before it becomes an inner node
CHUNK = 8  # bytes by which a trie branches
TEXT_NAMES, PRODUCT_NAMES = ("text", "reviewText", "review_body"), ("asin", "product_id")


def canonical_text(c: Column) -> Column:
    """Letters, marks and digits in order; case is folded in Python, where letters that fold to several do so."""
    return F.regexp_replace(c, r"[^\p{L}\p{M}\p{Nd}]+", "")


def canonical_product(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def payload_records(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(ingest_seq, product_id, text) of the payloads that are valid JSON objects, whatever their field names and order.

    Where several names of a field have values, the first of PRODUCT_NAMES and TEXT_NAMES counts.
    """
    v = F.try_parse_json(F.col(payload))
    get = lambda names: F.coalesce(*[F.try_variant_get("_v", f"$.{n}", "string") for n in names])
    t = raw.select("ingest_seq", v.alias("_v")).where(F.col("_v").isNotNull())
    return t.select("ingest_seq", get(PRODUCT_NAMES).alias("product_id"), get(TEXT_NAMES).alias("text"))


class Trie:
    """A burst trie: leaves are small tables from the rest of a key to its counter, and burst into nodes of 8-byte branches."""

    def __init__(self, depth: int = 0) -> None:
        self.depth, self.leaf, self.kids = depth, {}, None
        self.end: list[int] | None = None  # terminal counter of the key that ends here

    def add(self, key: bytes, n: int, first: int) -> None:
        node = self
        while node.kids is not None:
            if len(key) <= node.depth:
                node.end = [n, first] if node.end is None else [node.end[0] + n, min(node.end[1], first)]
                return
            part = key[node.depth : node.depth + CHUNK]
            nxt = node.kids.get(part)
            if nxt is None:
                nxt = node.kids[part] = Trie(node.depth + CHUNK)
            node = nxt
        rest = key[node.depth :]
        c = node.leaf.get(rest)
        if c is not None:
            c[0] += n
            if first < c[1]:
                c[1] = first
            return
        node.leaf[rest] = [n, first]
        if len(node.leaf) > BURST:
            node.burst()

    def burst(self) -> None:
        self.kids, leaf, self.leaf = {}, self.leaf, {}
        for rest, c in leaf.items():
            if not rest:
                self.end = c
                continue
            kid = self.kids.get(rest[:CHUNK])
            if kid is None:
                kid = self.kids[rest[:CHUNK]] = Trie(self.depth + CHUNK)
            kid.leaf[rest[CHUNK:]] = c
        for kid in self.kids.values():
            if len(kid.leaf) > BURST:
                kid.burst()

    def items(self, prefix: bytes = b"") -> Iterator[tuple[bytes, list[int]]]:
        stack = [(prefix, self)]
        while stack:
            p, node = stack.pop()
            for rest, c in node.leaf.items():
                yield p + rest, c
            if node.end is not None:
                yield p, node.end
            if node.kids:
                stack += [(p + part, kid) for part, kid in node.kids.items()]


KEYED = pa.schema([("canon", pa.binary()), ("n", pa.int64()), ("first_seq", pa.int64())])
LOCAL_ENTRIES, LOCAL_BYTES = 100_000, 64 << 20  # what a task's own trie takes before it is passed on


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds case to canonical bytes and counts copies within a task, before anything is sent."""
    trie, size, held = Trie(), 0, 0

    def flush() -> pa.RecordBatch:
        keys, ns, firsts = [], [], []
        for k, c in trie.items():
            keys.append(k), ns.append(c[0]), firsts.append(c[1])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(firsts, pa.int64())], schema=KEYED)

    for b in batches:
        for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            key = k.casefold().encode()
            trie.add(key, 1, s)
            size += 1
            held += len(key)
            if size >= LOCAL_ENTRIES or held >= LOCAL_BYTES:
                yield flush()
                trie, size, held = Trie(), 0, 0
    if size:
        yield flush()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One trie per bucket; a task's rows come sorted by bucket."""
    bucket, trie = None, Trie()
    keys, ns, firsts = [], [], []

    def take() -> None:
        for k, c in trie.items():
            keys.append(k), ns.append(c[0]), firsts.append(c[1])

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(firsts, pa.int64())], schema=KEYED)
        keys.clear(), ns.clear(), firsts.clear()
        return batch

    for b in batches:
        for p, k, n, s in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if p != bucket:
                take()
                bucket, trie = p, Trie()
                if len(keys) > 10_000:
                    yield out()
            trie.add(k, n, s)
    take()
    if keys:
        yield out()


def radix_buckets(entries: DataFrame, fit: int = FIT) -> DataFrame:
    """Adds ``bucket`` BINARY: a run of leading bytes whose entries together have at most ``fit`` bytes.

    A bucket with more is cut by as many further bytes as all its entries share, which its smallest and largest tell, and
    STEP more; so a round tells entries apart however long their common beginning is. A bucket of entries that are all
    the same cannot be cut and stays; entries were combined before, so there is one such entry per earlier task. Oversized
    buckets are a table, broadcast up to MAX_RULES rows.
    """
    n, h = F.octet_length("canon"), F.xxhash64("canon")  # numbers, so that sizes are hash-aggregated
    t = entries.withColumns({"bucket": F.substring("canon", 1, STEP), "open": F.lit(True)})

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            upto = [len(os.path.commonprefix([bytes(a), bytes(b)])) + STEP for a, b in zip(pdf.least, pdf.most, strict=True)]
            yield pd.DataFrame({"over": pdf.over, "upto": upto})

    while True:
        sizes = t.where("open").groupBy("bucket").agg(F.sum(n).alias("size"), F.max(n).alias("longest"), F.min(h).alias("lo"), F.max(h).alias("hi"))
        over = sizes.where((F.col("size") > fit) & (F.col("longest") > F.octet_length("bucket")) & (F.col("lo") != F.col("hi")))
        over = written(over.select(F.col("bucket").alias("over")), "copies-over")
        if not over.take(1):
            return t.drop("open")
        ends = t.where("open").join(bounded_broadcast(over, MAX_RULES), F.col("bucket") == F.col("over")).groupBy("over").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
        rules = written(ends.mapInPandas(shared, "over binary, upto int"), "copies-rules")
        t = t.join(bounded_broadcast(rules, MAX_RULES), F.col("open") & (F.col("bucket") == F.col("over")), "left")
        cut = F.col("upto").isNotNull()
        t = t.withColumns({"bucket": F.when(cut, F.expr("substring(canon, 1, upto)")).otherwise(F.col("bucket")), "open": cut}).drop("over", "upto")


def count_copies(records: DataFrame, seq: str = "ingest_seq", product: str = "product_id", text: str = "text", fit: int = FIT) -> DataFrame:
    """(canon, n_copies, first_seq): each distinct record as canonical bytes, its number of copies and smallest ``seq``.

    Two records are copies if their products are equal but for case and outer white space and their texts have the
    same letters, marks and digits in order, case ignored. Records without a product, or without any letter or digit
    in the text, do not count. Every record counts, repeated rows too. A task holds the entries of one bucket at a time,
    at most ``fit`` bytes of them.
    """
    spark = records.sparkSession
    t = records.select(F.col(seq).alias("s"), canonical_product(F.col(product)).alias("p"), canonical_text(F.col(text)).alias("t")).where((F.length("p") > 0) & (F.length("t") > 0))
    # the text leads: its first bytes tell records apart sooner than a product that many share
    t = t.select(F.concat("t", F.lit("\u0000"), "p").alias("canon"), F.col("s").cast("bigint"))
    entries = written(t.mapInArrow(_combine, "canon binary, n bigint, first_seq bigint"), "copies")
    b = radix_buckets(entries, fit).select("bucket", "canon", "n", "first_seq")
    b = b.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return b.mapInArrow(_count, "canon binary, n bigint, first_seq bigint").withColumnRenamed("n", "n_copies")
