"""Mixing sources to target shares of the tokens.

Method: a low-discrepancy schedule. Slot i of the mixture is the i-th point of the golden-ratio sequence mapped through
the cumulative weights, the tokens that each source gives, so every prefix of the schedule is close to the whole. A
source's shuffled documents, one shuffle per repeat, form a stream of tokens cut into blocks of equal size; its n-th slot
takes its n-th block.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.ranks import BITS, order_code, spread_cumulate, spread_rank
from tidemill.session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # the session setting spark.tidemill.tokenizer names another file
# Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 512
GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio's fraction times 2^64


@functools.cache
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds ``n_tokens`` BIGINT: tokens of the whole text, 0 for null. The vocabulary file must stand on every executor."""
    path = path or df.sparkSession.conf.get("spark.tidemill.tokenizer", TOKENIZER)

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(path)
        for s in parts:
            yield pd.Series([len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in s], dtype="int64")

    return df.withColumn("n_tokens", count.asNondeterministic()(F.col(text)))  # so marked, a filter does not count twice


def _schedule(spark: SparkSession, slots: int, sources: list[str], weights: list[int]) -> DataFrame:
    """(slot, source, rank): which source fills each slot, and for the how-manieth time."""
    upto = np.cumsum(np.array(weights, dtype=np.float64))
    sent = spark.sparkContext.broadcast((upto / upto[-1], np.array(sources, dtype=object)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, names = sent.value
        for b in batches:
            slot = b.column(0).to_numpy()
            point = (slot.astype(np.uint64) * GOLDEN + np.uint64(1 << 63)) / 2.0**64  # modulo 2^64, so exact for any slot
            which = np.minimum(np.searchsorted(bounds, point, side="right"), len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[which], pa.string())], names=["slot", "source"])

    t = spark.range(slots).withColumnRenamed("id", "slot").mapInArrow(fill, "slot bigint, source string")
    t = t.withColumn("code", F.col("slot") * F.lit(((1 << BITS) - 1) // max(1, slots)))
    return spread_rank(t, ["source"], "code", ["slot"], "rank").drop("code")


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, seed: str = "0", text: str = "text", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, report): each source with its target share of ``total`` tokens, by default all tokens of ``docs``.

    mixture: (slot, source, doc_id, repeat, token_from, n_tokens): the pieces of each slot's block of ``block`` tokens; only
    a source's last block may be shorter. report: (source, target_share, wanted_tokens, available_tokens, tokens,
    shortfall, share, repeats); ``share`` is that of the mixture.

    A source whose documents do not suffice even if each stands max_repeats times is short by the rest, which is reported;
    the others get what they want all the same. ``docs`` has doc_id, source and text; documents of sources without a
    target, without a source or without tokens are left out, though their tokens count for the default total. A target without
    documents is reported with 0. Targets that are null or not above 0 take no part. The driver holds the targets.
    """
    spark = docs.sparkSession
    wanted = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("source").isNotNull()).dropDuplicates(["source"])
    rows = [tuple(r) for r in wanted.select("source", "target_share", "max_repeats").orderBy("source").collect()]
    named = F.broadcast(spark.createDataFrame([(r[0],) for r in rows], "source string"))
    counted = docs.where(F.length(text) > 0).select("doc_id", "source", text)
    if total is not None:
        counted = counted.join(named, "source")
    tok = written(token_counts(counted, text, path).where(F.col("n_tokens") > 0).select("doc_id", "source", "n_tokens"), "mix-tokens")
    sums = tok.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    whole = total if total is not None else sums.agg(F.sum("n")).first()[0] or 0
    have = {r[0]: r[1] for r in sums.join(named, "source").collect()}
    want = {s: int(share * whole + 1e-9) for s, share, _ in rows}
    allot = {s: n for s, _, most in rows if (n := min(want[s], have.get(s, 0) * most)) > 0}
    blocks = {s: -(-n // block) for s, n in allot.items()}
    slots = sum(blocks.values())
    info = [(s, share, want[s], have.get(s, 0), allot.get(s, 0), want[s] - allot.get(s, 0), allot.get(s, 0) / max(1, sum(allot.values())), -(-allot[s] // have[s]) if s in allot else 0, blocks.get(s, 0)) for s, share, _ in rows]
    plan = spark.createDataFrame(info, "source string, target_share double, wanted_tokens bigint, available_tokens bigint, tokens bigint, shortfall bigint, share double, repeats bigint, n_blocks bigint")
    report = plan.drop("n_blocks")

    if slots:
        sched = _schedule(spark, slots, list(allot), list(allot.values())).join(F.broadcast(plan.select("source", "n_blocks")), "source").where(F.col("rank") <= F.col("n_blocks"))
        sched = written(sched.select("slot", "source", "rank"), "mix-slots")
        used = {r[0]: r[1] for r in sched.groupBy("source").count().collect()}
        rest = [(s, k) for s in allot for k in range(used.get(s, 0) + 1, blocks[s] + 1)]  # what the sequence is off by: few for each source
        sched = sched.unionByName(spark.createDataFrame([(slots + i, s, k) for i, (s, k) in enumerate(rest)], "slot bigint, source string, rank bigint"))
    else:
        sched = spark.createDataFrame([], "slot bigint, source string, rank bigint")

    stream = tok.join(F.broadcast(plan.where("repeats > 0").select("source", "available_tokens", "tokens", "repeats")), "source")
    stream = stream.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("repeats"))))
    stream = stream.withColumn("code", order_code("doc_id", "repeat", seed=seed))
    stream = spread_cumulate(stream, ["source", "repeat"], "code", ["doc_id"], F.col("n_tokens"), "upto")
    end = (F.col("repeat") - 1) * F.col("available_tokens") + F.col("upto")
    stream = stream.withColumns({"end": F.least(end, F.col("tokens")), "start": end - F.col("n_tokens")}).where(F.col("start") < F.col("tokens"))
    b = F.lit(block).cast("bigint")
    pieces = stream.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("end") - 1) / b))))
    lo = F.greatest(F.col("start"), F.col("block") * b)
    pieces = pieces.select("source", (F.col("block") + 1).alias("rank"), "doc_id", "repeat", (lo - F.col("start")).alias("token_from"), (F.least("end", (F.col("block") + 1) * b) - lo).alias("n_tokens"))
    return sched.join(pieces, ["source", "rank"]).select("slot", "source", "doc_id", "repeat", "token_from", "n_tokens"), report
