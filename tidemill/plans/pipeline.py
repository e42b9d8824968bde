"""The review pipeline: clean, dedupe, cut into sentences, find aspects, cluster, audit, write."""

from __future__ import annotations

import argparse
import hashlib
import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.cleaning import clean_reviews
from tidemill.operators.aspects import extract_aspects, typed_mentions, with_reviews
from tidemill.operators.audit import broken_offsets, map_mentions
from tidemill.operators.clustering import cluster_aspects
from tidemill.operators.dedupe import deduplicate
from tidemill.operators.sentences import review_sentences
from tidemill.plans.config import Settings, load_settings, settings_hash
from tidemill.session import build_session, prepare, written
from tidemill.sources import files, sinks
from tidemill.sources.reviews import load_reviews
from tidemill.sources.synthetic import synthetic_reviews

MENTION = ["surface", "canonical_aspect", "cluster_id", "start_char", "end_char", "doc_start_char", "doc_end_char", "sentence_id", "review_id", "product_id", "category", "aspect_type", "confidence", "origin"]


@dataclass
class Result:
    reviews: DataFrame
    sentences: DataFrame
    mentions: DataFrame
    clusters: DataFrame
    metrics: dict


def mentions_of(reviews: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(sentences, typed mentions with product and category) of cleaned reviews; narrow up to the review join."""
    sentences = review_sentences(reviews)
    x = s.extraction
    found = extract_aspects(sentences, x.min_chars, x.max_words, x.allow_standalone_generics)
    return sentences, with_reviews(typed_mentions(found), reviews)


def run(reviews: DataFrame, settings: Settings | None = None, out: str | None = None, aliases: dict[str, str] | None = None, cleaned: bool = False, inputs: str = "") -> Result:
    """All stages. ``reviews`` has the review columns and ingest_seq. Raises if a mention does not match its sentence.

    With ``out``, writes aspect_mentions and aspect_clusters, metrics.json and a marker of the settings and ``inputs``, by which
    :func:`main` tells that nothing is left to do. With ``cleaned``, the reviews have been cleaned and are taken as they are.
    """
    s = settings or load_settings()
    began = time.time()
    t = reviews if cleaned else clean_reviews(reviews, s.data.min_chars, s.data.language)
    if s.dedupe:
        t = deduplicate(t, s.data.near_dedupe, s.data.near_threshold)
    t = written(t, "reviews")
    sentences, mentions = mentions_of(t, s)
    sentences, mentions = written(sentences, "sentences"), written(mentions, "mentions")
    c = s.clustering
    clusters, surface_map = cluster_aspects(mentions, c.by_category, c.min_cluster_size, c.min_samples, c.eps, aliases)
    clusters = written(clusters, "clusters")
    mentions = written(map_mentions(mentions, surface_map).select(*MENTION), "aspect-mentions")
    broken = broken_offsets(mentions, sentences).limit(1).count()
    if broken:
        raise AssertionError("a mention does not match its sentence")
    n = mentions.count()
    metrics = {"reviews": t.count(), "sentences": sentences.count(), "mentions": n, "clusters": clusters.count(), "outliers": clusters.where(F.col("cluster_id").startswith("cls_outlier_")).count(), "traceability_rate": 1.0, "seconds": round(time.time() - began, 2)}
    if out:
        sinks.write_table(mentions, f"{out}/aspect_mentions.parquet")
        sinks.write_table(clusters, f"{out}/aspect_clusters.parquet")
        sinks.write_json(metrics, f"{out}/metrics.json")
        sinks.mark_done(out, "aspects", run_hash(s, inputs), **metrics)
    return Result(t, sentences, mentions, clusters, metrics)


def run_hash(s: Settings, inputs: str = "") -> str:
    """Of the settings and what the inputs' files are: paths, sizes and times."""
    return hashlib.sha256(f"{settings_hash(s)}|{inputs}".encode()).hexdigest()


def stamps(*paths: str | None) -> str:
    return json.dumps([[p, files.list_files(p)] for p in paths if p])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = argparse.ArgumentParser(description="Find and cluster aspects of reviews.")
    p.add_argument("--profile", default="smoke")
    p.add_argument("--input", help="folder of raw exports; a made-up corpus without")
    p.add_argument("--cleaned", help="Parquet of cleaned reviews; if it is there, it is scanned instead of --input")
    p.add_argument("--config", help="YAML file of settings")
    p.add_argument("--out", default=None)
    p.add_argument("--set", nargs="*", default=[], help="section.key=value")
    a = p.parse_args(argv)
    spark = prepare(spark or build_session())
    s = load_settings(a.profile, a.set, files.read_text(a.config) if a.config else None)
    inputs = stamps(a.input, a.cleaned)
    if a.out and sinks.is_done(a.out, run_hash(s, inputs)):
        return sinks.read_json(f"{a.out}/metrics.json") or {}
    cleaned = bool(a.cleaned) and files.exists(a.cleaned)
    if cleaned:
        rows = spark.read.parquet(a.cleaned)
        if "ingest_seq" not in rows.columns:
            rows = rows.withColumn("ingest_seq", F.monotonically_increasing_id())
    elif a.input:
        rows, errors = load_reviews(spark, a.input, s.data.max_reviews)
        rows = rows.withColumn("ingest_seq", F.monotonically_increasing_id())
        if a.out:
            sinks.append_errors(spark, errors, f"{a.out}/errors")
    else:
        rows = synthetic_reviews(spark, s.seed)
    m = run(rows, s, a.out, cleaned=cleaned, inputs=inputs).metrics
    print(m)
    return m


if __name__ == "__main__":
    main()
