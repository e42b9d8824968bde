"""Aspect phrases of sentences: tokens, n-grams, filters and longest matches, inside one row expression each."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.aliases import aspect_type, candidate_type
from tidemill.functions.lexicon import COPULAS_AND_CONJUNCTIONS, GENERIC_NOUNS, OPINION_WORDS, PRONOUNS, STANDALONE_GENERIC, STOPWORDS, TOKEN
from tidemill.functions.pieces import with_starts
from tidemill.operators.spans import spans_from_bio

EDGE = rf"(?<![\p{{L}}\p{{N}}_]){TOKEN}(?![\p{{L}}\p{{N}}_])"
MAX_WORDS = 4
ALONE = sorted({*PRONOUNS, *STOPWORDS, *OPINION_WORDS, *GENERIC_NOUNS})


def _cut_tokens(text: Column) -> Column:
    """array<struct<piece, start>>: what stands between tokens and tokens by turns."""
    marked = F.regexp_replace(F.regexp_replace(text, "[\u0001\u0002]", " "), EDGE, "\u0001$0\u0002")
    return with_starts(F.split(marked, "[\u0001\u0002]"))


def tokens(text: Column) -> Column:
    """array<struct<piece, start>> of the word tokens; a hyphen joins two parts."""
    return F.filter(_cut_tokens(text), lambda p, i: i % 2 == 1)


def _with_edges(pieces: Column) -> Column:
    """Tokens with whether they can be the first or the last of a phrase, as far as that can be told from them alone.

    A token next to white space is a word by itself there, so stop words at an edge rule a phrase out before it is cut.
    """
    edges = [*STOPWORDS, *PRONOUNS]
    apart = lambda c: (c == "") | c.isin(" ", "\n", "\t")
    low = lambda p: F.lower(p["piece"])
    after = lambda i: F.substring(F.get(pieces, i + 1)["piece"], 1, 1)
    before = lambda i: F.substring(F.get(pieces, i - 1)["piece"], -1, 1)
    all_of = F.transform(
        pieces,
        lambda p, i: F.struct(
            p["start"].alias("start"),
            (p["start"] + F.length(p["piece"])).alias("end"),
            (~((i % 2 == 1) & low(p).isin(edges) & apart(after(i)))).alias("opens"),
            (~((i % 2 == 1) & low(p).isin([*edges, *OPINION_WORDS]) & apart(before(i)))).alias("closes"),
        ),
    )
    return F.filter(all_of, lambda p, i: i % 2 == 1)


def _valid(low: Column, words: Column, min_chars: int, max_words: int, allow_generic: bool) -> Column:
    n, first, last = F.size(words), F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)
    alone = sorted({*ALONE, *(() if allow_generic else STANDALONE_GENERIC)})
    edges = [*STOPWORDS, *PRONOUNS]
    copulas = F.array(*[F.lit(x) for x in COPULAS_AND_CONJUNCTIONS])
    ok = (n <= max_words) & (F.length(low) >= min_chars) & ~first.isin(edges) & ~last.isin(edges) & ~last.isin(OPINION_WORDS)
    return ok & ~((n == 1) & first.isin(alone)) & low.rlike(r"[\p{L}\p{N}]") & ~F.arrays_overlap(words, copulas)


def _low(surface: Column) -> Column:
    return F.regexp_replace(F.lower(surface), r"(?U)^\s+|\s+$", "")


def is_valid_aspect(surface: Column, min_chars: int = 2, max_words: int = MAX_WORDS, allow_generic: bool = False) -> Column:
    """Whether a phrase can be an aspect: length, words, no stop words at the edges, no copula inside, no opinion at the end."""
    return _valid(_low(surface), F.split(_low(surface), r"(?U)\s+"), min_chars, max_words, allow_generic)


def _spans(toks: Column, max_words: int) -> Column:
    """The runs of at most ``max_words`` tokens that can open and close as struct<start, end, n>, by start, longest first."""
    span = lambda t, i: lambda u, k: F.struct(t["start"].alias("start"), u["end"].alias("end"), (F.least(F.lit(max_words), F.size(toks) - i) - k).alias("n"), u["closes"].alias("closes"))
    per = lambda t, i: F.when(t["opens"], F.filter(F.transform(F.reverse(F.slice(toks, i + 1, F.lit(max_words))), span(t, i)), lambda s: s["closes"]))
    runs = F.filter(F.transform(toks, per), lambda x: x.isNotNull())
    return F.transform(F.flatten(runs), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["n"].alias("n")))


def longest(spans: Column) -> Column:
    """Of spans by (start, longest first) those inside no other: the end rises above all before."""
    none = F.expr("CAST(array() AS array<struct<start: int, end: int, n: int>>)")
    return F.aggregate(
        spans,
        F.struct(F.lit(-1).alias("reach"), none.alias("out")),
        lambda acc, s: F.when(s["end"] > acc["reach"], F.struct(s["end"].alias("reach"), F.array_append(acc["out"], s).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )


def extract_aspects(sentences: DataFrame, min_chars: int = 2, max_words: int = MAX_WORDS, allow_generic: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per aspect phrase: the sentence's id and review_id, ``keep``, surface, offsets in sentence and document, confidence, type.

    ``sentences`` has sentence_id, review_id, text and start_char. Null texts give none. No shuffle: candidates of a
    sentence are made, filtered and reduced to longest matches within its row.
    """
    t = sentences.where(F.col("text").isNotNull()).withColumn("_tm_all", _cut_tokens(F.col("text")))
    t = t.withColumn("_tm_tok", _with_edges(F.col("_tm_all"))).drop("_tm_all")
    cut = lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    # each step's struct is bound once, so that a phrase is cut, lowered and split once
    low = F.transform(_spans(F.col("_tm_tok"), max_words), lambda s: F.struct(s.alias("s"), _low(cut(s)).alias("low")))
    words = F.transform(low, lambda x: F.struct(x["s"].alias("s"), x["low"].alias("low"), F.split(x["low"], r"(?U)\s+").alias("w")))
    good = F.filter(words, lambda x: _valid(x["low"], x["w"], min_chars, max_words, allow_generic))
    t = t.withColumn("_tm_s", F.explode(longest(F.transform(good, lambda x: x["s"]))))
    s = F.col("_tm_s")
    return t.select(
        "sentence_id",
        "review_id",
        *keep,
        cut(s).alias("surface"),
        s["start"].alias("start_char"),
        s["end"].alias("end_char"),
        (F.col("start_char") + s["start"]).alias("doc_start_char"),
        (F.col("start_char") + s["end"]).alias("doc_end_char"),
        F.when(s["n"] > 1, 0.7).otherwise(0.5).alias("confidence"),
        F.lit("weak").alias("origin"),
        F.col("text").alias("sentence"),
        candidate_type(cut(s)).alias("aspect_type"),
    )


def typed_mentions(candidates: DataFrame) -> DataFrame:
    """With a repeatable confidence from .85 to .97 by the surface's hash, origin pseudo and the kind of aspect."""
    h = F.conv(F.substring(F.md5(F.col("surface")), 1, 8), 16, 10).cast("bigint") % 13
    return candidates.withColumns({"confidence": F.round(F.lit(0.85) + h * 0.01, 2), "origin": F.lit("pseudo"), "aspect_type": aspect_type(F.col("surface"), F.col("sentence"))})


def with_reviews(mentions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Adds product_id and category of the latest row of each review_id; '' where there is none."""
    latest = reviews.groupBy("review_id").agg(F.max_by(F.struct("product_id", "category"), "ingest_seq").alias("r"))
    t = mentions.join(latest, "review_id", "left")
    return t.withColumns({c: F.coalesce(F.col(f"r.{c}"), F.lit("")) for c in ("product_id", "category")}).drop("r")


TAGS = "offsets array<struct<start: int, end: int>>, labels array<string>, confidence array<double>"


def model_aspects(sentences: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple]]], keep: tuple[str, ...] = (), fallback: bool = True) -> DataFrame:
    """Aspect phrases by a token classifier, in the columns of :func:`typed_mentions`.

    ``load()`` runs once on the driver, as a check, and once per Python worker; what it returns takes a batch of texts and gives
    (offsets, labels, confidences) for each. If it cannot be loaded, the rules take its place, with a warning and the origin
    'fallback'; without ``fallback`` the error is raised. Null texts give none.
    """
    try:
        load()
    except Exception as e:  # noqa: BLE001
        if not fallback:
            raise
        warnings.warn(f"the model cannot be loaded, rules take its place: {e}", stacklevel=2)
        return typed_mentions(extract_aspects(sentences, keep=keep)).withColumn("origin", F.lit("fallback"))

    @F.pandas_udf(TAGS)
    def tag(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = load()
        for s in parts:
            rows = predict(s.fillna("").tolist())
            yield pd.DataFrame({"offsets": [[{"start": a, "end": b} for a, b in o] for o, _, _ in rows], "labels": [list(x) for _, x, _ in rows], "confidence": [list(c) for _, _, c in rows]})

    t = sentences.where(F.col("text").isNotNull()).withColumn("_tm_t", tag.asNondeterministic()(F.col("text")))
    t = t.withColumn("_tm_s", F.explode(spans_from_bio(F.col("text"), F.col("_tm_t.offsets"), F.col("_tm_t.labels"), F.col("_tm_t.confidence"))))
    s = F.col("_tm_s")
    surface = F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    at = F.col("start_char")
    return t.select(
        "sentence_id",
        "review_id",
        *keep,
        surface.alias("surface"),
        s["start"].alias("start_char"),
        s["end"].alias("end_char"),
        (at + s["start"]).alias("doc_start_char"),
        (at + s["end"]).alias("doc_end_char"),
        s["confidence"].alias("confidence"),
        F.lit("pseudo").alias("origin"),
        F.col("text").alias("sentence"),
        aspect_type(surface, F.col("text")).alias("aspect_type"),
    )
