"""Text cleaning as column functions. Only Unicode composition and entity decoding need Python: one Arrow function."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from tidemill.functions.language import detect_language
from tidemill.functions.lexicon import CONTROL, EMAIL, HTML_ENTITY, HTML_TAG, URL


def _decode_one(t: str | None) -> str | None:
    if not t or t.isascii():
        return html.unescape(t) if t and "&" in t else t
    t = unicodedata.normalize("NFC", t)
    return html.unescape(t) if "&" in t else t


@F.pandas_udf(T.StringType())
def _decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFC, then character entities decoded once."""
    for s in parts:
        yield s.map(_decode_one)


# So marked, a filter on the result is not moved below it, which would run it and all that follows twice.
decode = _decode.asNondeterministic()


def strip(c: Column) -> Column:
    """Without outer white space of any kind; ``trim`` takes off blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def remove_html(c: Column) -> Column:
    """Of text whose entities are decoded: what still looks like an entity, and tags, become a blank."""
    return F.regexp_replace(F.regexp_replace(c, HTML_ENTITY, " "), HTML_TAG, " ")


def remove_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, f"(?iU){URL}", "")


def remove_emails(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U){EMAIL}", "")


def normalise_space(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean(c: Column) -> Column:
    """Decode, then HTML, control signs, URLs, e-mail addresses and white space, in that order; null becomes ''."""
    c = decode(F.coalesce(c, F.lit("")))
    for step in (remove_html, remove_control, remove_urls, remove_emails, normalise_space):
        c = step(c)
    return c


def first_text(*cols: str) -> Column:
    """The first text that is not null or empty, else ''."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit(""))


def text_key(c: Column) -> Column:
    return strip(F.lower(c))


def stable_id(*cols: Column) -> Column:
    """SHA-256 of the parts joined by '|'; a null part counts as ''."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def char_ngrams(c: Column, n: int = 3) -> Column:
    """The distinct runs of n characters; of a text of at most n, the text itself."""
    runs = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) <= n, F.array(c)).otherwise(F.array_distinct(runs))


def clean_reviews(df: DataFrame, min_chars: int = 20, language: str | None = None, lang: str = "lang") -> DataFrame:
    """Rows with text and clean_text cleaned, title cleaned, raw_text kept or else filled, short rows left out.

    Empty results, and those under ``min_chars`` characters, are dropped; with a ``language``, rows of another one are
    too, by the ``lang`` column, or as detected from the clean text where there is no such column; a null stays. The
    order of rows and all other columns stay.
    """
    t = df.withColumn("raw_text", first_text("raw_text", "text"))
    body = clean(first_text("text", "raw_text"))
    t = t.withColumns({"text": body, "title": clean(F.col("title"))}).withColumn("clean_text", F.col("text"))
    t = t.where((F.length("clean_text") > 0) & (F.length("clean_text") >= min_chars))
    if language is not None:
        own = F.lower(F.col(lang)) if lang in df.columns else detect_language(F.col("clean_text"))
        t = t.where(F.coalesce(own == language.lower(), F.lit(True)))
    return t


def cleaning_counts(df: DataFrame, min_chars: int = 20) -> DataFrame:
    """(n_rows, n_empty, n_short, n_kept) of cleaning, in one pass."""
    n = F.length(clean(first_text("text", "raw_text")))
    one = lambda c: F.count_if(c)
    return df.select(n.alias("n")).agg(F.count(F.lit(1)).alias("n_rows"), one(F.col("n") == 0).alias("n_empty"), one((F.col("n") > 0) & (F.col("n") < min_chars)).alias("n_short"), one((F.col("n") >= min_chars) & (F.col("n") > 0)).alias("n_kept"))
