"""Rule-based sentences of English text with offsets, as one regular expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.cleaning import first_text, stable_id, strip
from tidemill.functions.lexicon import SHORT_FORMS, TITLES
from tidemill.functions.pieces import with_starts

MARK = "\u001e"
_WORD = r"(?<!\p{L})"
_TITLE = rf"(?<!{_WORD}(?i:{'|'.join(TITLES)}))"
_SHORT = rf"(?<!{_WORD}(?:\p{{L}}|(?i:{'|'.join(SHORT_FORMS)})))"
_CAPITAL = r"\.(?=[ \t]*[\p{IsUppercase}&&\p{L}]\p{L})"
#: After a run of signs, an upper-case letter, quotation mark or bracket follows; a title's full stop never ends a
#: sentence, that of an abbreviation or a single letter only before a capitalised word; an empty line always does.
BOUNDARY = rf"(?:[!?…]|{_TITLE}(?:{_SHORT}\.|{_CAPITAL}))[.!?]*(?=[ \t\n\r]*(?:\p{{IsUppercase}}|[\"'(\[{{“]))|\n(?=\n)"


def sentence_pieces(text: Column) -> Column:
    """array<struct<piece, start>> of the stripped text, white space between sentences included in the pieces."""
    return with_starts(F.split(F.regexp_replace(F.regexp_replace(text, MARK, ""), BOUNDARY, f"$0{MARK}"), MARK))


def split_into_sentences(text: Column) -> Column:
    """array<string> of the sentences, without outer white space; null and blank texts give none."""
    parts = F.transform(sentence_pieces(strip(F.coalesce(text, F.lit("")))), lambda p: strip(p["piece"]))
    return F.filter(parts, lambda s: s != "")


def review_sentences(df: DataFrame, key: str = "review_id", texts: tuple[str, ...] = ("clean_text", "text", "raw_text"), keep: tuple[str, ...] = ()) -> DataFrame:
    """(sentence_id, key, text, start_char, end_char, and ``keep``): offsets are code points of the first text not empty.

    Null and blank texts give no rows; repeated rows give repeated sentences.
    """
    raw = F.regexp_replace(first_text(*texts), MARK, "")
    t = df.select(key, *keep, raw.alias("_tm_raw")).withColumns({"_tm_text": strip(F.col("_tm_raw"))}).where(F.col("_tm_text") != "")
    lead = F.length("_tm_raw") - F.length(F.regexp_replace("_tm_raw", r"(?U)^\s+", ""))
    t = t.select(key, *keep, lead.alias("lead"), F.explode(sentence_pieces(F.col("_tm_text"))).alias("p"))
    body = strip(F.col("p.piece"))
    inner = F.length("p.piece") - F.length(F.regexp_replace("p.piece", r"(?U)^\s+", ""))
    t = t.select(key, *keep, body.alias("text"), (F.col("lead") + F.col("p.start") + inner).alias("start_char")).where(F.col("text") != "")
    t = t.withColumn("end_char", F.col("start_char") + F.length("text"))
    return t.select(stable_id(F.col(key), F.col("start_char"), F.col("end_char")).alias("sentence_id"), key, "text", "start_char", "end_char", *keep)
