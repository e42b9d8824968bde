"""The language of a text by its script and, in Latin letters, its frequent words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.lexicon import LANGUAGE_WORDS

# Scripts that tell a language, in order; Japanese is told from Chinese by its syllables.
SCRIPTS = [("ja", r"\p{IsHiragana}\p{IsKatakana}"), ("zh", r"\p{IsHan}"), ("ko", r"\p{IsHangul}"), ("th", r"\p{IsThai}"), ("hi", r"\p{IsDevanagari}"), ("ar", r"\p{IsArabic}"), ("ru", r"\p{IsCyrillic}"), ("el", r"\p{IsGreek}"), ("he", r"\p{IsHebrew}")]
LEAST_SHARE = {"ja": 0.1}  # of the letters; a fifth for the others


def detect_language(text: Column) -> Column:
    """A two-letter code, or null where nothing tells: null, empty and wordless texts, and languages that are not known.

    One expression without Python: shares of scripts among the letters, then the most hits of frequent words, ties by code.
    """
    letters = F.regexp_replace(text, r"[^\p{L}\p{M}]+", "")
    n = F.length(letters)
    words = F.split(F.lower(text), r"[^\p{L}\p{M}]+")
    hits = lambda lang: F.size(F.filter(words, lambda w: w.isin(LANGUAGE_WORDS[lang])))
    ranked = F.array_max(F.array(*[F.struct(hits(c).alias("n"), F.lit(i).alias("i"), F.lit(c).alias("lang")) for i, c in enumerate(sorted(LANGUAGE_WORDS, reverse=True))]))
    out = F.when(n.isNull() | (n == 0), F.lit(None).cast("string"))
    for lang, script in SCRIPTS:
        out = out.when(F.length(F.regexp_replace(letters, f"[^{script}]+", "")) >= LEAST_SHARE.get(lang, 0.2) * n, lang)
    return out.when(ranked["n"] > 0, ranked["lang"])
