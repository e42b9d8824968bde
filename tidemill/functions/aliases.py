"""Aliases, merge guards and kinds of aspect phrases."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.cleaning import text_key
from tidemill.functions.lexicon import (
    ACCESSORIES,
    ALIASES,
    CANDIDATE_TYPE_WORDS,
    CONTEXT_DELIVERY,
    CONTEXT_PACKAGING,
    CONTEXT_PACKAGING_SURFACE,
    CONTEXT_SELLER,
    CONTEXT_SERVICE,
    DISALLOWED_MERGES,
    GENERIC_MODIFIERS,
    TYPE_WORDS,
)


def _any_of(c: Column, words: list[str]) -> Column:
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words])


def aspect_type(surface: Column, context: Column | None = None) -> Column:
    """delivery, packaging, service or seller by words within the surface, then by the sentence, else product."""
    s = F.lower(surface)  # white space around it makes no difference to what it contains
    out = F
    for kind, words in TYPE_WORDS:
        out = out.when(_any_of(s, words), kind)
    if context is not None:
        c = F.lower(F.coalesce(context, F.lit("")))
        out = out.when(_any_of(c, CONTEXT_DELIVERY), "delivery")
        out = out.when(_any_of(c, CONTEXT_PACKAGING) & _any_of(s, CONTEXT_PACKAGING_SURFACE), "packaging")
        out = out.when(_any_of(c, CONTEXT_SERVICE), "service").when(_any_of(c, CONTEXT_SELLER), "seller")
    return out.otherwise("product")


def candidate_type(surface: Column) -> Column:
    """delivery, packaging, service or seller by words within the surface, else product: the type of a candidate as it is found."""
    s = F.lower(surface)
    out = F
    for kind, words in CANDIDATE_TYPE_WORDS:
        out = out.when(_any_of(s, words), kind)
    return out.otherwise("product")


def alias_table(custom: dict[str, str] | None = None, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Built-in aliases, then custom ones, then overrides; later ones win. Keys and values are lower case, stripped."""
    low = lambda d: {str(k).lower().strip(): str(v).lower().strip() for k, v in (d or {}).items()}
    return ALIASES | low(custom) | low(overrides)


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def resolve_alias(surface: Column, table: dict[str, str] | None = None) -> Column:
    """The alias of the phrase, or of its singular, or the singular itself."""
    table = table or ALIASES
    s = text_key(surface)
    n = F.length(s)
    ies = F.concat(F.substring(s, F.lit(1), n - 3), F.lit("y"))
    plain = F.substring(s, F.lit(1), n - 1)
    stem = F.when(s.endswith("ies") & (n > 4), ies).when(s.endswith("s") & ~s.endswith("ss") & (n > 3), plain).otherwise(s)
    return F.coalesce(_lookup(s, table), _lookup(stem, table), stem)


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def can_merge(a: Column, b: Column) -> Column:
    """Whether two phrases may name one aspect: equal; or not a forbidden pair, both or neither naming an accessory,
    and not sharing generic words alone."""
    a, b = text_key(a), text_key(b)
    wa, wb = _words(a), _words(b)
    forbidden = F.concat_ws("|", F.least(a, b), F.greatest(a, b)).isin(["|".join(sorted(p)) for p in DISALLOWED_MERGES])
    lit = lambda words: F.array(*[F.lit(w) for w in words])
    accessory = F.arrays_overlap(wa, lit(ACCESSORIES)) != F.arrays_overlap(wb, lit(ACCESSORIES))
    common = F.array_intersect(wa, wb)
    generic = (F.size(common) > 0) & (F.size(F.array_except(common, lit(GENERIC_MODIFIERS))) == 0)
    return (a == b) | ~(forbidden | accessory | generic)
