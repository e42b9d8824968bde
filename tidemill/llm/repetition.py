"""Repetition inside single documents, kept as a rule bitmask ledger.

Every rule is evaluated once per document: its measurement and a failure bit are stored. Policies, which are versioned
sets of rules, and ablations are then bitwise expressions over the ledger; no text is read again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import LETTERS, chunks, code_points, gram_hashes, is_unspaced

STRETCH_WORDS, STRETCH_LETTERS = 8, 24


@dataclass(frozen=True)
class Rule:
    name: str
    limit: float  # a document fails at or above it
    kind: str  # stretch, segment, top or repeated
    n: int = 0  # units of a run; of segments, 0 for sentences, 1 for lines, 2 for paragraphs


#: The bit of a rule is its place here: append new rules, never reorder.
RULES = (
    Rule("long_stretch_share", 0.4, "stretch"),
    Rule("line_share", 0.3, "segment", 1),
    Rule("paragraph_share", 0.3, "segment", 2),
    Rule("sentence_share", 0.3, "segment", 0),
    Rule("top_2gram_share", 0.20, "top", 2),
    Rule("top_3gram_share", 0.18, "top", 3),
    Rule("top_4gram_share", 0.16, "top", 4),
    Rule("repeated_5gram_share", 0.15, "repeated", 5),
    Rule("repeated_6gram_share", 0.14, "repeated", 6),
    Rule("repeated_7gram_share", 0.13, "repeated", 7),
    Rule("repeated_8gram_share", 0.12, "repeated", 8),
    Rule("repeated_9gram_share", 0.11, "repeated", 9),
    Rule("repeated_10gram_share", 0.10, "repeated", 10),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
#: Policies by version; a document fails a policy if it fails any of its rules.
POLICIES = {
    "stretch-v1": ("long_stretch_share",),
    "segments-v1": ("line_share", "paragraph_share", "sentence_share"),
    "full-v1": tuple(r.name for r in RULES),
}
_SENTENCE_END = re.compile("[.!?。！？।؟]")


def policy_mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _repeated(ids: np.ndarray, doc: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, positions, keys, later) for each n, ascending: the runs of n units that stand more than once in their document.

    A run that stands twice begins with a shorter one that does, so each length looks only at what the last one left.
    """
    at = np.arange(len(ids))
    own = doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for n in lengths:
        at = at[at + n <= len(ids)]
        at = at[doc[at] == doc[at + n - 1]]
        key = gram_hashes(ids, n)[at] ^ own[at]
        twice = pd.Series(key).duplicated(keep=False).to_numpy()
        at, key = at[twice], key[twice]
        yield n, at, key, pd.Series(key).duplicated().to_numpy()


def _covered(at: np.ndarray, n: int, units: int) -> np.ndarray:
    """Whether each unit lies in a run of n units that begins at one of the positions."""
    delta = np.zeros(units + 1, np.int64)
    delta[at] += 1
    np.add.at(delta, at + n, -1)
    return np.cumsum(delta[:-1]) > 0


def _top(at: np.ndarray, key: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Occurrences of each document's most frequent run, 0 where none stands twice."""
    out = np.zeros(docs, np.int64)
    if len(at):
        which, _ = pd.factorize(key)
        count = np.bincount(which)
        np.maximum.at(out, doc[at], count[which])
    return out


def _cut(text: str) -> tuple[list[list[str]], list[list[str]], list[list[str]]]:
    """Words of a text by sentence, line and paragraph; each word is found once. Blank lines part paragraphs."""
    sentences, lines, paragraphs = [], [], [[]]
    for line in text.casefold().split("\n"):
        parts = [LETTERS.findall(x) for x in _SENTENCE_END.split(line)]
        words = [w for p in parts for w in p]
        sentences += parts
        lines.append(words)
        if line.strip():
            paragraphs[-1] = paragraphs[-1] + words if paragraphs[-1] else words
        else:
            paragraphs.append([])
    return sentences, lines, paragraphs


def _again(segments: list[list[str]], letters: bool) -> float:
    """Share of units in segments that already stood earlier in the document."""
    seen, total, repeated = set(), 0, 0
    for s in segments:
        if s:
            size = sum(map(len, s)) if letters else len(s)
            total += size
            key = " ".join(s)
            if key in seen:
                repeated += size
            seen.add(key)
    return repeated / total if total else 0.0


def measure(texts: pd.Series) -> pd.DataFrame:
    """One column for each rule; null and empty texts measure 0."""
    plain = [t if isinstance(t, str) else "" for t in texts]
    n = len(plain)
    letters = [is_unspaced(t) for t in plain]
    out: dict[str, np.ndarray] = {r.name: np.zeros(n) for r in RULES}
    cuts = [_cut(t) for t in plain]
    words = [[w for line in c[1] for w in line] for c in cuts]
    for mode in (False, True):
        own = [i for i in range(n) if letters[i] is mode and words[i]]
        if not own:
            continue
        if mode:
            parts = [code_points("".join(words[i])) for i in own]
            ids = np.concatenate(parts).astype(np.uint64)
        else:
            parts = [words[i] for i in own]
            ids = pd.factorize(np.array([w for p in parts for w in p], dtype=object))[0].astype(np.uint64)
        size = np.array([len(p) for p in parts])
        doc = np.repeat(np.arange(len(own)), size)
        scale = STRETCH_LETTERS // STRETCH_WORDS if mode else 1  # three letters stand for a word
        units = {r.name: (STRETCH_WORDS if r.kind == "stretch" else r.n) * scale for r in RULES if r.kind != "segment"}
        for k, at, key, later in _repeated(ids, doc, sorted(set(units.values()))):
            for r in RULES:
                if units.get(r.name) != k:
                    continue
                if r.kind == "top":
                    v = np.minimum(1.0, _top(at, key, doc, len(own)) * k / size)
                else:
                    v = np.bincount(doc, weights=_covered(at[later], k, len(ids)), minlength=len(own)) / size
                out[r.name][own] = v
    for r in RULES:
        if r.kind == "segment":
            out[r.name] = np.array([_again(c[r.n], mode) for c, mode in zip(cuts, letters, strict=True)])
    return pd.DataFrame(out)


def repetition_ledger(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds a DOUBLE for each rule and ``failed_bits`` BIGINT to every row, each name with ``prefix``.

    Units are words (case, digits and punctuation ignored), or letters where the script has no spaces. Null and empty
    texts measure 0 and fail nothing. Repeated rows are measured alike. Clashing names raise; choose a prefix.
    """
    names = [prefix + r.name for r in RULES] + [f"{prefix}failed_bits"]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")

    @F.pandas_udf(", ".join(f"{r.name} double" for r in RULES))
    def ledger(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            size = s.str.len().fillna(0).to_numpy().astype(np.int64)
            found = [measure(s[c]) for c in chunks(size)]
            yield pd.concat(found, ignore_index=True) if found else measure(s)

    # so marked, a filter on the bits is not moved below it, which would measure twice
    rows = df.withColumn("_tm", ledger.asNondeterministic()(F.col(text)))
    bits = sum((F.when(F.col(f"_tm.{r.name}") >= r.limit, F.lit(BIT[r.name])).otherwise(F.lit(0)) for r in RULES), F.lit(0).cast("bigint"))
    cols = {prefix + r.name: F.col(f"_tm.{r.name}") for r in RULES}
    return rows.withColumns({**cols, f"{prefix}failed_bits": bits}).drop("_tm")


def apply_policy(ledger: DataFrame, policy: str, bits: str = "failed_bits") -> DataFrame:
    """The rows that fail the policy."""
    return ledger.where(F.col(bits).bitwiseAND(F.lit(policy_mask(policy))) != 0)


def ablations(ledger: DataFrame, bits: str = "failed_bits") -> DataFrame:
    """(policy, rule, n_failed, n_only): rows failing the rule, and rows that fail the policy by this rule alone.

    Counts are taken once per distinct bit set, of which there are at most 2 to the number of rules.
    """
    sets = ledger.groupBy(F.col(bits).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    pairs = [(p, name, policy_mask(p), BIT[name]) for p in POLICIES for name in POLICIES[p]]
    rules = ledger.sparkSession.createDataFrame(pairs, "policy string, rule string, mask bigint, bit bigint")
    hit, only = F.col("b").bitwiseAND(F.col("bit")) != 0, F.col("b").bitwiseAND(F.col("mask")) == F.col("bit")
    both = rules.join(F.broadcast(sets), F.lit(True), "left")
    return both.groupBy("policy", "rule").agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(only, F.col("n"))), F.lit(0)).alias("n_only"))
