"""Sentence boundaries across languages and scripts.

Method: semi-Markov dynamic programming. Places where a sentence may end are candidates; whole spans between chosen
candidates are scored by their length, opening word, closing word and the balance of quotations and brackets, and the
best chain of spans is taken. Word scores are log odds learned from checked sentences; without any, from fixed lists.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ranks import BITS, order_code

TRAIN_ROWS = 20_000  # checked sentences from which word scores are learned, a bounded sample by hash
UNBALANCED, LENGTH_WEIGHT = -14.0, 0.25
FLAT = 8.0  # no length scores worse than this square of its distance from the mean

# Abbreviations that seldom end a sentence, by language.
ABBREVIATIONS = """
mr mrs ms dr prof st no vs approx max min ca e.g i.e fig vol jr sr inc ltd co u.s a.m p.m www
nr bzw z b d h usw u.a vgl str hr fr evtl ggf inkl
m mme mlle env p ex n av cf
sra dra aprox p.ej ud uds núm pág
डॉ क्र श्री प्रो
د أ م
""".split()
#: Runs of signs that may end a sentence, and the closing signs that then belong to it.
_END = regex.compile(r"(?P<run>[.!?…。！？।॥؟．｡]+(?:(?<=[ऀ-ॿ؀-ۿ\p{Latin}] ?)[.!?…]+)?)(?P<close>[\"'”’»›)\]}」』】）》〉]*)")
_THAI_SPACE = regex.compile(r"(?<=\S)[ \t 　]+(?=\S)")
_QUOTES = regex.compile(r"[\"“”„«»「」『』（）()\[\]【】《》]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[.'’\-][\p{L}\p{M}\p{N}]+)*")
_NUMBER = regex.compile(r"[\d.,]+\s+([\p{L}\p{M}]+)")
_LAST = regex.compile(r"[\p{L}\p{M}\p{N}.]+$")
_FULL = frozenset("。！？।॥．｡")
_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_THAI = regex.compile(r"\p{Thai}")
_LEAD = "\"'“„«»‹¿¡([{「『【（《 \t"
_PAIRS = {"”": "“", "»": "«", "」": "「", "』": "『", "）": "（", ")": "(", "]": "[", "】": "【", "》": "《"}


def next_kind(text: str, at: int) -> tuple[str, str, bool]:
    """(kind, word, gap): what follows a candidate, past white space and opening signs."""
    n, i = len(text), at
    while i < n and text[i].isspace():
        i += 1
    gap = i > at
    while i < n and text[i] in _LEAD:
        i += 1
    if i >= n:
        return "end", "", gap
    c = text[i]
    m = _WORD.match(text, i)
    word = m[0].lower() if m else c
    if c.isdigit():
        m = _NUMBER.match(text, i)
        return "digit", f"9 {m[1].lower()}" if m else "9", gap
    if _HAN.match(c) or _THAI.match(c):
        return "unspaced", c, gap
    if c.isupper():
        return "upper", word, gap
    if c.islower():
        return "lower", word, gap
    return ("letter" if c.isalpha() else "other"), word, gap


def last_word(text: str, start: int, at: int) -> str:
    back = 24
    while (m := _LAST.search(text, max(start, at - back), at)) and m.start() == at - back > start:
        back *= 2  # the word may begin further back
    w = m[0].strip(".").lower() if m else ""
    return "9" if w.replace(".", "").isdigit() else w


def run_kind(run: str) -> str:
    if any(c in _FULL for c in run):
        return "full"
    if "…" in run or ".." in run:
        return "dots"
    return "stop" if run == "." else "mark"


@dataclass
class Model:
    """Log odds that a candidate ends a sentence; words unknown to it count 0."""

    prior: dict[tuple[str, str], float] = field(default_factory=dict)
    closing: dict[str, float] = field(default_factory=dict)
    opening: dict[str, float] = field(default_factory=dict)
    length: tuple[float, float] = (math.log(60), 0.8)

    def score(self, kind: str, before: str, follows: str, word: str, gap: bool) -> float:
        s = self.prior[kind, follows]
        if kind == "full":
            return s
        if kind == "stop":
            s += self.closing.get(before, -4.0 if len(before) == 1 and before.isalpha() else 0.0)
        s += self.opening.get(word, 0.0)
        return s if gap else s - 0.5


_KINDS = ("stop", "dots", "mark", "full")
# Log odds before anything is learned, by the kind of the run and of what follows.
_PRIOR = {
    "upper": (3.0, 3.5, 5.0, 8.0),
    "digit": (0.5, 2.5, 3.0, 8.0),
    "letter": (2.5, 3.0, 4.0, 8.0),
    "unspaced": (1.0, -1.0, 5.0, 8.0),
    "other": (1.0, 1.0, 2.5, 6.0),
    "lower": (-4.0, -4.0, -3.0, 5.0),
    "end": (9.0, 9.0, 9.0, 9.0),
}


def train(sentences: list[str]) -> Model:
    """Counts of last words and first words at sentence ends against those at signs within sentences."""
    model = Model(prior={(k, f): v for f, row in _PRIOR.items() for k, v in zip(_KINDS, row, strict=True)})
    closed, within, opened, follow = Counter(), Counter(dict.fromkeys(ABBREVIATIONS, 3)), Counter(), Counter()
    lengths = []
    for t in sentences:
        t = t.strip()
        if not t:
            continue
        lengths.append(math.log(len(t)))
        opened[next_kind(t, 0)[1]] += 1
        for m in _END.finditer(t):
            before = last_word(t, 0, m.start())
            if m.end() >= len(t):
                closed[before] += 1
            else:
                nxt = t[m.end()]
                if nxt.isspace() or nxt.isupper():
                    within[before] += 1
                    follow[next_kind(t, m.end())[1]] += 1
    odds = lambda a, b, na, nb, w: math.log((a[w] + 0.5) / (na + 1)) - math.log((b[w] + 0.5) / (nb + 1))
    nc, nw, no, nf = sum(closed.values()), sum(within.values()), sum(opened.values()), sum(follow.values())
    for w in closed | within:
        if closed[w] + within[w] >= 3:
            model.closing[w] = max(-6.0, min(3.0, odds(closed, within, max(nc, nw), nw, w)))
        if not closed[w] and (w in ABBREVIATIONS or len(w) == 1):  # never seen at an end
            model.closing[w] = min(-4.0, model.closing.get(w, 0.0))
    for w in opened | follow:
        if opened[w] + follow[w] >= 3 and no:
            model.opening[w] = max(-5.0, min(4.0, odds(opened, follow, no, max(nf, 20), w)))
    if len(lengths) > 20:
        mu = sum(lengths) / len(lengths)
        model.length = mu, max(0.4, math.sqrt(sum((x - mu) ** 2 for x in lengths) / len(lengths)))
    return model


def _states(line: str) -> tuple[list[tuple[int, tuple[str, ...]]], dict[int, int]]:
    """(position, open quotations and brackets from there on) for every change; where what closes at a position opened."""
    out, stack, opened, where = [], [], {}, []

    def close(at: int, k: int) -> None:
        opened[at] = where[k]
        del stack[k:], where[k:]

    for m in _QUOTES.finditer(line):
        c, i = m[0], m.start()
        if c == '"':
            if '"' in stack:
                close(i, stack.index('"'))
            elif not (i and line[i - 1].isdigit()):  # an inch sign
                stack.append('"'), where.append(i)
        elif c == "“" and "„" in stack:
            close(i, stack.index("„"))
        elif c in _PAIRS:
            if _PAIRS[c] in stack:
                close(i, len(stack) - 1 - stack[::-1].index(_PAIRS[c]))
        else:
            stack.append(c), where.append(i)
        out.append((i + 1, tuple(stack)))
    return out, opened


def _line_spans(line: str, model: Model, flat: float | None = None) -> list[tuple[int, int]]:
    """The best chain of spans; ``flat`` is for tests, the length from which starts are not told apart one by one."""
    thai = len(_THAI.findall(line)) * 3 >= len(line)
    cands: list[tuple[int, float]] = []
    changes, opened = _states(line)
    inner: dict[int, int] = {}  # candidate -> where the quotation or bracket opened that closes there
    uncased = not any(map(str.isupper, line)) and any(map(str.islower, line))
    for m in _END.finditer(line):
        end = m.end()
        if end >= len(line):
            break
        kind = run_kind(m["run"])
        follows, word, gap = next_kind(line, end)
        if uncased and follows == "lower":
            follows = "letter"
        if not gap:
            if kind == "stop" and (follows not in ("upper", "letter", "unspaced", "digit") or (follows == "digit" and not line[m.start() - 1 : m.start()].isalpha())):
                continue
            if kind in ("dots", "mark") and follows in ("lower", "end"):
                continue
        before = last_word(line, 0, m.start()) if kind != "full" else ""
        cands.append((end, model.score(kind, before, follows, word, gap)))
        if m["close"] and (o := [opened[i] for i in range(m.start("close"), end) if i in opened]) and (not (follows == "upper" or (follows == "digit" and gap)) or line[min(o)] in "(（[【"):
            inner[end] = min(o)
    if thai:
        for m in _THAI_SPACE.finditer(line):
            if not (line[m.start() - 1].isdigit() or line[m.end()].isdigit()):
                cands.append((m.start(), 6.0))
        cands = sorted(dict(cands).items())
    if not cands:
        return [(0, len(line))]
    cands.append((len(line), 0.0))
    state, j, cur = [()], 0, ()
    for p, _ in cands:
        while j < len(changes) and changes[j][0] <= p:
            cur = changes[j][1]
            j += 1
        state.append(cur)
    mu, sigma = model.length
    flat = flat or math.exp(mu + sigma * math.sqrt(FLAT))  # longer spans all have the same length score, so their best start counts alone
    at = [0] + [p for p, _ in cands]
    best, back = [0.0] + [-math.inf] * len(cands), [0] * (len(cands) + 1)
    far: dict[tuple[str, ...], int] = {}  # the best start of a longer span, per open quotations
    far_any, lo = -1, 0
    for j in range(1, len(at)):
        gain = cands[j - 1][1]
        while lo < j and at[j] - at[lo] >= flat:
            if state[lo] not in far or best[lo] >= best[far[state[lo]]]:
                far[state[lo]] = lo
            if far_any < 0 or best[lo] >= best[far_any]:
                far_any = lo
            lo += 1
        first = lo
        if at[j] in inner:  # starts within what closes here are told apart one by one
            while first > 0 and not line[at[first - 1] : inner[at[j]]].strip():
                first -= 1
        starts = [*range(j - 1, first - 1, -1), *(x for x in (far.get(state[j], -1), far_any) if x >= 0)]
        for i in starts:
            z = (math.log(max(1, at[j] - at[i])) - mu) / sigma
            s = best[i] + gain - LENGTH_WEIGHT * min(FLAT, z * z)
            if state[i] != state[j] or (at[j] in inner and line[at[i] : inner[at[j]]].strip()):
                s += UNBALANCED  # or what closes here opened within the sentence, which then runs on
            if s > best[j]:
                best[j], back[j] = s, i
    cuts, j = [], len(at) - 1
    while j > 0:
        cuts.append((at[back[j]], at[j]))
        j = back[j]
    return cuts[::-1]


def split_text(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points, without outer white space; a line break always ends one."""
    out, at = [], 0
    for line in regex.split(r"([\n\r  \x0b\x0c\x85]+)", text):
        if line and not line.isspace():
            for a, b in _line_spans(line, model):
                part = line[a:b]
                lead = len(part) - len(part.lstrip())
                size = len(part.strip())
                if size:
                    out.append((at + a + lead, at + a + lead + size))
        at += len(line)
    return out


def learn(sentences: DataFrame, rows: int = TRAIN_ROWS, text: str = "text") -> Model:
    """A model from at most ``rows`` checked sentences; nulls are passed over, an empty table gives the fixed lists.

    The sample is what lies below a hash limit, so that tasks send the driver little more than it keeps, in the hash's order.
    """
    s = sentences.where(F.col(text).isNotNull()).select(text).distinct().withColumn("code", order_code(text))
    n = s.count()
    below = s if n <= rows else s.where(F.col("code") < F.lit((1 << BITS) * rows // n))
    return train([r[0] for r in below.orderBy("code", text).limit(rows).select(text).collect()])


def split_sentences(df: DataFrame, model: Model, key: str = "review_id", text: str = "clean_text") -> DataFrame:
    """(key, text, start_char, end_char): distinct sentences of every non-empty text.

    Null, empty and blank texts give no sentences. Offsets are code points, the end exclusive.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, t[a:b], a, b) for k, t in zip(pdf.key, pdf.text, strict=True) for a, b in split_text(t, sent.value)]
            yield pd.DataFrame(rows, columns=["key", "text", "start_char", "end_char"])

    t = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    return t.mapInPandas(cut, f"key {kind}, text string, start_char bigint, end_char bigint").withColumnRenamed("key", key)
