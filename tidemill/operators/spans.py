"""BIO labels, spans and their metrics; each row holds one sentence's arrays, so nothing is shuffled but the sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("O", "B-ASP", "I-ASP")
SPAN = "struct<start: int, end: int, confidence: double>"


def spans_from_bio(text: Column, offsets: Column, labels: Column, confidence: Column | None = None) -> Column:
    """array<struct<start, end, confidence>> of labelled runs, outer white space taken off.

    B starts a span, I goes on or, without one open, starts one, O ends it. Tokens of no width are passed over. The
    confidence is the mean of the tokens', .9 each if none is given. Null arrays give null.
    """
    conf = F.transform(labels, lambda _: F.lit(0.9)) if confidence is None else confidence
    toks = F.filter(F.zip_with(F.zip_with(offsets, labels, lambda o, lab: F.struct(o["start"].alias("s"), o["end"].alias("e"), lab.alias("l"))), conf, lambda t, c: F.struct(t["s"].alias("s"), t["e"].alias("e"), t["l"].alias("l"), c.cast("double").alias("c"))), lambda t: t["s"] < t["e"])
    state = lambda s, e, c, n, out: F.struct(s.alias("s"), e.alias("e"), c.alias("c"), n.alias("n"), out.alias("out"))
    closed = lambda a: F.when(a["s"] >= 0, F.array_append(a["out"], F.struct(a["s"].alias("start"), a["e"].alias("end"), (a["c"] / a["n"]).alias("confidence")))).otherwise(a["out"])
    zero = state(F.lit(-1), F.lit(-1), F.lit(0.0), F.lit(0), F.expr(f"CAST(array() AS array<{SPAN}>)"))
    begins = lambda a, t: t["l"].startswith("B") | (t["l"].startswith("I") & (a["s"] < 0))
    step = lambda a, t: F.when(begins(a, t), state(t["s"], t["e"], t["c"], F.lit(1), closed(a))).when(t["l"].startswith("I"), state(a["s"], t["e"], a["c"] + t["c"], a["n"] + 1, a["out"])).otherwise(state(F.lit(-1), F.lit(-1), F.lit(0.0), F.lit(0), closed(a)))
    raw = F.aggregate(toks, zero, step, closed)
    cut = lambda x: F.substring(text, x["start"] + 1, x["end"] - x["start"])
    lead = lambda x: F.length(cut(x)) - F.length(F.regexp_replace(cut(x), r"(?U)^\s+", ""))
    tail = lambda x: F.length(cut(x)) - F.length(F.regexp_replace(cut(x), r"(?U)\s+$", ""))
    trimmed = F.transform(raw, lambda x: F.struct((x["start"] + lead(x)).alias("start"), (x["end"] - tail(x)).alias("end"), x["confidence"].alias("confidence")))
    return F.filter(trimmed, lambda x: x["start"] < x["end"])


def bio_from_spans(offsets: Column, spans: Column) -> Column:
    """array<string> of labels: the last span that overlaps a token counts; its first token is B, the others I."""
    overlaps = lambda t, s: F.greatest(t["start"], s["start"]) < F.least(t["end"], s["end"])
    first = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(F.filter(offsets, lambda t: overlaps(t, s)), F.lit(0))["start"].alias("b")))
    last = lambda t: F.element_at(F.concat(F.array(F.lit(None).cast("struct<start: int, end: int, b: int>")), F.filter(first, lambda s: overlaps(t, s))), -1)
    return F.transform(offsets, lambda t: F.when(last(t).isNull(), "O").when(last(t)["b"] == t["start"], "B-ASP").otherwise("I-ASP"))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _share(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, a / (a + b)).otherwise(F.lit(0.0))


def bio_metrics(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(precision, recall, f1, macro_f1, micro_f1), rounded to 4 digits, of token labels; all 0 for an empty table."""
    n = F.least(F.size(gold), F.size(pred))
    t = df.select(F.explode(F.zip_with(F.slice(gold, F.lit(1), n), F.slice(pred, F.lit(1), n), lambda g, p: F.struct(g.alias("g"), p.alias("p")))).alias("x")).select("x.g", "x.p")
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    g, p = F.col("g"), F.col("p")
    cols = [n((g == p) & (g != "O")).alias("tp"), n((g != p) & (p != "O")).alias("fp"), n((g != p) & (g != "O")).alias("fn")]
    for x in LABELS[1:]:
        k = x[0].lower()
        cols += [n((g == p) & (g == x)).alias(f"{k}tp"), n((g != p) & (p == x)).alias(f"{k}fp"), n((g != p) & (g == x)).alias(f"{k}fn")]
    s = t.agg(*cols)
    pr = lambda k: (_share(F.col(f"{k}tp"), F.col(f"{k}fp")), _share(F.col(f"{k}tp"), F.col(f"{k}fn")))
    prec, rec = pr("")
    macro = (_f1(*pr("b")) + _f1(*pr("i"))) / 2
    r = lambda c, name: F.round(c, 4).alias(name)
    return s.select(r(prec, "precision"), r(rec, "recall"), r(_f1(prec, rec), "f1"), r(macro, "macro_f1"), r(_f1(prec, rec), "micro_f1"))


def span_metrics(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Exact (as sets) and partial (any overlap, as lists) precision, recall and F1 of spans; null arrays are empty."""
    none = F.expr("CAST(array() AS array<struct<start: int, end: int>>)")
    plain = lambda c: F.coalesce(F.transform(F.col(c), lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))), none)
    t = df.select(plain(gold).alias("g"), plain(pred).alias("p"))
    overlaps = lambda a, b: F.greatest(a["start"], b["start"]) < F.least(a["end"], b["end"])
    hit = lambda xs, ys: F.size(F.filter(F.col(xs), lambda x: F.exists(F.col(ys), lambda y: overlaps(x, y))))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    s = t.agg(
        total(F.size(F.array_intersect("g", "p")), "tp"),
        total(F.size(F.array_except("p", "g")), "fp"),
        total(F.size(F.array_except("g", "p")), "fn"),
        total(hit("p", "g"), "ptp"),
        total(F.size("p") - hit("p", "g"), "pfp"),
        total(F.size("g") - hit("g", "p"), "pfn"),
    )
    out = []
    for name, k in (("exact", ""), ("partial", "p")):
        prec, rec = _share(F.col(f"{k}tp"), F.col(f"{k}fp")), _share(F.col(f"{k}tp"), F.col(f"{k}fn"))
        out += [F.round(c, 4).alias(f"{name}_span_{m}") for m, c in (("precision", prec), ("recall", rec), ("f1", _f1(prec, rec)))]
    return s.select(*out)


def overlapping_spans(gold: DataFrame, pred: DataFrame, key: str = "sentence_id") -> DataFrame:
    """(key, gold_start, gold_end, pred_start, pred_end) of spans of one sentence that overlap: an equi-join with a range condition."""
    g = gold.select(key, F.col("start_char").alias("gold_start"), F.col("end_char").alias("gold_end"))
    p = pred.select(key, F.col("start_char").alias("pred_start"), F.col("end_char").alias("pred_end"))
    return g.join(p, key).where(F.greatest("gold_start", "pred_start") < F.least("gold_end", "pred_end"))
