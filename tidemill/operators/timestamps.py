"""Timestamps in many notations, precisions and zones, as one UTC instant each.

Method: every string is turned into a mask of character classes (digits 9, letters a, all else itself). A mask fixes
where each field stands, so a parser is planned once per distinct mask and then reads all strings of that mask at once
from a matrix of code points. Local times are converted through zone transition tables (``functions.zones``).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.zones import ZoneTable, version, zone_table
from tidemill.session import bounded_broadcast

# English month names, week days, and the unit of an epoch by its number of digits.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
LONG_MASK = 200  # masks of longer strings are planned anew each time, so that what is kept stays small
EPOCH_DIGITS = {9: "s", 10: "s", 12: "ms", 13: "ms", 15: "us", 16: "us", 18: "ns", 19: "ns"}
FEED_ROWS = 10_000  # a feeds table of more rows is joined by a shuffle

_TO_MASK = {i: "9" for i in range(48, 58)} | {i: "a" for i in [*range(65, 91), *range(97, 123)]}
_DATE = (
    r"(?:(?P<Y>9{4})(?P<s1>[-/.])(?P<M>9{1,2})(?P=s1)(?P<D>9{1,2})"
    r"|(?P<Ycjk>9{4})年(?P<Mcjk>9{1,2})月(?P<Dcjk>9{1,2})日"
    r"|(?P<Yc>9{4})(?P<Mc>9{2})(?P<Dc>9{2})"
    r"|(?P<p1>9{1,2})(?P<s2>[-/.])(?P<p2>9{1,2})(?P=s2)(?P<p3>9{4}|9{2})"
    r"|(?:(?P<wd>a{3,9})\.?,? )?(?P<Dt>9{1,2})(?:a{2})?[ -](?P<mon>a{3,9})\.?,?[ -](?P<Yt>9{4}|9{2})"
    r"|(?:(?P<wd2>a{3,9})\.?,? )?(?P<mon2>a{3,9})\.? (?P<Dt2>9{1,2})(?:a{2})?,? (?P<Yt2>9{4}))"
)
_TIME = (
    r"(?:(?P<h>9{1,2}):(?P<m>9{2})(?::(?P<s>9{2})(?:[.,](?P<f>9{1,12}))?)?"
    r"|(?P<hj>9{1,2})時(?P<mj>9{1,2})分(?:(?P<sj>9{1,2})秒)?"
    r"|(?P<hc>9{2})(?P<mc>9{2})(?:(?P<sc>9{2})(?:[.,](?P<fc>9{1,12}))?)?)"
)
_ZONE = r"(?: ?(?P<sign>[-+])(?P<zh>9{2})(?::?(?P<zm>9{2}))?(?:\[(?P<region>[a/_+\-9]+)\])?| ?(?P<abbr>a{1,5})| ?\[(?P<region2>[a/_+\-9]+)\])?"
_MASK = re.compile(rf"{_DATE}(?:(?P<sep>a|,? +|, ?){_TIME}(?: ?(?P<half>aa(?!a)))?{_ZONE})?")
_MASK_PLAIN = re.compile(rf"{_DATE}(?:(?P<sep>a|,? +|, ?){_TIME}{_ZONE})?")
_EPOCH = re.compile(r"(?P<neg>-)?(?P<int>9+)(?:\.(?P<frac>9+))?")


def mask_of(s: str) -> str:
    return s.translate(_TO_MASK)


@functools.lru_cache(maxsize=65536)
def plan(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """('epoch' or 'civil', field -> (start, end)) for a mask, None if strings of that mask denote no time."""
    if (m := _EPOCH.fullmatch(mask)) and len(m["int"]) in EPOCH_DIGITS and not (m["frac"] and EPOCH_DIGITS[len(m["int"])] != "s"):
        return "epoch", {k: m.span(k) for k in m.groupdict() if m[k]}
    if m := _MASK.fullmatch(mask) or _MASK_PLAIN.fullmatch(mask):
        return "civil", {k: m.span(k) for k in m.groupdict() if m[k]}
    return None


def _number(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(codes), dtype=np.int64)
    for i in range(*span):
        out = out * 10 + (codes[:, i] - 48)
    return out


def _words(texts: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct lower-case words at a span, and which one each string has."""
    cut = [t[span[0] : span[1]].lower() for t in texts]
    return np.unique(np.array(cut, dtype=object).astype(str), return_inverse=True)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 in the Gregorian calendar."""
    first = (y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m - 1)
    return first.astype("datetime64[D]").astype(np.int64) + d - 1


def _month_length(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    a = (y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m - 1)
    return ((a + 1).astype("datetime64[D]") - a.astype("datetime64[D]")).astype(np.int64)


def _civil(texts: np.ndarray, codes: np.ndarray, at: dict[str, tuple[int, int]], zones: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts)
    ok = np.ones(n, dtype=bool)
    get = lambda *names: next((_number(codes, at[k]) for k in names if k in at), None)
    if "p1" in at:
        a, b, c = get("p1"), get("p2"), get("p3")
        four = at["p3"][1] - at["p3"][0] == 4
        mdy, ymd = orders == "MDY", orders == "YMD"
        if four:  # the year is plain: YMD feeds write the rest as month, day
            y, m, d = c, np.where(mdy | ymd, a, b), np.where(mdy | ymd, b, a)
        else:
            y, m, d = np.where(ymd, a, c), np.where(mdy, a, b), np.where(mdy, b, np.where(ymd, c, a))
            ok &= ~(ymd & (at["p1"][1] - at["p1"][0] != 2))
            y = y + 2000
    else:
        y, m, d = get("Y", "Ycjk", "Yc", "Yt", "Yt2"), get("M", "Mcjk", "Mc"), get("D", "Dcjk", "Dc", "Dt", "Dt2")
        for k in ("Yt",):
            if k in at and at[k][1] - at[k][0] == 2:
                y = y + 2000
        for k in ("mon", "mon2"):
            if k in at:
                words, which = _words(texts, at[k])
                number = np.array([next((i + 1 for i, x in enumerate(MONTHS) if x == w or x[:3] == w or (w == "sept" and i == 8)), 0) for w in words], dtype=np.int64)
                m = number[which]
        for k in ("wd", "wd2"):
            if k in at:
                words, which = _words(texts, at[k])
                ok &= np.array([any(x == w or x[:3] == w for x in DAYS) for w in words])[which]
    zero = np.zeros(n, dtype=np.int64)
    hour, minute, sec = get("h", "hj", "hc"), get("m", "mj", "mc"), get("s", "sj", "sc")
    timed = hour is not None
    hour, minute, sec = (zero if x is None else x for x in (hour, minute, sec))
    if "sep" in at and at["sep"][1] - at["sep"][0] == 1:
        c = codes[:, at["sep"][0]]
        ok &= (c == 84) | (c == 116) | (c == 32) | (c == 44)  # T, t, blank, comma
    if "half" in at:
        words, which = _words(texts, at["half"])
        pm, am = (words == "pm")[which], (words == "am")[which]
        ok &= (pm | am) & (hour >= 1) & (hour <= 12)
        hour = np.where(pm, hour % 12 + 12, np.where(am, hour % 12, hour))
    ms = zero
    for k in ("f", "fc"):
        if k in at:
            s, e = at[k]
            ms = _number(codes, (s, min(e, s + 3))) * 10 ** max(0, 3 - (e - s))
    ok &= (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (minute <= 59) & (sec <= 59) & (hour <= 23)
    y, m = np.where(ok, y, 1970), np.where(ok, m, 1)
    ok &= d <= _month_length(y, m)
    local = _days(y, m, np.where(ok, d, 1)) * 86400 + hour * 3600 + minute * 60 + sec

    utc, settled = local.copy(), np.zeros(n, dtype=bool)
    if "sign" in at:
        zm = get("zm")
        off = get("zh") * 3600 + (0 if zm is None else zm * 60)
        ok &= off <= 18 * 3600
        utc = local - np.where(codes[:, at["sign"][0]] == 45, -off, off)
        settled[:] = True
    elif "abbr" in at or "region2" in at:
        words, which = _words(texts, at.get("abbr") or at["region2"])
        for i, w in enumerate(words):
            sel = which == i
            if "abbr" in at:
                if w in ("z", "utc", "gmt"):
                    utc[sel], settled[sel] = local[sel], True
                    continue
                for z in np.unique(zones[sel].astype(str)):
                    own = sel & (zones == z)
                    off = t.named_offset(w, local[own]) if (t := zone_table(z)) else None
                    if off is None:
                        ok[own] = False  # no abbreviation of that zone
                    else:
                        utc[own], settled[own] = local[own] - off, True
            else:
                name = texts[sel][0][at["region2"][0] : at["region2"][1]]
                if (t := zone_table(name)) is None:
                    ok[sel] = False
                else:
                    utc[sel], settled[sel] = t.to_utc(local[sel]), True
    if not settled.all():
        for z in np.unique(zones[~settled].astype(str)):
            sel = ~settled & (zones == z)
            t: ZoneTable | None = zone_table(z)
            if t is None:
                ok[sel] = False  # local time of an unknown zone
            else:
                utc[sel] = t.to_utc(local[sel])
    return utc * 1000 + (ms if timed else 0), ok


def _epoch(codes: np.ndarray, at: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    n = at["int"][1] - at["int"][0]
    v = _number(codes, at["int"])
    ms = {"s": lambda: v * 1000, "ms": lambda: v, "us": lambda: v // 1000, "ns": lambda: v // 1_000_000}[EPOCH_DIGITS[n]]()
    if "frac" in at:
        s, e = at["frac"]
        ms = ms + _number(codes, (s, min(e, s + 3))) * 10 ** max(0, 3 - (e - s))
    return (-ms if "neg" in at else ms), np.ones(len(codes), dtype=bool)


def parse(texts: pd.Series, zones: pd.Series, orders: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(milliseconds since 1970 UTC, whether the string denotes a time), for columns of the same length."""
    n = len(texts)
    out, good = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    t = np.array([x.strip() if isinstance(x, str) else "" for x in texts], dtype=object)
    z = np.array([x if isinstance(x, str) else "" for x in zones], dtype=object)
    o = np.array([x if isinstance(x, str) else "" for x in orders], dtype=object)
    which, masks = pd.factorize(np.array([mask_of(x) for x in t], dtype=object))
    order = np.argsort(which, kind="stable")
    starts = np.searchsorted(which[order], np.arange(len(masks) + 1))
    for k, mask in enumerate(masks):
        p = (plan if len(mask) <= LONG_MASK else plan.__wrapped__)(mask)
        if p is None or not mask:
            continue
        rows = order[starts[k] : starts[k + 1]]
        own = t[rows]
        codes = own.astype(f"U{len(mask)}").view(np.uint32).reshape(len(rows), len(mask)).astype(np.int64)
        out[rows], good[rows] = _epoch(codes, p[1]) if p[0] == "epoch" else _civil(own, codes, p[1], z[rows], o[rows])
    return out, good


def normalise_timestamps(df: DataFrame, feeds: DataFrame, column: str = "timestamp", source: str = "source", prefix: str = "") -> DataFrame:
    """Adds epoch_ms BIGINT, time_mask STRING and zone_version STRING (each with ``prefix``) to every row of ``df``.

    epoch_ms is null where the string is null, empty, in no known notation, names no possible date or time, or has
    an abbreviation unknown in its zone, or is local while its source has no known zone; a second 60 is no possible time. Rows stay as they are,
    repeated ones too; ``feeds`` (source unique, time_zone, date_order) may lack a source. Added names must not clash
    with the columns of ``df``; choose a prefix if they do.
    """
    ms, mask, ver = f"{prefix}epoch_ms", f"{prefix}time_mask", f"{prefix}zone_version"
    if clash := {ms, mask, ver} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    known = feeds.select(F.col("source").alias("_tm_source"), F.col("time_zone").alias("_tm_zone"), F.col("date_order").alias("_tm_order")).dropDuplicates(["_tm_source"])
    rows = df.join(bounded_broadcast(known, FEED_ROWS), F.col(source) == F.col("_tm_source"), "left").drop("_tm_source")
    schema = f"epoch_ms bigint, time_mask string"

    @F.pandas_udf(schema)
    def convert(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, zones, orders in parts:
            v, ok = parse(texts, zones, orders)
            yield pd.DataFrame({"epoch_ms": pd.array(v, dtype="Int64").copy(), "time_mask": [mask_of(x.strip()) if isinstance(x, str) else None for x in texts]}).assign(epoch_ms=lambda d: d.epoch_ms.mask(~ok))

    # so marked, a filter on the result is not moved below it, which would run it twice
    rows = rows.withColumn("_tm", convert.asNondeterministic()(F.col(column), F.col("_tm_zone"), F.col("_tm_order")))
    return rows.withColumns({ms: F.col("_tm.epoch_ms"), mask: F.col("_tm.time_mask"), ver: F.lit(version())}).drop("_tm", "_tm_zone", "_tm_order")
