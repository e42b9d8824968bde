"""Evaluation texts inside a training corpus.

Method: q-gram lemma filtering. A passage of L characters with at most e edits shares at least L - q + 1 - q e of its
q-grams with the document, all in one narrow band of diagonals (document position minus item position). The items'
q-grams are a table of postings. One pass over the documents keeps the places whose q-gram is one of the items' and that
lie densely enough for any passage; they meet the postings, shared q-grams are counted in overlapping bands, pairs below the bound are dropped, and what is left is extended on both sides, from each run of shared q-grams, by banded
alignment within the edit budget.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import chunks, code_points, gram_hashes, is_unspaced, level_hashes, squeeze
from tidemill.session import written

WORDS, LETTERS = 12, 25  # a passage: so many words, or letters where the item's script has no spaces
EDIT_EVERY = 30  # a passage may have one edit in so many characters, one at least
Q_LEVELS = (1, 2, 3, 4, 6, 8, 12, 16)  # lengths of q-grams; an item has the one that suits its shortest passage
FILTER_BITS = (16, 27)  # least and most bits of the filter of the items' q-grams: at most 16 MB
BLOCK_BITS = 16
IN_MEMORY = 2_000_000  # postings that are broadcast, 64 MB; more are joined as a table
SCHEMA = "item_id bigint, doc_key bigint, item_start int, item_end int, doc_start int, doc_end int, edits int, exact_units int"


def budget(shortest: int, every: int = EDIT_EVERY, edits: int | None = None) -> tuple[int, int, int]:
    """(edits, q, least number of shared q-grams) for passages of ``shortest`` characters or more."""
    edits = max(1, shortest // every) if edits is None else edits
    q = max(x for x in Q_LEVELS if x == 1 or x * (edits + 1) <= 0.6 * shortest)
    return edits, q, max(1, shortest - q + 1 - q * edits)


@dataclass
class Item:
    """An item squeezed to letters, marks and digits, with its q-grams in order."""

    unit: str
    codes: np.ndarray
    starts: np.ndarray  # of each word
    ends: np.ndarray
    edits: int
    q: int
    bound: int
    shortest: int  # characters of the shortest passage
    grams: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    places: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


def prepare_item(text: str | None, every: int = EDIT_EVERY, edits: int | None = None) -> Item | None:
    """None if the text holds no whole passage."""
    if not text:
        return None
    unit = "letters" if is_unspaced(text) else "words"
    need = WORDS if unit == "words" else LETTERS
    words = [w for w in (squeeze(x) for x in text.split()) if w]
    c = code_points("".join(words))
    if unit == "words":
        e = np.cumsum([len(w) for w in words]).astype(np.int64)
        s = e - [len(w) for w in words] if len(words) else e
    else:
        s, e = np.arange(len(c)), np.arange(1, len(c) + 1)
    if len(e) < need:
        return None
    shortest = int((e[need - 1 :] - s[: len(s) - need + 1]).min())
    edits, q, bound = budget(shortest, every, edits)
    h = gram_hashes(c, q)
    order = np.argsort(h, kind="stable")
    return Item(unit, c, s, e, edits, q, bound, shortest, h[order], order)


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two code point arrays within a band of ``most``; ``most`` + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, most + 1) + 1
            if j:
                best = min(best, new.get(j - 1, most + 1) + 1, row.get(j - 1, most + 1) + int(a[i - 1] != b[j - 1]))
            else:
                best = i
            new[j] = best
        if min(new.values()) > most:
            return most + 1
        row = new
    return min(row.get(len(b), most + 1), most + 1)


def reaches(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int]]:
    """For 0, 1, ... ``most`` edits, the most characters of ``a`` that a beginning of ``b`` covers, and that beginning's length.

    The furthest-reaching points of the diagonals within ``most``: exact, in time in proportion to ``most`` squared and the
    characters that match.
    """
    b = b[: len(a) + most]

    def slide(i: int, t: int) -> int:
        n = min(len(a) - i, len(b) - i - t)
        if n <= 0:
            return i
        odd = a[i : i + n] != b[i + t : i + t + n]
        k = int(odd.argmax())
        return i + (k if odd[k] else n)

    far = {0: slide(0, 0)}  # diagonal: characters of ``a``
    out = [(far[0], far[0])]
    for k in range(1, most + 1):
        new = {}
        for t in range(-k, k + 1):
            best = far.get(t, -1)
            if best >= 0:
                best += int(best < len(a) and best + t < len(b))
            if far.get(t + 1, len(a)) < len(a):
                best = max(best, far[t + 1] + 1)
            if t - 1 in far and far[t - 1] + t <= len(b):
                best = max(best, far[t - 1])
            if best >= 0 and best + t >= 0:
                new[t] = slide(best, t)
        far = new
        i, _, t = max((i, -abs(t), t) for t, i in far.items())
        out.append((i, i + t))
    return out


def align(x: Item, c: np.ndarray) -> tuple | None:
    """(item_start, item_end, doc_start, doc_end, edits, exact_units) of the best passage in a document's code points."""
    h = gram_hashes(c, x.q)
    if not len(h):
        return None
    lo, hi = np.searchsorted(x.grams, h, side="left"), np.searchsorted(x.grams, h, side="right")
    count = hi - lo
    dp = np.repeat(np.arange(len(h)), count)
    ip = x.places[np.repeat(lo, count) + np.arange(len(dp)) - np.repeat(np.cumsum(count) - count, count)]
    # exact runs: consecutive shared q-grams on one diagonal
    diag = dp - ip
    kept = in_bands(diag, x.bound, x.edits)
    ip, diag = ip[kept], diag[kept]
    if not len(ip):
        return None
    order = np.lexsort((ip, diag))
    ip, diag = ip[order], diag[order]
    s = np.flatnonzero(np.r_[True, (diag[1:] != diag[:-1]) | (ip[1:] != ip[:-1] + 1)])
    begin, end, diag = ip[s], ip[np.append(s[1:], len(ip)) - 1] + x.q, diag[s]
    need = WORDS if x.unit == "words" else LETTERS
    units = lambda a, b: int(max(0, np.searchsorted(x.ends, b, side="right") - np.searchsorted(x.starts, a)))
    exact, best = 0, None
    for p, r, d in zip(begin, end, diag, strict=True):  # every passage holds a run: extend each by what the edit budget allows
        left = reaches(x.codes[:p][::-1], c[max(0, d - x.edits) : p + d][::-1], x.edits)
        right = reaches(x.codes[r:], c[r + d : r + d + len(x.codes) - r + x.edits], x.edits)
        exact = max(exact, units(p - left[0][0], r + right[0][0]))
        for k in range(x.edits + 1):
            for m in range(x.edits + 1 - k):
                at, upto = int(p - left[k][0]), int(r + right[m][0])
                n = units(at, upto)
                if n >= need and (best is None or (n, -k - m) > (best[0], -best[5])):
                    best = (n, at, upto, int(p + d - left[k][1]), int(r + d + right[m][1]), k + m)
    return (*best[1:], exact) if best else None


def in_bands(diag: np.ndarray, bound: int, edits: int) -> np.ndarray:
    """Which shared q-grams lie in a band of diagonals that holds at least ``bound``.

    Two grids of bands, so that any edits + 1 diagonals lie within one.
    """
    width, kept = 2 * edits + 2, np.zeros(len(diag), bool)
    for half in (0, width // 2):
        _, inv, n = np.unique((diag + half) // width, return_inverse=True, return_counts=True)
        kept |= n[inv] >= bound
    return kept


def postings(items: DataFrame, every: int = EDIT_EVERY, edits: int | None = None) -> DataFrame:
    """(item, q, edits, bound, shortest, gram, at): one row for each q-gram of the items that hold a passage."""
    names = "item bigint, q int, edits int, bound int, shortest int, gram bigint, at int"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, t in zip(pdf["item"], pdf.text, strict=True):
                if (x := prepare_item(t, every, edits)) is not None:
                    yield pd.DataFrame({"item": i, "q": x.q, "edits": x.edits, "bound": x.bound, "shortest": x.shortest, "gram": x.grams.view(np.int64), "at": x.places})

    return items.select("item", "text").mapInPandas(cut, names)


def gram_filter(post: DataFrame, bits: int) -> np.ndarray:
    """Which last ``bits`` bits some q-gram of the items has: 2^bits flags, made in blocks by the executors."""
    cell = F.col("gram").bitwiseAND(F.lit((1 << bits) - 1))
    cells = post.select(cell.alias("cell")).distinct().withColumn("block", F.shiftright("cell", BLOCK_BITS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << BLOCK_BITS, bool)
        flags[pdf.cell.to_numpy() & ((1 << BLOCK_BITS) - 1)] = True
        return pd.DataFrame({"block": pdf.block.iloc[:1], "flags": [np.packbits(flags).tobytes()]})

    out = np.zeros((1 << (bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for r in cells.groupBy("block").applyInPandas(pack, "block bigint, flags binary").collect():  # 8 KB each
        out[r[0]] = np.frombuffer(r[1], np.uint8)
    return out.reshape(-1)


def dense(pos: np.ndarray, shortest: int, edits: int, bound: int) -> np.ndarray:
    """Which places lie where a passage can: the lemma before items and bands are told apart."""
    if bound <= 1 or not len(pos):
        return np.ones(len(pos), bool)
    k = np.arange(len(pos))
    right = np.searchsorted(pos, pos + shortest + edits)  # a passage's q-grams start within its length
    many = right - k >= bound
    reach = np.zeros(len(pos) + 1, np.int64)
    np.add.at(reach, k[many], 1)
    np.add.at(reach, right[many], -1)
    return np.cumsum(reach[:-1]) > 0


@dataclass
class Index:
    """Postings in memory, by gram, with the demands of each item's number."""

    grams: np.ndarray  # distinct
    first: np.ndarray  # where the postings of each begin, and the end
    item: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    edits: np.ndarray
    bound: np.ndarray

    @classmethod
    def of(cls, post: DataFrame) -> Index:
        t = post.select("gram", "item", "at", "edits", "bound").toPandas()
        t = t.assign(gram=t.gram.to_numpy().view(np.uint64)).sort_values("gram", kind="stable")
        grams, first = np.unique(t.gram.to_numpy(), return_index=True)
        ids, one, item = np.unique(t["item"].to_numpy(), return_index=True, return_inverse=True)
        return cls(grams, np.append(first, len(t)), item, t["at"].to_numpy().astype(np.int64), ids, t.edits.to_numpy()[one].astype(np.int64), t.bound.to_numpy()[one])

    def pairs(self, doc: np.ndarray, place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (doc, item) of which some band holds as many shared q-grams as the item demands."""
        j = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        same = self.grams[j] == h
        doc, place, j = doc[same], place[same], j[same]
        count = self.first[j + 1] - self.first[j]
        post = np.repeat(self.first[j] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item = self.item[post]
        _, pair, n = np.unique(np.repeat(doc, count) * len(self.ids) + item, return_inverse=True, return_counts=True) if len(post) else (post, post, post)
        some = n[pair] >= self.bound[item]  # too few in all bands together
        item, pair, rep = item[some], pair[some], np.repeat(np.arange(len(doc)), count)[some]
        diag, width = place[rep] - self.at[post[some]], 2 * self.edits[item] + 2
        kept = np.zeros(len(pair), bool)
        for half in (0, 1):
            key = (pair << 33) + (diag + half * (width // 2)) // width + (1 << 32)
            order = np.argsort(key)
            cut = np.flatnonzero(np.diff(key[order], prepend=-1))
            n = np.diff(np.append(cut, len(key)))
            kept[order] |= np.repeat(n, n) >= self.bound[item[order]]
        _, one = np.unique(pair[kept], return_index=True)
        return doc[rep[kept][one]], self.ids[item[kept][one]]


def find_leaks(docs: DataFrame, items: DataFrame, every: int = EDIT_EVERY, edits: int | None = None, doc_key: str = "doc_id", text: str = "text", most: int = IN_MEMORY) -> DataFrame:
    """(item_id, doc_key, item_start, item_end, doc_start, doc_end, edits, exact_units): one row per item and document.

    A row says that a passage of at least 12 words of the item (25 letters in a script without spaces) stands in the
    document with at most one edited character in ``every`` of the item's shortest passage, one at least (``edits`` sets
    the number itself); case, punctuation and white space are ignored; positions count letters, marks and digits.
    ``exact_units`` are the words (letters) of the longest unedited run. Items shorter than a passage and null or empty
    texts match nothing. Repeated rows of a document or an item give one row each with the longest passage.

    The documents are read once, whatever the number of items. Up to ``most`` postings are broadcast and counted in the
    pass itself; more are joined as a table, and what is broadcast is a filter of at most 16 MB. The rows are the same.
    """
    spark = docs.sparkSession
    own = written(items.where(F.length("text") > 0).select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()), "leak-items")
    post = written(postings(own, every, edits), "leak-postings")
    # for each q and number of edits the weakest demand of any item, which all its passages meet
    kinds = [tuple(r) for r in post.groupBy("q", "edits").agg(F.min("shortest"), F.count(F.lit(1))).orderBy("q", "edits").collect()]
    size = sum(k[3] for k in kinds)
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], math.ceil(math.log2(8 * size + 1))))
    index = Index.of(post) if size <= most else None
    sent = spark.sparkContext.broadcast((kinds, gram_filter(post, bits) if kinds else np.zeros(0, np.uint8), index))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds, flags, index = sent.value
        lengths = sorted({k[0] for k in kinds})
        for pdf in batches:
            for part in chunks(pdf.text.str.len().to_numpy()) if kinds else []:
                codes = [code_points(squeeze(t)) for t in pdf.text[part]]
                base = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
                held: list[tuple[np.ndarray, ...]] = []
                for q, h in zip(lengths, level_hashes(np.concatenate(codes), lengths), strict=True):
                    cell = (h & np.uint64(len(flags) * 8 - 1)).astype(np.int64)
                    pos = np.flatnonzero((flags[cell >> 3] >> (7 - (cell & 7))) & 1)
                    doc = np.searchsorted(base, pos, side="right") - 1
                    inside = pos + q <= base[doc + 1]
                    pos, doc = pos[inside], doc[inside]
                    keep = np.zeros(len(pos), bool)
                    for k, e, shortest, _ in kinds:
                        if k == q:
                            keep |= dense(pos, shortest, e, shortest - q + 1 - q * e)
                    pos, doc = pos[keep], doc[keep]
                    place = pos - base[doc]
                    held.append(index.pairs(doc, place, h[pos]) if index else (doc, h[pos].view(np.int64), place))
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                order = np.argsort(columns[0], kind="stable")
                doc, *values = (x[order] for x in columns)
                some, first = np.unique(doc, return_index=True)
                if len(some):
                    each = [np.split(v, first[1:]) for v in values]
                    yield pd.DataFrame({"doc_key": pdf.doc_key.to_numpy()[part][some], "text": pdf.text[part].to_numpy()[some], **dict(zip(("items",) if index else ("grams", "places"), each, strict=True))})

    rows = docs.select(F.col(doc_key).cast("bigint").alias("doc_key"), F.col(text).alias("text")).where(F.length("text") > 0)
    found = rows.mapInPandas(scan, "doc_key bigint, text string, " + ("items array<bigint>" if index else "grams array<bigint>, places array<bigint>"))
    found = written(found.withColumn("doc", F.monotonically_increasing_id()), "leak-documents")
    if index:
        pairs = found.select("doc", F.explode("items").alias("item")).distinct()
    else:
        shared = found.select("doc", F.explode(F.arrays_zip("grams", "places")).alias("g")).select("doc", F.col("g.grams").alias("gram"), F.col("g.places").alias("place"))
        shared = shared.join(post.select("item", "edits", "bound", "gram", "at"), "gram").withColumn("width", 2 * F.col("edits") + 2)
        shared = shared.select("doc", "item", "bound", (F.col("place") - F.col("at")).alias("diag"), "width", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
        band = F.floor((F.col("diag") + F.col("half") * F.floor(F.col("width") / 2)) / F.col("width"))
        bands = shared.groupBy("doc", "item", "half", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.first("bound").alias("bound"))
        pairs = bands.where(F.col("n") >= F.col("bound")).select("doc", "item").distinct()
    pairs = pairs.join(found.select("doc", "doc_key", "text"), "doc").join(own.select("item", "item_id", F.col("text").alias("item_text")), "item")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        ready = functools.lru_cache(maxsize=256)(lambda t: prepare_item(t, every, edits))
        for pdf in batches:
            out = []
            for i, k, t, d in zip(pdf.item_id, pdf.doc_key, pdf.item_text, pdf.text, strict=True):
                if (best := align(ready(t), code_points(squeeze(d)))) is not None:
                    out.append((i, k, *best))
            yield pd.DataFrame(out, columns=names)

    out = pairs.select("item_id", "doc_key", "item_text", "text").mapInPandas(verify, SCHEMA)
    rest = ["item_start", "item_end", "doc_start", "doc_end", "edits"]
    best = F.max(F.struct((F.col("item_end") - F.col("item_start")).alias("n"), (-F.col("edits")).alias("m"), *rest)).alias("best")
    return out.groupBy("item_id", "doc_key").agg(best, F.max("exact_units").alias("exact_units")).select("item_id", "doc_key", *[f"best.{c}" for c in rest], "exact_units")


def find_whole_passages(docs: DataFrame, items: DataFrame, **kw: object) -> DataFrame:
    """(item_id, doc_key) where the document holds a passage without any edit: the exact check after the search."""
    need = F.when(F.col("unspaced"), LETTERS).otherwise(WORDS)
    unspaced = F.pandas_udf(lambda s: s.map(lambda t: isinstance(t, str) and is_unspaced(t)).astype(bool), "boolean")
    kinds = items.select("item_id", unspaced("text").alias("unspaced")).dropDuplicates(["item_id"])
    return find_leaks(docs, items, **kw).join(kinds, "item_id").where(F.col("exact_units") >= need).select("item_id", "doc_key").distinct()
