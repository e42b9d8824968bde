"""Overlaps, groups and copies against brute force."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemill.llm import copies, groups, overlap

WORDS = "lamp cable steel handle quiet garden noise travel colour bright corner window kettle ladder basket mirror pocket rubber silver timber yellow anchor button candle doctor".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)) + "."


def edit(r, t, n):
    t = list(t)
    for _ in range(n):
        i = r.randrange(len(t))
        k = r.randrange(3)
        if k == 0:
            t[i] = r.choice("abcdefgh")
        elif k == 1:
            del t[i]
        else:
            t.insert(i, r.choice("abcdefgh"))
    return "".join(t)


def norm(t):
    return "".join(c for c in t.lower() if unicodedata.category(c)[0] in "LMN")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def reviews():
    r = random.Random(11)
    base = [sentence(r, 30) for _ in range(12)]
    texts = []
    for t in base:
        texts += [t, t.upper().replace(" ", "  "), edit(r, t, 4), edit(r, t, 9), sentence(r, 30)]
    texts += ["short text", "", None, base[0], base[0]]
    texts += ["窓の近くで雨の日に旅行用の予備の充電口はすぐに漏れました！仕事中に仕事中に去年買った電池は突然止まりました。台所で木製のブラシは便利です。", "窓の近くで雨の日に旅行用の予備の充電口はすぐに漏れました仕事中に仕事中に去年買った電池は突然止まりました。台所で木製のブラシは不便です。"]
    splits = ["train", "validation", "test", None]
    rows = [(f"r{i:03}", f"s{i % 3}", t) for i, t in enumerate(texts)]
    return rows, [(f"r{i:03}", splits[r.randrange(7) % 4] if i < len(texts) - 2 else ("train", "test")[i % 2]) for i in range(len(texts))] + [("gone", "train")]


def test_overlaps_equal_all_pairs(spark, reviews):
    rows, split = reviews
    df = spark.createDataFrame(rows + rows[:5], "review_id string, source string, clean_text string").withColumns({"norm": F.lit(1), "split": F.lit("x"), "cls": F.lit(2)})
    members, links = overlap.overlap_classes(df, spark.createDataFrame(split, "review_id string, split string"))
    got = {tuple(r) for r in overlap.overlap_pairs(members, links).collect()}
    side, text = dict(split), {i: norm(t or "") for i, _, t in rows}
    long = {i for i, t in text.items() if len(t) >= (50 if any("\u3040" < c < "\u30ff" for c in t) else 100)}
    want = set()
    for a in long:
        for b in long:
            if a < b and {side.get(a), side.get(b)} & {"train"} and {side.get(a), side.get(b)} & {"validation", "test"}:
                n = max(len(text[a]), len(text[b]))
                if abs(len(text[a]) - len(text[b])) * 10 <= n and distance(text[a], text[b]) * 10 <= n:
                    want.add((a, b))
    assert got == want and len(want) > 10
    cover = {(r["review_id"], r["coverage"] > 0) for r in overlap.record_coverage(members, links).collect()}
    assert {i for i, hit in cover if hit} == {x for p in want for x in p}


def test_overlaps_leave_no_shuffles_behind_and_are_the_same_in_passes(spark, reviews, monkeypatch):
    rows, split = reviews
    df, s = spark.createDataFrame(rows, "review_id string, source string, clean_text string"), spark.createDataFrame(split, "review_id string, split string")
    blocks = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if x.startswith("shuffle")}
    results, left, real = [], set(), overlap.written

    def write(df, what):
        before = blocks()
        out = real(df, what)
        left.update(blocks() - before)
        return out

    monkeypatch.setattr(overlap, "written", write)
    for chars in (overlap.PASS_CHARS, 1000):
        monkeypatch.setattr(overlap, "PASS_CHARS", chars)
        m, links = overlap.overlap_classes(df, s)
        results.append((sorted(map(tuple, links.collect())), {tuple(x) for x in overlap.overlap_pairs(m, links).collect()}))
    assert overlap.passes(10_000) == overlap.MAX_PASSES and results[0] == results[1] and len(results[0][1]) > 10
    assert not left


def test_codes_of_letter_counts_bound_the_edits():
    import numpy as np
    import pandas as pd

    r = random.Random(17)
    code = [int(x) for x in overlap.RING]
    assert all((code[a] ^ code[b]).bit_count() == min(abs(a - b), 16 - abs(a - b)) for a in range(16) for b in range(16))
    for n in (60, 700, 5000):
        a = sentence(r, n)
        for edits in (0, 1, n // 10):
            b = edit(r, a, edits)
            x, y = overlap.rings(pd.Series([a, b])).astype(np.int64).tolist()
            apart = sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y, strict=True))
            assert apart + abs(len(a) - len(b)) <= 2 * edits


def test_seeds_of_stock_phrases_end_where_letters_rule_the_pair_out(spark):
    """All texts share a phrase at one place, so all pairs meet there; only edited copies go on."""
    r = random.Random(19)
    phrase, letters = "it works as described and arrived on time today", "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for i in range(40):
        own = "".join(r.choice(letters[i % 20 : i % 20 + 6]) for _ in range(150))
        rows += [(2 * i, own + phrase, True, False), (2 * i + 1, own[:70] + "é" + own[71:] + phrase, False, True)]
    rows = [(i, t.replace(" ", ""), t, e) for i, t, e, _ in rows]
    c = spark.createDataFrame([(i, t, len(t), False, e, not e) for i, t, _, e in rows], "id bigint, norm string, n_chars int, unspaced boolean, in_train boolean, in_eval boolean")
    f, _ = overlap.fingerprints(spark, c)
    pairs = {(x[0], x[1]) for x in overlap.near_seeds(f).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(40)} <= pairs and len(pairs) < 40 * 40 / 4


def test_overlaps_of_empty_tables(spark):
    a = spark.createDataFrame([], "review_id string, source string, clean_text string")
    s = spark.createDataFrame([("x", "train")], "review_id string, split string")
    m, links = overlap.overlap_classes(a, s)
    assert overlap.overlap_pairs(m, links).count() == 0 and overlap.record_coverage(m, links).count() == 0


def test_very_long_texts(spark):
    r = random.Random(3)
    t = sentence(r, 4000)
    df = spark.createDataFrame([("a", "s", t), ("b", "s", edit(r, t, 50)), ("c", "s", sentence(r, 4000))], "review_id string, source string, clean_text string")
    s = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "test")], "review_id string, split string")
    assert [tuple(x) for x in overlap.overlap_pairs(*overlap.overlap_classes(df, s)).collect()] == [("a", "b")]


def test_recall_up_to_the_tenth(spark):
    """Pairs of random letters, edits at random places and evenly spread; all within the tenth."""
    r = random.Random(21)
    letters, rows, side, cases = "abcdefghijklmnopqrstuvwxyz", [], [], {}
    for n in (100, 120, 300, 800):
        for rate in (0.03, 0.06, 0.09):
            for spread in ("random", "even"):
                for i in range(25):
                    a = [r.choice(letters) for _ in range(n)]
                    b, m = list(a), int(n * rate)
                    for at in r.sample(range(n), m) if spread == "random" else [(2 * k + 1) * n // (2 * m) for k in range(m)]:
                        b[at] = r.choice([x for x in letters if x != a[at]])
                    key = f"{n}-{rate}-{spread}-{i}"
                    cases.setdefault((n, rate, spread), []).append((f"{key}a", f"{key}b"))
                    rows += [(f"{key}a", "s", "".join(a)), (f"{key}b", "s", "".join(b))]
                    side += [(f"{key}a", "train"), (f"{key}b", "test")]
    m, links = overlap.overlap_classes(spark.createDataFrame(rows, "review_id string, source string, clean_text string"), spark.createDataFrame(side, "review_id string, split string"))
    got = {tuple(x) for x in overlap.overlap_pairs(m, links).collect()}
    recall = {c: len(got & set(p)) / len(p) for c, p in cases.items()}
    assert got <= {x for p in cases.values() for x in p}
    assert min(recall.values()) >= 0.96 and len(got) >= 0.99 * sum(map(len, cases.values())), recall


def test_winnowing_shares_fingerprints_of_common_runs():
    import numpy as np

    r = random.Random(5)
    sketch = np.random.default_rng(1).integers(0, 12, (2, 1 << 12)).astype(np.uint8)
    for i in range(300):
        k, w = overlap.LEVELS[-1]
        run = "".join(r.choice("abcdef") for _ in range(k + w - 1))
        picks = []
        for _ in range(2):
            x = overlap.code_points("".join(r.choice("abcdef") for _ in range(30)) + run + "".join(r.choice("abcdef") for _ in range(30)))
            hashes = [np.append(h, np.zeros(len(x) - len(h), np.uint64)) for h in overlap.level_hashes(x, [k for k, _ in overlap.LEVELS])]
            cells = hashes[-1][30 : 30 + w] & np.uint64(sketch.shape[1] - 1)
            sketch[:, cells.astype(int)] = np.maximum(sketch[:, cells.astype(int)], 1)  # what both share is held on both sides
            picks.append((hashes, x))
        a, b = ({int(h[p]) for h, (at, _) in zip(hashes, overlap.chosen(hashes, overlap.LEVELS, sketch), strict=True) for p in at} for hashes, _ in picks)
        assert a & b, i


def test_chain_and_its_alignment():
    r = random.Random(8)
    for _ in range(200):
        seeds = [(r.randrange(9), r.randrange(9)) for _ in range(r.randrange(0, 9))]
        best = max((len(c) for k in range(1 << len(seeds)) for c in [[s for i, s in enumerate(sorted(set(seeds))) if k >> i & 1]] if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:], strict=False))), default=0)
        assert len(overlap.chain(seeds)) == best
    for n in (0, 3, 12):
        a = "".join(r.choice("abcdefghij") for _ in range(3000))
        b = edit(r, a, n)
        k = 9
        seeds = [(i, j) for i in range(0, len(a) - k, 7) for j in [b.find(a[i : i + k])] if j >= 0]
        assert distance(a[:300], b[:300]) <= n + abs(len(a) - len(b)) and overlap.chained_distance(a, b, seeds, 300) <= n
    assert overlap.chained_distance("a" * 50, "b" * 50, [], 5) == 6


def test_very_long_pairs_are_aligned_along_the_chain(spark):
    r = random.Random(13)
    t = sentence(r, 9000)
    rows = [("a", "s", t), ("b", "s", edit(r, t, 400)), ("c", "s", sentence(r, 9000)), ("d", "s", t[: len(t) // 2] * 2)]
    df = spark.createDataFrame(rows, "review_id string, source string, clean_text string")
    s = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "test"), ("d", "test")], "review_id string, split string")
    m, links = overlap.overlap_classes(df, s)
    assert [tuple(x) for x in overlap.overlap_pairs(m, links).collect()] == [("a", "b")]
    d = links.first()
    assert d["n_chars"] > overlap.LONG and d["distance"] <= 400


# ---- groups


def test_groups_equal_union_find(spark):
    r = random.Random(2)
    rows = [(f"p{r.randrange(60):02}", r.choice([None, "", f"q{r.randrange(40):02}", f"p{r.randrange(60):02}"])) for _ in range(90)]
    rows += [(None, "q01"), ("", "q02"), ("a", "a"), ("a", None)] + [(f"h{i:02}", "hub") for i in range(40)] * 2
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        ends = [find(x) for x in (a, b) if x]
        if len(ends) == 2 and ends[0] != ends[1]:
            parent[ends[0]] = ends[1]
    items = {a for a, _ in rows if a}
    best = {}
    for a in items:
        best[find(a)] = min(best.get(find(a), a), a)
    df = spark.createDataFrame(rows, "product_id string, parent_product_id string").withColumns({"node": F.lit(1), "root": F.lit(2), "group_key": F.lit(3)})
    got = {x["product_id"]: x["group_key"] for x in groups.product_groups(df).collect()}
    assert got == {a: best[find(a)] for a in items}


def test_split_keeps_groups_and_meets_shares(spark):
    r = random.Random(9)
    rows = [(f"p{int(r.paretovariate(0.8)) % 300}", f"q{r.randrange(500)}") for _ in range(3000)]
    rows = [(a, f"q{a}" if i % 2 else None) for i, (a, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "product_id string, parent_product_id string")
    got = groups.grouped_split(df).collect()
    by = {}
    for x in got:
        by.setdefault(x["group_key"], set()).add(x["split"])
    assert all(len(s) == 1 for s in by.values()) and len(got) == len({a for a, _ in rows})
    n = {}
    for k, size, split in {(x["group_key"], x["n_group"], x["split"]) for x in got}:
        n[split] = n.get(split, 0) + size
    assert sum(n.values()) == 3000 and abs(n.get("test", 0) - 300) <= 1 and abs(n.get("validation", 0) - 300) <= 1
    assert groups.grouped_split(df.limit(0)).count() == 0


def test_closest_subset_is_the_best():
    import itertools

    r = random.Random(4)
    for _ in range(60):
        sizes = [r.randrange(1, 12) for _ in range(r.randrange(1, 10))]
        target = r.uniform(0, sum(sizes))
        mult = {s: sizes.count(s) for s in sizes}
        took = groups.closest_subset(mult, target)
        assert all(took[s] <= mult[s] for s in took)
        best = min(abs(sum(c) - target) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k))
        assert abs(abs(sum(s * n for s, n in took.items()) - target) - best) < 1e-9
    assert groups.closest_subset({}, 0.0) == {}
    big = groups.closest_subset({10**9: 3, 7: 10**6, 1: 10**6}, 5e8)
    assert sum(s * n for s, n in big.items()) == 8 * 10**6 and sum(s * n for s, n in groups.closest_subset({1: 10**7}, 123456).items()) == 123456


def test_closest_subset_is_exact_at_any_size():
    total = lambda took: sum(s * n for s, n in took.items())
    assert abs(total(groups.closest_subset({11: 264_000}, 290_400.0)) - 290_400) <= 5  # 2.9 M rows
    r = random.Random(6)
    for low, high, n in ((6, 11, 300_000), (50, 110, 50_000), (1, 2000, 3000), (500, 900, 4000)):
        sizes = {}
        for _ in range(n):
            s = r.randrange(low, high + 1)
            sizes[s] = sizes.get(s, 0) + 1
        target = 0.1 * total(sizes)
        took = groups.closest_subset(sizes, target)
        assert all(took[s] <= sizes[s] for s in took) and abs(total(took) - target) <= 0.5
    assert total(groups.closest_subset({10**6: 3, 999_999: 2}, 1_999_998.6)) == 1_999_999


# ---- copies


def records(spark, rows):
    return spark.createDataFrame(rows, "ingest_seq long, product_id string, text string")


def brute(rows):
    out = {}
    for s, p, t in rows:
        p = (p or "").strip().casefold()
        c = "".join(x for x in (t or "").casefold() if unicodedata.category(x)[0] in "LM" or unicodedata.category(x) == "Nd")
        if p and c:
            n, f = out.get((p, c), (0, s))
            out[p, c] = (n + 1, min(f, s))
    return sorted(out.values())


@pytest.mark.parametrize("fit", [copies.FIT, 1, 60, 2000])
def test_copies_equal_grouping(spark, fit):
    r = random.Random(8)
    rows, seq = [], 0
    for _ in range(60):
        t, p = sentence(r, r.randrange(1, 6)), f"B{r.randrange(4)}"
        for _ in range(r.choice([1, 1, 2, 5])):
            seq += 1
            rows.append((seq, r.choice([p, f" {p.lower()}\t", p]), r.choice([t, t.upper(), t.replace(" ", " - "), f"«{t}»"])))
    rows += [(900 + i, "hot", "the very same text") for i in range(300)] + [(5000, "B", "the very same text, longer"), (5001, "B", "the"), (5002, "B", "The!")]
    rows += [(6000, None, "x"), (6001, "", "x"), (6002, " ", "x"), (6003, "B", None), (6004, "B", "?!"), (6005, "B", ""), (6006, "S", "Straße"), (6007, "S", "STRASSE"), (6008, "L", "long " * 20000), (6009, "L", "Long! " * 20000)]
    got = sorted((x["n_copies"], x["first_seq"]) for x in copies.count_copies(records(spark, rows), fit=fit).collect())
    assert got == brute(rows)


def test_long_shared_beginnings_take_few_rounds(spark, monkeypatch):
    r = random.Random(12)
    rows = [(i, "P", "x" * 3000 + r.choice(["", "y" * 500]) + sentence(r, 3)) for i in range(400)]
    rows += [(1000 + i, "P", rows[i][2].upper()) for i in range(50)]
    rounds = []
    real = copies.written
    monkeypatch.setattr(copies, "written", lambda df, what: rounds.append(what) or real(df, what))
    got = sorted((x["n_copies"], x["first_seq"]) for x in copies.count_copies(records(spark, rows), fit=20_000).collect())
    assert got == brute(rows) and 2 <= rounds.count("copies-over") <= 5
    entries = spark.createDataFrame([(b"x" * 3000 + bytes([i]) * 9,) for i in range(90)], "canon binary")
    sizes = {}
    for x in copies.radix_buckets(entries, 9000).collect():
        sizes[bytes(x["bucket"])] = sizes.get(bytes(x["bucket"]), 0) + len(x["canon"])
    assert len(sizes) == 90 and max(sizes.values()) <= 9000


def test_copies_of_an_empty_table(spark):
    assert copies.count_copies(records(spark, [])).count() == 0


def test_trie_counts_like_a_table():
    r = random.Random(1)
    t, want = copies.Trie(), {}
    for i in range(5000):
        k = bytes(r.choice(b"ab") for _ in range(r.randrange(0, 24)))
        t.add(k, 1, i)
        n, f = want.get(k, (0, i))
        want[k] = (n + 1, min(f, i))
    assert {k: tuple(c) for k, c in t.items()} == want


def test_payloads(spark):
    rows = [
        (1, json.dumps({"asin": "A", "text": "one"})),
        (2, json.dumps({"review_body": "one", "product_id": " a "})),
        (3, '{"asin": "A", "text": "one'),
        (4, "[1, 2]"),
        (5, None),
        (6, json.dumps({"asin": 7, "reviewText": None, "other": {"text": "x"}})),
    ]
    got = {r["ingest_seq"]: (r["product_id"], r["text"]) for r in copies.payload_records(spark.createDataFrame(rows, "ingest_seq long, payload string")).collect()}
    assert got[1] == ("A", "one") and got[2] == (" a ", "one") and 3 not in got and got[6] == ("7", None)
