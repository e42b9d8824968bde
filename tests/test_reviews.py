import hashlib
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import aliases as al
from tidemill.functions import cleaning as cl
from tidemill.operators import aspects, audit, clustering, dedupe, embedding, graph, sampling, spans
from tidemill.operators.sentences import review_sentences, split_into_sentences
from tidemill.plans.config import load_settings, settings_hash
from tidemill.plans.pipeline import main, run
from tidemill.sources import reviews as src
from tidemill.sources import sinks
from tidemill.sources.synthetic import EDGE_CASES, synthetic_reviews
from tidemill.streaming import reviews as stream


def values(spark, texts, col):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", col(F.col("t")).alias("x")).orderBy("i").collect()]


# ---- cleaning and casts


def test_clean(spark):
    texts = ["Tom &amp; Jerry &lt;love&gt;", "a\n\n\n\n\nb", "x\x00\x07y", None, "", "see https://a.example/b?c=1 now", "mail me@a.example now", "  two   blanks\t ", "é", "<p>Hi</p> &bogus; there", "  x　"]
    got = values(spark, texts, cl.clean)
    assert got == ["Tom & Jerry", "a\n\nb", "xy", "", "", "see now", "mail now", "two blanks", "é", "Hi there", "x"]


def test_clean_reviews_keeps_raw_and_drops_short(spark):
    df = spark.createDataFrame([(1, "<b>a long enough text here</b>", None, "<i>T</i>", 9), (2, "OK", None, None, 9), (3, None, "from raw text, also long", None, 9)], "ingest_seq int, text string, raw_text string, title string, lang int")
    got = {r["ingest_seq"]: r for r in cl.clean_reviews(df.withColumn("clean_text", F.lit(""))).collect()}
    assert set(got) == {1, 3} and got[1]["clean_text"] == "a long enough text here" and got[1]["raw_text"].startswith("<b>") and got[1]["title"] == "T"
    n = cl.cleaning_counts(df).first()
    assert (n["n_rows"], n["n_empty"], n["n_short"], n["n_kept"]) == (3, 0, 1, 2)


def test_ids_and_ngrams(spark):
    r = spark.range(1).select(cl.stable_id(F.lit("a"), F.lit(None), F.lit("ü")).alias("x")).first()["x"]
    assert r == hashlib.sha256("a||ü".encode()).hexdigest()
    assert values(spark, ["abcd", "ab", "aaaa"], cl.char_ngrams) == [["abc", "bcd"], ["ab"], ["aaa"]]


def test_discover_and_normalise(spark):
    assert src.discover_schema(["reviewText", "ASIN", "Star Rating", "zzz"]) == {"reviewText": "text", "ASIN": "product_id", "Star Rating": "rating"}
    df = spark.createDataFrame([(None, "hello", "4.5", "yes", 3.9), ("p", None, "bad", "no", float("nan"))], "asin string, text string, overall string, verified string, vote double")
    a, b = src.normalise(df, "s").collect()
    assert (a["product_id"], a["rating"], a["verified_purchase"], a["helpful_vote"], a["raw_text"]) == ("", 4.5, True, 3, "hello")
    assert (b["product_id"], b["parent_product_id"], b["text"], b["rating"], b["verified_purchase"], b["helpful_vote"]) == ("p", "p", "", -1.0, False, 0)
    only = src.normalise(spark.createDataFrame([(["x", "y"],)], "text array<string>")).first()
    assert only["text"] == "x" and only["rating"] == -1.0 and only["verified_purchase"] is False
    later = src.normalise(spark.createDataFrame([("first", "second")], "text string, review_body string")).first()
    assert later["text"] == "second"


def test_loader_reads_all_formats_and_reports_bad_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one", "asin": "A"}\nnot json\n\n{"text": "two", "asin": "B"}\n')
    (tmp_path / "b.json").write_text(json.dumps([{"reviewText": "three", "asin": "C", "overall": 5}]))
    (tmp_path / "c.csv").write_text('text,asin,rating\n"four, with ""quotes""",D,2\n,E,\n')
    (tmp_path / "d.parquet").write_text("no parquet")
    sub = tmp_path / "sub"
    sub.mkdir()
    spark.createDataFrame([("five", "F")], "text string, asin string").toPandas().to_parquet(sub / "e.parquet")
    df, errors = src.load_reviews(spark, str(tmp_path))
    rows = {r["product_id"]: r for r in df.collect()}
    assert set(rows) == set("ABCDEF") and rows["D"]["text"] == 'four, with "quotes"' and rows["E"]["text"] == "" and rows["E"]["rating"] == -1.0 and rows["C"]["rating"] == 5.0
    assert len(errors) == 1 and errors[0][0].endswith("d.parquet")
    assert src.load_reviews(spark, str(tmp_path), max_reviews=3)[0].count() == 3
    assert src.load_reviews(spark, str(tmp_path / "none"))[0].count() == 0
    assert src.load_by_category(spark, {"Toys": str(sub), "None": str(tmp_path / "none")})[0].first()["category"] == "Toys"
    sinks.append_errors(spark, errors, str(tmp_path / "errors"))
    assert spark.read.json(str(tmp_path / "errors")).count() == 1


def test_files_of_the_same_fields_are_one_scan(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"x y{i:02}.jsonl").write_text("".join(json.dumps({"text": f"t{i}-{k}", "asin": f"A{i}"}) + "\n" for k in range(3)))
    (tmp_path / "z.jsonl").write_text('{"review_body": "other fields", "product_id": "Z"}\n')
    (tmp_path / "empty.jsonl").write_text("")
    df, errors = src.load_reviews(spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    got = sorted((r["source"], r["text"]) for r in df.collect())
    assert got == sorted([(f"x y{i:02}", f"t{i}-{k}") for i in range(12) for k in range(3)] + [("z", "other fields")])
    assert [p.rsplit("/", 1)[1] for p, _ in errors] == ["empty.jsonl"]
    assert [r["text"] for r in src.load_reviews(spark, str(tmp_path), max_reviews=4)[0].collect()] == ["t0-0", "t0-1", "t0-2", "t1-0"]


def test_small_files_go_through_the_file_system(spark, tmp_path):
    from tidemill.sources import files

    path = f"file://{tmp_path}/deep/er/x.json"
    sinks.write_json({"a": "ü"}, path)
    assert sinks.read_json(path) == {"a": "ü"} == sinks.read_json(str(tmp_path / "deep/er/x.json"))
    assert files.exists(path) and not files.exists(f"file://{tmp_path}/no") and files.read_text(f"file://{tmp_path}/no") is None
    assert [f for f, _, _ in files.list_files(f"file://{tmp_path}")][-1].endswith("/deep/er/x.json") and files.list_files(str(tmp_path / "no")) == []


def test_languages_of_documents(spark):
    from tidemill.functions.language import detect_language

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(lang) = 2 AND length(text) >= 60")
    got = d.select("lang", detect_language(F.col("text")).alias("own")).groupBy(F.expr("lang = own").alias("same")).count().collect()
    n = {r["same"]: r["count"] for r in got}
    assert n.get(True, 0) >= 0.97 * sum(n.values())
    assert values(spark, [None, "", "123 !", "xyzzy"], detect_language) == [None] * 4
    df = spark.createDataFrame([("The lamp was very good and it works for us",), ("Die Lampe ist sehr gut und nicht teuer",)], "text string").withColumns({"title": F.lit(""), "raw_text": F.lit(""), "clean_text": F.lit("")})
    assert [r["text"][:3] for r in cl.clean_reviews(df, 5, "de").collect()] == ["Die"]


def test_candidates_have_a_type_of_their_own(spark):
    from tidemill.functions.aliases import candidate_type

    assert values(spark, ["Fast Shipping", "bubble wrap", "refund", "the store", "screen", "courier"], candidate_type) == ["delivery", "packaging", "service", "seller", "product", "product"]


def test_a_model_that_cannot_be_loaded_shows(spark):
    s = spark.createDataFrame([("s1", "r1", "The battery life is short.", 0)], "sentence_id string, review_id string, text string, start_char int")

    def load():
        raise OSError("no weights")

    with pytest.warns(UserWarning):
        assert {r["origin"] for r in aspects.model_aspects(s, load).collect()} == {"fallback"}
    with pytest.raises(OSError):
        aspects.model_aspects(s, load, fallback=False)


def test_chunks(spark):
    got = [r["chunk_id"] for r in src.chunked(spark.range(0, 2500).withColumnRenamed("id", "ingest_seq"), 1000).orderBy("ingest_seq").collect()]
    assert got == [i // 1000 for i in range(2500)]


def test_alias_file_and_json_documents(spark, tmp_path):
    sinks.write_aliases({"panel": "screen"}, str(tmp_path / "a.yaml"))
    assert src.read_aliases(str(tmp_path / "a.yaml")) == {"panel": "screen"} and src.read_aliases(str(tmp_path / "no")) == {}
    assert sinks.read_json(str(tmp_path / "no.json")) is None
    sinks.mark_done(str(tmp_path), "s", "h", n=1)
    assert sinks.is_done(str(tmp_path), "h") and not sinks.is_done(str(tmp_path), "other")


# ---- duplicates


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ingest_seq long, clean_text string").withColumns({"text": F.lit(None).cast("string"), "raw_text": F.lit(None).cast("string")})


def test_exact_duplicates(spark):
    df = rows(spark, ["Same Text", "same text ", "", "", None, "other"])
    assert [r["ingest_seq"] for r in dedupe.exact_deduplicate(df).orderBy("ingest_seq").collect()] == [0, 2, 3, 4, 5]
    assert dedupe.exact_deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_near_duplicates_equal_a_pass_in_order(spark, threshold):
    r = random.Random(int(threshold * 10))
    base = ["the sound quality is great and the battery lasts long", "a steel handle that never gets warm in the kitchen", "it broke at once"]
    texts = []
    for _ in range(60):
        t = list(r.choice(base))
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = r.choice("abcdefgh ")
        texts.append("".join(t))
    texts += ["", "", texts[0], "ab"]
    kept, drop = [], []
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)} if len(t) > 3 else {t}
    for i, t in enumerate(texts):
        k = t.lower().strip()
        if k and any(len(grams(k) & g) / len(grams(k) | g) >= threshold for g in kept):
            drop.append(i)
        elif k:
            kept.append(grams(k))
    got = [r["ingest_seq"] for r in dedupe.near_duplicates(rows(spark, texts), threshold).where("is_duplicate").orderBy("ingest_seq").collect()]
    assert got == drop
    assert dedupe.near_duplicates(rows(spark, texts), 1.0).where("is_duplicate").count() == 0


def shuffled(spark):
    """Records that all stages so far have written for a shuffle, by stage."""
    gw = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gw.new_array(gw.jvm.double, 0), gw.jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_similar_pairs_of_stock_words_meet_by_buckets(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(4, 9))) for _ in range(40)]
    texts = [" ".join(r.sample(words, 30)) for _ in range(1000)]  # every n-gram of a word is in most texts
    for t in texts[:60]:
        i = r.randrange(10, len(t) - 10)
        texts.append(r.choice([t[:i] + "\U0001f600" + t[i:], t[:i] + t[i + 3 :], t + " " + t[:9]]))
    texts += ["a", "ab", "abc", "\U0001f600", "aaaaaaaa", "aaaaaaaaa", words[0], words[0] + words[0], words[0] * 3]
    sets = [{t[i : i + 3] for i in range(max(1, len(t) - 2))} for t in texts]
    want = {}
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if len(a) >= 0.9 * len(b) - 1e-9 and len(b) >= 0.9 * len(a) - 1e-9 and (n := len(a & b)) >= 0.9 * (len(a) + len(b) - n) - 1e-12:
                want[i, j] = n / (len(a) + len(b) - n)
    before = shuffled(spark)
    got = {(x["a"], x["b"]): x["similarity"] for x in dedupe.similar_pairs(rows(spark, texts), 0.9).collect()}
    assert len(want) >= 60 and got == want
    assert sum(n for k, n in shuffled(spark).items() if k not in before) < 200 * len(texts)  # not a record for each pair of texts that share an n-gram


@pytest.mark.parametrize("threshold", [0.55, 0.75, 0.9, 0.97])
def test_buckets_that_similar_sets_share(threshold):
    r = np.random.default_rng(int(threshold * 100))
    met = 0
    while met < 100:
        a = r.choice(2**40, int(r.integers(1, 300)), replace=False).astype(np.uint64)
        most = int((1 - threshold) / threshold * len(a))
        b = np.unique(np.concatenate([a[int(r.integers(0, most + 1)) :], r.choice(2**40, int(r.integers(0, most + 1)), replace=False).astype(np.uint64)]))
        n = len(np.intersect1d(a, b))
        if n == 0 or n < threshold * (len(a) + len(b) - n):
            continue
        met += 1
        low, buckets = dedupe._size_classes(threshold, max(len(a), len(b)))
        own, under = [], []
        for s in (a, b):
            h, one = dedupe._mix(s), np.zeros(len(s), np.int64)
            c = np.searchsorted(low, [len(s)], "right") - 1
            own.append(set(dedupe._bucket_hashes(h, one, c, buckets[c])[0].tolist()))
            under.append(set(dedupe._bucket_hashes(h, one, c - 1, buckets[np.maximum(c - 1, 0)])[0].tolist()))
        assert own[0] & (own[1] | under[1]) or own[1] & under[0]


# ---- samples and splits


@pytest.fixture(scope="module")
def corpus(spark):
    return synthetic_reviews(spark).cache()


def test_corpus(spark, corpus):
    texts = [r["text"] for r in corpus.collect()]
    assert set(EDGE_CASES) <= set(texts) and len(texts) - len(set(texts)) >= 4
    assert [r["text"] for r in synthetic_reviews(spark, 1).orderBy("ingest_seq").collect()] != [r["text"] for r in corpus.orderBy("ingest_seq").collect()]


def test_samples(corpus):
    n = {r["category"]: r["count"] for r in sampling.sample_by_category(corpus, ["Home", "Beauty"], 5, 1).groupBy("category").count().collect()}
    assert n == {"Home": 5, "Beauty": 5}
    p = sampling.sample_by_product(corpus, ["Home-1", "none", "Home-2"], 1, 3, 1).collect()
    assert {r["product_id"] for r in p} == {"Home-1"} and len(p) == 3
    one = lambda s: [r["review_id"] for r in sampling.random_sample(corpus, 10, s).collect()]
    assert one(1) == one(1) != one(2) and len(one(1)) == 10
    assert sampling.sample_by_rating(corpus, 2, 1).count() == 6


def test_rating_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (2.5, 3.5, -1.0, 0.0, 0.2, 9.0, None)], "r double")
    assert [r[0] for r in df.select(sampling.rating_bucket(F.col("r"))).collect()] == [2, 4, 0, 0, 1, 5, 0]


def test_split_keeps_products_apart(corpus):
    s = sampling.split_reviews(corpus, seed=3).cache()
    assert s.count() == corpus.count()
    sizes = {r["split"]: r["n_products"] for r in audit.split_sizes(s).collect()}
    assert sizes["train"] == 16 and sum(sizes.values()) == 20
    leaks = {(r["kind"], r["n_shared"] > 0) for r in sampling.split_leaks(s).collect()}
    assert ("product_id", True) not in leaks and ("review_id", True) not in leaks
    other = sampling.split_reviews(corpus, seed=4).where("split = 'test'").select("product_id").distinct().collect()
    assert other != s.where("split = 'test'").select("product_id").distinct().collect()
    r = {x["split"]: x["count"] for x in sampling.split_reviews(corpus, by_product=False).groupBy("split").count().collect()}
    assert r["train"] == int(corpus.count() * 0.8)


def test_unseen_and_isolation(spark, corpus):
    known = corpus.where("category = 'Home'")
    assert {r["category"] for r in sampling.unseen(corpus, known, "category").select("category").distinct().collect()} == {"Electronics", "Beauty", "Sports"}
    assert sampling.unseen(corpus, known, "category", 7).count() == 7
    with pytest.raises(Exception, match="synthetic"):
        sampling.assert_real_only(corpus).collect()
    assert sampling.assert_real_only(corpus.withColumn("source", F.lit("hub"))).count() == corpus.count()


# ---- sentences and aspects


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One here. Two there! Three?", ["One here.", "Two there!", "Three?"]),
        ("Dr. Smith paid 3.50 for it. Fine.", ["Dr. Smith paid 3.50 for it.", "Fine."]),
        ("It has approx. 3 parts etc. The rest is fine.", ["It has approx. 3 parts etc.", "The rest is fine."]),
        ("First part\n\nSecond part", ["First part", "Second part"]),
        ("Wait... What?! No.", ["Wait...", "What?!", "No."]),
        ("", []),
        ("   ", []),
        (None, []),
        ("no end", ["no end"]),
    ],
)
def test_rule_sentences(spark, text, want):
    assert values(spark, [text], split_into_sentences) == [want]


def test_sentence_offsets(spark):
    text = "  One here. “Two there!”\n\nThree é… Four "
    df = spark.createDataFrame([("r", text)], "review_id string, clean_text string").withColumns({"text": F.lit(""), "raw_text": F.lit("")})
    got = review_sentences(df).collect()
    assert len(got) >= 3 and all(text[r["start_char"] : r["end_char"]] == r["text"] for r in got)


def greedy(text):
    import re

    from tidemill.functions import lexicon as lx

    toks = [m.span() for m in re.finditer(rf"\b{lx.TOKEN}\b", text)]
    alone = {*lx.PRONOUNS, *lx.STOPWORDS, *lx.OPINION_WORDS, *lx.GENERIC_NOUNS, *lx.STANDALONE_GENERIC}
    edges = {*lx.STOPWORDS, *lx.PRONOUNS}

    def ok(s):
        w = s.lower().split()
        return len(s) >= 2 and len(w) <= 4 and not (len(w) == 1 and w[0] in alone) and not set(w) & set(lx.COPULAS_AND_CONJUNCTIONS) and w[-1] not in lx.OPINION_WORDS and w[0] not in edges and w[-1] not in edges

    kept = []
    for n in range(4, 0, -1):
        for i in range(len(toks) - n + 1):
            a, b = toks[i][0], toks[i + n - 1][1]
            if ok(text[a:b]) and not any(x <= a and b <= y for x, y in kept):
                kept.append((a, b))
    return sorted(text[a:b] for a, b in kept)


def test_aspects_are_the_longest_matches(spark):
    texts = ["The sound quality is great but the battery life, honestly, is poor.", "It came with a third-party seller's box and wasn't sealed.", "a-b-c d", "", "it they the", "Great screen, terrible keyboard and a so-so trackpad!"]
    df = spark.createDataFrame([(str(i), str(i), t, 5) for i, t in enumerate(texts)] + [("n", "n", None, 0)], "sentence_id string, review_id string, text string, start_char int")
    got = aspects.extract_aspects(df).collect()
    for i, t in enumerate(texts):
        mine = [r for r in got if r["sentence_id"] == str(i)]
        assert sorted(r["surface"] for r in mine) == greedy(t)
        assert all(t[r["start_char"] : r["end_char"]] == r["surface"] and r["doc_start_char"] == r["start_char"] + 5 for r in mine)
    assert aspects.extract_aspects(df.limit(0)).count() == 0


def test_aspect_queries_fall_back_where_cleaning_has_not_run(spark, tmp_path):
    from tidemill import queries_reviews as q

    one, two = "The battery life is poor.", "The sound quality is great."
    rows = [(1, "a", two, two, two), (2, "a", None, one, "x"), (3, "b", "", one, None), (4, "c", None, "", two), (5, "d", one, two, two), (6, "e", None, None, "")]
    df = spark.createDataFrame(rows, "ingest_seq long, review_id string, clean_text string, text string, raw_text string")
    df.withColumns({"product_id": F.lit("p"), "category": F.lit("C")}).write.parquet(f"{tmp_path}/reviews.parquet")
    got = {(r["review_id"], r["surface"]) for r in q.aspect_candidates(spark, str(tmp_path)).collect()}
    assert got == {(k, x) for k, t in (("a", one), ("b", one), ("c", two), ("d", one)) for x in greedy(t)}
    n = q.offset_audit(spark, str(tmp_path)).first()
    assert n["n_mentions"] == len(got) and n["n_broken"] == 0
    assert q.aspect_counts(spark, str(tmp_path)).agg(F.sum("mentions")).first()[0] == len(got)


def test_filters(spark):
    words = ["it", "they", "the", "thing", "product", "quality", "battery life", "screen", "camera", "great", "the screen", "screen is big", "x", "a b c d e", ""]
    assert values(spark, words, lambda c: aspects.is_valid_aspect(c)) == [False] * 6 + [True] * 3 + [False] * 6


def test_types_and_aliases(spark):
    s = ["delivery speed", "bubble wrap", "warranty", "third-party seller", "display", "panel", "runtime", "speakers", "batteries", "lens", "glass"]
    assert values(spark, s[:5], lambda c: al.aspect_type(c)) == ["delivery", "packaging", "service", "seller", "product"]
    assert values(spark, s[4:], lambda c: al.resolve_alias(c)) == ["screen", "screen", "battery", "speaker", "battery", "len", "glass"]
    assert values(spark, ["panel"], lambda c: al.resolve_alias(c, al.alias_table({"Panel": "Dashboard"}))) == ["dashboard"]
    pairs = [("screen", "screen", True), ("screen", "screen protector", False), ("sound quality", "build quality", False), ("phone", "phone case", False), ("screen", "display", True), ("picture quality", "sound quality", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r["x"] == r["want"] for r in df.select(al.can_merge(F.col("a"), F.col("b")).alias("x"), "want").collect())


def _broken():
    raise OSError("no model here")


def test_model_aspects_and_their_fallback(spark):
    def _tagger():
        def predict(texts):
            out = []
            for t in texts:
                words, at = [], 0
                for w in t.split(" "):
                    words.append((at, at + len(w)))
                    at += len(w) + 1
                out.append((words, ["B-ASP" if t[a:b] in ("screen", "battery") else "I-ASP" if t[a:b] == "life" else "O" for a, b in words], [0.5] * len(words)))
            return out

        return predict

    df = spark.createDataFrame([("s", "r", "the screen and battery life", 5), ("n", "r", None, 0)], "sentence_id string, review_id string, text string, start_char int")
    got = aspects.model_aspects(df, _tagger).collect()
    assert sorted((r["surface"], r["doc_start_char"], r["confidence"], r["aspect_type"]) for r in got) == [("battery life", 20, 0.5, "product"), ("screen", 9, 0.5, "product")]
    rules = aspects.model_aspects(df, _broken)
    assert sorted(r["surface"] for r in rules.collect()) == sorted(r["surface"] for r in aspects.extract_aspects(df).collect()) and rules.columns == aspects.model_aspects(df, _tagger).columns


def test_projection(spark):
    from pyspark.sql import types as T

    from tidemill.functions.casts import project_to

    r = project_to(spark.createDataFrame([("1", None, 3)], "a string, b string, z int"), T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("c", T.DoubleType())]), {"b": "", "c": -1.0}).first()
    assert r.asDict() == {"b": "", "a": 1, "c": -1.0}


# ---- spans


def test_bio(spark):
    text = "The sound quality of the mic and battery life"
    words = [(0, 3), (4, 9), (10, 17), (18, 20), (21, 24), (25, 28), (29, 32), (33, 40), (41, 45), (0, 0)]
    labels = ["O", "B-ASP", "I-ASP", "O", "O", "B-ASP", "O", "I-ASP", "I-ASP", "B-ASP"]
    df = spark.createDataFrame([(text, words, labels, [0.5] * 10), ("", [], [], [])], "text string, o array<struct<start:int,end:int>>, l array<string>, c array<double>")
    got = [r["x"] for r in df.select(spans.spans_from_bio(F.col("text"), F.col("o"), F.col("l")).alias("x")).collect()]
    assert [text[x["start"] : x["end"]] for x in got[0]] == ["sound quality", "mic", "battery life"] and got[1] == []
    assert {round(x["confidence"], 6) for x in got[0]} == {0.9}
    conf = df.select(spans.spans_from_bio(F.col("text"), F.col("o"), F.col("l"), F.col("c")).alias("x")).first()["x"]
    assert {x["confidence"] for x in conf} == {0.5}
    back = df.limit(1).select(spans.bio_from_spans(F.col("o"), F.array(F.struct(F.lit(4).alias("start"), F.lit(17).alias("end")))).alias("x")).first()["x"]
    assert back == ["O", "B-ASP", "I-ASP", "O", "O", "O", "O", "O", "O", "O"]


def test_metrics(spark):
    shape = "gold array<struct<start:int,end:int>>, pred array<struct<start:int,end:int>>"
    m = spans.span_metrics(spark.createDataFrame([([(4, 17), (35, 45)], [(4, 17), (36, 45)])], shape)).first()
    assert (m["exact_span_f1"], m["partial_span_f1"]) == (0.5, 1.0)
    assert spans.span_metrics(spark.createDataFrame([], shape)).first()["exact_span_f1"] == 0.0
    b = spans.bio_metrics(spark.createDataFrame([(["B-ASP", "I-ASP", "O"], ["B-ASP", "O", "O"])], "gold array<string>, pred array<string>")).first()
    assert (b["precision"], b["recall"], b["f1"], b["macro_f1"]) == (1.0, 0.5, 0.6667, 0.5)


# ---- vectors, graphs, clusters


def plain_vector(text):
    v = [0.0] * 384
    s = text.lower().strip()
    padded = f" {s} "
    parts = [(hashlib.md5, w, 1.5) for w in s.split()] + [(hashlib.sha256, padded[j : j + 3], 0.8) for j in range(max(1, len(padded) - 2))]
    for f, x, w in parts:
        h = int(f(x.encode()).hexdigest(), 16)
        v[h % 384] += w if (h >> 8) & 1 else -w
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n > 1e-9 else [1.0] + v[1:]


def test_embedding(spark, tmp_path):
    phrases = ["battery life", "Screen", "é", "a", ""]
    df = spark.createDataFrame([(p,) for p in phrases] + [(None,)], "surface string")
    got = {r["surface"]: r["d"] for r in embedding.embed(df).select("surface", embedding.dense(F.col("vec")).alias("d")).collect()}
    assert set(got) == set(phrases)
    for p in phrases:
        assert got[p] == pytest.approx(plain_vector(p), abs=1e-6)
    cache = str(tmp_path / "cache")
    a = embedding.cached_embed(df.limit(2), cache).count()
    b = embedding.cached_embed(df, cache).count()
    assert (a, b, spark.read.parquet(cache).count()) == (2, 5, 5)
    own = embedding.cached_embed(df, cache, "lengths", encode=lambda texts: [[float(len(t)), 0.0] for t in texts])
    assert {r["surface"]: [tuple(x) for x in r["vec"]] for r in own.collect()} == {p: [(0, 1.0)] for p in phrases} and spark.read.parquet(cache).count() == 10



def test_components(spark):
    r = random.Random(5)
    edges = [(f"n{r.randrange(200):03}", f"n{r.randrange(200):03}") for _ in range(150)] + [("x", None), ("", "y"), (None, None), ("z", "z")]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(100)] + [("hub", f"h{i}") for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ends = [find(x) for x in (a, b) if x]
        if len(ends) == 2:
            parent[max(ends)] = min(ends)
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def dbscan(names, ms, eps=0.35):
    vec = {s: plain_vector(s) for s in names}
    near = {s: [t for t in names if round(sum(a * b for a, b in zip(vec[s], vec[t], strict=True)), 9) >= round(1 - eps, 9)] for s in names}
    label, n = {}, 0
    for s in names:
        if s in label or len(near[s]) < ms:
            continue
        todo = [s]
        while todo:
            t = todo.pop(0)
            if t not in label:
                label[t] = n
                if len(near[t]) >= ms:
                    todo += near[t]
        n += 1
    return {s: label.get(s, -1) for s in names}


@pytest.mark.parametrize("ms", [1, 2, 3])
def test_density_labels(spark, ms):
    names = sorted({f"{a} {b}" for a in ("battery", "batteries", "screen", "big screen") for b in ("life", "lives", "cover", "covers")} | {"zipper", "lid", "lids", "handle"})
    df = spark.createDataFrame([("c", s) for s in names] + [("solo", "lid")], "category string, surface string")
    got = {r["surface"]: r["label"] for r in clustering.density_labels(clustering.surfaces(df), 3, ms).where("category = 'c'").collect()}
    want = dbscan(names, min(ms, 3))
    assert got == want


def test_clusters(spark):
    m = [("E", "display"), ("E", "screen"), ("E", "displays"), ("E", "screen"), ("E", "zipper"), ("", "lid"), ("E", "screen protector")]
    clusters, mapping = clustering.cluster_aspects(spark.createDataFrame(m, "category string, surface string"))
    got = {(r["category"], r["surface"]): r["canonical_aspect"] for r in mapping.collect()}
    assert got["E", "screen"] == "screen" and got["E", "display"] == "screen" and got["general", "lid"] == "lid" and got["E", "screen protector"] != "screen"
    c = clusters.collect()
    assert sum(r["member_count"] for r in c) == len(m) and len({r["cluster_id"] for r in c}) == len(c) and all(r["category"] in r["cluster_id"] for r in c)
    noisy, nm = clustering.cluster_aspects(spark.createDataFrame(m, "category string, surface string"), min_samples=2)
    assert any(r["cluster_id"].startswith("cls_outlier_") and r["cluster_confidence"] == 0.5 for r in noisy.collect()) and nm.count() == mapping.count()
    assert clustering.cluster_aspects(spark.createDataFrame([], "category string, surface string"))[0].count() == 0


# ---- pipeline, settings, streams


def test_settings():
    s = load_settings("smoke", ["data.min_chars=5", "dedupe=true", "clustering.eps=0.2"])
    assert (s.data.min_chars, s.dedupe, s.clustering.eps, s.data.max_reviews) == (5, True, 0.2, 500)
    assert settings_hash(s) != settings_hash(load_settings("smoke")) == settings_hash(load_settings("smoke"))
    with pytest.raises(ValueError):
        load_settings("smoke", {"no.such": 1})
    y = "# settings\nseed: 7\ndata:\n  min_chars: 9 # short ones\n  language: 'de'\nclustering:\n  eps: 0.5\n"
    s = load_settings("smoke", ["clustering.eps=0.1"], y)
    assert (s.seed, s.data.min_chars, s.data.language, s.clustering.eps, s.data.max_reviews) == (7, 9, "de", 0.1, 500)


def test_pipeline_end_to_end(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    m = main(["--profile", "smoke", "--out", out, "--set", "dedupe=true"], spark)
    assert m["mentions"] > 100 and m["clusters"] > 10 and m["reviews"] < corpus.count()
    t = spark.read.parquet(f"{out}/aspect_mentions.parquet")
    assert t.count() == m["mentions"] and t.where("cluster_id = ''").count() == 0
    assert main(["--profile", "smoke", "--out", out, "--set", "dedupe=true"], spark) == sinks.read_json(f"{out}/metrics.json")
    a, b = (run(corpus).mentions for _ in range(2))
    assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
    assert audit.broken_offsets(t.limit(3).withColumn("start_char", F.col("start_char") + 1), run(corpus).sentences).count() == 3
    corpus.limit(40).write.parquet(str(tmp_path / "raw"))
    one = main(["--profile", "smoke", "--out", out, "--set", "dedupe=true", "--cleaned", str(tmp_path / "raw")], spark)
    assert one["reviews"] <= 40 and one != m  # other inputs, so nothing is taken from before
    assert main(["--profile", "smoke", "--out", out, "--set", "dedupe=true", "--cleaned", str(tmp_path / "raw")], spark) == sinks.read_json(f"{out}/metrics.json")


def test_streams(spark, corpus, tmp_path):
    df = corpus.withColumn("ingested_at", F.to_timestamp(F.concat("timestamp", F.lit(" 10:15:00"))))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    s = stream.read_review_stream(spark, str(tmp_path / "in"), df.schema, 1)

    def finish(x, name, mode="append"):
        q = x.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    batch = cl.clean_reviews(df)
    assert finish(stream.clean_stream(s), "cleaned").count() == batch.count()
    texts = [r[0] for r in corpus.select(cl.text_key(F.col("text"))).collect()]
    want = len({t for t in texts if t}) + sum(not t for t in texts)
    assert finish(stream.dedupe_stream(s, delay="3650 days"), "deduped").count() == want
    n = finish(stream.windowed_aspects(stream.mention_stream(stream.clean_stream(s)), "ingested_at", "1 day"), "windows", "complete").agg(F.sum("n")).first()[0]
    assert n == aspects.extract_aspects(review_sentences(batch)).count()


def test_components_leave_only_their_last_tables(spark):
    from tidemill.operators.graph import components
    from tidemill.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    r = random.Random(4)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [(f"m{r.randrange(99)}", f"m{r.randrange(99)}") for _ in range(80)]
    got = components(spark.createDataFrame(edges, "a string, b string"))
    new = [p.name.split("-")[1] for p in set(folder.iterdir()) - before]
    assert new.count("roots") == 1 and new.count("jump") == 0 and new.count("hook") == 0
    assert {x["root"] for x in got.where("node like 'n%'").collect()} == {"n0"} and got.count() == len({x for e in edges for x in e})
    chain = components(spark.createDataFrame([("a", None), ("b", "b")], "a string, b string"))
    assert {tuple(x) for x in chain.collect()} == {("a", "a"), ("b", "b")}
