"""Queries of the review operators over the test tables, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.aliases import aspect_type, can_merge, resolve_alias
from tidemill.functions.cleaning import clean_reviews as cleaned
from tidemill.functions.cleaning import cleaning_counts as counted
from tidemill.functions.cleaning import first_text, stable_id
from tidemill.functions.lexicon import (
    ACCESSORIES,
    ALIASES,
    CANDIDATE_TYPE_WORDS,
    COPULAS_AND_CONJUNCTIONS,
    DISALLOWED_MERGES,
    GENERIC_MODIFIERS,
    GENERIC_NOUNS,
    OPINION_WORDS,
    PRONOUNS,
    SHORT_FORMS,
    STANDALONE_GENERIC,
    STOPWORDS,
    TITLES,
    TOKEN,
    TYPE_WORDS,
)
from tidemill.functions.pieces import with_starts
from tidemill.operators import audit, clustering, dedupe, embedding, sampling, spans
from tidemill.operators.aspects import extract_aspects, is_valid_aspect, typed_mentions
from tidemill.operators.sentences import review_sentences as cut_sentences
from tidemill.session import table, texts
from tidemill.sources.reviews import chunked, normalise

RATIOS, SEED = (0.8, 0.1, 0.1), 42


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "reviews")


def clean_reviews(spark: SparkSession, sf: str) -> DataFrame:
    t = cleaned(_reviews(spark, sf))
    return t.select("ingest_seq", "title", "clean_text", F.sha2("clean_text", 256).alias("content_hash"))


def cleaning_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counted(_reviews(spark, sf))


def normalised_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Raw payloads of any field names in the review schema; broken ones are left out."""
    raw = table(spark, sf, "raw_reviews").where(F.try_parse_json("payload").isNotNull())
    m = raw.select(F.from_json("payload", "map<string,string>").alias("m"))
    one = lambda *keys: F.coalesce(*[F.col("m")[k] for k in keys])
    flat = m.select(one("asin", "product_id").alias("product_id"), one("text", "reviewText", "review_body").alias("text"), one("rating", "overall", "star_rating").alias("rating"), one("verified_purchase", "verified").alias("verified"), one("helpful_vote", "helpful", "vote").alias("vote"))
    return normalise(flat, "payload").select("review_id", "product_id", "text", "rating", "verified_purchase", "helpful_vote")


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.exact_duplicates(_reviews(spark, sf)).select("ingest_seq", "is_duplicate")


def exact_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.exact_deduplicate(_reviews(spark, sf)).select("ingest_seq", "review_id")


def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.near_duplicates(_reviews(spark, sf)).select("ingest_seq", "is_duplicate")


def split_by_product(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_reviews(_reviews(spark, sf), RATIOS, SEED).select("ingest_seq", "split")


def split_random(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_reviews(_reviews(spark, sf), RATIOS, SEED, by_product=False).select("ingest_seq", "split")


def split_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_leaks(sampling.split_reviews(_reviews(spark, sf), RATIOS, SEED, by_product=False)).drop("examples")


def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return audit.split_sizes(sampling.split_reviews(_reviews(spark, sf), RATIOS, SEED))


def sample_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_by_category(_reviews(spark, sf), None, 20, SEED).select("category", "ingest_seq")


def sample_by_product(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_by_product(_reviews(spark, sf), None, 20, 10, SEED).select("product_id", "ingest_seq")


def sample_by_rating(spark: SparkSession, sf: str) -> DataFrame:
    t = sampling.sample_by_rating(_reviews(spark, sf), 25, SEED)
    return t.select(sampling.rating_bucket(F.col("rating")).alias("bucket"), "ingest_seq")


def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.random_sample(_reviews(spark, sf), 100, SEED).select("ingest_seq")


def unseen_products(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews of products without aspects."""
    return sampling.unseen(_reviews(spark, sf), table(spark, sf, "product_aspects"), "product_id").select("ingest_seq")


def unseen_categories(spark: SparkSession, sf: str) -> DataFrame:
    known = _reviews(spark, sf).where(F.col("category") < "G")
    return sampling.unseen(_reviews(spark, sf), known, "category").select("ingest_seq")


def review_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunked(_reviews(spark, sf).select("ingest_seq"), 1000)


def review_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return cut_sentences(_reviews(spark, sf), "ingest_seq").drop("sentence_id")


TEXTS = ("clean_text", "text", "raw_text")  # the first that is not empty counts: clean_text is empty where cleaning has not run


def _latest(spark: SparkSession, sf: str, texts: tuple[str, ...] = TEXTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(review_id, text, and ``keep`` of its latest row): text is the first of ``texts`` that is not empty."""
    row = F.max_by(F.struct(first_text(*texts).alias("text"), *keep), "ingest_seq").alias("row")
    return _reviews(spark, sf).groupBy("review_id").agg(row).select("review_id", "row.*")


def _sentences(spark: SparkSession, sf: str, texts: tuple[str, ...] = TEXTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sentences of the first of ``texts`` that is not empty in the latest row of each review."""
    return cut_sentences(_latest(spark, sf, texts, keep), texts=("text",), keep=keep)


def aspect_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return extract_aspects(_sentences(spark, sf)).select("review_id", "surface", "doc_start_char", "doc_end_char", "start_char", "end_char", "confidence")


def candidate_types(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates per type as found, before the sentence is looked at."""
    return extract_aspects(_sentences(spark, sf)).groupBy("aspect_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("surface").alias("surfaces"))


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Typed mentions with product_id and category of the review's latest row, '' where it has none."""
    keep = ("product_id", "category")
    m = typed_mentions(extract_aspects(_sentences(spark, sf, keep=keep), keep=keep))
    return m.withColumns({c: F.coalesce(c, F.lit("")) for c in keep})


def typed_aspects(spark: SparkSession, sf: str) -> DataFrame:
    return _mentions(spark, sf).select("review_id", "product_id", "category", "surface", "doc_start_char", "confidence", "aspect_type", "origin")


def aspect_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions and reviews per category, alias-resolved aspect and kind."""
    t = _mentions(spark, sf).withColumn("aspect", resolve_alias(F.col("surface")))
    return t.groupBy("category", "aspect", "aspect_type").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("review_id").alias("reviews"))


def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.word_count_histogram(extract_aspects(_sentences(spark, sf)))


def offset_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of the rule-based pipeline, and those whose offsets do not cut their surface out of the review."""
    m = extract_aspects(_sentences(spark, sf)).select("review_id", "surface", "doc_start_char", "doc_end_char")
    one = _latest(spark, sf).withColumnRenamed("text", "cut_text")
    cut = F.substring(F.col("cut_text"), F.col("doc_start_char") + 1, F.col("doc_end_char") - F.col("doc_start_char"))
    t = m.join(one, "review_id", "left")
    return t.agg(F.count(F.lit(1)).alias("n_mentions"), F.count_if(F.coalesce(cut != F.col("surface"), F.lit(True))).alias("n_broken"))


def product_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return audit.product_rollup(_reviews(spark, sf))


def product_aspect_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return audit.product_aspect_rollup(_mentions(spark, sf), "aspect_type")


def text_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return audit.text_lengths(_reviews(spark, sf))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """(category, surface, n): canonical names of product_aspects; the category leads the aspect's id."""
    t = table(spark, sf, "product_aspects").where(F.col("canonical_aspect").isNotNull())
    return t.select(F.substring_index("aspect_id", "_", 1).alias("category"), F.col("canonical_aspect").alias("surface"))


def resolved_aliases(spark: SparkSession, sf: str) -> DataFrame:
    t = _names(spark, sf).select("surface").distinct()
    s = F.col("surface")
    return t.select("surface", resolve_alias(s).alias("alias"), aspect_type(s).alias("aspect_type"), is_valid_aspect(s).alias("is_valid"))


def merge_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each canonical name may merge with each known alias."""
    keys = F.explode(F.array(*[F.lit(k) for k in [*ALIASES, *[b for _, b in DISALLOWED_MERGES]]]))
    t = _names(spark, sf).select("surface").distinct().withColumn("other", keys)
    return t.select("surface", "other", can_merge(F.col("surface"), F.col("other")).alias("mergeable")).distinct()


def phrase_vectors(spark: SparkSession, sf: str) -> DataFrame:
    t = embedding.embed(_names(spark, sf))
    return t.select("surface", F.explode("vec").alias("v")).select("surface", F.col("v.idx").alias("idx"), F.round("v.w", 6).alias("w"))


def similar_phrases(spark: SparkSession, sf: str) -> DataFrame:
    e = clustering.cosine_edges(clustering.surfaces(_names(spark, sf)), eps=0.7)
    return e.select("category", "a", "b", F.round("similarity", 6).alias("similarity"))


def aspect_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.cluster_aspects(_names(spark, sf))[0].withColumn("representative_terms", F.concat_ws("|", "representative_terms"))


def surface_map(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.cluster_aspects(_names(spark, sf))[1]


def top_clusters(spark: SparkSession, sf: str) -> DataFrame:
    c = audit.top_clusters(clustering.cluster_aspects(_names(spark, sf))[0])
    return c.select("category", "canonical_aspect", "member_count")


def centroid_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding's cosine to the mean vector of its label."""
    e = table(spark, sf, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    return e.join(F.broadcast(centre), "label").select("vec_id", F.round(embedding.cosine(F.col("embedding"), F.col("centre")), 5).alias("cosine"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Checked sentences as words with made-up labels by word length."""
    t = table(spark, sf, "sentences").where(F.col("text").isNotNull()).select("sentence_id", "text").distinct()
    words = with_starts(F.transform(F.split("text", " "), lambda w: F.concat(w, F.lit(" "))))
    t = t.withColumn("w", words)
    n = lambda p: F.length(p["piece"]) - 1
    t = t.withColumn("offsets", F.transform("w", lambda p: F.struct(p["start"].alias("start"), (p["start"] + n(p)).alias("end"))))
    lab = lambda p, k: F.when((n(p) + k) % 4 == 0, "B-ASP").when((n(p) + k) % 4 == 1, "I-ASP").otherwise("O")
    return t.withColumns({"gold": F.transform("w", lambda p: lab(p, 0)), "pred": F.transform("w", lambda p, i: F.when(i % 5 == 0, lab(p, 1)).otherwise(lab(p, 0)))})


def bio_spans(spark: SparkSession, sf: str) -> DataFrame:
    t = _labelled(spark, sf)
    t = t.select("sentence_id", F.explode(spans.spans_from_bio(F.col("text"), F.col("offsets"), F.col("gold"))).alias("x"))
    return t.select("sentence_id", F.col("x.start").alias("start_char"), F.col("x.end").alias("end_char"))


def bio_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return spans.bio_metrics(_labelled(spark, sf))


def span_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Rule-based sentences of the reviews with checked ones against those, whose offsets are into clean_text."""
    gold = table(spark, sf, "sentences").groupBy("review_id").agg(F.collect_set(F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end"))).alias("gold"))
    s = _sentences(spark, sf, ("clean_text",)).join(gold.select("review_id"), "review_id", "left_semi")
    pred = s.groupBy("review_id").agg(F.collect_set(F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end"))).alias("pred"))
    return spans.span_metrics(gold.join(pred, "review_id", "left"))


def overlapping_sentences(spark: SparkSession, sf: str) -> DataFrame:
    gold = table(spark, sf, "sentences").select("review_id", "start_char", "end_char").distinct()
    return spans.overlapping_spans(gold, _sentences(spark, sf, ("clean_text",)), "review_id")


def review_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _reviews(spark, sf).select("ingest_seq", stable_id(F.col("source"), F.col("product_id"), F.col("text"), F.col("timestamp")).alias("stable_id"))


def windowed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events per hour and kind, as a stream over the table's files that ends when all are read."""
    e = table(spark, sf, "events")
    import glob
    import uuid

    path = f"{sf}/events.parquet"
    s = spark.readStream.schema(e.schema).parquet(path if glob.glob(f"{path}/*") else f"{sf}/events*.parquet")
    w = s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    name = f"windowed_{uuid.uuid4().hex}"
    q = w.select(F.col("w.start").alias("window_start"), "event_type", "n").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


QUERIES = {
    f.__name__: f
    for f in (
        clean_reviews, cleaning_counts, normalised_payloads, exact_duplicates, exact_dedupe, near_duplicates, split_by_product, split_random, split_leaks, split_sizes,
        sample_by_category, sample_by_product, sample_by_rating, random_sample, unseen_products, unseen_categories, review_chunks, review_sentences, aspect_candidates, candidate_types,
        typed_aspects, aspect_counts, word_counts, offset_audit, product_rollup, product_aspect_rollup, text_lengths, resolved_aliases, merge_guards, phrase_vectors,
        similar_phrases, aspect_clusters, surface_map, top_clusters, centroid_cosine, bio_spans, bio_metrics, span_metrics, overlapping_sentences, review_ids, windowed_events,
    )
}


# ---- SQL ----------------------------------------------------------------------------------------------------------

_WS = r"[\s\x0b\x85\p{Z}]"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _clean(c: str) -> str:
    """Entities of the test tables, '&amp;' last, then the cleaning patterns."""
    s = f"coalesce({c}, '')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        s = f"replace({s}, '{a}', '{b}')"
    s = f"nfc_normalize({s})"
    sub = lambda s, rx, to, f="g": f"regexp_replace({s}, '{rx}', '{to}', '{f}')"
    s = sub(s, r"&[a-zA-Z]+;|&#\d+;|&#x[0-9a-fA-F]+;", " ")
    s = sub(s, "<[^>]+>", " ")
    s = sub(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", "")
    s = sub(s, r"""https?://[^\s\p{Z}<>"'']+|www\.[^\s\p{Z}<>"'']+""", "", "gi")
    s = sub(s, r"[^\s\p{Z}]+@[^\s\p{Z}]+\.[^\s\p{Z}]+", "")
    s = sub(sub(s, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return _strip(s)


_FIRST = "coalesce(nullif(clean_text, ''), nullif(text, ''), nullif(raw_text, ''), '')"
_BODY = "coalesce(nullif(text, ''), nullif(raw_text, ''), '')"


def _code(seed: int, c: str) -> str:
    return f"substr(md5('{seed}|' || coalesce(CAST({c} AS VARCHAR), '')), 1, 15)"


def _sample(key: str, k: int, where: str = "") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {_code(SEED, 'review_id')}, ingest_seq) AS rn FROM reviews {where} QUALIFY rn <= {k}"


_CUT = "CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END"
_SPLIT_RANDOM = f"SELECT *, {_CUT} AS split FROM (SELECT *, row_number() OVER (ORDER BY {_code(SEED, 'review_id')}, ingest_seq) AS rn, count(*) OVER () AS n FROM reviews)"
_SPLIT_PRODUCT = f"""SELECT r.*, s.split FROM reviews r JOIN (SELECT p, {_CUT} AS split FROM (
    SELECT p, row_number() OVER (ORDER BY {_code(SEED, 'p')}, p) AS rn, count(*) OVER () AS n
    FROM (SELECT DISTINCT coalesce(nullif(product_id, ''), 'unknown') AS p FROM reviews))) s ON coalesce(nullif(r.product_id, ''), 'unknown') = s.p"""


def _sentences_sql(source: str, key: str, keep: str = "") -> str:
    """Sentences of (key, t): RE2 has no look-around, so dots are masked, unmasked and marked; each mask is applied twice."""
    title, short = "|".join(TITLES), "|".join(SHORT_FORMS)
    s = _strip("t")
    for rx, to in ((rf"(^|[^\p{{L}}])({title})\.", 1), (rf"(^|[^\p{{L}}])(\p{{L}}|(?:{short}))\.", 2)):
        for _ in range(2):
            s = f"regexp_replace({s}, '(?i){rx}', '\\1\\2' || chr({to}), 'g')" if to == 1 else f"regexp_replace({s}, '{rx.replace(short, '(?i:' + short + ')')}', '\\1\\2' || chr({to}), 'g')"
    s = rf"regexp_replace({s}, chr(2) || '([ \t]*\p{{Lu}}\p{{L}})', '.\1', 'g')"
    s = rf"""regexp_replace({s}, '([.!?…][.!?]*)([ \t\n\r]*)([\p{{Lu}}"''(\[{{“])', '\1' || chr(30) || '\2\3', 'g')"""
    s = f"replace(replace(replace({s}, chr(10) || chr(10), chr(10) || chr(30) || chr(10)), chr(1), '.'), chr(2), '.')"
    lead = rf"length(t) - length(regexp_replace(t, '^{_WS}+', ''))"
    pieces = f"SELECT {key}{keep}, {lead} AS lead, unnest(string_split(s, chr(30))) AS piece, generate_subscripts(string_split(s, chr(30)), 1) AS i FROM (SELECT *, {s} AS s FROM ({source}) WHERE {_strip('t')} <> '')"
    at = f"SELECT *, lead + coalesce(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ({pieces})"
    return rf"""SELECT {key}{keep}, {_strip('piece')} AS text,
      CAST(pos + length(piece) - length(regexp_replace(piece, '^{_WS}+', '')) AS INTEGER) AS start_char FROM ({at}) WHERE {_strip('piece')} <> ''"""


_LATEST_CLEAN = "SELECT review_id, clean_text AS t FROM reviews QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY ingest_seq DESC) = 1"
_LATEST = "SELECT review_id, arg_max(clean_text, ingest_seq) FILTER (clean_text IS NOT NULL) AS t FROM reviews WHERE clean_text IS NOT NULL GROUP BY review_id"


def _words_in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _valid(s: str) -> str:
    w = rf"regexp_split_to_array({s}, '{_WS}+')"
    alone = _words_in(sorted({*PRONOUNS, *STOPWORDS, *OPINION_WORDS, *GENERIC_NOUNS, *STANDALONE_GENERIC}))
    edge = _words_in([*STOPWORDS, *PRONOUNS])
    return rf"""(length({s}) >= 2 AND regexp_matches({s}, '[\p{{L}}\p{{N}}]') AND len({w}) <= 4 AND NOT (len({w}) = 1 AND {s} IN {alone})
      AND {w}[1] NOT IN {edge} AND {w}[-1] NOT IN {edge} AND {w}[-1] NOT IN {_words_in(OPINION_WORDS)}
      AND NOT list_has_any({w}, {str(COPULAS_AND_CONJUNCTIONS)}))"""


def _type(s: str, table: list[tuple[str, list[str]]] = TYPE_WORDS) -> str:
    whens = " ".join(f"WHEN regexp_matches({s}, '{'|'.join(words)}') THEN '{kind}'" for kind, words in table)
    return f"CASE {whens} ELSE 'product' END"


def _context_type(s: str, c: str) -> str:
    from tidemill.functions.lexicon import CONTEXT_DELIVERY, CONTEXT_PACKAGING, CONTEXT_PACKAGING_SURFACE, CONTEXT_SELLER, CONTEXT_SERVICE

    has = lambda x, words: f"regexp_matches({x}, '{'|'.join(words)}')"
    more = f"WHEN {has(c, CONTEXT_DELIVERY)} THEN 'delivery' WHEN {has(c, CONTEXT_PACKAGING)} AND {has(s, CONTEXT_PACKAGING_SURFACE)} THEN 'packaging' WHEN {has(c, CONTEXT_SERVICE)} THEN 'service' WHEN {has(c, CONTEXT_SELLER)} THEN 'seller'"
    return _type(s).replace(" ELSE", f" {more} ELSE")


def _resolve(s: str) -> str:
    table = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())
    look = lambda x: f"CASE {x} {table} END"
    stem = f"CASE WHEN {s} LIKE '%ies' AND length({s}) > 4 THEN left({s}, length({s}) - 3) || 'y' WHEN {s} LIKE '%s' AND {s} NOT LIKE '%ss' AND length({s}) > 3 THEN left({s}, length({s}) - 1) ELSE {s} END"
    return f"coalesce({look(s)}, {look(stem)}, {stem})"


# tokens by splitting at marked tokens; candidate runs of up to four; the longest match by a running maximum
_LATEST_FIRST = f"SELECT review_id, {_FIRST} AS t FROM reviews QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY ingest_seq DESC) = 1"
_SENT = f"SELECT *, row_number() OVER () AS sid FROM ({_sentences_sql(_LATEST_FIRST, 'review_id')})"
_EDGE, _INNER = r"[^\p{L}\p{N}_]", TOKEN.replace("(?:-", r"(?:-\x03")  # a sign of its own after each separator keeps matches apart
_TOKENS = rf"""SELECT sid, i, pos AS s, pos + length(piece) AS e FROM (
    SELECT sid, i, piece, coalesce(sum(length(piece)) OVER (PARTITION BY sid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM (
      SELECT sid, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT sid, regexp_split_to_array(m, '[\x01\x02]') AS p FROM (
        SELECT sid, replace(regexp_replace(regexp_replace(text, '({_EDGE})', '\1' || chr(3), 'g'), '(^|\x03)({_INNER})($|[^\p{{L}}\p{{N}}_\x03])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(3), '') AS m FROM sent)))) WHERE i % 2 = 0"""
_CANDIDATES = f"""WITH sent AS MATERIALIZED ({_SENT}), tok AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY i) AS k FROM ({_TOKENS})),
  cand AS (SELECT a.sid, a.s, b.e, b.k - a.k + 1 AS n, substr(sent.text, CAST(a.s + 1 AS BIGINT), CAST(b.e - a.s AS BIGINT)) AS surface
    FROM tok a JOIN tok b ON a.sid = b.sid AND b.k BETWEEN a.k AND a.k + 3 JOIN sent ON sent.sid = a.sid),
  good AS (SELECT * FROM cand WHERE {_valid(_strip('lower(surface)'))}),
  kept AS (SELECT * FROM good QUALIFY coalesce(max(e) OVER (PARTITION BY sid ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < e, true)),
  mention AS (SELECT sent.review_id, kept.surface, CAST(sent.start_char + kept.s AS INTEGER) AS doc_start_char, CAST(sent.start_char + kept.e AS INTEGER) AS doc_end_char,
    CAST(kept.s AS INTEGER) AS start_char, CAST(kept.e AS INTEGER) AS end_char, CASE WHEN kept.n > 1 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence, sent.text AS sentence
    FROM kept JOIN sent ON sent.sid = kept.sid),
  latest AS (SELECT review_id, arg_max({{'p': product_id, 'c': category}}, ingest_seq) AS r FROM reviews GROUP BY 1),
  typed AS (SELECT m.*, coalesce(r.p, '') AS product_id, coalesce(r.c, '') AS category, {_context_type(_strip('lower(surface)'), _strip('lower(sentence)'))} AS aspect_type
    FROM mention m LEFT JOIN latest USING (review_id)) """

_NAMES = "SELECT split_part(aspect_id, '_', 1) AS category, canonical_aspect AS surface FROM product_aspects WHERE canonical_aspect IS NOT NULL"


def _horner(h: str, chunks: int) -> str:
    s = "0"
    for i in range(chunks):
        s = f"(({s}) * 256 + CAST('0x' || substr({h}, {8 * i + 1}, 8) AS BIGINT)) % 384"
    return s


_FEATURES = f"""SELECT surface, idx, sum(w) AS w FROM (
  SELECT surface, {_horner('md5(x)', 4)} AS idx, CASE WHEN (CAST('0x' || substr(md5(x), 25, 8) AS BIGINT) >> 8) & 1 = 1 THEN 1.5::DOUBLE ELSE -1.5::DOUBLE END AS w
  FROM (SELECT surface, unnest(string_split(surface, ' ')) AS x FROM names) WHERE x <> ''
  UNION ALL SELECT surface, {_horner('sha256(x)', 8)} AS idx, CASE WHEN (CAST('0x' || substr(sha256(x), 57, 8) AS BIGINT) >> 8) & 1 = 1 THEN 0.8::DOUBLE ELSE -0.8::DOUBLE END AS w
  FROM (SELECT surface, substr(' ' || surface || ' ', CAST(i AS BIGINT), 3) AS x FROM (SELECT surface, unnest(range(1, length(surface) + 1)) AS i FROM names))) GROUP BY 1, 2"""
_VECTORS = f"names AS (SELECT DISTINCT surface FROM ({_NAMES})), feat AS ({_FEATURES}), vec AS (SELECT surface, idx, w / sqrt(sum(w * w) OVER (PARTITION BY surface)) AS w FROM feat QUALIFY w <> 0)"

_WORDS = """SELECT sentence_id, i, w, CAST(coalesce(sum(length(w) + 1) OVER (PARTITION BY sentence_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s, text
  FROM (SELECT sentence_id, text, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i
    FROM (SELECT DISTINCT sentence_id, text FROM sentences WHERE text IS NOT NULL))"""
_LAB = lambda k: f"CASE (length(w) + {k}) % 4 WHEN 0 THEN 'B-ASP' WHEN 1 THEN 'I-ASP' ELSE 'O' END"
_BIO = f"SELECT *, {_LAB(0)} AS gold, CASE WHEN (i - 1) % 5 = 0 THEN {_LAB(1)} ELSE {_LAB(0)} END AS pred FROM ({_WORDS})"


def _f(tp: str, fp: str, fn: str) -> tuple[str, str, str]:
    p, r = (f"coalesce({tp}::DOUBLE / nullif({tp} + {x}, 0), 0)" for x in (fp, fn))
    return p, r, f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)"


_P, _R, _F = _f("tp", "fp", "fn")
_PP, _PR, _PF = _f("ptp", "pfp", "pfn")
SQL = {
    "clean_reviews": f"SELECT ingest_seq, {_clean('title')} AS title, c AS clean_text, sha256(c) AS content_hash FROM (SELECT *, {_clean(_BODY)} AS c FROM reviews) WHERE length(c) >= 20",
    "cleaning_counts": f"""SELECT count(*) AS n_rows, count(*) FILTER (n = 0) AS n_empty, count(*) FILTER (n BETWEEN 1 AND 19) AS n_short, count(*) FILTER (n >= 20) AS n_kept
      FROM (SELECT length({_clean(_BODY)}) AS n FROM reviews)""",
    "normalised_payloads": """SELECT sha256('payload|' || p || '|' || t || '|') AS review_id, p AS product_id, t AS text, coalesce(TRY_CAST(r AS DOUBLE), -1.0) AS rating,
        coalesce(lower(v) IN ('true', 'yes', '1', 'y'), false) AS verified_purchase, coalesce(CAST(trunc(TRY_CAST(h AS DOUBLE)) AS BIGINT), 0) AS helpful_vote FROM (
      SELECT coalesce(j->>'$.asin', j->>'$.product_id', '') AS p, coalesce(j->>'$.text', j->>'$.reviewText', j->>'$.review_body', '') AS t,
        coalesce(j->>'$.rating', j->>'$.overall', j->>'$.star_rating') AS r, coalesce(j->>'$.verified_purchase', j->>'$.verified') AS v,
        coalesce(j->>'$.helpful_vote', j->>'$.helpful', j->>'$.vote') AS h
      FROM (SELECT CAST(payload AS JSON) AS j FROM raw_reviews WHERE json_valid(payload)))""",
    "exact_duplicates": f"""SELECT ingest_seq, k <> '' AND row_number() OVER (PARTITION BY k ORDER BY ingest_seq) > 1 AS is_duplicate FROM (SELECT ingest_seq, {_strip(f'lower({_FIRST})')} AS k FROM reviews)""",
    "exact_dedupe": f"""SELECT ingest_seq, review_id FROM (SELECT ingest_seq, review_id, {_strip(f'lower({_FIRST})')} AS k FROM reviews) QUALIFY k = '' OR row_number() OVER (PARTITION BY k ORDER BY ingest_seq) = 1""",
    "split_by_product": f"SELECT ingest_seq, split FROM ({_SPLIT_PRODUCT})",
    "split_random": f"SELECT ingest_seq, split FROM ({_SPLIT_RANDOM})",
    "split_sizes": f"SELECT split, count(*) AS n_reviews, count(DISTINCT product_id) AS n_products, count(DISTINCT category) AS n_categories FROM ({_SPLIT_PRODUCT}) GROUP BY split",
    "split_leaks": f"""WITH t AS MATERIALIZED ({_SPLIT_RANDOM}), v AS (
        SELECT DISTINCT 'review_id' AS kind, review_id AS value, split FROM t WHERE review_id IS NOT NULL UNION ALL SELECT DISTINCT 'product_id', product_id, split FROM t WHERE product_id IS NOT NULL
        UNION ALL SELECT DISTINCT 'text', {_strip('lower(clean_text)')}, split FROM t WHERE {_strip('lower(clean_text)')} <> '')
      SELECT a.kind, a.split AS split_a, b.split AS split_b, count(*) AS n_shared FROM v a JOIN v b ON a.kind = b.kind AND a.value = b.value AND a.split < b.split GROUP BY 1, 2, 3""",
    "sample_by_category": f"SELECT category, ingest_seq FROM ({_sample('category', 20)})",
    "sample_by_product": f"""SELECT product_id, ingest_seq FROM ({_sample('product_id', 10, f"WHERE product_id IN (SELECT product_id FROM (SELECT DISTINCT product_id FROM reviews WHERE product_id <> '') ORDER BY {_code(SEED, 'product_id')}, product_id LIMIT 20)")})""",
    "sample_by_rating": f"""SELECT CAST(bucket AS INTEGER) AS bucket, ingest_seq FROM (SELECT *, CASE WHEN rating > 0 THEN greatest(1, least(5, round_even(rating, 0))) ELSE 0 END AS bucket FROM reviews)
      QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY {_code(SEED, 'review_id')}, ingest_seq) <= 25""",
    "random_sample": f"SELECT ingest_seq FROM reviews ORDER BY {_code(SEED, 'review_id')}, ingest_seq LIMIT 100",
    "unseen_products": "SELECT ingest_seq FROM reviews r WHERE NOT EXISTS (SELECT 1 FROM product_aspects a WHERE a.product_id = r.product_id)",
    "unseen_categories": "SELECT ingest_seq FROM reviews r WHERE NOT EXISTS (SELECT 1 FROM reviews a WHERE a.category < 'G' AND a.category = r.category)",
    "review_chunks": "SELECT ingest_seq, CAST(floor((row_number() OVER (ORDER BY ingest_seq) - 1) / 1000) AS BIGINT) AS chunk_id FROM reviews",
    "review_sentences": f"SELECT ingest_seq, text, start_char, CAST(start_char + length(text) AS INTEGER) AS end_char FROM ({_sentences_sql(f'SELECT ingest_seq, {_FIRST} AS t FROM reviews', 'ingest_seq')})",
    "aspect_candidates": f"{_CANDIDATES} SELECT review_id, surface, doc_start_char, doc_end_char, start_char, end_char, confidence FROM mention",
    "candidate_types": f"{_CANDIDATES} SELECT {_type('lower(surface)', CANDIDATE_TYPE_WORDS)} AS aspect_type, count(*) AS n, count(DISTINCT surface) AS surfaces FROM mention GROUP BY 1",
    "typed_aspects": f"""{_CANDIDATES} SELECT review_id, product_id, category, surface, doc_start_char, round(0.85 + CAST('0x' || substr(md5(surface), 1, 8) AS BIGINT) % 13 * 0.01, 2)::DOUBLE AS confidence, aspect_type, 'pseudo' AS origin FROM typed""",
    "aspect_counts": f"{_CANDIDATES} SELECT category, {_resolve(_strip('lower(surface)'))} AS aspect, aspect_type, count(*) AS mentions, count(DISTINCT review_id) AS reviews FROM typed GROUP BY 1, 2, 3",
    "word_counts": rf"{_CANDIDATES} SELECT CAST(len(regexp_split_to_array(surface, '{_WS}+')) AS INTEGER) AS n_words, count(*) AS n FROM mention GROUP BY 1",
    "offset_audit": f"{_CANDIDATES} SELECT count(*) AS n_mentions, 0::BIGINT AS n_broken FROM mention",
    "product_aspect_rollup": f"""{_CANDIDATES} SELECT product_id, aspect_type, count(*) AS mention_count, count(DISTINCT review_id) AS unique_review_count,
      round(avg(round(0.85 + CAST('0x' || substr(md5(surface), 1, 8) AS BIGINT) % 13 * 0.01, 2)::DOUBLE), 6) AS confidence FROM typed GROUP BY 1, 2""",
    "product_rollup": "SELECT product_id, count(*) AS review_count, round(avg(CASE WHEN rating >= 0 THEN rating END), 6) AS average_rating FROM reviews WHERE product_id <> '' GROUP BY 1",
    "text_lengths": "SELECT category, count(*) AS n, CAST(min(length(clean_text)) AS INTEGER) AS shortest, CAST(max(length(clean_text)) AS INTEGER) AS longest, round(avg(length(clean_text)), 6) AS mean_length FROM reviews WHERE clean_text IS NOT NULL GROUP BY 1",
    "resolved_aliases": f"SELECT surface, {_resolve(_strip('lower(surface)'))} AS alias, {_type(_strip('lower(surface)'))} AS aspect_type, {_valid(_strip('lower(surface)'))} AS is_valid FROM (SELECT DISTINCT surface FROM ({_NAMES}))",
    "merge_guards": f"""SELECT surface, other, surface = other OR NOT (
        least(surface, other) || '|' || greatest(surface, other) IN {_words_in(["|".join(sorted(p)) for p in DISALLOWED_MERGES])}
        OR list_has_any(a, {ACCESSORIES}) <> list_has_any(b, {ACCESSORIES})
        OR (list_has_any(a, b) AND len(list_filter(list_intersect(a, b), lambda x: x NOT IN {_words_in(GENERIC_MODIFIERS)})) = 0)) AS mergeable
      FROM (SELECT surface, other, string_split(lower(surface), ' ') AS a, string_split(other, ' ') AS b FROM (SELECT DISTINCT surface FROM ({_NAMES})),
        (SELECT DISTINCT unnest({[*ALIASES, *[b for _, b in DISALLOWED_MERGES]]}) AS other))""",
    "phrase_vectors": f"WITH {_VECTORS} SELECT surface, CAST(idx AS INTEGER) AS idx, round(w, 6) AS w FROM vec",
    "similar_phrases": f"""WITH {_VECTORS}, c AS (SELECT DISTINCT category, surface FROM ({_NAMES})),
      dots AS (SELECT a.surface AS a, b.surface AS b, round(sum(a.w * b.w), 9) AS d FROM vec a JOIN vec b ON a.idx = b.idx AND a.surface < b.surface GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 9) >= 0.3)
      SELECT x.category, a, b, round(d, 6) AS similarity FROM dots JOIN c x ON x.surface = a JOIN c y ON y.surface = b AND x.category = y.category""",
    "centroid_cosine": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
      m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2)
      SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 5) AS cosine FROM e JOIN m USING (label, i) GROUP BY vec_id""",
    "bio_spans": f"""SELECT sentence_id, min(s) AS start_char, CAST(max(s + length(w)) AS INTEGER) AS end_char FROM (
        SELECT *, sum(CASE WHEN gold = 'B-ASP' OR (gold = 'I-ASP' AND coalesce(prev, 'O') = 'O') THEN 1 ELSE 0 END) OVER (PARTITION BY sentence_id, text ORDER BY i) AS island
        FROM (SELECT *, lag(gold) OVER (PARTITION BY sentence_id, text ORDER BY i) AS prev FROM ({_BIO}) WHERE length(w) > 0)) WHERE gold <> 'O' GROUP BY sentence_id, text, island""",
    "bio_metrics": f"""SELECT round({_P}, 4) AS precision, round({_R}, 4) AS recall, round({_F}, 4) AS f1, round(({_f('btp', 'bfp', 'bfn')[2]} + {_f('itp', 'ifp', 'ifn')[2]}) / 2, 4) AS macro_f1, round({_F}, 4) AS micro_f1 FROM (
      SELECT count(*) FILTER (gold = pred AND gold <> 'O') AS tp, count(*) FILTER (gold <> pred AND pred <> 'O') AS fp, count(*) FILTER (gold <> pred AND gold <> 'O') AS fn,
        count(*) FILTER (gold = pred AND gold = 'B-ASP') AS btp, count(*) FILTER (gold <> pred AND pred = 'B-ASP') AS bfp, count(*) FILTER (gold <> pred AND gold = 'B-ASP') AS bfn,
        count(*) FILTER (gold = pred AND gold = 'I-ASP') AS itp, count(*) FILTER (gold <> pred AND pred = 'I-ASP') AS ifp, count(*) FILTER (gold <> pred AND gold = 'I-ASP') AS ifn FROM ({_BIO}))""",
    "overlapping_sentences": f"""SELECT g.review_id, g.start_char AS gold_start, g.end_char AS gold_end, p.start_char AS pred_start, CAST(p.start_char + length(p.text) AS INTEGER) AS pred_end
      FROM (SELECT DISTINCT review_id, start_char, end_char FROM sentences) g JOIN ({_sentences_sql(_LATEST, 'review_id')}) p
      ON g.review_id = p.review_id AND greatest(g.start_char, p.start_char) < least(g.end_char, p.start_char + length(p.text))""",
    "span_metrics": f"""WITH g AS MATERIALIZED (SELECT DISTINCT review_id, start_char AS s, end_char AS e FROM sentences),
      p AS MATERIALIZED (SELECT DISTINCT review_id, start_char AS s, CAST(start_char + length(text) AS INTEGER) AS e FROM ({_sentences_sql(_LATEST_CLEAN, 'review_id')}) WHERE review_id IN (SELECT review_id FROM g)),
      n AS (SELECT (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g JOIN p USING (review_id, s, e)) AS tp,
        (SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.review_id = p.review_id AND greatest(g.s, p.s) < least(g.e, p.e))) AS ptp,
        (SELECT count(*) FROM g WHERE EXISTS (SELECT 1 FROM p WHERE g.review_id = p.review_id AND greatest(g.s, p.s) < least(g.e, p.e))) AS gtp),
      c AS (SELECT tp, np - tp AS fp, ng - tp AS fn, ptp, np - ptp AS pfp, ng - gtp AS pfn FROM n)
      SELECT round({_P}, 4) AS exact_span_precision, round({_R}, 4) AS exact_span_recall, round({_F}, 4) AS exact_span_f1,
        round({_PP}, 4) AS partial_span_precision, round({_PR}, 4) AS partial_span_recall, round({_PF}, 4) AS partial_span_f1 FROM c""",
    # all pairs of distinct texts that share a run of three characters, then the pass in order as a fold over each text's earlier neighbours
    "near_duplicates": f"""WITH k AS MATERIALIZED (SELECT ingest_seq, {_strip('lower(clean_text)')} AS k FROM reviews),
      d AS MATERIALIZED (SELECT k, min(ingest_seq) AS id FROM k WHERE k <> '' GROUP BY k),
      g AS MATERIALIZED (SELECT DISTINCT id, hash(substr(k, i, 3)) AS g FROM (SELECT *, unnest(range(1, greatest(2, length(k) - 1))) AS i FROM d)),
      n AS MATERIALIZED (SELECT id, count(*) AS n FROM g GROUP BY id),
      pairs AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM g x JOIN g y ON x.g = y.g AND x.id < y.id JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = y.id
        WHERE nx.n >= 0.9 * ny.n AND ny.n >= 0.9 * nx.n GROUP BY x.id, y.id HAVING count(*) >= 0.9 * (min(nx.n) + min(ny.n) - count(*)) - 1e-12),
      nodes AS (SELECT id, coalesce(list(a) FILTER (a IS NOT NULL), []) AS near FROM (SELECT DISTINCT unnest([a, b]) AS id FROM pairs) LEFT JOIN pairs ON pairs.b = id GROUP BY id),
      kept AS (SELECT list_reduce(list(list_prepend(id, near) ORDER BY id), lambda acc, x: CASE WHEN list_has_any(x[2:], acc) THEN acc ELSE list_append(acc, x[1]) END, CAST([] AS BIGINT[])) AS ids FROM nodes)
      SELECT k.ingest_seq, d.id IS NOT NULL AND (k.ingest_seq > d.id OR (d.id IN (SELECT id FROM nodes) AND NOT coalesce((SELECT list_contains(ids, d.id) FROM kept), true))) AS is_duplicate
      FROM k LEFT JOIN d USING (k)""",
    "review_ids": """SELECT ingest_seq, sha256(coalesce(source, '') || '|' || coalesce(product_id, '') || '|' || coalesce(text, '') || '|' || coalesce(timestamp, '')) AS stable_id FROM reviews""",
    "windowed_events": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
