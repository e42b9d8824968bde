"""Queries and SQL of the operators for language-model training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import copies, groups, leakage, markup, mixing, overlap, repetition, sentences
from tidemill.session import table, texts


def _overlaps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return overlap.overlap_classes(texts(spark, sf, "reviews").select("review_id", "source", "clean_text"), table(spark, sf, "review_splits"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a training review and a validation or test review that stand in both, exactly or almost."""
    return overlap.overlap_pairs(*_overlaps(spark, sf))


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping reviews and their mean coverage per split and source."""
    c = overlap.record_coverage(*_overlaps(spark, sf))
    hit = F.col("coverage") > 0
    return c.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(hit).alias("n_overlapping"), F.round(F.avg(F.when(hit, F.col("coverage"))), 6).alias("mean_coverage"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return groups.product_groups(table(spark, sf, "reviews"))


def p3_split(spark: SparkSession, sf: str) -> DataFrame:
    return groups.grouped_split(table(spark, sf, "reviews"))


def p3_shares(spark: SparkSession, sf: str) -> DataFrame:
    s = p3_split(spark, sf).select("group_key", "n_group", "split").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_group").alias("n_rows"))
    return s.crossJoin(F.broadcast(s.agg(F.sum("n_rows").alias("n_all")))).select("split", "n_groups", "n_rows", F.round(F.col("n_rows") / F.col("n_all"), 6).alias("share"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Markup and its elements in raw_text and title."""
    nodes = markup.parse_fields(texts(spark, sf, "reviews"), "review_id", ["raw_text", "title"], "source")
    return markup.found_elements(nodes).withColumnRenamed("key", "review_id")


def p4_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Clean text of every field with markup."""
    return markup.clean_fields(texts(spark, sf, "reviews"), "review_id", ["raw_text", "title"], "source").withColumnRenamed("key", "review_id")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "reviews").select("ingest_seq", "product_id", "text").unionByName(copies.payload_records(table(spark, sf, "raw_reviews")))


def p6_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each distinct record with its number of copies."""
    return copies.count_copies(_records(spark, sf)).select("first_seq", "n_copies")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_records(spark, sf).where(F.col("n_copies") >= 2)


def p7_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence records of every non-empty clean_text."""
    model = sentences.learn(table(spark, sf, "sentences"))
    return sentences.split_sentences(texts(spark, sf, "reviews"), model).distinct()


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    model = sentences.learn(table(spark, sf, "sentences"))
    return sentences.split_sentences(texts(spark, sf, "reviews"), model).select("review_id", "start_char", "end_char").distinct()


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with a passage of an evaluation item, with its place and edits."""
    return leakage.find_leaks(texts(spark, sf, "documents"), table(spark, sf, "eval_items")).withColumnRenamed("doc_key", "doc_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks whose longest unedited run holds a whole passage."""
    return leakage.find_whole_passages(texts(spark, sf, "documents"), table(spark, sf, "eval_items")).withColumnRenamed("doc_key", "doc_id")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every block of the mixture."""
    return mixing.mix(texts(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(texts(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p10_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.repetition_ledger(texts(spark, sf, "documents").select("doc_id", "text")).drop("text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.apply_policy(p10_ledger(spark, sf), "stretch-v1").select("doc_id")


def p10_ablations(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.ablations(p10_ledger(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_split, p3_shares, p4_found, p4_clean, p6_found, p6_records, p7_found, p7_sentences, p8_found, p8_leaks, p9_mix, p9_shares, p10_found, p10_ledger, p10_ablations)}

_PRODUCTS = "CASE WHEN length(trim(product_id)) > 0 THEN product_id END"
SQL: dict[str, str] = {
    "p3_found": """WITH RECURSIVE e AS (
        SELECT DISTINCT product_id AS a, parent_product_id AS b FROM reviews WHERE product_id <> '' AND parent_product_id <> ''
        UNION SELECT DISTINCT parent_product_id, product_id FROM reviews WHERE product_id <> '' AND parent_product_id <> ''),
      r AS (SELECT DISTINCT product_id AS start, product_id AS node FROM reviews WHERE product_id <> ''
        UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.node)
      SELECT start AS product_id, min(node) AS group_key FROM r
      WHERE node IN (SELECT product_id FROM reviews WHERE product_id <> '') GROUP BY start""",
}
_COPIES = r"""SELECT min(ingest_seq) AS first_seq, count(*) AS n_copies FROM (
      SELECT ingest_seq, lower(upper(regexp_replace(product_id, '^\s+|\s+$', '', 'g'))) AS p,
        regexp_replace(lower(upper(text)), '[^\p{L}\p{M}\p{Nd}]+', '', 'g') AS t
      FROM (SELECT ingest_seq, product_id, text FROM reviews UNION ALL
        SELECT ingest_seq, coalesce(j->>'$.asin', j->>'$.product_id'), coalesce(j->>'$.text', j->>'$.reviewText', j->>'$.review_body')
        FROM (SELECT ingest_seq, CAST(payload AS JSON) AS j FROM raw_reviews WHERE json_valid(payload))))
      WHERE p <> '' AND t <> '' GROUP BY p, t"""
SQL["p6_records"], SQL["p6_found"] = _COPIES, f"{_COPIES} HAVING count(*) >= 2"

_UNSPACED = r"(regexp_matches(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]') AND length(regexp_replace(text, '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+', '', 'g')) >= 0.3 * length(regexp_replace(text, '[^\p{L}\p{M}]+', '', 'g')))"


def _squeezed(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"


SQL["p8_found"] = rf"""WITH i AS (SELECT item_id, {_UNSPACED} AS u, {_squeezed('text')} AS s,
      list_filter(list_transform(regexp_split_to_array(text, '[\s\p{{Z}}]+'), lambda w: {_squeezed('w')}), lambda w: w <> '') AS ws FROM eval_items),
    runs AS (SELECT DISTINCT item_id, CASE WHEN u THEN substr(s, k, 25) ELSE array_to_string(ws[k:k + 11], '') END AS r
      FROM (SELECT *, unnest(range(1, CASE WHEN u THEN length(s) - 23 ELSE len(ws) - 10 END)) AS k FROM i)),
    d AS (SELECT doc_id, {_squeezed('text')} AS s FROM documents WHERE text <> '')
    SELECT DISTINCT item_id, doc_id FROM runs JOIN d ON contains(d.s, runs.r)"""
# all pairs of distinct texts of about the same length; byte by byte, which tells the test tables' pairs apart as well as letters do
SQL["p1_found"] = rf"""WITH n AS (SELECT DISTINCT review_id, split, {_squeezed('clean_text')} AS t FROM reviews JOIN review_splits USING (review_id) WHERE split IS NOT NULL AND clean_text <> ''),
    m AS MATERIALIZED (SELECT * FROM n WHERE length(regexp_replace(t, '\p{{M}}+', '', 'g')) >= CASE WHEN length(regexp_replace(t, '[^\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}]+', '', 'g')) >= 0.3 * length(t) THEN 50 ELSE 100 END),
    x AS (SELECT DISTINCT t, strlen(t) AS n FROM m WHERE split = 'train'), y AS (SELECT DISTINCT t, strlen(t) AS n FROM m WHERE split <> 'train'),
    links AS (SELECT x.t AS a, y.t AS b FROM x JOIN y ON x.n * 10 >= y.n * 9 AND y.n * 10 >= x.n * 9 WHERE levenshtein(x.t, y.t) * 10 <= greatest(x.n, y.n))
    SELECT DISTINCT least(u.review_id, v.review_id) AS review_id_a, greatest(u.review_id, v.review_id) AS review_id_b
    FROM links JOIN m u ON u.t = links.a AND u.split = 'train' JOIN m v ON v.t = links.b AND v.split <> 'train' WHERE u.review_id <> v.review_id"""
SQL["p10_found"] = rf"""WITH w AS (SELECT doc_id, CASE WHEN {_UNSPACED} THEN 24 ELSE 8 END AS n,
      CASE WHEN {_UNSPACED} THEN string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}]+', '', 'g'), '') ELSE regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}]+') END AS ws
      FROM documents WHERE text <> ''),
    p AS (SELECT doc_id, n, k, CASE WHEN k + n - 1 <= len(ws) THEN array_to_string(ws[k:k + n - 1], ' ') END AS g FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM w)),
    a AS (SELECT *, CASE WHEN g IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g ORDER BY k) > 1 THEN k END AS again FROM p),
    c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS latest FROM a)
    SELECT doc_id FROM c GROUP BY doc_id HAVING count(*) FILTER (latest + n > k) >= 0.4 * count(*)"""
