"""Density clustering of aspect phrases within categories, as components of a cosine graph, with merge guards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.aliases import alias_table, resolve_alias
from tidemill.functions.cleaning import text_key
from tidemill.functions.lexicon import ACCESSORIES, ALIASES, DISALLOWED_MERGES, GENERIC_MODIFIERS
from tidemill.operators.embedding import embed, sparse_dot
from tidemill.operators.graph import components
from tidemill.session import written

EPS, PROBABILITY = 0.35, 0.75
SEP = "\u0001"


def surfaces(mentions: DataFrame, by_category: bool = True) -> DataFrame:
    """(category, surface, n): mentions per distinct phrase; an empty category is general, all are global if not by category."""
    cat = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("general")) if by_category else F.lit("global")
    return mentions.select(cat.alias("category"), text_key(F.col("surface")).alias("surface")).where(F.col("surface") != "").groupBy("category", "surface").agg(F.count(F.lit(1)).alias("n"))


def cosine_edges(phrases: DataFrame, eps: float = EPS) -> DataFrame:
    """(category, a, b, similarity): phrases of a category, a before b, with 1 - cosine at most ``eps``.

    Prefix filter on the vectors: of b only the rarest dimensions count, as many as leave a rest shorter than the wanted
    cosine. A pair needs one of them in common, and its product over them plus the rest's length must reach the wanted
    cosine, since a has length 1. What passes is verified on the vectors, rounded to 9 digits. In 384 dimensions the
    filter leaves a share of all pairs of a category, as density clustering by cosine does.
    """
    least = 1.0 - eps
    vec = written(embed(phrases), "phrase-vectors")
    x = phrases.select("category", "surface").distinct().join(vec, "surface").select("category", "surface", F.explode("vec").alias("v")).select("category", "surface", "v.idx", "v.w")
    df = x.groupBy("category", "idx").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("category", "surface").orderBy("df", "idx").rowsBetween(0, Window.unboundedFollowing)
    x = x.join(df, ["category", "idx"]).withColumn("rest", F.sum(F.col("w") * F.col("w")).over(w))
    kept = F.col("rest") >= least * least - 1e-9
    short = x.where(~kept).groupBy("category", "surface").agg(F.max("rest").alias("r"))
    pre = x.where(kept).join(short, ["category", "surface"], "left").select("category", F.col("surface").alias("b"), "idx", F.col("w").alias("wb"), F.sqrt(F.coalesce("r", F.lit(0.0))).alias("r"))
    part = x.select("category", F.col("surface").alias("a"), "idx", F.col("w").alias("wa")).join(pre, ["category", "idx"]).where(F.col("a") != F.col("b"))
    part = part.groupBy("category", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.first("r").alias("r")).where(F.col("dot") + F.col("r") >= least - 1e-6)
    pairs = part.select("category", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    v = lambda k: vec.select(F.col("surface").alias(k), F.col("vec").alias(f"v{k}"))
    sim = F.round(sparse_dot(F.col("va"), F.col("vb")), 9)
    return pairs.join(v("a"), "a").join(v("b"), "b").select("category", "a", "b", sim.alias("similarity")).where(F.col("similarity") >= round(least, 9))


def density_labels(phrases: DataFrame, min_cluster_size: int = 3, min_samples: int = 1, eps: float = EPS) -> DataFrame:
    """(category, surface, n, label, probability): label -1 is noise; labels count from 0 by their smallest phrase.

    The number of neighbours that makes a core point is bounded by the category: at most a third of its phrases. A
    phrase next to a core point only belongs to the lowest label among its core neighbours. A category of one phrase is
    one cluster of probability 1.
    """
    phrases = written(phrases, "phrases")
    size = phrases.groupBy("category").agg(F.count(F.lit(1)).alias("m"))
    mcs = F.when(F.col("m") > 3, F.least(F.lit(min_cluster_size), F.greatest(F.lit(2), F.floor(F.col("m") / 3)))).otherwise(2)
    size = size.withColumn("ms", F.least(F.lit(min_samples), mcs).cast("int"))
    edges = written(cosine_edges(phrases, eps).select("category", "a", "b"), "phrase-edges")
    both = edges.unionByName(edges.select("category", F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("category", F.col("a").alias("surface")).agg(F.count(F.lit(1)).alias("degree"))
    nodes = phrases.join(size, "category").join(degree, ["category", "surface"], "left").withColumn("core", F.coalesce("degree", F.lit(0)) + 1 >= F.col("ms"))
    nodes = written(nodes.select("category", "surface", "n", "m", "core"), "phrase-nodes")
    cores = nodes.where("core").select("category", "surface")
    joined = edges.join(cores.withColumnRenamed("surface", "a"), ["category", "a"]).join(cores.withColumnRenamed("surface", "b"), ["category", "b"])
    key = lambda c: F.concat("category", F.lit(SEP), c)
    loops = cores.select(key("surface").alias("a"), key("surface").alias("b"))
    comp = components(joined.select(key("a").alias("a"), key("b").alias("b")).unionByName(loops)).select(F.split("node", SEP)[0].alias("category"), F.split("node", SEP)[1].alias("surface"), F.split("root", SEP)[1].alias("root"))
    roots = comp.select("category", "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy("category").orderBy("root")) - 1)
    comp = comp.join(roots, ["category", "root"]).select("category", "surface", "label")
    border = both.join(comp.withColumnRenamed("surface", "b"), ["category", "b"]).groupBy("category", F.col("a").alias("surface")).agg(F.min("label").alias("near"))
    t = nodes.join(comp, ["category", "surface"], "left").join(border, ["category", "surface"], "left")
    label = F.coalesce(F.when(F.col("m") < 2, F.lit(0)), "label", "near", F.lit(-1))
    return t.select("category", "surface", "n", label.cast("int").alias("label"), F.when(F.col("m") < 2, 1.0).otherwise(F.lit(PROBABILITY)).alias("probability"))


def _mergeable(a: str, b: str) -> bool:
    if a == b:
        return True
    wa, wb = set(a.split()), set(b.split())
    common = wa & wb
    return (a, b) not in _FORBIDDEN and bool(wa & _ACC) == bool(wb & _ACC) and not (common and common <= _GENERIC)


_FORBIDDEN = {p for x in DISALLOWED_MERGES for p in (x, x[::-1])}
_ACC, _GENERIC = set(ACCESSORIES), set(GENERIC_MODIFIERS)


def guarded_groups(labelled: DataFrame) -> DataFrame:
    """(category, surface, n, label, probability, grp, medoid): clusters cut into groups whose members may all merge.

    First fit in the phrases' order: that is sequential by its nature, so a cluster is one task's work; it holds
    distinct phrases of one category only. ``medoid`` is the group's member closest to its centroid, the first of equals.
    """
    rows = labelled.where(F.col("label") >= 0).join(embed(labelled), "surface")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("surface", kind="stable").reset_index(drop=True)
        groups: list[list[int]] = []
        for i, s in enumerate(pdf.surface):
            for g in groups:
                if all(_mergeable(s, pdf.surface[k]) for k in g):
                    g.append(i)
                    break
            else:
                groups.append([i])
        grp, med = [0] * len(pdf), [""] * len(pdf)
        for gi, g in enumerate(groups):
            centre: dict[int, float] = {}
            for i in g:
                for x in pdf.vec[i]:
                    centre[x["idx"]] = centre.get(x["idx"], 0.0) + x["w"]
            score = [round(sum(x["w"] * centre.get(x["idx"], 0.0) for x in pdf.vec[i]), 9) for i in g]
            best = pdf.surface[g[score.index(max(score))]]
            for i in g:
                grp[i], med[i] = gi, best
        return pdf.drop(columns=["vec"]).assign(grp=grp, medoid=med)[["category", "surface", "n", "label", "probability", "grp", "medoid"]]

    return rows.select("category", "surface", "n", "label", "probability", "vec").groupBy("category", "label").applyInPandas(cut, "category string, surface string, n bigint, label int, probability double, grp int, medoid string")


def cluster_aspects(mentions: DataFrame, by_category: bool = True, min_cluster_size: int = 3, min_samples: int = 1, eps: float = EPS, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, surface_map) of mentions with category and surface.

    clusters: (cluster_id, category, canonical_aspect, cluster_confidence, representative_terms, member_count).
    surface_map: (category, surface, canonical_aspect, cluster_id). The canonical name is the alias of the first member
    that has a known one, else the medoid's. Noise stays as clusters of one phrase with confidence .5.
    """
    table = alias_table(aliases)
    known = sorted(set(ALIASES.values()))
    labelled = written(density_labels(surfaces(mentions, by_category), min_cluster_size, min_samples, eps), "phrase-labels")
    g = written(guarded_groups(labelled).withColumn("alias", resolve_alias(F.col("surface"), table)), "phrase-groups")
    named = g.groupBy("category", "label", "grp").agg(
        F.min_by(F.when(F.col("alias").isin(known), F.col("alias")), F.when(F.col("alias").isin(known), F.col("surface"))).alias("named"),
        F.first("medoid").alias("medoid"),
        F.sum("n").alias("member_count"),
        F.round(F.avg("probability"), 4).alias("cluster_confidence"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "surface"))), 1, 5), lambda x: x["surface"]).alias("representative_terms"),
    )
    named = named.withColumn("canonical_aspect", F.coalesce("named", resolve_alias(F.col("medoid"), table)))
    digest = F.substring(F.sha2(F.concat_ws("_", "category", "label", "grp", "canonical_aspect"), 256), 1, 16)
    named = named.withColumn("cluster_id", F.concat(F.lit("cls_"), "category", F.lit("_"), digest))
    noise = labelled.where(F.col("label") < 0)
    noise = noise.select(
        F.concat(F.lit("cls_outlier_"), F.substring(F.sha2(F.concat_ws("_", F.lit("outlier"), "category", "surface"), 256), 1, 16)).alias("cluster_id"),
        "category",
        resolve_alias(F.col("surface"), table).alias("canonical_aspect"),
        F.lit(0.5).alias("cluster_confidence"),
        F.array("surface").alias("representative_terms"),
        F.col("n").alias("member_count"),
        "surface",
    )
    cols = ["cluster_id", "category", "canonical_aspect", "cluster_confidence", "representative_terms", "member_count"]
    clusters = named.select(*cols).unionByName(noise.select(*cols))
    pairs = g.join(named.select("category", "label", "grp", "canonical_aspect", "cluster_id"), ["category", "label", "grp"]).select("category", "surface", "canonical_aspect", "cluster_id")
    return clusters, pairs.unionByName(noise.select("category", "surface", "canonical_aspect", "cluster_id"))
