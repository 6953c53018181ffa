"""Strain of claims: local scores, calibration by discipline, consistency per source, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import strain as S

GAP = 0.3
BINS = 4096
_COLUMNS = ("supports", "contradicts", "defines", "quantifies", "contextualizes", "method", "cautions")
PROFILES = {
    "hard_science": (0.15, 0.08, 0.20, 0.35, 0.55, (0, 0.10, -0.05, -0.05, 0.10, -0.03, 0.05)),
    "social_science": (0.22, 0.12, 0.25, 0.45, 0.65, (0, 0.10, 0, -0.05, 0.15, 0, 0.05)),
    "humanities": (0.30, 0.15, 0.30, 0.50, 0.70, (0, 0.10, 0.05, -0.05, 0.20, 0.05, 0.05)),
    "legal": (0.25, 0.18, 0.25, 0.50, 0.70, (0, 0.05, -0.05, -0.05, 0.15, 0, 0.05)),
    "journalism": (0.28, 0.14, 0.30, 0.50, 0.65, (0, 0.05, 0, -0.10, 0.15, 0, 0.05)),
    "ai_output": (0.10, 0.05, 0.15, 0.30, 0.45, (0, 0.05, -0.05, -0.05, 0.05, 0, 0)),
}
LEGAL_SIGNALS = {"see": 0.0, "see_also": 0.05, "see_generally": 0.15, "cf": 0.25, "but_see": 0.35, "contra": 0.45, "compare": 0.20}


def profiles(spark: SparkSession) -> DataFrame:
    rows = [(k, float(m), float(s), lo, mo, hi, {r: float(a) for r, a in zip(_COLUMNS, adj)}, LEGAL_SIGNALS if k == "legal" else {}) for k, (m, s, lo, mo, hi, adj) in PROFILES.items()]
    return spark.createDataFrame(rows, "discipline string, mean double, std double, low double, moderate double, high double, relations map<string,double>, signals map<string,double>")


def local_strain(df: DataFrame, passage: str, claim: str) -> DataFrame:
    """With jaccard_overlap, rouge_l, idf_overlap, bigram_divergence, score and band."""
    df = df.withColumn("__a", S.tokens(passage)).withColumn("__b", S.tokens(claim))
    df = df.withColumn("__m", S.sequence_measures("__a", "__b"))
    n = F.size("__a") + F.size("__b")
    df = df.withColumns({"jaccard_overlap": S.jaccard(F.col("__a"), F.col("__b")), "idf_overlap": S.idf_overlap(F.col("__a"), F.col("__b")), "rouge_l": F.when(F.col("__m.lcs") > 0, 2.0 * F.col("__m.lcs") / n).otherwise(0.0), "bigram_divergence": F.col("__m.divergence")})
    df = df.withColumn("score", S.lexical_score(F.col("jaccard_overlap"), F.col("rouge_l"), F.col("idf_overlap"), F.col("bigram_divergence")))
    return df.withColumn("band", S.band("score")).drop("__a", "__b", "__m")


def calibrate(df: DataFrame, score: str = "score", discipline: str = "discipline", relation: str = "relation", signal: str | None = None) -> DataFrame:
    """With calibrated, and band by the discipline's own thresholds. Unknown disciplines take the default.

    The profiles are six rows whatever the input, so Catalyst broadcasts them.
    """
    known = F.col(discipline).isin(*PROFILES)
    p = profiles(df.sparkSession).withColumnRenamed("discipline", "__d")
    df = df.withColumn("__d", F.when(known, F.col(discipline)).otherwise("social_science")).join(p, "__d", "left")
    shift = F.coalesce(F.element_at("relations", F.col(relation)), F.lit(0.0))
    if signal:
        shift = shift + F.coalesce(F.element_at("signals", F.col(signal)), F.lit(0.0))
    z = F.when(F.col("std") > 0, (F.col(score) - shift - F.col("mean")) / F.col("std")).otherwise(0.0)
    df = df.withColumn("calibrated", F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(0.0)), F.lit(1.0)))
    own = F.when(F.col(score) < F.col("low"), "low").when(F.col(score) < F.col("moderate"), "moderate").when(F.col(score) < F.col("high"), "high").otherwise("extreme")
    return df.withColumn("discipline_band", own).drop("__d", "mean", "std", "low", "moderate", "high", "relations", "signals")


def clusters(scored: DataFrame, doc: str, source: str, order: str, score: str = "score", title: str | None = None) -> DataFrame:
    """Per document and source: size, mean, population variance, gap, and whether the uses agree."""
    gap = F.max(score) - F.min(score)
    return scored.groupBy(doc, source).agg(F.count("*").alias("citations"), F.min_by(title or source, order).alias("source_title"), F.avg(score).alias("mean_strain"), F.when(F.count("*") > 1, F.var_pop(score)).otherwise(0.0).alias("strain_variance"), gap.alias("max_strain_gap"), (gap < GAP).alias("consistent"))


def obstructions(scored: DataFrame, doc: str, source: str, order: str, score: str = "score", gap: float = GAP) -> DataFrame:
    """Pairs of uses of one source in one document whose scores are at least gap apart."""
    a = scored.select(doc, source, F.col(order).alias("citation_a"), F.col(score).alias("strain_a"))
    b = scored.select(doc, source, F.col(order).alias("citation_b"), F.col(score).alias("strain_b"))
    pairs = a.join(b, [doc, source]).filter((F.col("citation_a") < F.col("citation_b")) & (F.abs(F.col("strain_a") - F.col("strain_b")) >= gap))
    return pairs.withColumn("strain_gap", F.abs(F.col("strain_a") - F.col("strain_b")))


def obstruction_counts(scored: DataFrame, doc: str, source: str, order: str, score: str = "score", gap: float = GAP) -> DataFrame:
    """Each use with the number of uses of its source in its document that are at least gap away.

    One sort by (document, source, score) instead of all pairs: uses that are far below or above are
    counted by ranges of the sorted scores. Scores that differ by just the gap count by the bounds of the range.
    """
    frame = f"(PARTITION BY `{doc}`, `{source}` ORDER BY `{score}` RANGE BETWEEN "
    below, above = (F.expr(f"count(*) OVER {frame} {range_})") for range_ in (f"UNBOUNDED PRECEDING AND {gap!r}D PRECEDING", f"{gap!r}D FOLLOWING AND UNBOUNDED FOLLOWING"))
    return scored.select(doc, source, F.col(order).alias("citation"), score, (below + above).alias("obstructions"))


def consistency(clustered: DataFrame, doc: str) -> DataFrame:
    """Per document: sources cited more than once, once, and the share of the former that agree."""
    multi = F.col("citations") > 1
    n = F.count_if(multi)
    return clustered.groupBy(doc).agg(n.alias("multi_cited_sources"), F.count_if(~multi).alias("single_cited_sources"), F.when(n > 0, F.count_if(multi & F.col("consistent")) / n).otherwise(1.0).alias("consistency_score"))


def global_strain(scored: DataFrame, doc: str, score: str = "score") -> DataFrame:
    """Per document: count, mean, max, median and the histogram of bands."""
    b = S.band(score)
    return scored.groupBy(doc).agg(F.count("*").alias("citation_count"), F.avg(score).alias("mean_local_strain"), F.max(score).alias("max_local_strain"), F.median(score).alias("median_local_strain"), *[F.count_if(b == name).alias(name) for name in ("low", "moderate", "high", "extreme")])


def discipline_mode(citations: DataFrame, doc: str, source_type: str = "source_type") -> DataFrame:
    """The commonest source type of each document; of equally common ones the least."""
    counts = citations.groupBy(doc, source_type).agg(F.count("*").alias("n"))
    return counts.groupBy(doc).agg(F.min_by(source_type, F.struct(-F.col("n"), F.col(source_type))).alias(source_type))


def fit_profile(points: DataFrame, raw: str = "raw_score", label: str = "human_label", relation: str = "relation") -> DataFrame:
    """(relation, adjustment, mean, std, low, moderate, high) from labelled scores.

    Thresholds are the scores of rank floor(q n) among the faithful, found by their row numbers, so
    that no list of all scores is held anywhere.
    """
    var = F.var_pop(raw)
    base = points.agg(F.avg(raw).alias("mean"), F.when(var > 0, F.sqrt(var)).otherwise(0.1).alias("std"), F.count_if(F.col(label) < 0.5).alias("n"))
    good = points.filter(F.col(label) < 0.5)
    ranks = lambda q: F.floor(F.col("n") * q)
    # Scores are counted by value, and values numbered range by range: BINS ranges of the scores' span,
    # and on top of each the running count of those before it.
    span = base.select("n").crossJoin(points.agg(F.min(raw).alias("lo"), F.max(raw).alias("hi")))
    byval = good.groupBy(raw).agg(F.count("*").alias("k")).crossJoin(F.broadcast(span))
    byval = byval.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.floor((F.col(raw) - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).otherwise(0))
    before = byval.groupBy("bin").agg(F.sum("k").alias("own")).withColumn("below", F.sum("own").over(Window.orderBy("bin")) - F.col("own")).drop("own")
    byval = byval.join(F.broadcast(before), "bin").withColumn("upto", F.col("below") + F.sum("k").over(Window.partitionBy("bin").orderBy(raw)))
    limits = byval.agg(*[F.min(F.when(F.col("upto") > ranks(q), F.col(raw))).alias(name) for name, q in (("q75", 0.75), ("q90", 0.90), ("q95", 0.95))])
    means = points.groupBy(relation).agg(F.avg(raw).alias("rel_mean"))
    n, mean, std = F.col("n"), F.col("mean"), F.col("std")
    return means.crossJoin(base).crossJoin(limits).select(relation, (F.col("rel_mean") - mean).alias("adjustment"), mean, std, F.when(n > 3, F.col("q75")).otherwise(mean).alias("low"), F.when(n > 9, F.col("q90")).otherwise(mean + std).alias("moderate"), F.when(n > 19, F.col("q95")).otherwise(mean + 2 * std).alias("high"))


def embedding_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two vectors; null if one is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return 1 - dot / F.nullif(norm(a) * norm(b), F.lit(0.0))
