"""Queries over the driver's tables, each with SQL that gives the same rows where SQL can.

The tables hold no citations, so the queries derive citation-shaped rows from whole tables: lines of
documents are passages, turns are claims about the turn before, events are scores, fetches or results.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import links, relation, text
from citeloom.functions.html import html_to_text
from citeloom.operators import extract, match, store, strain, verify
from citeloom.plans import sql
from citeloom.sources import citations
from citeloom.streaming.drift import drift_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """A fresh folder in the cluster's shared spark.checkpoint.dir; a temporary one only where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="citeloom-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, with the ends of its neighbours as context; no shuffle."""
    lines = F.split("text", "\n")
    around = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("exact"), F.right(F.coalesce(F.get(lines, i - 1), F.lit("")), F.lit(50)).alias("before"), F.left(F.coalesce(F.get(lines, i + 1), F.lit("")), F.lit(50)).alias("after")))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.inline(around))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.least(F.col("value") / 20, F.lit(1.0)).alias("score"))


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("url"), "ts", F.col("event_id").alias("seq"), F.sha2(F.col("event_type").cast("binary"), 256).alias("content_hash"), F.char_length("event_type").cast("long").alias("content_length"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("citation_id"), F.col("event_type").alias("status"), F.col("ts").alias("verified_at"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a claim about the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("passage", F.lag("text").over(w)).filter("passage is not null").select("conv_id", "turn", "passage", F.col("text").alias("claim"))


@query(f"WITH {sql.PASSAGES} SELECT doc_id, pos, {sql.fingerprint('exact', 'before', 'after')} AS hash FROM passages")
def fingerprint_passages(spark, sf_dir):
    return passages(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), text.fingerprint("exact", "before", "after").alias("hash"))


@query("SELECT sha256(nfc_normalize(text)) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", text.content_hash("text").alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")


@query(f"""
    WITH {sql.PASSAGES}, checked AS (
        SELECT lang, {sql.fingerprint("CASE WHEN lang = 'de' THEN upper(exact) ELSE exact END", 'before', 'after')} = {sql.fingerprint('exact', 'before', 'after')} AS valid FROM passages
    )
    SELECT lang, CASE WHEN valid THEN 'verified' ELSE 'hash_mismatch' END AS status, CASE WHEN valid THEN 'internal-only' ELSE 'internal-mismatch' END AS badge, count(*) AS n FROM checked GROUP BY ALL
""")
def verify_offline(spark, sf_dir):
    """Passages of one language are tampered with after they were hashed."""
    p = passages(spark, sf_dir).withColumn("hash", text.fingerprint("exact", "before", "after"))
    now = p.select("lang", "hash", F.when(F.col("lang") == "de", text.upper("exact")).otherwise(F.col("exact")).alias("text_exact"), F.col("before").alias("text_before"), F.col("after").alias("text_after"))
    return verify.verify(now, offline=True).groupBy("lang", "status", "badge").agg(F.count("*").alias("n"))


@query("""
    SELECT page_id, CASE WHEN regexp_extract(html, '<title>(.*?)</title>', 1) = '' THEN 1 WHEN url LIKE 'https%' AND contains(url, '#') THEN 3 ELSE 2 END AS level FROM pages
""")
def conformance_levels(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    secure, anchored = F.when(F.col("url").startswith("https"), F.col("url")), F.when(F.contains("url", F.lit("#")), F.col("url"))
    return p.select("page_id", relation.conformance_level(F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit(None).cast("string"), F.lit(""), "url", secure, anchored).alias("level"))


@query("""
    SELECT page_id, concat_ws(' ', CASE WHEN url LIKE 'https%' THEN 'https://archive.example/web/20240102030405/' || url END, url, 'https://doi.org/10.1000/' || page_id) AS urls,
           'url:' || url AS source_key, regexp_matches(url, '^(?i)https?://') AS fetchable
    FROM pages
""")
def resolve_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    archive = F.when(F.col("url").startswith("https"), F.concat(F.lit("https://archive.example/web/20240102030405/"), "url"))
    doi = F.concat(F.lit("http://doi.org/10.1000/"), F.col("page_id").cast("string"))
    found = links.resolve_urls(archive, F.concat("url", F.lit("#:~:text=a")), "url", doi)
    return p.select("page_id", F.array_join(found, " ").alias("urls"), links.source_key(F.lit(""), "url", F.lit("x"), F.lit("y")).alias("source_key"), links.is_http("url").alias("fetchable"))


@query(f"SELECT page_id, sha256(t) AS text_hash, length(t) AS n_chars FROM (SELECT page_id, {sql.html_to_text('html')} AS t FROM pages)")
def html_to_text_pages(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", html_to_text("html").alias("t"))
    return t.select("page_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_hash"), F.char_length("t").cast("long").alias("n_chars"))


@query(f"""
    WITH w AS (SELECT page_id, url, lang, source, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words FROM pages JOIN documents ON page_id = doc_id)
    SELECT page_id, CASE WHEN {sql.telling('words')} >= 3 THEN
        url || CASE WHEN contains(url, '#') THEN ':~:text=' ELSE '#:~:text=' END || url_encode(lang || ' ' || source) || '-,' ||
        CASE WHEN len(words) <= 6 THEN url_encode(array_to_string(words, ' ')) ELSE url_encode(array_to_string(words[1:3], ' ')) || ',' || url_encode(array_to_string(words[-3:], ' ')) END || ',-' || url_encode(source) END AS link
    FROM w
""")
def fragment_urls(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text", "lang", "source")
    p = table(spark, sf_dir, "pages").select("page_id", "url").join(d, "page_id")
    return p.select("page_id", links.text_fragment_url("url", "text", F.concat_ws(" ", "lang", "source"), "source").alias("link"))


@query(f"""
    WITH p AS (SELECT item_id, {sql.norm('text')} AS p FROM benchmark), s AS (SELECT doc_id, {sql.norm('text')} AS s FROM documents), l AS (SELECT *, lower(s) AS ls FROM s),
    m AS (SELECT item_id, doc_id, s, p, position(p IN s) AS e, position(lower(p) IN ls) AS f FROM p, l WHERE p <> '' AND position(lower(p) IN ls) > 0),
    a AS (SELECT *, CASE WHEN e > 0 THEN e ELSE f END - 1 AS st FROM m)
    SELECT item_id, doc_id, CASE WHEN e > 0 THEN 'exact' ELSE 'normalized' END AS match_type, CAST(st AS INT) AS norm_char_start, substr(s, st + 1, length(p)) AS matched_text,
           {sql.fingerprint('substr(s, st + 1, length(p))', 'substr(s, greatest(st - 50, 0) + 1, least(st, 50))', 'substr(s, st + length(p) + 1, 50)')} AS recomputed
    FROM a
""")
def passage_match(spark, sf_dir):
    found = match.search_corpus(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")
    return found.select("item_id", "doc_id", "match_type", "norm_char_start", "matched_text", text.fingerprint("matched_text", "context_before", "context_after").alias("recomputed"))


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second line of each document, as it was cited, and what its source is now."""
    d = table(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n")).filter(F.size("lines") > 1)
    before = F.right(F.concat(F.get("lines", F.lit(0)), F.lit("\n")), F.lit(50))
    after = F.left(F.concat(F.lit("\n"), F.coalesce(F.get("lines", F.lit(2)), F.lit(""))), F.lit(50))
    now = F.when(F.col("lang") == "fr", text.upper("text")).when(F.col("lang") == "de", F.get("lines", F.lit(0))).when(F.col("lang") == "en", F.col("text"))
    rows = d.select("doc_id", F.get("lines", F.lit(1)).alias("text_exact"), before.alias("text_before"), after.alias("text_after"), F.col("source").alias("url"), now.alias("source_text"), F.lit("tool").alias("captured_by"))
    return rows.withColumn("hash", text.fingerprint("text_exact", "text_before", "text_after"))


def _cited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with all its lines, as they were cited, and what its whole source is now; no shuffle."""
    lines = F.col("lines")
    # 50 lines with their ends are 50 characters at least; a neighbour of 49 is enough by itself.
    ends = lambda i, n, cut: F.array_join(F.transform(F.slice(lines, i, n), lambda x: cut(x, F.lit(50))), "\n")
    above = lambda i: F.when(F.char_length(F.get(lines, i - 1)) >= 49, F.get(lines, i - 1)).otherwise(ends(F.greatest(i - 49, F.lit(1)), F.least(i, F.lit(50)), F.right))
    below = lambda i: F.when(F.char_length(F.get(lines, i + 1)) >= 49, F.get(lines, i + 1)).otherwise(ends(i + 2, F.lit(50), F.left))
    before = lambda i: F.when(i > 0, F.right(F.concat(above(i), F.lit("\n")), F.lit(50))).otherwise("")
    after = lambda i: F.when(i + 1 < F.size(lines), F.left(F.concat(F.lit("\n"), below(i)), F.lit(50))).otherwise("")
    around = F.transform(lines, lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias("text_exact"), before(i).alias("text_before"), after(i).alias("text_after")))
    now = F.when(F.col("lang") == "fr", text.upper("text")).when(F.col("lang").isin("de", "en"), F.col("text"))
    # The lines as a column of their own: within the lambda, split would run once for every line.
    rows = table(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n"))
    rows = rows.select("doc_id", F.col("source").alias("url"), now.alias("source_text"), F.lit("tool").alias("captured_by"), around.alias("citations"))
    hashed = F.transform("citations", lambda x: x.withField("hash", text.fingerprint(x["text_exact"], x["text_before"], x["text_after"])))
    return rows.withColumn("citations", hashed)


_NOW = "CASE lang WHEN 'fr' THEN upper(text) WHEN 'de' THEN lines[1] WHEN 'en' THEN text END"


@query(f"""
    WITH d AS (SELECT doc_id, lang, text, string_split(text, chr(10)) AS lines FROM documents),
    c AS (SELECT doc_id, lines[2] AS x, right(lines[1] || chr(10), 50) AS b, left(chr(10) || coalesce(lines[3], ''), 50) AS a, {_NOW} AS t FROM d WHERE len(lines) > 1),
    n AS (SELECT *, {sql.norm('t')} AS s, {sql.norm('x')} AS p FROM c),
    m AS (SELECT *, CASE WHEN x = '' THEN 0 WHEN position(p IN s) > 0 OR p = '' THEN greatest(position(p IN s), 1) ELSE position(lower(p) IN lower(s)) END - 1 AS st FROM n),
    r AS (SELECT *, {sql.fingerprint('substr(s, st + 1, length(p))', 'substr(s, greatest(st - 50, 0) + 1, least(st, 50))', 'substr(s, st + length(p) + 1, 50)')} = {sql.fingerprint('x', 'b', 'a')} AS same FROM m)
    SELECT doc_id, CASE WHEN coalesce(t, '') = '' THEN 'source_unavailable' WHEN st < 0 THEN 'passage_not_found' WHEN same THEN 'verified' ELSE 'passage_verified' END AS status,
           CASE WHEN coalesce(t, '') = '' THEN 'unreachable' WHEN st >= 0 AND same THEN 'verified' ELSE 'partial' END AS badge
    FROM r
""")
def source_verify_status(spark, sf_dir):
    return verify.verify(_cited(spark, sf_dir), fuzzy=False).select("doc_id", "status", "badge")


@query()
def source_verify_lines(spark, sf_dir):
    """The same of every line of every document against its whole source."""
    return verify.verify_each(_cited_lines(spark, sf_dir), fuzzy=False).select("doc_id", "pos", "status", "badge")


@query()
def source_verify_fuzzy(spark, sf_dir):
    """With approximate search of what the plain ones left over, which SQL cannot express."""
    return verify.verify_each(_cited_lines(spark, sf_dir)).select("doc_id", "pos", "status", "badge", "match_type", F.round("similarity", 9).alias("similarity"), F.array_join("warnings", "; ").alias("warnings"))


_BIGRAMS = "list_transform(range(1, len({0})), lambda i: {0}[i] || '_' || {0}[i + 1])"


@query(f"""
    WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS passage FROM conversations),
    k AS (SELECT conv_id, turn, {sql.tokens('passage')} AS a, {sql.tokens('text')} AS b FROM t WHERE passage IS NOT NULL),
    j AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) END AS jac, {_BIGRAMS.format('a')} AS x, {_BIGRAMS.format('b')} AS y FROM k),
    g AS (SELECT conv_id, turn, 1 AS cx, 0 AS cy, unnest(x) AS w FROM j UNION ALL SELECT conv_id, turn, 0, 1, unnest(y) FROM j),
    c AS (SELECT conv_id, turn, w, sum(cx) AS cx, sum(cy) AS cy FROM g GROUP BY ALL),
    v AS (SELECT conv_id, turn, count(*) AS v FROM c GROUP BY ALL),
    p AS (SELECT conv_id, turn, (cx + 1) / (len(x) + v) AS p, (cy + 1) / (len(y) + v) AS q FROM c JOIN v USING (conv_id, turn) JOIN j USING (conv_id, turn)),
    s AS (SELECT conv_id, turn, sum(0.5 * p * log2(2 * p / (p + q)) + 0.5 * q * log2(2 * q / (p + q))) AS d FROM p GROUP BY ALL)
    SELECT conv_id, turn, round(jac, 9) AS jaccard_overlap, round(jac, 9) AS idf_overlap, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 1.0 ELSE least(d, 1.0) END, 9) AS bigram_divergence
    FROM j LEFT JOIN s USING (conv_id, turn)
""")
def strain_lexical(spark, sf_dir):
    out = strain.local_strain(turns(spark, sf_dir), "passage", "claim")
    return out.select("conv_id", "turn", *[F.round(c, 9).alias(c) for c in ("jaccard_overlap", "idf_overlap", "bigram_divergence")])


@query()
def strain_turns(spark, sf_dir):
    """With the longest common subsequence and the score; the test compares them with brute force."""
    out = strain.local_strain(turns(spark, sf_dir), "passage", "claim")
    return out.select("conv_id", "turn", F.round("rouge_l", 9).alias("rouge_l"), F.round("score", 9).alias("score"), "band")


_TYPES = {"click": "academic", "view": "web", "error": "ai_output"}
_DISCIPLINE = "CASE event_type WHEN 'click' THEN 'social_science' WHEN 'view' THEN 'journalism' WHEN 'error' THEN 'ai_output' ELSE 'social_science' END"


def _profile_values() -> str:
    return ", ".join(f"('{k}', {m}, {s}, {lo}, {mo}, {hi}, {adj[4]}, {adj[3]})" for k, (m, s, lo, mo, hi, adj) in strain.PROFILES.items())


@query(f"""
    WITH {sql.SCORED}, p(discipline, mean, std, low, moderate, high, ctx, quant) AS (VALUES {_profile_values()}),
    d AS (SELECT *, {_DISCIPLINE} AS discipline FROM scored),
    c AS (SELECT event_id, score, low, moderate, high, (score - CASE event_type WHEN 'view' THEN ctx WHEN 'error' THEN quant ELSE 0 END - mean) / std AS z FROM d JOIN p USING (discipline))
    SELECT event_id, round(1 / (1 + exp(-z)), 9) AS calibrated, CASE WHEN score < low THEN 'low' WHEN score < moderate THEN 'moderate' WHEN score < high THEN 'high' ELSE 'extreme' END AS discipline_band FROM c
""")
def strain_calibrated(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])
    rel = F.when(F.col("event_type") == "view", "contextualizes").when(F.col("event_type") == "error", "quantifies").otherwise("supports")
    s = scored(spark, sf_dir).withColumn("discipline", relation.discipline(F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("other")))).withColumn("relation", rel)
    return strain.calibrate(s).select("event_id", F.round("calibrated", 9).alias("calibrated"), "discipline_band")


@query(f"""
    WITH {sql.SCORED} SELECT user_id, count(*) AS citation_count, round(avg(score), 9) AS mean_local_strain, round(max(score), 9) AS max_local_strain, round(median(score), 9) AS median_local_strain,
        count(*) FILTER (score < 0.25) AS low, count(*) FILTER (score >= 0.25 AND score < 0.5) AS moderate, count(*) FILTER (score >= 0.5 AND score < 0.75) AS high, count(*) FILTER (score >= 0.75) AS extreme
    FROM scored GROUP BY user_id
""")
def global_strain(spark, sf_dir):
    out = strain.global_strain(scored(spark, sf_dir), "user_id")
    return out.withColumns({c: F.round(c, 9) for c in ("mean_local_strain", "max_local_strain", "median_local_strain")})


@query(f"""
    WITH {sql.SCORED} SELECT user_id, event_type, count(*) AS citations, min(event_type) AS source_title, round(avg(score), 9) AS mean_strain,
        round(CASE WHEN count(*) > 1 THEN var_pop(score) ELSE 0 END, 9) AS strain_variance, round(max(score) - min(score), 9) AS max_strain_gap, max(score) - min(score) < 0.3 AS consistent
    FROM scored GROUP BY user_id, event_type
""")
def consistency_clusters(spark, sf_dir):
    out = strain.clusters(scored(spark, sf_dir), "user_id", "event_type", "event_id")
    return out.withColumns({c: F.round(c, 9) for c in ("mean_strain", "strain_variance", "max_strain_gap")})


@query(f"""
    WITH {sql.SCORED}, c AS (SELECT user_id, event_type, count(*) AS n, max(score) - min(score) < 0.3 AS ok FROM scored GROUP BY ALL)
    SELECT user_id, count(*) FILTER (n > 1) AS multi_cited_sources, count(*) FILTER (n = 1) AS single_cited_sources,
        CASE WHEN count(*) FILTER (n > 1) > 0 THEN count(*) FILTER (n > 1 AND ok) / count(*) FILTER (n > 1) ELSE 1.0 END AS consistency_score
    FROM c GROUP BY user_id
""")
def consistency_report(spark, sf_dir):
    return strain.consistency(strain.clusters(scored(spark, sf_dir), "user_id", "event_type", "event_id"), "user_id")


@query(f"""
    WITH {sql.SCORED} SELECT user_id, event_type, event_id AS citation,
        count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND 0.3 PRECEDING) + count(*) OVER (w RANGE BETWEEN 0.3 FOLLOWING AND UNBOUNDED FOLLOWING) AS obstructions
    FROM scored WINDOW w AS (PARTITION BY user_id, event_type ORDER BY score)
""")
def consistency_obstructions(spark, sf_dir):
    """One row a citation with the number of those that disagree with it; pairs are not spelled out."""
    return strain.obstruction_counts(scored(spark, sf_dir), "user_id", "event_type", "event_id").drop("score")


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)
    SELECT user_id, event_type AS source_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) WHERE r = 1
""")
def discipline_mode(spark, sf_dir):
    return strain.discipline_mode(table(spark, sf_dir, "events").withColumnRenamed("event_type", "source_type"), "user_id")


@query(f"""
    WITH {sql.SCORED}, b AS (SELECT avg(score) AS mean, stddev_pop(score) AS std, list_sort(list(score) FILTER (event_type <> 'error')) AS f FROM scored)
    SELECT event_type AS relation, round(avg(score) - any_value(mean), 9) AS adjustment, round(any_value(mean), 9) AS mean, round(any_value(std), 9) AS std,
        round(any_value(f[1 + CAST(floor(len(f) * 0.75) AS BIGINT)]), 9) AS low, round(any_value(f[1 + CAST(floor(len(f) * 0.9) AS BIGINT)]), 9) AS moderate, round(any_value(f[1 + CAST(floor(len(f) * 0.95) AS BIGINT)]), 9) AS high
    FROM scored, b GROUP BY event_type
""")
def profile_fit(spark, sf_dir):
    points = scored(spark, sf_dir).select(F.col("score").alias("raw_score"), F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("human_label"), F.col("event_type").alias("relation"))
    out = strain.fit_profile(points)
    return out.select("relation", *[F.round(c, 9).alias(c) for c in ("adjustment", "mean", "std", "low", "moderate", "high")])


@query(sql.DRIFT)
def drift_events(spark, sf_dir):
    return store.drift_events(fetches(spark, sf_dir)).withColumn("detected_at", stamp("detected_at"))


@query(sql.DRIFT)
def drift_streamed(spark, sf_dir):
    """The same events found by the stateful stream over the events table."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.col("user_id").cast("string").alias("url"), "ts", F.col("event_id").alias("seq"), F.sha2(F.col("event_type").cast("binary"), 256).alias("content_hash"), F.char_length("event_type").cast("long").alias("content_length"))
    at = shared(spark, "drift")
    drift_stream(rows).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("detected_at", stamp("detected_at"))


@query(f"""
    WITH {sql.FETCHES} SELECT url, content_hash, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, count(*) AS fetch_count, min(content_length) AS content_length
    FROM fetches GROUP BY url, content_hash
""")
def source_history(spark, sf_dir):
    return store.source_history(fetches(spark, sf_dir)).withColumns({c: stamp(c) for c in ("first_seen", "last_seen")})


@query(f"""
    WITH d AS ({sql.DRIFT}) SELECT (SELECT count(*) FROM events) AS verifications, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') FROM events) AS last_verified_at,
        (SELECT count(DISTINCT user_id) FROM events) AS unique_sources, (SELECT count(*) FROM d) AS drift_events, (SELECT count(DISTINCT url) FROM d) AS drifted_sources
""")
def store_stats(spark, sf_dir):
    f = fetches(spark, sf_dir)
    return store.stats(results(spark, sf_dir), f, store.drift_events(f)).withColumn("last_verified_at", stamp("last_verified_at"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_summary(spark, sf_dir):
    return store.by_status(results(spark, sf_dir))


@query("SELECT max(event_id) AS id, CAST(user_id AS VARCHAR) AS citation_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def latest_result(spark, sf_dir):
    return store.latest(results(spark, sf_dir)).select("id", "citation_id", "status")


@query("SELECT event_id AS id, CAST(user_id AS VARCHAR) AS citation_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_results(spark, sf_dir):
    return store.recent(results(spark, sf_dir), status="error").select("id", "citation_id")


@query(f"WITH {sql.PASSAGES} SELECT lang, {sql.relation('exact', "before || ' ' || after")} AS relation, count(*) AS n FROM passages GROUP BY ALL")
def relation_inference(spark, sf_dir):
    return passages(spark, sf_dir).groupBy("lang", relation.infer_relation("exact", "before", "after").alias("relation")).agg(F.count("*").alias("n"))


@query("""
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings)
    SELECT vec_id, label, round(1 - list_cosine_similarity(e, f), 6) AS distance FROM v WHERE f IS NOT NULL
""")
def embedding_distance(spark, sf_dir):
    """Of each vector and the one before it under the same label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").withColumn("other", F.lag("embedding").over(w)).filter("other is not null")
    return e.select("vec_id", "label", F.round(strain.embedding_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("SELECT conv_id, turn, 'c-' || conv_id || '-' || turn AS id, text AS text_exact, role AS title FROM conversations WHERE text IS NOT NULL")
def citations_from_html(spark, sf_dir):
    """Writes each turn as a citation in a page of its own and reads it back."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    record = F.to_json(F.struct(F.lit("Cite").alias("@type"), F.lit("1.0").alias("version"), F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), F.struct(F.col("role").alias("title")).alias("source"), F.struct(F.col("text").alias("text_exact")).alias("target"), F.lit("supports").alias("relation"), F.lit("author").alias("captured_by")))
    pages = c.select("conv_id", "turn", F.concat(F.lit('<html><script type="application/ld+json">'), record, F.lit("</script><p>x</p></html>")).alias("html"))
    return citations.from_html(pages, "html", "Cite").select("conv_id", "turn", "id", F.col("target.text_exact").alias("text_exact"), F.col("source.title").alias("title"))


@query("""
    WITH q AS (SELECT doc_id, unnest(regexp_extract_all(text, '"([^"\\n]{20,})"', 1)) AS q FROM documents)
    SELECT DISTINCT doc_id, trim(q) AS text_exact FROM q WHERE length(trim(q)) >= 20
""")
def quoted_passages(spark, sf_dir):
    return extract.extract(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "markdown").select("doc_id", "text_exact")


@query("""
    SELECT page_id, date_diff('day', DATE '2024-01-02', DATE '2024-01-02' + CAST(page_id AS INT)) AS age_days, page_id <= 30 AS reusable FROM pages
""")
def snapshot_ages(spark, sf_dir):
    """Snapshots taken on one day, looked at page_id days later."""
    p = table(spark, sf_dir, "pages")
    address, now = F.concat(F.lit("https://archive.example/web/20240102030405/"), "url"), F.try_to_timestamp(F.lit("20240102030405"), F.lit("yyyyMMddHHmmss")) + F.make_dt_interval(days=F.col("page_id").cast("int"))
    return p.select("page_id", links.snapshot_age_days(address, now).cast("long").alias("age_days"), links.reusable_snapshot(address, now).alias("reusable"))
