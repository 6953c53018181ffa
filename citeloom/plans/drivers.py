"""Queries of the drivers: metadata, enrichment, rendering, reports and stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import labels, links, strain, text
from citeloom.operators import enrich, extract, render, resolve, store
from citeloom.plans import sql
from citeloom.plans.queries import fetches, passages, query, shared, stamp, table, turns
from citeloom.sources import writers

_HINT = """
    CASE s_suppkey % 4 WHEN 0 THEN '(' || NAME || ' & Smith, ' || (1990 + s_nationkey + s_suppkey % 8) || ')' WHEN 1 THEN 'see 10.1234/abc.' || s_suppkey || ', p. 3'
    WHEN 2 THEN NAME || ' et al., ' || (1990 + s_nationkey + s_suppkey % 8) || 'b' ELSE '' END
"""
_NAMED, _AUTHOR = ("'Nat' || chr(97 + CAST({} AS INT))".format(k) for k in ("s_nationkey", "n_nationkey"))  # Nata, Natb, ...


def hints(spark, sf_dir):
    """A hint of each supplier: an author and a year, a DOI, or none."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_HINT.replace("NAME", _NAMED)).alias("citation_hint"))


def registry(spark, sf_dir):
    """Records of works, by nations as authors, as a registry would send them."""
    n = table(spark, sf_dir, "nation")
    dates = lambda y: F.struct(F.array(F.array(y)).alias("date-parts"))
    item = F.struct(
        F.array(F.concat(F.lit("On "), "n_name")).alias("title"), F.array(F.struct(F.expr(_AUTHOR).alias("family"), F.lit("A.").alias("given"))).alias("author"), F.concat(F.lit("10.1234/abc."), F.col("n_nationkey").cast("string")).alias("DOI"),
        F.when(F.col("n_nationkey") % 2 == 0, "report").otherwise("journal-article").alias("type"), (F.col("n_nationkey") / 4).alias("score"), dates((1990 + F.col("n_nationkey")).cast("int")).alias("issued"),
    )
    return n.select("n_nationkey", F.to_json(item).alias("item"))


def sources(spark, sf_dir):
    return registry(spark, sf_dir).select(resolve.source_metadata("item").alias("s")).select("s.*")


_WITH_HINTS = f"h AS (SELECT s_suppkey, {_HINT.replace('NAME', _NAMED)} AS hint FROM supplier)"
_WITH_PARTS = _WITH_HINTS + r""", p AS (SELECT s_suppkey, hint, CASE WHEN contains(hint, '10.1234') THEN regexp_extract(hint, '10\.[0-9]+/[^ ,]+') END AS doi,
    nullif(regexp_extract(hint, '[A-Z][a-z]+'), '') AS author, CAST(nullif(regexp_extract(hint, '[0-9]{4}'), '') AS INT) AS year FROM h)"""
_WITH_ITEMS = f"i AS (SELECT n_nationkey AS k, n_name, {_AUTHOR} AS author, 1990 + n_nationkey AS year, n_nationkey / 4 AS score FROM nation)"


@query(f"WITH {_WITH_PARTS} SELECT s_suppkey, doi, CASE WHEN doi IS NULL THEN author END AS author, CASE WHEN doi IS NULL THEN year END AS year FROM p")
def hint_parts(spark, sf_dir):
    return hints(spark, sf_dir).select("s_suppkey", resolve.hint_parts("citation_hint").alias("p")).select("s_suppkey", "p.*")


@query(f"WITH {_WITH_ITEMS} SELECT 'On ' || n_name AS title, author || ', A.' AS authors, CAST(year AS INT) AS year, '10.1234/abc.' || k AS doi, 'https://doi.org/10.1234/abc.' || k AS url, CASE WHEN k % 2 = 0 THEN 'grey' ELSE 'academic' END AS source_type FROM i")
def source_records(spark, sf_dir):
    return sources(spark, sf_dir).select("title", F.array_join("authors", "; ").alias("authors"), "year", "doi", "url", "source_type")


_LOOKED_UP = f"""
    {_WITH_PARTS}, {_WITH_ITEMS}, f AS (
        SELECT s_suppkey, 'On ' || n_name AS title, k FROM p JOIN i ON p.doi = '10.1234/abc.' || k
        UNION ALL SELECT s_suppkey, 'On ' || n_name, k FROM p JOIN i ON p.doi IS NULL AND p.author = i.author AND abs(p.year - i.year) <= 1 AND score >= 1
    )
"""


@query(f"WITH {_LOOKED_UP} SELECT s_suppkey, title, CASE WHEN k % 3 = 0 THEN 'http://pdf/' || k ELSE 'http://page/' || k END AS oa_url FROM f")
def metadata_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    location = F.struct(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("http://pdf/"), key)).alias("url_for_pdf"), F.lit("").alias("url"), F.concat(F.lit("http://page/"), key).alias("url_for_landing_page"))
    free = n.select(F.concat(F.lit("10.1234/abc."), key).alias("doi"), location.alias("best_oa_location"))
    found = resolve.looked_up(hints(spark, sf_dir), sources(spark, sf_dir), "s_suppkey", open_access=free)
    return found.select("s_suppkey", "source.title", "oa_url")


@query(f"""
    WITH {_LOOKED_UP}, refs AS (SELECT n_nationkey AS ord, n_name, {_AUTHOR} AS who, 1995 + n_nationkey AS year FROM nation WHERE n_nationkey >= 5),
    m AS (SELECT s_suppkey, min(ord) AS ord FROM h JOIN refs ON contains(lower(hint), lower(who)) AND regexp_extract(hint, '[0-9]{{4}}') = CAST(year AS VARCHAR) GROUP BY 1)
    SELECT h.s_suppkey, CASE WHEN m.ord IS NOT NULL THEN 'matched' WHEN f.title IS NOT NULL THEN 'searched' WHEN hint = '' THEN 'self' ELSE 'unresolved' END AS resolution,
        CASE WHEN m.ord IS NOT NULL THEN 'Book ' || refs.n_name WHEN f.title IS NOT NULL THEN f.title WHEN hint = '' THEN 'This article' ELSE '[UNRESOLVED: ' || hint || ']' END AS title
    FROM h LEFT JOIN m USING (s_suppkey) LEFT JOIN refs USING (ord) LEFT JOIN f USING (s_suppkey)
""")
def reference_resolution(spark, sf_dir):
    """Curated references first, then the registry, then the article itself."""
    n = table(spark, sf_dir, "nation").filter("n_nationkey >= 5")
    refs = n.select(F.concat_ws(", ", F.expr(_AUTHOR), (1995 + F.col("n_nationkey")).cast("string")).alias("ref_key"), F.col("n_nationkey").alias("ord"), F.array(F.concat(F.expr(_AUTHOR), F.lit(", B."))).alias("authors"), (1995 + F.col("n_nationkey")).cast("int").alias("year"), F.concat(F.lit("Book "), "n_name").alias("title"))
    out = resolve.resolve(hints(spark, sf_dir), refs, sources(spark, sf_dir), {"title": "This article", "authors": ["Own, A."], "year": 2020}, "s_suppkey")
    return out.select("s_suppkey", "resolution", "title")


@query(f"""
    WITH {sql.PASSAGES} SELECT doc_id, pos, CASE WHEN lang = 'de' AND {sql.fingerprint('upper(exact)', 'before', 'after')} <> {sql.fingerprint('exact', 'before', 'after')} THEN 'internal-mismatch' ELSE 'internal-only' END AS status, '2026-01-01' AS checked_at, 'kept' AS other FROM passages
""")
def enriched_citations(spark, sf_dir):
    """Every line as a citation that had an enrichment of its own, enriched offline."""
    p = passages(spark, sf_dir).withColumn("hash", text.fingerprint("exact", "before", "after"))
    cites = p.select("doc_id", "pos", F.when(F.col("lang") == "de", text.upper("exact")).otherwise(F.col("exact")).alias("text_exact"), F.col("before").alias("text_before"), F.col("after").alias("text_after"), "hash", F.create_map(F.lit("own"), F.lit('"kept"')).alias("enrichment"))
    out = enrich.enrich(cites, F.lit("2026-01-01T00:00:00Z"), offline=True).withColumn("json", enrich.enrichment_json("enrichment"))
    part = lambda path: F.get_json_object("json", path)
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), part("$.verification.status").alias("status"), labels.short_date(part("$.verification.checked_at")).alias("checked_at"), part("$.own").alias("other"))


def analysed(spark, sf_dir):
    """Turns as claims that quote the turn before them in an article of their own."""
    t = turns(spark, sf_dir).select("conv_id", "turn", F.col("passage").alias("text_exact"), F.lit("").alias("text_before"), F.lit("").alias("text_after"), F.concat_ws(" ", F.col("claim"), F.lit("So they say: "), "passage", F.lit(". That is that. And more.")).alias("article"))
    kind = F.when(F.col("conv_id") % 2 == 0, "web").otherwise("academic")
    null = F.lit(None).cast("string")
    rows = t.select("*", kind.alias("source_type"), F.lit("supports").alias("relation"), null.alias("doi"), F.concat(F.lit("http://s/"), (F.col("turn") % 2).cast("string")).alias("url"), F.lit("t").alias("title"))

    def stage(df):
        at = shared(spark, "strain")
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    return enrich.analyze(rows, "conv_id", "turn", "article", stage=stage)


@query()
def document_strain(spark, sf_dir):
    """Claims in context, calibrated, per conversation; a test compares it with brute force."""
    return analysed(spark, sf_dir)["documents"]


@query()
def strain_reports(spark, sf_dir):
    a = analysed(spark, sf_dir)
    return enrich.report_json(a, "conv_id", "turn").join(enrich.report_text(a, "conv_id").withColumnRenamed("report", "lines"), "conv_id")


_LEX, _ENT = "least(value / 20, 1.0)", "least(value / 40, 1.0)"


@query(f"SELECT event_id, round(CASE WHEN event_type = 'error' THEN {_LEX} ELSE least(greatest(0.4 * {_LEX} + 0.6 * least(1 - {_ENT} + CASE WHEN event_type = 'view' THEN 0.15 ELSE 0 END, 1.0), 0), 1) END, 9) AS score FROM events")
def strain_blended(spark, sf_dir):
    """Lexical scores with those of an inference model, where there are any."""
    e = table(spark, sf_dir, "events")
    entailed = F.when(F.col("event_type") != "error", F.least(F.col("value") / 40, F.lit(1.0)))
    against = F.when(F.col("event_type") == "view", 0.5)
    return e.select("event_id", F.round(strain.blended_score(F.least(F.col("value") / 20, F.lit(1.0)), entailed, against), 9).alias("score"))


_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"


@query(f"SELECT page_id, CAST(contains(substr(html, strpos(html, '<body')), {_TITLE}) AS INT) AS located, 1 AS panels FROM pages WHERE {_TITLE} <> ''")
def rendered_pages(spark, sf_dir):
    """Pages with their title cited, rendered twice: the second time renews the first."""
    p = table(spark, sf_dir, "pages").withColumn("title", F.regexp_extract("html", "<title>(.*?)</title>", 1)).filter("title <> ''")
    cites = p.select("page_id", F.lit("c1").alias("id"), F.struct(F.lit("A source").alias("title"), F.array(F.lit("Doe, Jane")).alias("authors"), F.lit(2020).alias("year"), "url", F.lit(None).cast("string").alias("venue"), F.lit("web").alias("source_type")).alias("source"), F.struct(F.col("title").alias("text_exact"), F.lit("sha256:0").alias("hash"), F.lit(None).cast("string").alias("fragment_url")).alias("target"))
    cites = cites.select("page_id", render.shown(F.to_json(F.struct("id", "source", "target")), F.lit("verified"), F.lit("low")).alias("c"))
    once = render.rendered(p, cites, "page_id", "html").select("page_id", F.col("output").alias("html"))
    return render.rendered(once, cites, "page_id", "html").select("page_id", "located", F.regexp_count("output", F.lit('class="cl-panel"')).alias("panels"))


@query("SELECT conv_id, count(*) AS citations, 'ok' AS forms FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def written_articles(spark, sf_dir):
    """Each conversation as an article, with its turns as citations in three forms."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    null = F.lit(None).cast("string")
    cites = c.select("conv_id", F.lit("1.0").alias("version"), F.format_string("c-%05d", "turn").alias("id"), F.struct(F.col("role").alias("title")).alias("source"), F.struct(F.col("text").alias("text_exact")).alias("target"), F.lit("supports").alias("relation"), null.alias("captured_at"), F.lit("author").alias("captured_by"), null.alias("enrichment"))
    articles = c.groupBy("conv_id").agg(F.min("text").alias("body"))
    out = writers.written(articles, cites, "body", "json", "conv_id").withColumnRenamed("output", "json")
    md, tex = (writers.written(articles, cites, "body", form, "conv_id").withColumnRenamed("output", form) for form in ("markdown", "latex"))
    rows = out.join(md, "conv_id").join(tex, "conv_id")
    inner = F.regexp_extract("markdown", r"(?s)```json\n\n(.*)\n\n```\n\z", 1)
    tail = F.regexp_replace(F.regexp_extract("latex", r"(?s)% ====== citation metadata ======\n(.*)\n% ====== end ======\n\z", 1), "(?m)^% ", "")
    same = (F.concat(inner, F.lit("\n")) == F.col("json")) & (F.concat(tail, F.lit("\n")) == F.col("json"))
    return rows.select("conv_id", F.json_array_length("json").cast("long").alias("citations"), F.when(same, "ok").otherwise("differ").alias("forms"))


_STATUS = "CASE event_type WHEN 'click' THEN 'verified' WHEN 'view' THEN 'passage_verified' WHEN 'error' THEN 'hash_mismatch' ELSE 'source_unavailable' END"


@query(f"""
    WITH c AS (SELECT {_STATUS} AS status, count(*) AS n FROM events GROUP BY 1), w(status, k, words) AS (VALUES ('verified', 1, 'fully verified'), ('passage_verified', 2, 'passage confirmed'), ('hash_mismatch', 3, 'hash mismatch'), ('source_unavailable', 4, 'source unavailable'))
    SELECT CAST(sum(n) AS BIGINT) || ' citations checked | ' || string_agg(n || ' ' || words, ' | ' ORDER BY k) AS summary FROM c JOIN w USING (status)
""")
def verification_summary(spark, sf_dir):
    return writers.summary_text(table(spark, sf_dir, "events").groupBy(F.expr(_STATUS).alias("status")).agg(F.count("*").alias("n")))


@query(f"""
    SELECT event_id, '  [' || CASE event_type WHEN 'click' THEN '✓] ' || event_id || ': VERIFIED' WHEN 'view' THEN '~] ' || event_id || ': PASSAGE FOUND' WHEN 'error' THEN '✗] ' || event_id || ': HASH MISMATCH' ELSE '!] ' || event_id || ': SOURCE UNAVAILABLE' END || chr(10) ||
        '      Source: s' || chr(10) || '      Relation: supports | Level: L2 | Captured by: tool' || chr(10) || '      Internal hash: valid' ||
        CASE WHEN event_type = 'view' THEN chr(10) || '      Match type: fuzzy (90%)' || chr(10) || '      Found: "view"' || chr(10) || '      Source hash: differs' || chr(10) || '      Warning: w' ELSE '' END AS report
    FROM events
""")
def verification_reports(spark, sf_dir):
    e, view = table(spark, sf_dir, "events"), F.col("event_type") == "view"
    rows = e.select("event_id", F.col("event_id").alias("citation_id"), F.expr(_STATUS).alias("status"), F.lit("s").alias("source_title"), F.lit("").alias("page_ref"), F.lit("supports").alias("relation"), F.lit(2).alias("conformance_level"), F.lit("tool").alias("captured_by"), F.lit(True).alias("internal_hash_valid"), F.lit("").alias("source_url"), F.when(view, "fuzzy").alias("match_type"), F.when(view, 0.9).alias("similarity"), F.col("event_type").alias("matched_text"), F.when(view, F.lit(False)).alias("source_hash_valid"), F.lit("").alias("fetch_error"), F.when(view, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return rows.select("event_id", writers.result_text().alias("report"))


@query(f"""
    WITH d AS ({sql.DRIFT}), r AS (SELECT CAST(user_id AS VARCHAR) AS url, event_type AS citation_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events)
    SELECT d.url, d.new_hash, any_value(d.detected_at) AS detected_at, array_to_string(list_sort(list(DISTINCT citation_id)), ' ') AS citation_ids FROM d JOIN r ON d.url = r.url AND r.at <= d.detected_at GROUP BY d.url, d.new_hash
""")
def drift_report(spark, sf_dir):
    """Drift of all addresses, newest first, with the citations checked against them up to then."""
    f = fetches(spark, sf_dir)
    r = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_url"), F.col("event_type").alias("citation_id"), F.col("ts").alias("verified_at"))
    out = store.drift_of(store.affected(store.drift_events(f), r), newest_first=True)
    return out.select("url", "new_hash", stamp("detected_at").alias("detected_at"), F.array_join("citation_ids", " ").alias("citation_ids"))


@query("""
    SELECT source AS url, sha256(nfc_normalize(text)) AS content_hash, count(*) AS fetch_count, min(length(text)) AS content_length, epoch(min(make_timestamp(doc_id * 1000000))) AS first_seen FROM documents GROUP BY 1, 2
""")
def content_history(spark, sf_dir):
    """Documents as fetches of their source: what each has had, from whole texts."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("url"), "text", F.timestamp_seconds("doc_id").alias("ts"), F.col("doc_id").alias("seq"))
    h = store.source_history(store.hashed_fetches(d))
    return h.select("url", "content_hash", "fetch_count", F.col("content_length").cast("long").alias("content_length"), F.unix_seconds("first_seen").cast("double").alias("first_seen"))


@query("""
    WITH s AS (SELECT user_id, arg_max('https://archive.example/web/' || strftime(ts, '%Y%m%d%H%M%S') || '/x', ts) AS archive_url, max(ts) AS ts FROM events WHERE event_type <> 'error' GROUP BY 1)
    SELECT user_id, archive_url, coalesce(floor(epoch(TIMESTAMP '2024-02-15 00:00:00' - date_trunc('second', ts)) / 86400) <= 30, false) AS reusable FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN s USING (user_id)
""")
def snapshot_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.select("user_id", F.concat(F.lit("http://archive.example/web/"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("/x")).alias("archive_url"), F.col("ts").alias("timestamp"), (F.col("event_type") != "error").alias("available"))
    return resolve.closest_snapshots(e.select("user_id").distinct(), s, "user_id", F.to_timestamp(F.lit("2024-02-15 00:00:00")))


@query("SELECT conv_id, turn, 'cite' AS kind, conv_id || '-' || turn AS id, role AS relation FROM conversations WHERE text IS NOT NULL")
def notation_citations(spark, sf_dir):
    """Citations noted in plain text, one in each turn."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    note = F.concat(F.lit(" [[cite:"), F.concat_ws("-", "conv_id", "turn"), F.lit("|sha256:00|http://a/b|"), "role", F.lit("]] "))
    return extract.from_notation(c.select("conv_id", "turn", F.concat("text", note, F.lit("end")).alias("t")), "t").select("conv_id", "turn", "kind", "id", "relation")


@query("""
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'A &amp; B' WHEN 1 THEN 'Doe' WHEN 2 THEN 'Doe &amp; O&#x27;Hara' ELSE 'Doe et al.' END || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ' (' || (1990 + s_suppkey % 30) || ')' END AS label,
        concat_ws(' &middot; ', CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Doe, Jane' WHEN 2 THEN 'Doe, Jane; Pat O&#x27;Hara' ELSE 'Doe, Jane et al.' END, s_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(1990 + s_suppkey % 30 AS VARCHAR) END, 'web') AS meta,
        'https://doi.org/10.1/' || s_suppkey AS reference
    FROM supplier
""")
def source_labels(spark, sf_dir):
    names = ["Doe, Jane", "Pat O'Hara", "Third, X"]
    n = F.col("s_suppkey") % 4
    s = table(spark, sf_dir, "supplier").withColumn("authors", F.slice(F.array(*map(F.lit, names)), 1, n.cast("int"))).withColumn("year", F.when(F.col("s_suppkey") % 3 != 0, (1990 + F.col("s_suppkey") % 30).cast("int")))
    return s.select("s_suppkey", labels.author_label("authors", F.lit("A & B"), "year").alias("label"), labels.meta_line("authors", "s_name", "year", F.lit("web")).alias("meta"), links.reference_url(F.concat(F.lit("10.1/"), F.col("s_suppkey").cast("string")), F.lit("u")).alias("reference"))
