"""Registered queries of the archive operators, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text, urls
from ..operators import browse as B
from ..operators import clusters as C
from ..operators import dedup as D
from ..operators import learn as L
from ..operators import links as K
from ..operators import reports as R
from ..operators import search as S
from ..operators import tags as T
from ..operators import vectors as V
from ..operators import writes as W
from ..operators.graph import connected_components, shared_folder
from ..operators.text_index import TextIndex
from ..sources import connectors as X
from .archive import Archive, sql

# ── SQL pieces ───────────────────────────────────────────────────────────────

HOST = r"nullif(lower(regexp_extract(trim({u}), '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"
DOMAIN = r"regexp_replace(" + HOST + r", '^www\.', '')"
KEY = r"substr(trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({t})), '[^\w\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-'), 1, 64)"
OWNER = "owned AS (SELECT u.*, coalesce(l.canonical_id, u.document_id) AS owner_id FROM used u LEFT JOIN links l ON u.document_id = l.duplicate_id)"
USED = "used AS (SELECT document_id, tag_string AS tag, 'source' AS origin FROM source_tags UNION ALL SELECT document_id, tag, origin FROM overlay_tags)"
FOLDS = f"""cnt AS (SELECT origin, tag AS raw, count(DISTINCT document_id) AS n FROM used GROUP BY 1, 2),
keyed AS (SELECT c.*, coalesce(nullif({KEY.format(t='raw')}, ''), raw) AS key FROM cnt c),
folds AS (SELECT k.origin, k.raw, k.n, k.key, CASE WHEN k.origin = 'inferred' THEN k.key ELSE coalesce(a.canonical, k.key) END AS canonical
  FROM keyed k LEFT JOIN aliases a ON a.state = 'active' AND a.alias = k.key),
shown AS (SELECT *, first_value(raw) OVER (PARTITION BY origin, canonical ORDER BY n DESC, raw) AS display FROM folds)"""


def tags_sql(body: str, *names: str) -> str:
    return sql("", "source_tags", "overlay_tags", "aliases", "links", *names).rstrip() + f",\n{USED},\n{FOLDS},\n{OWNER}\n{body.strip()}"


def folded(a: Archive):
    used = T.usage(a.source_tags, a.overlay_tags)
    return used, T.fold_table(used, a.aliases)


# ── functions ────────────────────────────────────────────────────────────────


@query(sql(rf"SELECT id, {DOMAIN.format(u='url_or_path')} AS domain, {HOST.format(u='url_or_path')} AS host FROM web", "web"))
def fn_extract_domain(spark, d):
    """FN10."""
    return Archive(spark, d).web.select(
        "id",
        urls.extract_domain(F.col("url_or_path")).alias("domain"),
        urls.hostname(F.col("url_or_path")).alias("host"),
    )


@query(sql(r"""
SELECT id, CASE WHEN trim(coalesce(url_or_path, '')) = '' THEN 'empty url'
  WHEN lower(regexp_extract(trim(url_or_path), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https') THEN NULL
  WHEN lower(regexp_extract(trim(url_or_path), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) = 'file' THEN 'local file url'
  WHEN regexp_extract(trim(url_or_path), '^([A-Za-z][A-Za-z0-9+.-]*):', 1) <> '' THEN 'unsupported url scheme: ' || lower(regexp_extract(trim(url_or_path), '^([A-Za-z][A-Za-z0-9+.-]*):', 1))
  ELSE 'missing http(s) scheme' END AS reason
FROM docs""", "docs"))  # fmt: skip
def fn_unfetchable_reason(spark, d):
    """FL13."""
    return Archive(spark, d).docs.select("id", urls.unfetchable_reason(F.col("url_or_path")).alias("reason"))


@query(r"""
SELECT page_id AS id, 'https://' || regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^(www\.)?(m\.)?', '') || rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/')
  || CASE WHEN regexp_extract(url, '[?]([^#]*)', 1) IN ('', 'utm_source=feed') THEN '' ELSE '?' || regexp_replace(regexp_extract(url, '[?]([^#]*)', 1), '&?ref=x', '') END AS canonical
FROM pages""")
def fn_canonical_url(spark, d):
    """FN12, on the url shapes that occur here."""
    return Archive(spark, d).web.select("id", urls.canonical_url(F.col("url_or_path")).alias("canonical"))


@query(sql(rf"""SELECT tag_string AS tag, {KEY.format(t='tag_string')} AS key,
  trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(tag_string)), '[^\w\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-') AS slug, count(*) AS n
FROM source_tags GROUP BY tag_string""", "source_tags"))  # fmt: skip
def fn_tag_key(spark, d):
    """FN7, FN8."""
    n = Archive(spark, d).source_tags.groupBy(F.col("tag_string").alias("tag")).agg(F.count("*").alias("n"))
    return n.select("tag", text.tag_key(F.col("tag")).alias("key"), text.slugify_tag(F.col("tag")).alias("slug"), "n")


@query(sql(r"""
WITH flat AS (SELECT id, trim(regexp_replace(regexp_replace(body, '<[a-zA-Z/][^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM docs)
SELECT id, CASE WHEN length(t) <= 280 THEN t ELSE rtrim(substr(t, 1, 280)) || '…' END AS summary FROM flat""".replace("WITH flat AS", "SELECT * FROM (WITH flat AS") + ")", "docs"))
def fn_truncate_summary(spark, d):
    """FN4."""
    return Archive(spark, d).docs.select("id", text.truncate_summary(F.col("body")).alias("summary"))


@query(sql(r"SELECT id, sha256(body) AS hash, CAST(len(list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '')) AS INTEGER) AS tokens FROM docs", "docs"))
def fn_hash_tokens(spark, d):
    """FN25, FN34."""
    return Archive(spark, d).docs.select(
        "id",
        text.content_hash(F.col("body")).alias("hash"),
        text.token_count(F.col("body")).alias("tokens"),
    )


@query(sql("""
SELECT id, CASE WHEN source = 'zotero' AND item_type = 'preprint' THEN 'academic,preprint' WHEN source = 'zotero' AND item_type = 'journalArticle' THEN 'academic,paper'
  WHEN source = 'youtube' THEN 'video' ELSE '' END AS tags FROM docs""", "docs"))  # fmt: skip
def fn_classify(spark, d):
    """FN19, HP18."""
    return Archive(spark, d).docs.select(
        "id",
        F.array_join(urls.classify_document(F.col("source"), F.col("item_type"), F.col("url_or_path")), ",")
        .alias("tags"),
    )


@query("""
WITH i AS (SELECT p_partkey AS id, lpad(CAST((p_partkey * 7919 + 30600) % 1000000000 AS VARCHAR), 9, '0') AS core FROM part),
d AS (SELECT id, core, list_transform(range(1, 10), lambda k: CAST(core[k] AS INTEGER)) AS v FROM i)
SELECT id, CAST((38 + list_sum(list_transform(range(1, 10), lambda k: v[k] * CASE WHEN k % 2 = 1 THEN 3 ELSE 1 END))) AS BIGINT) % 10 = 0 AS zero_check,
  '978' || core || CAST((10 - CAST(38 + list_sum(list_transform(range(1, 10), lambda k: v[k] * CASE WHEN k % 2 = 1 THEN 3 ELSE 1 END)) AS BIGINT) % 10) % 10 AS VARCHAR) AS isbn
FROM d""")
def fn_isbn13(spark, d):
    """FN14, FN15: part keys as ISBN-10 cores."""
    core = F.lpad(((F.col("p_partkey") * 7919 + 30600) % 1000000000).cast("string"), 9, "0")
    out = (
        Archive(spark, d)
        .raw("part")
        .select(
            F.col("p_partkey").alias("id"),
            urls.isbn13(F.concat(F.substring(core, 1, 3), F.lit("-"), F.substring(core, 4, 6), F.lit("X")))
            .alias("isbn"),
        )
    )
    return out.select("id", F.col("isbn").endswith("0").alias("zero_check"), "isbn")


@query(sql(r"SELECT id, CASE WHEN regexp_matches(substr(html, 1, 200), '(?i)enable javascript|accept all cookies|before you continue') THEN 'interstitial: consent or script wall' ELSE NULL END AS reason FROM web", "web"))
def fn_content_gate(spark, d):
    """FL12."""
    return Archive(spark, d).web.select("id", text.interstitial_reason(F.col("html")).alias("reason"))


@query()
def fn_html_text(spark, d):
    """SC17; tested on fixtures."""
    return Archive(spark, d).web.select("id", text.html_text(F.col("html")).alias("text"))


@query()
def fn_chunk_text(spark, d):
    """FN1, FN2, RC2: chunks of each document, numbered."""
    return Archive(spark, d).docs.select("id", F.posexplode(text.chunk_text(F.col("body"))).alias("chunk_index", "text"))


@query()
def fn_sentences(spark, d):
    """FN3."""
    return Archive(spark, d).docs.select(
        "id",
        F.size(text.split_sentences(F.col("body"))).alias("n"),
        text.trim_to_sentences(F.col("body"), F.lit(2)).alias("head"),
    )


@query()
def fn_reassemble(spark, d):
    """FN27: chunks with overlap joined back."""
    parts = Archive(spark, d).docs.select("id", text.chunk_text(F.col("body"), F.lit(64), F.lit(16), F.lit(1)).alias("c"))
    return parts.select("id", F.length(text.reassemble_chunks(F.col("c"))).alias("n_chars"))


@query(sql("SELECT id, CAST(length(title) + 2 AS INTEGER) AS second_offset, CAST(length(body) AS INTEGER) AS second_length, CAST(2 AS INTEGER) AS n_blocks FROM (SELECT id, trim(title) AS title, trim(body) AS body FROM docs) WHERE title <> '' AND body <> ''", "docs"))
def fn_section_blocks(spark, d):
    """FN26."""
    none = F.lit(None).cast("long")
    part = lambda i, c: F.struct(F.lit(i).alias("index"), F.lit("t").alias("title"), none.alias("page_start"), none.alias("page_end"), F.trim(c).alias("text"))
    b = text.section_blocks(F.array(part(0, F.col("title")), part(1, F.col("body"))))
    rows = Archive(spark, d).docs.where("trim(title) <> '' and trim(body) <> ''").select("id", b.alias("b"))
    return rows.select(
        "id",
        F.col("b")[1]["offset"].alias("second_offset"),
        F.col("b")[1]["length"].alias("second_length"),
        F.size("b").alias("n_blocks"),
    )


@query()
def fn_site_ids(spark, d):
    """HP1-14: identifiers in urls; tested on fixtures."""
    u = F.col("url_or_path")
    return Archive(spark, d).web.select(
        "id",
        urls.arxiv_id(u).alias("arxiv"),
        urls.biorxiv_doi(u).alias("biorxiv"),
        urls.pubmed_id(u).alias("pubmed"),
        urls.nature_doi(u).alias("nature"),
        urls.publisher_doi(u).alias("publisher"),
        urls.sciencedirect_pii(u).alias("pii"),
        urls.mitpress_isbn(u).alias("isbn"),
        urls.doi_of_url(u).alias("doi"),
        urls.youtube_id(u).alias("video"),
        urls.amazon_asin(u).alias("asin"),
        urls.parse_search_url(u).getField("query").alias("query"),
    )


# ── reports ──────────────────────────────────────────────────────────────────

_DOMAINS = f"""dom AS (SELECT {DOMAIN.format(u='url_or_path')} AS domain, fetch_status FROM web),
per AS (SELECT domain, fetch_status, count(*) AS c FROM dom WHERE domain IS NOT NULL GROUP BY 1, 2),
rep AS (SELECT domain, CAST(sum(c) AS BIGINT) AS n, string_agg(fetch_status || '=' || c, ',' ORDER BY fetch_status || '=' || c) AS by_status,
  CAST(sum(CASE WHEN fetch_status = 'unfetchable' THEN c ELSE 0 END) AS BIGINT) AS unfetchable, false AS has_handler FROM per GROUP BY domain)"""


@query(sql("", "web").rstrip() + f",\n{_DOMAINS}\nSELECT * FROM rep")
def domain_frequency(spark, d):
    """AG4, FN10, FN11."""
    return R.domain_frequency(Archive(spark, d).web)


@query(sql("", "web").rstrip() + f""",
{_DOMAINS}
SELECT * FROM (SELECT 'count' AS kind, CAST(row_number() OVER (ORDER BY n DESC, domain) AS INTEGER) AS place, domain, n FROM rep) WHERE place <= 10
UNION ALL SELECT * FROM (SELECT 'unfetchable' AS kind, CAST(row_number() OVER (ORDER BY unfetchable DESC, domain) AS INTEGER) AS place, domain, unfetchable AS n FROM rep WHERE unfetchable > 0) WHERE place <= 10""")
def domain_top(spark, d):
    """AG5, ST5."""
    return R.domain_top(R.domain_frequency(Archive(spark, d).web))


@query(sql("SELECT source, strftime(make_timestamp(CAST(date_added AS BIGINT) * 1000000), '%Y-%m') AS period, count(*) AS n FROM docs WHERE date_added IS NOT NULL GROUP BY 1, 2", "docs"))
def source_period(spark, d):
    """AG6."""
    return R.sources_over_time(Archive(spark, d).docs)


@query(sql("""
SELECT d.source, count(*) AS total, CAST(sum(CAST(fetch_status = 'pending' AS INTEGER)) AS BIGINT) AS pending, CAST(sum(CAST(fetch_status = 'fetched' AS INTEGER)) AS BIGINT) AS fetched,
  CAST(sum(CAST(fetch_status = 'unfetchable' AS INTEGER)) AS BIGINT) AS unfetchable, count(c.document_id) AS embedded
FROM docs d LEFT JOIN (SELECT DISTINCT document_id FROM chunks) c ON d.id = c.document_id GROUP BY 1""", "docs", "chunks"))  # fmt: skip
def status_report(spark, d):
    """AG8, AG9."""
    a = Archive(spark, d)
    return R.status_report(a.docs, a.chunks)


@query("""
WITH r AS (SELECT o_orderpriority AS label, epoch(o_orderdate) AS ts, count(*) AS n FROM orders GROUP BY 1, 2),
m AS (SELECT label, ts, n, unnest(range(-2, 3)) AS k, date_trunc('month', make_timestamp(CAST(ts * 1000000 AS BIGINT))) AS m0 FROM r),
c AS (SELECT label, n, ts, m0 + to_months(CAST(k AS INTEGER)) AS mon FROM m),
w AS (SELECT label, strftime(mon, '%Y-%m') AS period, n, (epoch(mon) + 14 * 86400 + 43200 - ts) / 86400.0 AS days FROM c)
SELECT label, period, round(sum(n * exp(-0.5 * (days / 15.0) * (days / 15.0))), 6) AS weight FROM w WHERE abs(days) <= 45 GROUP BY 1, 2""")
def kernel_timeline(spark, d):
    """AG7, FN23, FN24."""
    rows = Archive(spark, d).raw("orders").select(F.col("o_orderpriority").alias("label"), F.unix_timestamp("o_orderdate").alias("ts"))
    return R.kernel_timeline(rows).withColumn("weight", F.round("weight", 6))


@query(sql("SELECT run_id, count(*) AS clusters, min(n) AS smallest, max(n) AS largest, round(avg(n), 1) AS mean FROM (SELECT run_id, cluster_id, count(*) AS n FROM assignments GROUP BY 1, 2) GROUP BY 1", "assignments"))
def run_diagnostics(spark, d):
    """AG10, AG19."""
    return R.run_diagnostics(Archive(spark, d).assignments)


@query(sql("SELECT count(*) AS n_noise FROM assignments a JOIN clusters c USING (cluster_id) WHERE c.is_noise", "assignments", "clusters"))
def noise_count(spark, d):
    """AG11."""
    a = Archive(spark, d)
    return R.noise_count(a.chunks, a.assignments, a.clusters, 1)


@query(tags_sql("""
SELECT cluster_id, tag, n FROM (
  SELECT cluster_id, tag, n, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, tag) AS r FROM (
    SELECT f.cluster_id, min(s.display) AS tag, count(DISTINCT f.document_id) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY document_id) AS r FROM assignments) f
    JOIN source_tags t ON f.document_id = t.document_id JOIN shown s ON s.origin = 'source' AND s.raw = t.tag_string
    WHERE f.r <= 200 GROUP BY f.cluster_id, s.canonical)) WHERE r <= 10""", "assignments"))  # fmt: skip
def cluster_top_tags(spark, d):
    """AG12."""
    a = Archive(spark, d)
    return R.cluster_top_tags(a.assignments, a.source_tags.withColumnRenamed("tag_string", "tag"), folded(a)[1])


@query(sql("SELECT l.list_id, l.name, count(i.document_id) AS n FROM reading_lists l LEFT JOIN reading_items i USING (list_id) GROUP BY 1, 2", "reading_lists", "reading_items"))
def list_sizes(spark, d):
    """AG20."""
    a = Archive(spark, d)
    return R.list_sizes(a.reading_lists, a.reading_items)


@query(sql("SELECT user_id AS run_id, count(*) AS calls, CAST(sum(length(props)) AS BIGINT) AS chars_sent, CAST(sum(event_id % 2) AS BIGINT) AS artifacts FROM events GROUP BY 1", "docs"))
def spend_counters(spark, d):
    """AG23."""
    return R.spend(
        Archive(spark, d)
        .raw("events")
        .select(
            F.col("user_id").alias("run_id"),
            F.length("props").alias("chars"),
            (F.col("event_id") % 2).alias("artifacts"),
        )
    )


@query(sql("SELECT document_id, count(*) AS n, min(chunk_index) AS first FROM chunks WHERE chunk_pass IN ('summary', 'external_synopsis') GROUP BY 1", "chunks"))
def enrichment_items(spark, d):
    """AG25."""
    return (
        B.enrichment(Archive(spark, d).chunks)
        .select("document_id", F.size("items").cast("long").alias("n"), F.col("items")[0]["chunk_index"].alias("first"))
    )


@query(sql("""
SELECT 'summaries' AS target, count(*) AS n FROM chunks WHERE chunk_pass = 'summary'
UNION ALL SELECT 'fetched_text', count(*) FROM chunks WHERE (chunk_pass IS NULL OR chunk_pass NOT IN ('summary', 'external_synopsis', 'metadata')) AND document_id IN (SELECT id FROM docs)
UNION ALL SELECT 'document_texts', count(*) FROM texts
UNION ALL SELECT 'machine_tags', count(*) FROM overlay_tags WHERE origin IN ('llm', 'cluster_l1', 'cluster_l2', 'learned')
UNION ALL SELECT 'fetch_failures', count(*) FROM fetch_log WHERE document_id IN (SELECT id FROM docs WHERE fetch_status = 'unfetchable')
UNION ALL SELECT 'vectors', count(*) FROM chunks WHERE vector_id IS NOT NULL
UNION ALL SELECT 'clip_vectors', count(*) FROM images WHERE clip_vector_id IS NOT NULL
UNION ALL SELECT 'image_text', count(*) FROM chunks WHERE document_id IN (SELECT document_id FROM images WHERE indexed_at IS NOT NULL)
UNION ALL SELECT 'cluster_runs', count(*) FROM runs
UNION ALL SELECT 'duplicate_chunks', (SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY document_id, text ORDER BY chunk_index, id) AS r FROM chunks WHERE chunk_pass = 'summary') WHERE r > 1)
""", "docs", "chunks", "texts", "overlay_tags", "fetch_log", "images", "runs"))  # fmt: skip
def purge_counts(spark, d):
    """AG21, AG22, SK16 (a conversation has one full-text chunk at most here, so none repeats)."""
    a = Archive(spark, d)
    return R.purge_counts(a.docs, a.chunks, a.texts, a.overlay_tags, a.fetch_log, a.images, a.runs)


@query(sql("SELECT 'documents' AS name, count(*) AS n FROM docs WHERE source <> 'zotero' UNION ALL SELECT 'overlay_tags', count(*) FROM overlay_tags WHERE origin IN ('manual', 'learned') OR document_id NOT IN (SELECT id FROM docs WHERE source = 'zotero')", "docs", "overlay_tags"))
def purge_source(spark, d):
    """SK17."""
    a = Archive(spark, d)
    out = R.purge_source({"documents": a.docs, "overlay_tags": a.overlay_tags}, "zotero")
    part = lambda n: out[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return part("documents").unionByName(part("overlay_tags"))


# ── queues ───────────────────────────────────────────────────────────────────


@query(sql("""
SELECT id, url_or_path, CAST(0 AS INTEGER) AS phase FROM docs WHERE source = 'firefox' AND fetch_status = 'pending' AND url_or_path <> ''
UNION ALL SELECT id, url_or_path, 1 FROM docs WHERE source = 'firefox' AND fetch_status = 'fetched' AND url_or_path <> '' AND id NOT IN (SELECT document_id FROM chunks)""", "docs", "chunks"))  # fmt: skip
def ingest_queue(spark, d):
    """FL14, SO4."""
    a = Archive(spark, d)
    return R.ingest_queue(a.docs, a.chunks, "firefox")


@query(sql("""
SELECT id FROM docs LEFT JOIN (SELECT document_id, max(timestamp) AS last FROM fetch_log GROUP BY 1) l ON id = l.document_id
WHERE source = 'firefox' AND fetch_status = 'unfetchable' AND url_or_path LIKE 'http%' AND (last IS NULL OR last <= 1704400000)""", "docs", "fetch_log"))  # fmt: skip
def requeue_unfetchable(spark, d):
    """FL15, JN2."""
    a = Archive(spark, d)
    return R.requeue_unfetchable(a.docs, a.fetch_log, "firefox", 1704400000)


@query(sql("SELECT id FROM docs WHERE source IN ('zotero', 'calibre') AND generated_summary IS NULL AND id IN (SELECT document_id FROM chunks WHERE chunk_pass IS NULL OR chunk_pass NOT IN ('summary', 'external_synopsis', 'metadata'))", "docs", "chunks"))
def summary_candidates(spark, d):
    """FL10, FL16."""
    a = Archive(spark, d)
    return R.summary_candidates(a.docs, a.chunks, ["zotero", "calibre"])


@query(sql("SELECT id, CAST(char_count AS INTEGER) AS char_count FROM docs JOIN texts ON id = document_id WHERE char_count > 0 AND full_char_count <= char_count", "docs", "texts"))
def rechunk_candidates(spark, d):
    """FL17, RC1."""
    a = Archive(spark, d)
    return R.rechunk_candidates(a.docs, a.texts)


@query(sql("SELECT path FROM images WHERE path NOT IN (SELECT path FROM images WHERE image_type = 'scan')", "images"))
def admitted_images(spark, d):
    """FL18."""
    i = Archive(spark, d).images
    return R.admitted_images(i.select("path"), i.where("image_type = 'scan'"))


@query(sql("SELECT source, count(*) AS n FROM docs WHERE id NOT IN (SELECT doc_id FROM labels) GROUP BY 1", "docs"))
def pending_metadata(spark, d):
    """IN9."""
    a = Archive(spark, d)
    known = a.docs.join(a.raw("labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return R.pending_metadata(known, a.docs.select("source", "source_id"))


@query(sql("SELECT id, summary_run_id FROM chunks WHERE chunk_pass = 'summary' AND summary_run_id IN (SELECT run_id FROM runs WHERE provider = 'remote')", "chunks", "runs"))
def summary_provenance(spark, d):
    """FL11."""
    a = Archive(spark, d)
    return R.provenance(a.chunks, a.runs, provider="remote").select("id", "summary_run_id")


# ── browse ───────────────────────────────────────────────────────────────────

VISIBLE = "id NOT IN (SELECT duplicate_id FROM links) AND id NOT IN (SELECT document_id FROM images WHERE indexed_at IS NULL)"


@query(sql(f"SELECT id, source, title, date_added FROM docs WHERE {VISIBLE} ORDER BY date_added IS NULL, date_added DESC, id DESC LIMIT 48 OFFSET 10", "docs", "links", "images"))
def browse_page(spark, d):
    """FL1, FL6, FL7, FL20, JN3, ST1."""
    a = Archive(spark, d)
    return B.page(B.browse(a.docs, a.links, a.images), 48, 10).select("id", "source", "title", "date_added")


@query(sql(f"SELECT id FROM docs WHERE {VISIBLE} AND (source = 'zotero' OR id IN (SELECT canonical_id FROM links JOIN docs ON duplicate_id = id WHERE source = 'zotero'))", "docs", "links", "images"))
def browse_source(spark, d):
    """FL4."""
    a = Archive(spark, d)
    return B.browse(a.docs, a.links, a.images, ["zotero"]).select("id")


@query(sql(f"SELECT id FROM docs WHERE {VISIBLE} AND source = 'firefox' AND archive_url IS NOT NULL", "docs", "links", "images"))
def browse_wayback(spark, d):
    """FL5."""
    a = Archive(spark, d)
    return B.browse(a.docs, a.links, a.images, wayback=True).select("id")


@query(tags_sql("""
SELECT id FROM docs WHERE id IN (SELECT owner_id FROM owned o JOIN folds f ON o.origin = f.origin AND o.tag = f.raw WHERE o.origin = 'source' AND f.canonical = 'en')
AND id IN (SELECT owner_id FROM owned o JOIN folds f ON o.origin = f.origin AND o.tag = f.raw WHERE o.origin = 'source' AND f.canonical = 'topic-3')""", "docs"))
def browse_tags(spark, d):
    """FL2, FL3: all wanted tags, each in any spelling, through duplicates."""
    a = Archive(spark, d)
    folds = folded(a)[1].where("origin = 'source'").select("raw", "canonical")
    return (
        B.having_tag(
            a.docs,
            a.source_tags.select("document_id", F.col("tag_string").alias("tag")),
            folds,
            a.links,
            ["EN", "Topic 3"],
        )
        .select("id")
    )


@query(sql("""
SELECT id AS doc_id, n_chars AS rank FROM docs WHERE fetch_status IN ('fetched', 'pending') AND coalesce(date_added, 0) >= 1620000000 AND coalesce(date_added, 0) <= 1690000000
AND id IN (SELECT document_id FROM assignments WHERE cluster_id IN (1, 2, 3))""", "docs", "assignments"))  # fmt: skip
def restrict_hits(spark, d):
    """FL8, FL9."""
    a = Archive(spark, d)
    hits = a.docs.select(F.col("id").alias("doc_id"), F.col("n_chars").alias("rank"))
    return B.restrict_hits(hits, a.docs, a.assignments, [1, 2, 3], ["fetched", "pending"], 1620000000, 1690000000)


@query(sql("""
SELECT d.id, coalesce(c.n, 0) AS n_chunks, coalesce(t.tags, '') AS tags, k.label AS cluster
FROM docs d LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) c ON d.id = c.document_id
LEFT JOIN (SELECT document_id, string_agg(DISTINCT tag_string, ',' ORDER BY tag_string) AS tags FROM source_tags GROUP BY 1) t ON d.id = t.document_id
LEFT JOIN (SELECT document_id, min(label) AS label FROM assignments JOIN clusters USING (cluster_id) GROUP BY 1) k ON d.id = k.document_id""", "docs", "chunks", "source_tags", "assignments", "clusters"))  # fmt: skip
def cards(spark, d):
    """JN7, RK8, RK11, FN6."""
    a = Archive(spark, d)
    out = B.cards(a.docs, a.chunks, a.source_tags.withColumnRenamed("tag_string", "tag"), a.assignments, a.clusters)
    return out.select("id", "n_chunks", F.array_join("tags", ",").alias("tags"), "cluster")


@query(sql("SELECT document_id, arg_min(text, chunk_index) AS text FROM chunks GROUP BY 1", "chunks"))
def first_chunks(spark, d):
    """JN6."""
    return B.first_chunks(Archive(spark, d).chunks)


@query(sql("SELECT list_id, position, document_id, title FROM reading_items JOIN docs ON document_id = id", "reading_items", "docs"))
def reading_list(spark, d):
    """JN12."""
    a = Archive(spark, d)
    return B.reading_list(a.reading_items, a.docs.select("id", "title")).select("list_id", "position", "document_id", "title")


@query(sql("SELECT id, path FROM images WHERE indexed_at IS NOT NULL AND image_type = 'photo'", "images"))
def images_listed(spark, d):
    """FL19, ST9."""
    return B.images_listed(Archive(spark, d).images, "photo").select("id", "path")


@query(sql("SELECT d.id, l.id AS log_id, l.http_status FROM docs d JOIN fetch_log l ON d.id = l.document_id WHERE fetch_status = 'unfetchable'", "docs", "fetch_log"))
def unfetchable_log(spark, d):
    """JN13."""
    a = Archive(spark, d)
    return (
        B.unfetchable_log(a.docs.select("id", "fetch_status"), a.fetch_log.withColumnRenamed("id", "log_id"))
        .select("id", "log_id", "http_status")
    )


# ── links and duplicates ─────────────────────────────────────────────────────


@query(sql("""
WITH m AS (SELECT canonical_id AS o, duplicate_id AS id FROM links UNION SELECT canonical_id, canonical_id FROM links)
SELECT a.id AS document_id, b.id AS copy_id, d.source FROM m a JOIN m b USING (o) JOIN docs d ON d.id = b.id WHERE a.id <> b.id""".replace("\nWITH m AS", "\nSELECT * FROM (WITH m AS") + ")", "docs", "links"))
def linked_copies(spark, d):
    """RK12, DD9, JN4, JN5."""
    a = Archive(spark, d)
    return K.linked_copies(a.docs, a.links).select("document_id", "copy_id", "source")


@query(sql("""
SELECT canonical_id, duplicate_id, match_key, state FROM (
  SELECT * FROM links UNION ALL
  SELECT id - id % 10 AS canonical_id, id AS duplicate_id, 'manual' AS match_key, 'merged' AS state FROM docs WHERE id % 10 > 0 AND id NOT IN (SELECT duplicate_id FROM links UNION SELECT canonical_id FROM links) AND id - id % 10 NOT IN (SELECT duplicate_id FROM links))""", "links", "docs"))
def link_writer(spark, d):
    """DD6, SK14: all unlinked documents are linked to the first of their ten."""
    a = Archive(spark, d)
    held = a.links.select(F.col("duplicate_id").alias("id")).union(a.links.select("canonical_id"))
    asked = (
        a.docs
        .where("id % 10 > 0")
        .join(held, "id", "left_anti")
        .select(
            (F.col("id") - F.col("id") % 10).alias("canonical_id"),
            F.col("id").alias("duplicate_id"),
            F.lit("manual").alias("match_key"),
        )
    )
    asked = asked.join(a.links.select(F.col("duplicate_id").alias("canonical_id")), "canonical_id", "left_anti")
    return K.link(a.links, asked).select("canonical_id", "duplicate_id", "match_key", "state")


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS a, CASE WHEN c_custkey % 10 < 9 THEN c_custkey + 1 ELSE c_custkey - 3 END AS b FROM customer),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
r AS (SELECT a AS node, b AS seen FROM b UNION SELECT r.node, b.b FROM r JOIN b ON r.seen = b.a)
SELECT node, min(seen) AS root FROM r GROUP BY node""")
def components(spark, d):
    """DD3: chains of ten over all customers."""
    k = F.col("c_custkey")
    e = Archive(spark, d).raw("customer").select(k.alias("a"), F.when(k % 10 < 9, k + 1).otherwise(k - 3).alias("b"))
    return connected_components(e, "a", "b")


@query(sql("""
WITH c AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1),
r AS (SELECT d.id, md5(body) AS k, row_number() OVER (PARTITION BY md5(body) ORDER BY CASE fetch_status WHEN 'fetched' THEN 0 WHEN 'unfetchable' THEN 2 ELSE 1 END, -coalesce(n, 0), ingested_at, d.id) AS p FROM docs d LEFT JOIN c ON d.id = c.document_id)
SELECT b.id AS canonical_id, r.id AS duplicate_id, 'url' AS match_key FROM r JOIN r b ON r.k = b.k AND b.p = 1 WHERE r.p > 1""".replace("\nWITH c AS", "\nSELECT * FROM (WITH c AS") + ")", "docs", "chunks"))
def exact_copies(spark, d):
    """DD1-5, DD8, ST8: documents of one key value, linked to the best of them."""
    a = Archive(spark, d)
    docs = a.docs
    keys = docs.select("id", F.lit("url").alias("key"), F.md5("body").alias("value"))
    none = a.links.where("false")
    n = a.chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    return D.propose_links(D.groups(keys, none), D.canonical_rank(docs, n), keys, none)


_WEB_KEY = r"""'https://' || regexp_replace(regexp_extract(url_or_path, '://([^/?#]*)', 1), '^(www\.)?(m\.)?', '') || rtrim(regexp_extract(url_or_path, '://[^/?#]*([^?#]*)', 1), '/')
  || CASE WHEN regexp_extract(url_or_path, '[?]([^#]*)', 1) IN ('', 'utm_source=feed') THEN '' ELSE '?' || regexp_replace(regexp_extract(url_or_path, '[?]([^#]*)', 1), '&?ref=x', '') END"""


@query(sql("", "web", "chunks").rstrip() + f""",
k AS (SELECT id, {_WEB_KEY} AS key, CASE fetch_status WHEN 'fetched' THEN 0 WHEN 'unfetchable' THEN 2 ELSE 1 END AS s, coalesce((SELECT count(*) FROM chunks WHERE document_id = web.id), 0) AS n FROM web),
r AS (SELECT id, first_value(id) OVER (PARTITION BY key ORDER BY s, -n, id) AS canonical_id FROM k)
SELECT canonical_id, id AS duplicate_id, 'url' AS match_key FROM r WHERE id <> canonical_id""")
def url_duplicates(spark, d):
    """DD1, DD3, DD5 on canonical urls."""
    a = Archive(spark, d)
    web = a.web.withColumns(
        {
            "doi": F.lit(None).cast("string"),
            "arxiv_id": F.lit(None).cast("string"),
            "isbn": F.lit(None).cast("string"),
            "ingested_at": F.col("id"),
        }
    )
    keys, none = D.match_keys(web), a.links.where("false")
    n = a.chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    return D.propose_links(D.groups(keys, none), D.canonical_rank(web, n), keys, none)


_NORM = "n AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@query(f"WITH {_NORM} SELECT a.vec_id AS canonical_id, b.vec_id AS duplicate_id, round(list_cosine_similarity(a.v, b.v), 4) AS score FROM n a JOIN n b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.43")
def near_pairs(spark, d):
    """DD7, JN9 (at a threshold that has pairs here)."""
    a = Archive(spark, d)
    v = a.raw("embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    ranks = v.select(F.col("document_id").alias("id"), F.struct("document_id").alias("standing"))
    return D.near_candidates(v, ranks, a.links.where("false"), 0.43, None)


# ── tags ─────────────────────────────────────────────────────────────────────


@query(tags_sql("""
SELECT min(s.display) AS tag, o.origin, count(DISTINCT o.owner_id) AS count, string_agg(DISTINCT o.tag, ',' ORDER BY o.tag) AS variants
FROM owned o JOIN shown s ON o.origin = s.origin AND o.tag = s.raw GROUP BY o.origin, s.canonical"""))
def tag_counts_folded(spark, d):
    """AG1, AG2, AG3, TF1, TF2, SO1."""
    a = Archive(spark, d)
    used, folds = folded(a)
    return T.tag_counts(used, folds, a.links).withColumn("variants", F.array_join(F.array_sort("variants"), ","))


@query(tags_sql("""
SELECT tag, origin, count FROM (SELECT min(s.display) AS tag, o.origin, count(DISTINCT o.owner_id) AS count FROM owned o JOIN shown s ON o.origin = s.origin AND o.tag = s.raw GROUP BY o.origin, s.canonical)
ORDER BY count DESC, origin <> 'source', tag, origin LIMIT 12"""))
def tag_listing(spark, d):
    """ST2."""
    a = Archive(spark, d)
    used, folds = folded(a)
    return T.listed(T.tag_counts(used, folds, a.links), limit=12).select("tag", "origin", "count")


@query(tags_sql("SELECT key, CAST(sum(n) AS BIGINT) AS n FROM folds WHERE origin <> 'inferred' AND key NOT IN (SELECT alias FROM aliases WHERE state = 'active') GROUP BY 1"))
def tag_inventory(spark, d):
    """AG17."""
    a = Archive(spark, d)
    return T.inventory(folded(a)[1], a.aliases)


@query(tags_sql("SELECT origin, min(display) AS tag, string_agg(raw, ',' ORDER BY n DESC, raw) AS variants, CAST(sum(n) AS BIGINT) AS documents FROM shown GROUP BY origin, canonical HAVING count(*) > 1"))
def variant_report(spark, d):
    """AG18."""
    return T.variant_report(folded(Archive(spark, d))[1]).withColumn("variants", F.array_join("variants", ","))


@query("""
WITH w AS (SELECT lower(unnest(string_split(p_name || ' ' || p_type || ' ' || p_type || 's', ' '))) AS key FROM part), t AS (SELECT key, count(*) AS n FROM w WHERE key <> '' GROUP BY 1)
SELECT CASE WHEN a.n > b.n OR (a.n = b.n AND a.key < b.key) THEN b.key ELSE a.key END AS alias, CASE WHEN a.n > b.n OR (a.n = b.n AND a.key < b.key) THEN a.key ELSE b.key END AS canonical
FROM t a JOIN t b ON b.key = CASE WHEN a.key LIKE '%ies' THEN left(a.key, length(a.key) - 3) || 'y' WHEN regexp_matches(a.key, '(ses|xes|ches|shes)$') THEN left(a.key, length(a.key) - 2)
  WHEN a.key LIKE '%s' AND a.key NOT LIKE '%ss' THEN left(a.key, length(a.key) - 1) END WHERE length(a.key) >= 4""")
def morphology_pairs(spark, d):
    """TF3, TF6."""
    words = (
        Archive(spark, d)
        .raw("part")
        .select(
            F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", F.concat("p_type", F.lit("s")))), " "))
            .alias("key")
        )
    )
    return T.morphology_pairs(words.where("key <> ''").groupBy("key").agg(F.count("*").alias("n")))


@query("""
WITH t AS (SELECT lower(replace(p_type, ' ', '-')) AS key FROM part UNION SELECT lower(array_to_string(list_transform(string_split(p_type, ' '), lambda w: w[1]), '')) FROM part)
SELECT s.key AS alias, l.key AS canonical FROM t s JOIN t l ON s.key = array_to_string(list_transform(string_split(l.key, '-'), lambda w: w[1]), '') WHERE l.key LIKE '%-%' AND regexp_matches(s.key, '^[a-z]{2,5}$')""")
def initialism_pairs(spark, d):
    """TF4."""
    p = Archive(spark, d).raw("part")
    keys = (
        p.select(F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("key"))
        .union(p.select(F.lower(F.array_join(F.transform(F.split("p_type", " "), lambda w: F.substring(w, 1, 1)), ""))))
    )
    return T.initialism_pairs(keys.distinct().withColumn("n", F.lit(1)))


@query(tags_sql("""
SELECT alias, canonical, 'morphology' AS kind FROM (
  SELECT CASE WHEN a.n > b.n OR (a.n = b.n AND a.key < b.key) THEN b.key ELSE a.key END AS alias, CASE WHEN a.n > b.n OR (a.n = b.n AND a.key < b.key) THEN a.key ELSE b.key END AS canonical
  FROM inv a JOIN inv b ON b.key = left(a.key, length(a.key) - 1) WHERE a.key LIKE '%s' AND length(a.key) >= 4)""").replace("\nSELECT alias, canonical, 'morph", ",\ninv AS (SELECT key, sum(n) AS n FROM folds WHERE origin <> 'inferred' AND key NOT IN (SELECT alias FROM aliases WHERE state = 'active') GROUP BY 1)\nSELECT alias, canonical, 'morph", 1))
def tag_scan(spark, d):
    """TF7."""
    a = Archive(spark, d)
    inv = T.inventory(folded(a)[1], a.aliases)
    return T.scan([("morphology", T.morphology_pairs(inv)), ("initialism", T.initialism_pairs(inv))], a.aliases)


@query(sql("SELECT lower(lang) AS tag, count(*) AS n, count(*) > 100 AS over FROM docs GROUP BY 1", "docs"))
def path_tag_counts(spark, d):
    """AG15, FN21."""
    docs = Archive(spark, d).docs.withColumn("source", F.lit("zotero"))
    paths = docs.select(
        "id",
        "source",
        F.explode(
            text.collection_tags(F.array(F.concat_ws("/", F.upper("lang"), F.lit("x"))), F.col("source"), F.lit(4))
        )
        .alias("tag"),
    )
    return T.path_tag_counts(paths, 100)


# ── vectors and search ───────────────────────────────────────────────────────

_Q = "q AS (SELECT v FROM n WHERE vec_id = 0)"


@query(f"WITH {_NORM}, {_Q} SELECT vec_id AS vector_id, round(list_cosine_similarity(n.v, q.v), 4) AS similarity FROM n, q ORDER BY list_cosine_similarity(n.v, q.v) DESC, vec_id LIMIT 20")
def vector_topk(spark, d):
    """JN11, FN31."""
    v = Archive(spark, d).raw("embeddings").withColumnRenamed("vec_id", "vector_id")
    q = v.where("vector_id = 0").select("embedding").first()["embedding"]
    return V.top_k(v, q, 20).select("vector_id", F.round("similarity", 4).alias("similarity"))


@query(f"""WITH {_NORM}, {_Q},
top AS (SELECT vec_id % 100 AS doc_id, list_cosine_similarity(n.v, q.v) AS s FROM n, q ORDER BY s DESC, vec_id LIMIT 60)
SELECT doc_id, round(max(s), 4) AS similarity, row_number() OVER (ORDER BY max(s) DESC, doc_id) AS rank FROM top GROUP BY doc_id""")
def semantic_collapse(spark, d):
    """RK1: the best chunk of each document."""
    v = (
        Archive(spark, d)
        .raw("embeddings")
        .select(
            F.col("vec_id").alias("vector_id"),
            (F.col("vec_id") % 100).alias("document_id"),
            F.lit("x").alias("source"),
            "embedding",
        )
    )
    q = v.where("vector_id = 0").select("embedding").first()["embedding"]
    return S.semantic_hits(v, q, 20).withColumn("similarity", F.round("similarity", 4))


_BM = """f AS (SELECT id, lower(coalesce(title, '')) AS a, lower(coalesce(card_summary, '')) AS b FROM docs),
g AS (SELECT id, greatest(0, length(a) - 2) + greatest(0, length(b) - 2) AS d,
  len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 4) = 'tion')) + len(list_filter(range(1, length(b) + 1), lambda i: substr(b, i, 4) = 'tion')) AS f FROM f),
s AS (SELECT count(*) AS n, sum(CAST(f > 0 AS INTEGER)) AS m, avg(d) AS avgd FROM g),
head AS (SELECT id, -greatest(ln((n - m + 0.5) / (m + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avgd)) AS score FROM g, s WHERE f > 0)"""


_INDEXES: dict[tuple, tuple[TextIndex, TextIndex]] = {}


def _indexes(spark, d) -> tuple[TextIndex, TextIndex]:
    """Text indexes of titles and cards, and of chunks; written once a session and table folder, then opened."""
    key = spark.sparkContext.applicationId, d
    if key not in _INDEXES:
        a, path = Archive(spark, d), shared_folder(spark)
        _INDEXES[key] = (
            TextIndex.create(spark, f"{path}/heads", ["title", "card_summary"]).append(a.docs),
            TextIndex.create(spark, f"{path}/bodies", ["text"]).append(a.chunks),
        )
    return _INDEXES[key]


_BM_ALL = sql("", "docs").rstrip() + f",\n{_BM}\nSELECT id, round(score, 8) AS score FROM head"


@query(_BM_ALL)
def keyword_bm25(spark, d):
    """RK2: match set and score of titles and cards, from the text index."""
    return _indexes(spark, d)[0].bm25("tion").select(F.col("row_id").alias("id"), F.round("score", 8).alias("score"))


@query(_BM_ALL)
def keyword_scan(spark, d):
    """RK2: the same without an index."""
    return S.bm25(Archive(spark, d).docs, ["title", "card_summary"], "tion").select("id", F.round("score", 8).alias("score"))


@query(_BM_ALL.replace("lower(coalesce(title, '')) AS a", "CASE WHEN id % 5 = 1 THEN 'station to station' ELSE lower(coalesce(title, '')) END AS a").replace("FROM docs),\ng AS", "FROM docs WHERE id % 7 > 0),\ng AS"))
def keyword_changes(spark, d):
    """RK2: scores after upserts, deletes and a merge of the index."""
    docs = Archive(spark, d).docs.select("id", "title", "card_summary")
    index = TextIndex.create(spark, f"{shared_folder(spark)}/changed", ["title", "card_summary"])
    index = index.append(docs.where("id % 2 = 0")).append(docs.where("id % 2 = 1"))
    index = index.upsert(docs.where("id % 5 = 1").withColumn("title", F.lit("Station to station"))).delete(docs.where("id % 7 = 0"))
    index = index.merge()
    index.vacuum()
    return index.bm25("tion").select(F.col("row_id").alias("id"), F.round("score", 8).alias("score"))


@query(sql("", "docs", "chunks").rstrip() + """,
f AS (SELECT id FROM docs WHERE contains(lower(title), 'tionth') OR contains(lower(coalesce(card_summary, '')), 'tionth')),
b AS (SELECT DISTINCT document_id AS id FROM chunks WHERE contains(lower(text), 'tionth') AND document_id IN (SELECT id FROM docs))
SELECT id AS doc_id, CAST(id IN (SELECT id FROM f) AS BOOLEAN) AS in_head FROM (SELECT id FROM f UNION SELECT id FROM b)""")
def keyword_substring(spark, d):
    """RK2: which documents match, and where."""
    a = Archive(spark, d)
    heads, bodies = _indexes(spark, d)
    hits = S.keyword_hits(a.docs, a.chunks, "tionth", heads=heads, bodies=bodies)
    n = heads.search("tionth").select(F.col("row_id").alias("doc_id"), F.lit(True).alias("h"))
    return hits.join(n, "doc_id", "left").select("doc_id", F.coalesce("h", F.lit(False)).alias("in_head"))


@query(sql("SELECT id AS doc_id, row_number() OVER (ORDER BY id) AS rank FROM docs WHERE title ILIKE '%qu%'", "docs"))
def keyword_short(spark, d):
    """RK3."""
    a = Archive(spark, d)
    return S.keyword_hits(a.docs, a.chunks, " qu ").select("doc_id", "rank")


def _hybrid(a: Archive, d):
    heads, bodies = _indexes(a._spark, d)
    v = (
        a.raw("embeddings")
        .select(
            F.col("vec_id").alias("vector_id"),
            F.col("vec_id").alias("document_id"),
            F.lit("x").alias("source"),
            "embedding",
        )
    )
    q = v.where("vector_id = 0").select("embedding").first()["embedding"]
    return S.fold_duplicates(S.hybrid(S.semantic_hits(v, q, 20), S.keyword_hits(a.docs, a.chunks, "tionth", heads=heads, bodies=bodies)), a.links)


@query()
def search_hybrid(spark, d):
    """RK1, RK2, RK4, RK6-8, FL9: the flagship search."""
    a = Archive(spark, d)
    page = S.paginate(B.restrict_hits(_hybrid(a, d), a.docs, statuses=["fetched", "pending"]), 20)
    out = B.cards(a.docs, a.chunks, a.source_tags.withColumnRenamed("tag_string", "tag"), a.assignments, a.clusters)
    return page.join(out.select(F.col("id").alias("doc_id"), "source", "title", "description", "tags", "cluster"), "doc_id").orderBy("rank")


@query(sql("", "docs", "chunks", "links").rstrip() + f""",
{_NORM}, {_Q},
sem AS (SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS r, s FROM (SELECT vec_id, list_cosine_similarity(n.v, q.v) AS s FROM n, q ORDER BY s DESC, vec_id LIMIT 60)),
f AS (SELECT id FROM docs WHERE contains(lower(title), 'tionth') OR contains(lower(coalesce(card_summary, '')), 'tionth')),
b AS (SELECT DISTINCT document_id AS id FROM chunks WHERE contains(lower(text), 'tionth') AND document_id IN (SELECT id FROM docs)),
u AS (SELECT id, s FROM sem UNION ALL SELECT id, NULL FROM (SELECT id FROM f UNION SELECT id FROM b) WHERE id NOT IN (SELECT id FROM sem))
SELECT coalesce(l.canonical_id, u.id) AS doc_id, round(max(s), 4) AS similarity FROM u LEFT JOIN links l ON u.id = l.duplicate_id GROUP BY 1""")
def hybrid_fold(spark, d):
    """RK4, RK6, SO3: members and scores of the fused, folded hits."""
    return _hybrid(Archive(spark, d), d).select("doc_id", F.round("similarity", 4).alias("similarity"))


@query("""
WITH c AS (SELECT vec_id AS doc_id, label / 10.0 AS c FROM embeddings WHERE vec_id % 2 = 0), t AS (SELECT vec_id AS doc_id, label / 20.0 + 0.1 AS t FROM embeddings WHERE vec_id % 3 = 0)
SELECT coalesce(c.doc_id, t.doc_id) AS doc_id, round(greatest(coalesce(c, t), coalesce(t, c)), 3) AS similarity, CASE WHEN c IS NULL THEN 'text' WHEN t IS NULL THEN 'clip' ELSE 'clip+text' END AS matched_by
FROM c FULL JOIN t ON c.doc_id = t.doc_id""")
def image_hits(spark, d):
    """RK10."""
    e = Archive(spark, d).raw("embeddings")
    clip = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), (F.col("label") / 10.0).alias("similarity"))
    return S.merge_image_hits(
        clip,
        e.where("vec_id % 3 = 0")
        .select(F.col("vec_id").alias("doc_id"), (F.col("label") / 20.0 + 0.1).alias("similarity")),
    )


_CENT = """p AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM p GROUP BY 1, 2), c AS (SELECT label AS cluster_id, list(x ORDER BY i) AS c FROM m GROUP BY 1)"""


def _centroids(a: Archive):
    rows = a.raw("embeddings").select(F.col("label").cast("long").alias("cluster_id"), "embedding")
    return V.mean_vectors(rows, "cluster_id")


@query(f"WITH {_CENT} SELECT CAST(cluster_id AS BIGINT) AS cluster_id, array_to_string(list_transform(c[1:4], lambda x: printf('%.4f', round(x, 4) + 0.0)), ',') AS head, CAST(len(c) AS INTEGER) AS d FROM c")
def centroids(spark, d):
    """AG13, AG14."""
    head = F.array_join(F.transform(F.slice("embedding", 1, 4), lambda x: F.format_string("%.4f", F.round(x, 4) + 0.0)), ",")
    return _centroids(Archive(spark, d)).select("cluster_id", head.alias("head"), F.size("embedding").alias("d"))


@query(f"WITH {_NORM}, {_CENT}, s AS (SELECT vec_id, cluster_id, list_cosine_similarity(n.v, c.c) AS s FROM n, c) SELECT vec_id AS document_id, CAST(arg_max(cluster_id, s) AS BIGINT) AS cluster_id, round(max(s), 4) AS score FROM s GROUP BY 1")
def nearest_centroid(spark, d):
    """JN10."""
    a = Archive(spark, d)
    return (
        V.nearest_centroid(a.raw("embeddings").select(F.col("vec_id").alias("document_id"), "embedding"), _centroids(a))
        .withColumn("score", F.round("score", 4))
    )


@query(f"""WITH {_NORM}, {_CENT}, r AS (SELECT CAST(c.cluster_id AS BIGINT) AS cluster_id, 1 - avg(list_cosine_similarity(n.v, c.c)) AS d, count(n.vec_id) AS k FROM c LEFT JOIN n ON n.label = c.cluster_id AND n.vec_id >= (SELECT 0.8 * max(vec_id) FROM n) GROUP BY 1)
SELECT cluster_id, round(coalesce(d, 0), 3) AS drift_score, k AS n_recent, coalesce(d, 0) > 0.6 AS flagged FROM r""")
def drift(spark, d):
    """CL11, ST7."""
    a = Archive(spark, d)
    v = a.raw("embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    newest = v.agg(F.max("document_id").alias("newest"))
    recent = a.assignments.crossJoin(F.broadcast(newest)).where("document_id >= 0.8 * newest")
    return V.drift(_centroids(a), recent.select("document_id", "cluster_id"), v)


@query(f"WITH {_CENT} SELECT CAST(a.cluster_id AS BIGINT) AS cluster_id_a, CAST(b.cluster_id AS BIGINT) AS cluster_id_b, round(list_cosine_similarity(a.c, b.c), 3) AS similarity FROM c a JOIN c b ON a.cluster_id < b.cluster_id WHERE list_cosine_similarity(a.c, b.c) >= 0.05")
def merge_suggestions(spark, d):
    """CL12 (at a threshold that has pairs here)."""
    return V.merge_suggestions(_centroids(Archive(spark, d)), 0.05)


# ── clusters and learning ────────────────────────────────────────────────────


@query(sql("SELECT id FROM docs WHERE id IN (SELECT document_id FROM chunks) AND id NOT IN (SELECT duplicate_id FROM links)", "docs", "chunks", "links"))
def cluster_candidates(spark, d):
    """CL1."""
    a = Archive(spark, d)
    return C.candidates(a.docs, a.chunks, a.links).select("id")


@query(sql("SELECT DISTINCT document_id, 'cluster-' || cluster_id AS tag, 'cluster_l1' AS origin FROM assignments JOIN clusters USING (cluster_id) WHERE NOT is_noise", "assignments", "clusters"))
def cluster_overlays(spark, d):
    """CL13, FN9."""
    a = Archive(spark, d)
    return C.label_overlays(a.assignments, a.clusters)


@query(sql(r"""
SELECT cluster_id, coalesce(string_agg(word, ' / ' ORDER BY n DESC, f), 'Unlabelled') AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, f) AS place FROM (
    SELECT cluster_id, ws[i] AS word, count(*) AS n, min(k * 10000000 + i) AS f FROM (
      SELECT a.cluster_id, row_number() OVER (PARTITION BY a.cluster_id ORDER BY d.id) AS k, regexp_extract_all(lower(concat_ws(' ', d.title, CASE WHEN length(t) <= 280 THEN t ELSE rtrim(substr(t, 1, 280)) || '…' END)), '[a-z]{3,}') AS ws
      FROM assignments a JOIN (SELECT *, trim(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:3], ' '), '<[a-zA-Z/][^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM docs) d ON d.id = a.document_id) q, unnest(range(1, len(ws) + 1)) u(i)
    WHERE k <= 8 AND ws[i] NOT IN ('the', 'a', 'an', 'of', 'in', 'and', 'to', 'for', 'with', 'on', 'is', 'are', 'by', 'from', 'at', 'as', 'that', 'this', 'its', 'it') GROUP BY 1, 2)) WHERE place <= 4 GROUP BY 1""", "assignments", "docs"))
def cluster_labels(spark, d):
    """CL9, CL10, AG24."""
    a = Archive(spark, d)
    return C.label_clusters(C.label_samples(a.assignments, a.docs))


@query()
def cluster_kmeans(spark, d):
    """CL3, CL4, CL7 (substitutes): both levels."""
    v = Archive(spark, d).raw("embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    one = C.cluster(v, 10)
    return (
        one.withColumn("level", F.lit(1))
        .unionByName(C.split_clusters(v, one).select("document_id", "cluster_id", F.lit(2).alias("level")))
    )


@query()
def silhouette_k(spark, d):
    """CL5 (substitute)."""
    v = Archive(spark, d).raw("embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    k, scores = C.auto_k(v, 4, 12, 4)
    return spark.createDataFrame([(n, float(s), n == k) for n, s in scores], "k int, silhouette double, chosen boolean")


@query()
def pca_plane(spark, d):
    """CL2, CL8 (substitute for UMAP)."""
    v = Archive(spark, d).raw("embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    return C.reduce_pca(v, 2).select("document_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))


@query(f"""WITH {_NORM}, {_CENT},
p2 AS (SELECT label * 2 + vec_id % 2 AS kid, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m2 AS (SELECT kid, i, avg(CAST(x AS DOUBLE)) AS x FROM p2 GROUP BY 1, 2), k AS (SELECT kid, list(x ORDER BY i) AS c FROM m2 GROUP BY 1),
new AS (SELECT * FROM n WHERE vec_id >= (SELECT 0.6 * max(vec_id) FROM n)),
one AS (SELECT vec_id, arg_max(cluster_id, s) AS cluster_id, max(s) AS score FROM (SELECT vec_id, cluster_id, list_cosine_similarity(new.v, c.c) AS s FROM new, c) GROUP BY 1),
two AS (SELECT o.vec_id, arg_max(k.kid, list_cosine_similarity(new.v, k.c)) AS cluster_id, max(list_cosine_similarity(new.v, k.c)) AS score FROM one o JOIN new USING (vec_id) JOIN k ON floor(k.kid / 2) = o.cluster_id WHERE o.score >= 0.05 GROUP BY 1)
SELECT vec_id AS document_id, CAST(CASE WHEN score >= 0.05 THEN cluster_id ELSE 9 END AS BIGINT) AS cluster_id, 1 AS level, round(score, 4) AS score FROM one
UNION ALL SELECT vec_id, CAST(cluster_id AS BIGINT), 2, round(score, 4) FROM two""")
def assign_new(spark, d):
    """IN2: the newest two fifths are placed."""
    a = Archive(spark, d)
    v = a.raw("embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    kids = V.mean_vectors(
        a.raw("embeddings")
        .select((F.col("label") * 2 + F.col("vec_id") % 2).cast("long").alias("cluster_id"), "embedding"),
        "cluster_id",
    )
    placed = a.assignments.crossJoin(F.broadcast(v.agg(F.max("document_id").alias("newest")))).where("document_id < 0.6 * newest")
    out = C.assign_new(v, placed, _centroids(a), kids.withColumn("parent_id", F.floor(F.col("cluster_id") / 2)), 9, 0.05)
    return out.select("document_id", "cluster_id", "level", F.round("score", 4).alias("score"))


def _model(a: Archive):
    v = a.raw("embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    labels = a.raw("labels").select(F.col("doc_id").alias("document_id"), F.col("quality").alias("label"), F.lit("manual").alias("source"))
    w, b, _ = L.train(L.label_matrix(labels, v))
    return v, labels, L.probability(F.col("embedding"), w, b)


@query()
def logistic_scores(spark, d):
    """LR1-3."""
    v, _, p = _model(Archive(spark, d))
    return v.select("document_id", p.alias("p"))


@query()
def uncertainty_queue(spark, d):
    """LR4, ST6."""
    return L.uncertainty_queue(*_model(Archive(spark, d)))


@query()
def pseudo_labels(spark, d):
    """LR5."""
    return L.pseudo_labels(*_model(Archive(spark, d)), 0.9, 0.1)


@query()
def learned_overlays(spark, d):
    """LR6, SK5."""
    a = Archive(spark, d)
    return L.apply_learned(a.overlay_tags, *_model(a), "quality", 0.5).select("document_id", "tag", "origin")


@query()
def seed_session(spark, d):
    """LR7."""
    a = Archive(spark, d)
    return L.seed_session(
        a.source_tags.withColumnRenamed("tag_string", "tag"),
        folded(a)[1],
        a.raw("embeddings").select(F.col("vec_id").alias("document_id")),
        "EN",
    )


# ── writers and logs ─────────────────────────────────────────────────────────


@query("""
WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS title, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS note FROM orders WHERE o_orderkey % 5 < 3),
i AS (SELECT o_orderkey AS id, lower(o_orderstatus) AS title, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1.0 END AS price, 'n' AS note FROM orders WHERE o_orderkey % 5 > 1)
SELECT coalesce(i.id, s.id) AS id, CASE WHEN i.id IS NULL THEN s.title ELSE i.title END AS title, coalesce(i.price, s.price) AS price, coalesce(s.note, i.note) AS note FROM s FULL JOIN i ON s.id = i.id""")
def upsert_policy(spark, d):
    """SK1-3."""
    o = Archive(spark, d).raw("orders")
    s = (
        o.where("o_orderkey % 5 < 3")
        .selectExpr(
            "o_orderkey AS id",
            "o_orderstatus AS title",
            "o_totalprice AS price",
            "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS note",
        )
    )
    i = (
        o.where("o_orderkey % 5 > 1")
        .selectExpr(
            "o_orderkey AS id",
            "lower(o_orderstatus) AS title",
            "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1.0D END AS price",
            "'n' AS note",
        )
    )
    return W.upsert(s, i, ["id"], ("title",), ("note",))


@query("""
WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS old FROM events WHERE event_id % 2 = 0 GROUP BY 1), i AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1)
SELECT i.user_id, i.event_type, CASE WHEN old IS NULL THEN 'new' WHEN old <> event_type THEN 'changed' ELSE 'unchanged' END AS outcome FROM i LEFT JOIN l USING (user_id)""")
def append_digest(spark, d):
    """SK9, IN4."""
    e = Archive(spark, d).raw("events")
    log = e.where("event_id % 2 = 0").select("user_id", W.digest(["event_type"]).alias("digest"), F.col("event_id").alias("line_no"))
    return (
        W.record_items(log, e.where("event_id % 2 = 1").select("user_id", "event_type"), "user_id", ["event_type"])
        .select("user_id", "event_type", "outcome")
    )


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first_seen FROM events GROUP BY 1")
def latest_version(spark, d):
    """SC14."""
    return (
        X.latest_items(
            Archive(spark, d).raw("events").select("user_id", "event_type", F.col("event_id").alias("line_no")),
            "user_id",
        )
        .select("user_id", "event_type", "first_seen")
    )


@query(sql("SELECT document_id, tag, origin FROM overlay_tags WHERE NOT (origin = 'learned' AND tag IN ('topic-1', 'topic-2')) UNION ALL SELECT id, 'topic-1', 'learned' FROM docs WHERE id % 10 = 0", "overlay_tags", "docs"))
def sync_overlay(spark, d):
    """SK4, SK5."""
    a = Archive(spark, d)
    want = a.docs.where("id % 10 = 0").select(F.col("id").alias("document_id"), F.lit("topic-1").alias("tag"))
    return (
        W.sync_tags(
            a.overlay_tags,
            want,
            "learned",
            a.docs.select(F.col("id").alias("document_id")),
            ["topic-1", "topic-2"],
        )
        .select("document_id", "tag", "origin")
    )


@query(sql("SELECT count(*) - (SELECT count(*) FROM overlay_tags o JOIN docs d ON o.document_id = d.id WHERE o.origin = 'manual' AND o.tag = 'topic-1') AS applied, (SELECT count(*) FROM overlay_tags o JOIN docs d ON o.document_id = d.id WHERE o.origin = 'manual' AND o.tag = 'topic-1') AS skipped FROM docs", "overlay_tags", "docs"))
def insert_overlay(spark, d):
    """SK6."""
    a = Archive(spark, d)
    return W.insert_tags(a.overlay_tags, a.docs.select(F.col("id").alias("document_id"), F.lit("topic-1").alias("tag"), F.lit("manual").alias("origin")))[1]


@query(sql("SELECT id AS document_id, trim(body) AS text, CAST(length(trim(body)) AS BIGINT) AS char_count, sha256(trim(body)) AS content_hash FROM docs WHERE trim(body) <> ''", "docs"))
def store_texts(spark, d):
    """SK10, FN25."""
    a = Archive(spark, d)
    own = a.docs.select(F.col("id").alias("document_id"), F.col("body").alias("text"))
    empty = spark.createDataFrame(
        [],
        "document_id long, text string, char_count long, full_char_count long, content_hash string, extracted_at long",
    )
    return W.store_text(empty, own, 0).select("document_id", "text", "char_count", "content_hash")


@query(sql("SELECT id, CASE WHEN id IN (SELECT user_id FROM events WHERE event_type = 'click') THEN 'fetched' ELSE fetch_status END AS fetch_status FROM docs", "docs"))
def record_fetch(spark, d):
    """SK11."""
    a = Archive(spark, d)
    got = (
        a.raw("events")
        .where("event_type = 'click'")
        .select(F.col("user_id").alias("document_id"))
        .distinct()
        .select(
            "document_id",
            F.lit("fetched").alias("fetch_status"),
            F.lit(200).alias("http_status"),
            F.lit(None).cast("string").alias("error_msg"),
        )
    )
    return W.record_fetch(a.docs, a.fetch_log, got, 0)[0].select("id", "fetch_status")


@query("SELECT user_id % 7 AS session_id, user_id AS document_id, CAST(arg_max(event_id % 2, event_id) AS BIGINT) AS label FROM events GROUP BY 1, 2")
def upsert_labels(spark, d):
    """SK12."""
    rows = (
        Archive(spark, d)
        .raw("events")
        .select(
            (F.col("user_id") % 7).alias("session_id"),
            F.col("user_id").alias("document_id"),
            (F.col("event_id") % 2).alias("label"),
            F.lit("manual").alias("source"),
            F.col("event_id").alias("ordinal"),
        )
    )
    return W.upsert_labels(rows.drop("ordinal").where("false"), rows).select("session_id", "document_id", "label")


@query("""
WITH RECURSIVE t AS (SELECT c_custkey AS id, nullif(CAST(floor(c_custkey / 3) AS BIGINT), c_custkey) AS parent, c_mktsegment AS title FROM customer),
r AS (SELECT id, title AS path FROM t WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t WHERE id IS NOT NULL) UNION ALL SELECT t.id, r.path || '/' || t.title FROM t JOIN r ON t.parent = r.id)
SELECT id, path FROM r""")
def folder_paths(spark, d):
    """SC2, SC6."""
    t = (
        Archive(spark, d)
        .raw("customer")
        .select(
            F.col("c_custkey").alias("id"),
            F.floor(F.col("c_custkey") / 3).alias("parent"),
            F.col("c_mktsegment").alias("title"),
        )
    )
    return X.tree_paths(t)


@query(r"SELECT document_id, section_index, min(page) AS page_start, max(page) AS page_end, string_agg(trim(text), chr(10) || chr(10) ORDER BY page, text) AS text FROM (SELECT conv_id AS document_id, turn AS page, text, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) AS INTEGER) AS section_index FROM conversations WHERE trim(text) <> '') GROUP BY 1, 2")
def page_sections(spark, d):
    """SC16."""
    return X.page_groups(
        Archive(spark, d)
        .raw("conversations")
        .select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), "text"),
        3,
    )

