"""The driver's tables in the roles of the archive's, as one SQL text for both engines.

Every derived table is a deterministic projection of a whole driver table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, str] = {
    "docs": """
SELECT doc_id AS id,
  CASE doc_id % 4 WHEN 0 THEN 'firefox' WHEN 1 THEN 'zotero' WHEN 2 THEN 'calibre' ELSE 'youtube' END AS source,
  'k' || CAST(doc_id AS VARCHAR(20)) AS source_id, split_part(text, chr(10), 1) AS title, text AS body,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE substr(text, 1, 90) END AS card_summary,
  CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'unfetchable' ELSE 'fetched' END AS fetch_status,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 1600000000 + ((doc_id * 7919) % 1500) * 86400 END AS date_added,
  1700000000 + doc_id AS ingested_at,
  CASE WHEN doc_id % 13 = 0 THEN 'ftp://old.example.org/' || lang WHEN doc_id % 17 = 0 THEN '' ELSE 'https://www.' || lang || '.example.org/' || source || '/' || CAST(doc_id AS VARCHAR(20)) END AS url_or_path,
  CASE WHEN doc_id % 6 = 0 THEN 'https://archive.example.org/' || CAST(doc_id AS VARCHAR(20)) ELSE NULL END AS archive_url,
  CASE doc_id % 3 WHEN 0 THEN 'journalArticle' WHEN 1 THEN 'preprint' ELSE NULL END AS item_type,
  CASE WHEN doc_id % 4 = 2 THEN NULL ELSE 's' END AS generated_summary, lang, n_chars
FROM documents""",
    "links": """
SELECT c.canonical_id, d.doc_id AS duplicate_id, 'text' AS match_key, 'merged' AS state
FROM documents d JOIN (SELECT text, min(doc_id) AS canonical_id FROM documents GROUP BY text) c ON d.text = c.text
WHERE d.doc_id <> c.canonical_id""",
    "chunks": """
SELECT conv_id * 1000 + turn AS id, conv_id AS document_id, turn AS chunk_index, text,
  CASE turn % 5 WHEN 3 THEN 'summary' WHEN 4 THEN 'fulltext' ELSE NULL END AS chunk_pass,
  CASE WHEN turn % 2 = 0 THEN 'v' || CAST(conv_id AS VARCHAR(20)) ELSE NULL END AS vector_id,
  CASE WHEN turn % 5 = 3 AND conv_id % 3 > 0 THEN conv_id % 3 ELSE NULL END AS summary_run_id, 1 AS page_start
FROM conversations""",
    "source_tags": """
SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS tag_string FROM documents
UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Topic ' ELSE 'topic_' END || CAST(doc_id % 7 AS VARCHAR(20)) FROM documents
UNION ALL SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN 's' ELSE '' END FROM documents""",
    "overlay_tags": """
SELECT doc_id AS document_id, 'topic-' || CAST(doc_id % 7 AS VARCHAR(20)) AS tag, CASE doc_id % 3 WHEN 0 THEN 'learned' WHEN 1 THEN 'manual' ELSE 'cluster_l1' END AS origin FROM documents
UNION ALL SELECT doc_id, CASE WHEN quality = 1 THEN 'Academic' ELSE 'academic' END, 'inferred' FROM labels""",
    "aliases": """
SELECT DISTINCT 'topic-' || CAST(doc_id % 7 AS VARCHAR(20)) AS alias, 'topic-0' AS canonical, 'semantic' AS kind,
  CASE WHEN doc_id % 7 < 3 THEN 'active' ELSE 'candidate' END AS state, 0.9 AS score
FROM documents WHERE doc_id % 7 > 0""",
    "fetch_log": "SELECT event_id AS id, user_id AS document_id, CAST(1704067200 + event_id * 60 AS BIGINT) AS timestamp, 200 + event_id % 5 AS http_status, event_type AS error_msg FROM events",
    "assignments": "SELECT vec_id AS document_id, CAST(label AS BIGINT) AS cluster_id, 1 AS run_id, 1 AS level FROM embeddings",
    "clusters": "SELECT DISTINCT CAST(label AS BIGINT) AS cluster_id, 'Cluster ' || CAST(label AS VARCHAR(20)) AS label, 1 AS run_id, 1 AS level, label = 9 AS is_noise FROM embeddings",
    "images": """
SELECT page_id AS id, page_id AS document_id, url AS path, CASE WHEN page_id % 2 = 0 THEN 'photo' ELSE 'scan' END AS image_type,
  CASE WHEN page_id % 5 = 0 THEN NULL ELSE 1700000000 + page_id END AS indexed_at, CASE WHEN page_id % 3 = 0 THEN 'c' || CAST(page_id AS VARCHAR(20)) ELSE NULL END AS clip_vector_id
FROM pages""",
    "web": "SELECT page_id AS id, url AS url_or_path, CASE page_id % 4 WHEN 0 THEN 'unfetchable' WHEN 1 THEN 'pending' ELSE 'fetched' END AS fetch_status, html FROM pages",
    "texts": "SELECT doc_id AS document_id, length(text) AS char_count, CASE WHEN doc_id % 9 = 0 THEN length(text) + 5 ELSE length(text) END AS full_char_count FROM documents",
    "runs": "SELECT DISTINCT CAST(label AS BIGINT) AS run_id, CASE WHEN label % 2 = 0 THEN 'local' ELSE 'remote' END AS provider, 'm' || CAST(label % 3 AS VARCHAR(20)) AS model FROM embeddings",
    "reading_lists": "SELECT CAST(n_nationkey AS BIGINT) AS list_id, n_name AS name FROM nation",
    "reading_items": "SELECT doc_id % 20 AS list_id, doc_id AS document_id, doc_id % 50 AS position FROM labels",
    # A browser's bookmarks: nations as folders, regions as tags, pages as bookmarks (some twice, some tagged).
    "fx_bookmarks": """
SELECT CAST(1 AS BIGINT) AS id, 2 AS type, CAST(0 AS BIGINT) AS parent, CAST(NULL AS BIGINT) AS fk, CAST(NULL AS VARCHAR(20)) AS title, CAST(NULL AS BIGINT) AS dateAdded, 'root________' AS guid
UNION ALL SELECT 2, 2, 1, NULL, 'menu', NULL, 'menu________' UNION ALL SELECT 4, 2, 1, NULL, 'tags', NULL, 'tags________'
UNION ALL SELECT 100 + n_nationkey, 2, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 100 + CAST(floor(n_nationkey / 3) AS INTEGER) END, NULL, n_name, NULL, 'f' || CAST(n_nationkey AS VARCHAR(20)) FROM nation
UNION ALL SELECT 50 + r_regionkey, 2, 4, NULL, lower(r_name), NULL, 't' || CAST(r_regionkey AS VARCHAR(20)) FROM region
UNION ALL SELECT 1000 + page_id, 1, 100 + page_id % 25, page_id, CASE WHEN page_id % 4 = 0 THEN ' ' ELSE 'Mark ' || CAST(page_id AS VARCHAR(20)) END, CASE WHEN page_id % 7 = 0 THEN 0 ELSE (1600000000 + page_id) * 1000000 END, 'b' FROM pages
UNION ALL SELECT 1000000000 + page_id, 1, 2, page_id, 'again', 1, 'd' FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT 2000000000 + page_id, 1, 50 + page_id % 5, page_id, NULL, 1, 'g' FROM pages WHERE page_id % 3 = 0""",
    "fx_places": """
SELECT page_id AS id, CASE WHEN page_id % 11 = 0 THEN 'place:sort=8' WHEN page_id % 13 = 0 THEN 'javascript:x' ELSE url END AS url,
  CASE WHEN page_id % 8 = 0 THEN NULL ELSE 'Page ' || CAST(page_id AS VARCHAR(20)) END AS title FROM pages""",
    # A reference manager's tables: documents as items of four types.
    "z_items": "SELECT doc_id AS itemID, 'K' || CAST(doc_id AS VARCHAR(20)) AS key, doc_id % 4 + 1 AS itemTypeID, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE '2020-01-0' || CAST(doc_id % 9 AS VARCHAR(20)) || ' 03:04:05' END AS dateAdded FROM documents",
    "z_types": "SELECT DISTINCT doc_id % 4 + 1 AS itemTypeID, CASE doc_id % 4 WHEN 0 THEN 'journalArticle' WHEN 1 THEN 'preprint' WHEN 2 THEN 'attachment' ELSE 'note' END AS typeName FROM documents",
    "z_fields": "SELECT DISTINCT doc_id % 2 + 1 AS fieldID, CASE WHEN doc_id % 2 = 0 THEN 'title' ELSE 'date' END AS fieldName FROM documents",
    "z_data": "SELECT doc_id AS itemID, 1 AS fieldID, source || ' ' || lang AS value FROM documents UNION ALL SELECT doc_id, 2, 'May ' || CAST(1990 + doc_id % 30 AS VARCHAR(20)) FROM documents WHERE doc_id % 5 > 0",
    "z_creators": "SELECT DISTINCT doc_id % 50 AS creatorID, CASE WHEN doc_id % 3 = 0 AND doc_id % 50 < 10 THEN NULL ELSE 'F' || CAST(doc_id % 50 AS VARCHAR(20)) END AS firstName, 'L' || CAST(doc_id % 50 AS VARCHAR(20)) AS lastName FROM documents WHERE doc_id < 50",
    "z_item_creators": "SELECT doc_id AS itemID, doc_id % 50 AS creatorID, 1 AS orderIndex FROM documents UNION ALL SELECT doc_id, (doc_id + 7) % 50, 0 FROM documents WHERE doc_id % 2 = 0",
    "z_item_tags": "SELECT doc_id AS itemID, doc_id % 6 AS tagID FROM documents UNION ALL SELECT doc_id, doc_id % 5 FROM documents",
    "z_tags": "SELECT DISTINCT doc_id % 6 AS tagID, 't' || CAST(doc_id % 6 AS VARCHAR(20)) AS name FROM documents",
    "z_collections": "SELECT CAST(n_nationkey AS BIGINT) AS collectionID, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(floor(n_nationkey / 3) AS BIGINT) END AS parentCollectionID, n_name AS collectionName FROM nation",
    "z_collection_items": "SELECT doc_id % 25 AS collectionID, doc_id AS itemID FROM documents UNION ALL SELECT (doc_id + 3) % 25, doc_id FROM documents WHERE doc_id % 3 = 0",
    "z_attachments": "SELECT doc_id AS itemID, doc_id - 2 AS parentItemID, CASE WHEN doc_id % 8 = 2 THEN 'application/pdf' ELSE 'text/html' END AS contentType FROM documents WHERE doc_id % 4 = 2",
    "z_annotations": "SELECT doc_id AS itemID, doc_id - 1 AS parentItemID, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'mark ' || lang END AS text, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE source END AS comment FROM documents WHERE doc_id % 4 = 3",
    # A book library: parts as books, suppliers as authors.
    "c_books": "SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN '0101-01-01 00:00:00+00:00' ELSE CAST(1990 + p_partkey % 30 AS VARCHAR(20)) || '-05-01 00:00:00+00:00' END AS pubdate, '2020-01-01 00:00:00+00:00' AS timestamp FROM part",
    "c_comments": "SELECT CAST(p_partkey AS BIGINT) * 2 AS id, CAST(p_partkey AS BIGINT) AS book, p_type AS text FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT CAST(p_partkey AS BIGINT) * 2 + 1, CAST(p_partkey AS BIGINT), 'later' FROM part WHERE p_partkey % 4 = 0",
    "c_ratings": "SELECT DISTINCT CAST(p_partkey % 5 AS BIGINT) AS id, CAST(p_partkey % 5 * 2 AS INTEGER) AS rating FROM part",
    "c_ratings_link": "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey AS BIGINT) AS book, CAST(p_partkey % 5 AS BIGINT) AS rating FROM part WHERE p_partkey % 3 > 0",
    "c_authors": "SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name FROM supplier",
    "c_authors_link": "SELECT CAST(p_partkey AS BIGINT) * 2 AS id, CAST(p_partkey AS BIGINT) AS book, CAST(p_partkey % 7 + 1 AS BIGINT) AS author FROM part UNION ALL SELECT CAST(p_partkey AS BIGINT) * 2 + 1, CAST(p_partkey AS BIGINT), CAST(p_partkey % 3 + 8 AS BIGINT) FROM part WHERE p_partkey % 2 = 0",
    "c_tags": "SELECT DISTINCT CAST(p_partkey % 6 AS BIGINT) AS id, CASE WHEN p_partkey % 6 < 4 THEN 'tag ' || CAST(p_partkey % 6 AS VARCHAR(20)) ELSE 'a tag of far too many words ' || CAST(p_partkey % 6 AS VARCHAR(20)) END AS name FROM part",
    "c_tags_link": "SELECT CAST(p_partkey AS BIGINT) * 2 AS id, CAST(p_partkey AS BIGINT) AS book, CAST(p_partkey % 6 AS BIGINT) AS tag FROM part UNION ALL SELECT CAST(p_partkey AS BIGINT) * 2 + 1, CAST(p_partkey AS BIGINT), CAST((p_partkey + 3) % 6 AS BIGINT) FROM part WHERE p_partkey % 5 = 0",
    "c_publishers": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation",
    "c_publishers_link": "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey AS BIGINT) AS book, CAST(p_partkey % 25 AS BIGINT) AS publisher FROM part WHERE p_partkey % 7 > 0",
    # Urls of every handled site, by part, with the identifiers that they hold.
    "site_urls": """
SELECT k AS id, k % 23 AS kind, CASE k % 23
  WHEN 0 THEN 'https://arxiv.org/abs/2101.' || n || 'v' || CAST(k % 3 + 1 AS VARCHAR(20)) WHEN 1 THEN 'http://www.arxiv.org/PDF/2101.' || n || '.pdf'
  WHEN 2 THEN 'https://www.biorxiv.org/content/10.1101/' || n || 'v2.full.pdf' WHEN 3 THEN 'https://biorxiv.org/content/early/2018/01/02/' || n
  WHEN 4 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || n || '/' WHEN 5 THEN 'https://www.ncbi.nlm.nih.gov/pubmed/' || n
  WHEN 6 THEN 'https://www.nature.com/articles/s' || n || '.pdf' WHEN 7 THEN 'https://nature.com/nature/journal/v1/n2/full/n' || n || '_F3.html'
  WHEN 8 THEN 'https://link.springer.com/article/10.1007%2Fs' || n WHEN 9 THEN 'https://journals.aps.org/prl/abstract/10.1103/P.' || n WHEN 10 THEN 'https://link.aps.org/doi/10.9999/' || n
  WHEN 11 THEN 'https://www.sciencedirect.com/science/article/abs/pii/s' || n || '0X' WHEN 12 THEN 'https://mitpress.mit.edu/97802620' || substr(n, 3, 5) || '/deep-' || n || '/'
  WHEN 13 THEN 'https://dx.doi.org/10.1000/x' || n WHEN 14 THEN 'https://m.youtube.com/watch?x=1&v=abcd' || n || '&t=4' WHEN 15 THEN 'https://youtu.be/abcd' || n
  WHEN 16 THEN 'https://smile.amazon.co.uk/Some-Book/dp/b00' || n || '/ref=x' WHEN 17 THEN 'https://www.google.de/search?q=deep++' || n || '+x&hl=de'
  WHEN 18 THEN 'https://old.reddit.com/r/Sub/comments/A' || n || '/slug/' WHEN 19 THEN 'https://direct.mit.edu/neco/article-pdf/9/8/' || n || '/813/neco.' || n || '.pdf'
  WHEN 20 THEN 'https://direct.mit.edu/books/book/' || n || '/A-Book_' || n WHEN 22 THEN 'https://www.researchgate.net/publication/' || n || '_A_good_title_' || n || '.pdf' ELSE 'https://en.wikipedia.org/wiki/Page_' || n || '#top' END AS url, n
FROM (SELECT CAST(p_partkey AS BIGINT) AS k, lpad(CAST(p_partkey AS VARCHAR(20)), 7, '0') AS n FROM part) q""",
}
_DRIVER = ("documents", "conversations", "labels", "events", "embeddings", "pages", "nation", "region", "part", "supplier", "orders", "customer")


class Archive:
    """Derived tables by name, as DataFrames over one directory of the driver's."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(_DRIVER)})\b", r"\1 {\2}", TABLES[name])
        used = set(re.findall(r"\{(\w+)\}", sql))
        return self._spark.sql(sql, **{t: self.raw(t) for t in used})


def sql(text: str, *names: str) -> str:
    """DuckDB SQL over derived tables."""
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in names) + "\n" + text.strip()
