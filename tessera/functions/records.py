"""Record parsers and compositions (FN29, FN30, FN35, FN36, HP1-3, HP12-15, HP17): JSON by from_json, XML by xpath."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import arrow_function
from .text import unescape
from .urls import hostname, normalize_doi


def _full(c: Column) -> Column:
    """The trimmed text, null if blank."""
    return F.nullif(F.trim(c), F.lit(""))


def _flat(c: Column) -> Column:
    return _full(F.regexp_replace(c, r"(?U)\s+", " "))


# Markup in a record's fields, the heading of a JATS abstract, and the word that is left of one.
FIELD_TAG = r"</?[A-Za-z][\w:.-]*(?:\s[^<>]*)?/?>"
JATS_HEADING = r"<jats:title>\s*abstract\s*</jats:title>"
LEADING_ABSTRACT = r"^abstract[\s:.–—-]*"
# What a model writes where it can't read a book's title or author.
PLACEHOLDERS = ("", "illegible", "n/a", "na", "none", "not visible", "null", "title", "unknown", "unknown author", "unknown title", "unreadable", "untitled")

# ── DOI records ──────────────────────────────────────────────────────────────


def plain_field(raw: Column) -> Column:
    """FN30: entities decoded, then markup dropped and blanks collapsed."""
    return _flat(F.regexp_replace(unescape(raw), FIELD_TAG, " "))


def strip_jats(raw: Column) -> Column:
    """FN30: a JATS abstract as plain text, without its heading."""
    bare = plain_field(F.regexp_replace(raw, f"(?i){JATS_HEADING}", " "))
    return _full(F.regexp_replace(bare, f"(?i){LEADING_ABSTRACT}", ""))


_DATES = "struct<`date-parts`:array<array<string>>>"
_DOI = (
    "title string, author array<struct<given:string,family:string,name:string>>, abstract string, "
    f"issued {_DATES}, published {_DATES}, `published-print` {_DATES}, `published-online` {_DATES}, `container-title` string, type string"
)


def parse_doi_record(raw: Column) -> Column:
    """FN30: (doi, title, authors, abstract, year, container, type) of a Crossref or CSL-JSON record; null without title or DOI.

    Fields that are arrays in one shape and strings in the other are read as text first.
    """
    r = F.from_json(raw, _DOI)
    first = lambda c: F.coalesce(F.try_element_at(F.from_json(c, "array<string>"), F.lit(1)), F.when(~c.startswith("["), c))
    name = lambda a: _flat(F.coalesce(_full(a["name"]), F.concat_ws(" ", _full(a["given"]), _full(a["family"]))))
    authors = F.filter(
        F.transform(
            F.coalesce(r["author"], F.expr("cast(array() as array<struct<given:string,family:string,name:string>>)")),
            name,
        ),
        lambda n: n.isNotNull(),
    )
    year = F.coalesce(
        *[F.try_element_at(F.try_element_at(r[k]["date-parts"], F.lit(1)), F.lit(1)).try_cast("int") for k in ("issued", "published", "published-print", "published-online")]
    )
    title, doi = plain_field(first(r["title"])), normalize_doi(F.coalesce(first(F.get_json_object(raw, "$.DOI")), first(F.get_json_object(raw, "$.doi"))))
    out = F.struct(
        doi.alias("doi"),
        title.alias("title"),
        authors.alias("authors"),
        strip_jats(r["abstract"]).alias("abstract"),
        year.alias("year"),
        plain_field(first(r["container-title"])).alias("container"),
        first(r["type"]).alias("type"),
    )
    return F.when(title.isNotNull() & doi.isNotNull(), out)


# ── preprints and articles ───────────────────────────────────────────────────


def parse_arxiv_atom(xml: Column) -> Column:
    """HP1: (arxiv_id, title, authors, abstract, categories) of the first entry; null without title or summary."""
    at = lambda p: F.lit(f"//*[local-name()='entry'][1]/*[local-name()='{p}']")
    title, summary = _full(F.regexp_replace(F.xpath_string(xml, at("title")), "\n", " ")), _full(F.xpath_string(xml, at("summary")))
    ident = F.regexp_replace(F.regexp_replace(F.xpath_string(xml, at("id")), r"^https?://[^/]+/abs/", ""), r"(?i)v\d+/?$", "")
    authors = F.xpath(xml, F.lit("//*[local-name()='entry'][1]/*[local-name()='author']/*[local-name()='name']/text()"))
    kinds = F.xpath(xml, F.lit("//*[local-name()='entry'][1]/*[local-name()='category']/@term"))
    out = F.struct(
        ident.alias("arxiv_id"),
        title.alias("title"),
        authors.alias("authors"),
        summary.alias("abstract"),
        kinds.alias("categories"),
    )
    return F.when(title.isNotNull() & summary.isNotNull() & (ident != ""), out)


def parse_biorxiv_detail(raw: Column) -> Column:
    """HP2: the first row of a detail reply; version 1 where none is given."""
    row = F.try_element_at(
        F.from_json(
            raw,
            "collection array<struct<title:string,abstract:string,doi:string,authors:string,version:string,category:string>>",
        )["collection"],
        F.lit(1),
    )
    title, abstract, doi = _full(row["title"]), _full(row["abstract"]), _full(row["doi"])
    out = F.struct(
        doi.alias("doi"),
        title.alias("title"),
        F.coalesce(F.trim(row["authors"]), F.lit("")).alias("authors"),
        abstract.alias("abstract"),
        F.coalesce(row["version"].try_cast("int"), F.lit(1)).alias("version"),
        _full(row["category"]).alias("category"),
    )
    return F.when(title.isNotNull() & abstract.isNotNull() & doi.isNotNull(), out)


def parse_pubmed_xml(xml: Column) -> Column:
    """HP3: (pmid, title, authors, abstract, year, doi) of the first article; null without title or abstract.

    Parts of a structured abstract carry their labels.
    """
    base = "//PubmedArticle[1]"
    one = lambda p: _full(F.xpath_string(xml, F.lit(f"{base}/{p}")))
    many = lambda p: F.xpath(xml, F.lit(f"{base}/{p}"))
    path = "MedlineCitation/Article/Abstract/AbstractText"
    labels, labelled, bare = many(f"{path}[@Label]/@Label"), many(f"{path}[@Label]/text()"), many(f"{path}[not(@Label)]/text()")
    marked = F.zip_with(
        labels,
        labelled,
        lambda a, t: F.concat(F.upper(F.substring(a, 1, 1)), F.lower(F.substring(a, F.lit(2), F.length(a))), F.lit(": "), t),
    )
    abstract = _flat(F.array_join(F.concat(marked, bare), " "))
    who = "MedlineCitation/Article/AuthorList/Author[LastName]"
    authors = F.zip_with(many(f"{who}/LastName/text()"), many(f"{who}/Initials/text()"), lambda a, b: F.trim(F.concat_ws(" ", a, b)))
    title = one("MedlineCitation/Article/ArticleTitle")
    out = F.struct(
        one("MedlineCitation/PMID").alias("pmid"),
        title.alias("title"),
        authors.alias("authors"),
        abstract.alias("abstract"),
        one("MedlineCitation/Article/Journal/JournalIssue/PubDate/Year").try_cast("int").alias("year"),
        normalize_doi(one("PubmedData/ArticleIdList/ArticleId[@IdType='doi']")).alias("doi"),
    )
    return F.when(title.isNotNull() & abstract.isNotNull(), out)


def preprint_text(title: Column, authors: Column, abstract: Column, body: Column) -> Column:
    """HP15: title, authors, abstract and body; a body that opens with the abstract isn't repeated."""
    a, b = F.trim(F.coalesce(abstract, F.lit(""))), F.trim(F.coalesce(body, F.lit("")))
    again = (a != "") & (b.startswith(F.substring(a, 1, 200)) | F.contains(F.substring(b, F.lit(1), F.length(a) + 80), a))
    by = F.array_join(F.filter(authors, lambda n: F.trim(n) != ""), ", ")
    return F.concat_ws("\n\n", _full(title), F.when(by != "", F.concat(F.lit("by "), by)), _full(a), F.when(~again, _full(b)))


# ── web pages ────────────────────────────────────────────────────────────────


def parse_oembed(raw: Column) -> Column:
    """HP12: (title, author_name) of an oEmbed reply; null without title."""
    r = F.from_json(raw, "title string, author_name string")
    return F.when(
        _full(r["title"]).isNotNull(),
        F.struct(
            F.trim(r["title"]).alias("title"),
            F.coalesce(F.trim(r["author_name"]), F.lit("")).alias("author_name"),
        ),
    )


def parse_reddit_listing(raw: Column, most: int = 10) -> Column:
    """HP13: (title, subreddit, is_self, selftext, external_url, comments) of a thread's reply; null without title or subreddit.

    Deleted comments and those of the moderating bot are left out.
    """
    entry = "struct<kind:string,data:struct<title:string,subreddit:string,is_self:boolean,selftext:string,url:string,author:string,body:string>>"
    lists = F.from_json(raw, f"array<struct<data:struct<children:array<{entry}>>>>")
    post = F.try_element_at(F.try_element_at(lists, F.lit(1))["data"]["children"], F.lit(1))["data"]
    replies = F.filter(
        F.try_element_at(lists, F.lit(2))["data"]["children"],
        lambda c: (c["kind"] == "t1") & (F.trim(c["data"]["body"]) != "") & ~F.trim(c["data"]["body"]).isin("[deleted]", "[removed]") & (F.coalesce(c["data"]["author"], F.lit("")) != "AutoModerator"),
    )
    comments = F.slice(F.coalesce(F.transform(replies, lambda c: F.trim(c["data"]["body"])), F.array().cast("array<string>")), 1, most)
    self_ = F.coalesce(post["is_self"], F.lit(False))
    out = F.struct(
        F.trim(post["title"]).alias("title"),
        F.trim(post["subreddit"]).alias("subreddit"),
        self_.alias("is_self"),
        F.coalesce(F.trim(post["selftext"]), F.lit("")).alias("selftext"),
        F.when(~self_, _full(post["url"])).alias("external_url"),
        comments.alias("comments"),
    )
    return F.when(_full(post["title"]).isNotNull() & _full(post["subreddit"]).isNotNull(), out)


def amazon_page(html: Column) -> Column:
    """HP14: (title, summary) of a product page: its title element, and its description meta."""
    tag = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    title = F.coalesce(tag(r'(?is)<span[^>]*id="productTitle"[^>]*>(.*?)</span>'), tag(r"(?is)<title[^>]*>(.*?)</title>"))
    about = F.coalesce(
        tag(r'(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"'),
        tag(r'(?is)<meta[^>]*content="([^"]*)"[^>]*name="description"'),
    )
    return F.struct(plain_field(title).alias("title"), plain_field(about).alias("summary"))


def reddit_detail(source_id: Column, url: Column, item_type: Column, collections: Column) -> Column:
    """FN36: (kind, subreddit, permalink, external_url) of a document without a sidecar row."""
    on_site = F.coalesce(hostname(url).rlike(r"^(?:(www\.|old\.|np\.)?reddit\.com|(www\.)?redd\.it)$"), F.lit(False))
    kind = F.coalesce(_full(item_type), F.when(source_id.startswith("t1_"), "comment").when(source_id.startswith("t3_"), "post"))
    shelf = F.try_element_at(F.filter(collections, lambda c: c.startswith("r/") & (F.length(c) > 2)), F.lit(1))
    thread = F.when(
        source_id.startswith("t3_"),
        F.concat(F.lit("https://www.reddit.com/comments/"), F.substring(source_id, F.lit(4), F.length(source_id))),
    )
    return F.struct(
        kind.alias("kind"),
        F.substring(shelf, F.lit(3), F.length(shelf)).alias("subreddit"),
        F.when(on_site, url).otherwise(thread).alias("permalink"),
        F.when(~on_site, _full(url)).alias("external_url"),
    )


# ── composition ──────────────────────────────────────────────────────────────


def metadata_text(title: Column, description: Column, authors: Column) -> Column:
    """FN29: a book's title, authors and description without tags."""
    by = F.when(F.size(authors) > 0, F.concat(F.lit("by "), F.array_join(authors, ", ")))
    return F.concat_ws("\n\n", _full(title), by, _flat(F.regexp_replace(description, "<[^>]+>", " ")))


def zotero_embed_text(item_type: Column, title: Column, authors: Column, abstract: Column, highlight: Column) -> Column:
    """FN29: an annotation's highlight, else title, authors and abstract."""
    by = F.when(F.size(authors) > 0, F.concat(F.lit("by "), F.array_join(authors, ", ")))
    return (
        F.when(item_type == "annotation", F.trim(F.coalesce(highlight, F.lit(""))))
        .otherwise(F.concat_ws("\n\n", _full(title), by, _full(abstract)))
    )


def youtube_embed_text(title: Column, channel: Column, description: Column, tags: Column) -> Column:
    """FN29: title, channel, description and tags."""
    return F.concat_ws(
        "\n\n",
        _full(title),
        F.concat(F.lit("Channel: "), _full(channel)),
        _full(description),
        F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))),
    )


# ── lenient JSON ─────────────────────────────────────────────────────────────


def lenient(raw: str | None) -> str | None:
    """HP17: the JSON in a reply, without code fences; failing that its first flat object; null if neither parses."""
    body = re.sub(r"(?m)^\s*```(?:json)?\s*|\s*```\s*$", "", raw or "").strip()
    for candidate in (body, *re.findall(r"\{[^{}]*\}", body)[:1]):
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False)
        except ValueError:
            continue
    return None


lenient_json = arrow_function(lenient, "string")


def _entries(raw: str | None) -> list:
    """What a reply lists: its ``books``, a list, one book, or else every flat object in it that can be read."""
    found = lenient(raw)
    data = json.loads(found) if found else None
    if isinstance(data, dict):
        data = data.get("books", [data] if "title" in data else None)
    if isinstance(data, list):
        return data
    return [json.loads(x) for x in map(lenient, re.findall(r"\{[^{}]*\}", raw or "")) if x]


def books(raw: str | None) -> list[dict]:
    """FN35: [{title, authors, isbn}] of a reply; a placeholder for a title drops the book, one for an author the author.

    Authors in one text are told apart at commas, semicolons, ampersands and " and ".
    """
    def said(value) -> str:
        text = " ".join(str(value or "").split()).strip('" ')
        return "" if text.lower() in PLACEHOLDERS else text

    out = []
    for book in _entries(raw):
        book = {"title": book} if isinstance(book, str) else book if isinstance(book, dict) else {}
        people = book.get("authors") or book.get("author") or []
        if isinstance(people, str):
            people = re.split(r",| and |;|&", people)
        number = "".join(c for c in str(book.get("isbn") or "").upper() if c in "0123456789X")
        if title := said(book.get("title")):
            authors = [a for a in map(said, people if isinstance(people, list) else []) if a]
            out.append({"title": title, "authors": authors, "isbn": number if len(number) in (10, 13) else None})
    return out


normalize_books = arrow_function(books, "array<struct<title:string,authors:array<string>,isbn:string>>")
