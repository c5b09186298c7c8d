import json

from pyspark.sql import functions as F

from tessera.functions import records as R


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first().o


def test_doi_records(spark):
    crossref = {"title": ["An &lt;i&gt;odd&lt;/i&gt;\n title"], "DOI": "10.1/AB", "author": [{"given": "A", "family": "B"}, {"name": "Group"}, {}], "abstract": "<jats:title>Abstract</jats:title><jats:p>Text.</jats:p>", "issued": {"date-parts": [[2020, 1]]}, "container-title": ["J"], "type": "x"}
    r = one(spark, R.parse_doi_record, json.dumps(crossref))
    assert (r.doi, r.title, r.authors, r.abstract, r.year, r.container) == ("10.1/ab", "An odd title", ["A B", "Group"], "Text.", 2020, "J")
    r = one(spark, R.parse_doi_record, json.dumps({"title": "Plain", "DOI": "10.2/c"}))
    assert (r.title, r.year, r.authors) == ("Plain", None, [])
    assert one(spark, R.parse_doi_record, "{}") is None and one(spark, R.parse_doi_record, None) is None


def test_preprints(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.1v2</id><title>T\nt</title><summary> S </summary><author><name>A</name></author><author><name>B</name></author><category term="cs.X"/></entry></feed>'
    r = one(spark, R.parse_arxiv_atom, atom)
    assert (r.arxiv_id, r.title, r.authors, r.abstract, r.categories) == ("2101.1", "T t", ["A", "B"], "S", ["cs.X"])
    r = one(spark, R.parse_biorxiv_detail, json.dumps({"collection": [{"title": "T", "abstract": "A", "doi": "10.1101/1"}]}))
    assert (r.doi, r.version, r.authors) == ("10.1101/1", 1, "")
    assert one(spark, R.parse_biorxiv_detail, '{"collection": []}') is None
    xml = "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label='AIM'>one</AbstractText><AbstractText Label='END'>two</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><Initials>I</Initials></Author></AuthorList><Journal><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue></Journal></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/X</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"
    r = one(spark, R.parse_pubmed_xml, xml)
    assert (r.pmid, r.title, r.authors, r.abstract, r.year, r.doi) == ("7", "T", ["L I"], "Aim: one End: two", 2001, "10.1/x")


def test_pages(spark):
    assert tuple(one(spark, R.parse_oembed, '{"title": " V ", "author_name": "C"}')) == ("V", "C") and one(spark, R.parse_oembed, "{}") is None
    thread = [{"data": {"children": [{"kind": "t3", "data": {"title": "T", "subreddit": "s", "is_self": False, "url": "https://x.org"}}]}}, {"data": {"children": [{"kind": "t1", "data": {"author": "a", "body": "hi"}}, {"kind": "t1", "data": {"author": "b", "body": "[deleted]"}}, {"kind": "more", "data": {}}]}}]
    r = one(spark, R.parse_reddit_listing, json.dumps(thread))
    assert (r.title, r.external_url, r.comments) == ("T", "https://x.org", ["hi"])
    assert tuple(one(spark, R.amazon_page, '<title>x</title><span id="productTitle"> A <b>B</b></span><meta name="description" content="d &amp; e">')) == ("A B", "d & e")


def test_compositions(spark):
    q = lambda e: spark.range(1).select(e.alias("o")).first().o
    names = F.array(F.lit("A"), F.lit("B"))
    assert q(R.metadata_text(F.lit("T"), F.lit("<p>d</p>"), names)) == "T\n\nby A, B\n\nd"
    assert q(R.youtube_embed_text(F.lit("T"), F.lit(None).cast("string"), F.lit(" "), names)) == "T\n\nTags: A, B"
    assert q(R.zotero_embed_text(F.lit("annotation"), F.lit("T"), names, F.lit("a"), F.lit(" h "))) == "h"
    assert q(R.preprint_text(F.lit("T"), names, F.lit("abs"), F.lit("abs and more"))) == "T\n\nby A, B\n\nabs"
    assert q(R.preprint_text(F.lit("T"), names, F.lit("abs"), F.lit("body"))).endswith("abs\n\nbody")
    r = q(R.reddit_detail(F.lit("t3_ab"), F.lit("https://x.org"), F.lit(None).cast("string"), F.array(F.lit("r/sub"))))
    assert tuple(r) == ("post", "sub", "https://www.reddit.com/comments/ab", "https://x.org")


def test_lenient_json():
    assert R.lenient('```json\n{"a": 1}\n```') == '{"a": 1}' and R.lenient("no") is None
    assert R.books('{"books": [{"title": " A  b", "author": "X", "isbn": "978-0-306-40615-7"}, {"authors": "y"}, "C"]}') == [{"title": "A b", "authors": ["X"], "isbn": "9780306406157"}, {"title": "C", "authors": [], "isbn": None}]
    assert R.books('[{"title": "A", "isbn": "1"}, {"title": "B"') == [{"title": "A", "authors": [], "isbn": None}] and R.books(None) == []
