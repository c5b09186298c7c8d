import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from tessera.llm.url_filter import filter_urls, mine_rules, url_tokens
from tests.conftest import SF

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def judged(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", "", None, None
    host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[2]), m[3]
    fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def mined_by_brute_force(baskets, support, confidence, lift, least):
    n, bad = len(baskets), sum(b for _, b in baskets)
    both, alone = Counter(), Counter()
    for tokens, b in baskets:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                alone[c] += 1
                both[c] += b
    floor = max(-(-support * n // 1), least)
    rules = {c: both[c] / alone[c] for c in alone if both[c] >= floor and both[c] / alone[c] >= max(confidence, lift * bad / n)}
    return {c: v for c, v in rules.items() if not any(set(d) < set(c) and w >= v for d, w in rules.items())}


def test_mining_and_verdicts(spark):
    pages = [(i, f"http{'s' * (i % 2)}://{'spam' if i % 5 == 0 else 'ok'}.Site{i % 7}.com/{'x' if i % 3 else 'y'}/{i}.html?a={i}", 3) for i in range(300)]
    labels = [(i, 0 if i % 5 == 0 and i % 3 else 1, 0) for i in range(200)] + [(0, 1, None), (None, 0, 1), (9999, 0, 0)]
    pages += [(None, None, 1), (301, "no url", 1), (302, "", 1), (303, "http://A.NET", 1), (303, "http://A.NET/", 1), (304, "x://example.net/en/?q#f", 1), (305, "://www.example.com/de/x://y", 1), (306, "a\nb://fr.org/fr/é\n", 1), (307, "http://notexample.com/de/", 1), (308, "http://spam.b.com/x/" + "long/" * 30_000, 1)]
    pages += [(400, "http://spam.site0.com/x/5.html?a=5", 1)] * 50
    p = spark.createDataFrame(pages, "page_id long, url string, host int").repartition(3)
    q = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks = {}
    for i, a, b in labels:
        marks[i] = marks.get(i, 0) or int(a == 0 or b == 1)
    tokens = {r.url: r.t for r in p.select("url", url_tokens(F.col("url")).alias("t")).distinct().collect()}
    baskets = [(tokens[u], marks[i]) for i, u, _ in pages if i in marks and i is not None and tokens[u]]
    for least in (1, 5, 12):
        want = mined_by_brute_force(baskets, 0.02, 0.5, 1.5, least)
        got = {tuple(r.tokens): r.confidence for r in mine_rules(p, q, 0.02, min_count=least).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and got
    want = mined_by_brute_force(baskets, 0.02, 0.5, 1.5, 5)
    rows = filter_urls(p, q, min_support=0.02).collect()
    assert len(rows) == len(pages)
    expected = Counter()
    for i, u, _ in pages:
        host, path, rule, verdict = judged(u)
        expected[(i, host, path, rule, verdict or ("block" if any(set(c) <= set(tokens[u]) for c in want) else "allow"))] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows) == expected


def test_driver_tables_and_empty(spark):
    pages, labels = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert filter_urls(pages, labels).count() == pages.count()
    assert filter_urls(pages.where("false"), labels).count() == 0
    assert {r.verdict for r in filter_urls(pages, labels.where("false")).where("rule is null").collect()} == {"allow"}


def test_tokens_that_say_the_same_do_not_multiply(spark):
    """Twenty tokens that always occur together: the rules are those of one, spelled for each."""
    path = "/".join(f"part{chr(97 + k)}" for k in range(20))
    pages = [(i, f"http://site.com/{path if i % 4 == 0 else 'good'}/p{chr(97 + i % 5)}") for i in range(200)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(200)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    got = [r.tokens for r in mine_rules(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()]
    assert sorted(got) == sorted([f"path:part{chr(97 + k)}"] for k in range(20))
    rows = filter_urls(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.page_id % 4 == 0, r.verdict) for r in rows.collect()} == {(True, "block"), (False, "allow")}
