import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import divergence
from tessera.llm.divergence import source_divergence, top_values

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_docs, top):
    """The audit from its definition: every group against every other over all kept terms."""
    n, docs, groups = Counter(), Counter(), set()
    for text, lang, source in ((t or "", a or "", b or "") for t, a, b in rows):
        groups.add((lang, source))
        terms = TERM.findall(text.translate(LOWER))
        n.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), held in docs.items():
        if held >= least_docs:
            kept[lang].append(t)
    share = {}
    for lang, source in groups:
        total = sum(n[lang, source, t] for t in kept[lang])
        for t in kept[lang]:
            share[lang, source, t] = 1 + 10**9 * (n[lang, source, t] + 5) // (total + 5 * len(kept[lang]))
    own = lambda lang, t: sum(n[lang, s, t] for a, s in groups if a == lang)
    whole = {(lang, t): 1 + 10**9 * (own(lang, t) + 5) // (sum(own(lang, x) for x in kept[lang]) + 5 * len(kept[lang])) for lang in kept for t in kept[lang]}
    out = set()
    for lang, source in groups:
        pairs = [(sum(abs(share[lang, source, t] - share[lang, s, t]) for t in kept[lang]), s) for a, s in groups if a == lang and s != source]
        terms = [(share[lang, source, t] - whole[lang, t], t) for t in kept[lang] if n[lang, source, t] and share[lang, source, t] > whole[lang, t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.add((lang, source, part, item, v, rank))
    return out


def rows_of(seed):
    draw = random.Random(seed)
    words = ["Alpha", "alpha", "bétä", "Ünder", "x", "ÉCLAIR", "zwei", "日本", "a1b", "under_score", "\U0001f600go", "ｚ"]
    rows = [(" ".join(draw.choices(words, k=draw.randrange(0, 12))) + draw.choice(["", ".", "\x7f!"]), draw.choice(["en", "de", None]), draw.choice(["web", "book", "", None, "Ä"])) for _ in range(60)]
    return rows + [(None, "en", "empty"), ("", None, None), ("solo", "fr", "a"), ("", "fr", "b"), (None, None, "web")] + [("same words here", "en", "web")] * 3


@pytest.mark.parametrize("least_docs,top", [(2, 3), (4, 50), (1000, 5)])
def test_against_brute_force(spark, monkeypatch, least_docs, top):
    monkeypatch.setattr(divergence, "BLOCK", 8)
    rows = rows_of(least_docs)
    docs = spark.createDataFrame([(*r, "taken", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(3)
    got = source_divergence(docs, least_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, least_docs, top)


def test_groups_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUPS", 0)
    rows = rows_of(7)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert {tuple(r) for r in source_divergence(docs, 2, 4).collect()} == brute(rows, 2, 4)


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("wörter und Zahlen 12 " * 300 + "x" * 9000 + " ende").encode()
    want = [w for part in divergence._terms(text) for w in part]
    monkeypatch.setattr(divergence, "SLICE", 7)
    assert [w for part in divergence._terms(text) for w in part] == want and want[-1] == b"ende"


def test_ties_refine_by_bytes(spark):
    draw = random.Random(3)
    rows = {(g, "".join(draw.choices("abÄ日", k=draw.randrange(0, 7)))): draw.choice([5, 5, 5, 700, 2**29 + 3]) for g in ("g", "h", "i") for _ in range(150)}
    rows[("few", "one")] = 4
    frame = spark.createDataFrame([(g, t, v) for (g, t), v in rows.items()], "g string, t string, v long")
    got = {(r.g, r.t, r.v, r.rank) for r in top_values(frame, ["g"], "v", "t", 60, 4).collect()}
    want = set()
    for g in ("g", "h", "i", "few"):
        own = sorted(((v, t) for (a, t), v in rows.items() if a == g), key=lambda x: (-x[0], x[1].encode()))[:60]
        want |= {(g, t, v, i) for i, (v, t) in enumerate(own, 1)}
    assert got == want


def test_empty(spark):
    assert source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
