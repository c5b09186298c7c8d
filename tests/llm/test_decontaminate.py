import random
from collections import defaultdict

import regex

from tessera.llm import decontaminate as D
from tessera.llm.decontaminate import drop_leaks, find_leaks

ITEMS = [
    (1, "Anna buys 12 apples for 3 dollars each and sells them on to Boris, so how much does Boris pay for 12 apples?"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (3, "short item of five words"),
    (4, "too short"),
    (5, None),
    (5, None),
    (6, "1 2 3 4 5 6 7 8 9 10"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (7, "When will Anna give Boris 5 of the red pears that she picked, and Boris give Anna 3?"),
]
CLEAN = [
    (100, "nothing to see here, only words that no benchmark item holds in this order at all"),
    (101, "the quick brown fox sleeps under a tree and the lazy dog snores near the bank"),
    (102, None),
    (103, ""),
    (104, "on to Boris so many people pay for the apples that they buy and sell in town each day"),
    (None, "clean text with a null id and a few more words to make windows of eight tokens"),
    # The template agrees but one value of the item, 12, becomes two here.
    (105, "So Clara buys 40 apples for 9 dollars each and sells them on to David, so how much does David pay for 41 apples?"),
    # Two names of the item become one.
    (107, "When will Dora give Dora 6 of the red pears that she picked, and Dora give Dora 4?"),
]
LEAKS = [
    (200, "Before. THE QUICK BROWN FOX jumps!! over!! the LAZY dog near the river bank today and after"),
    (201, "In class Clara asks: Anna buys 50 apples for 7 dollars each and sells them on to Emil, so how much does Emil pay for 50 apples? Done."),
    (202, "Here is a short item of five words in a text"),
    (200, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (None, "x " * 5000 + ITEMS[1][1] + " y" * 5000),
    (203, ITEMS[0][1]),
    # One name of the item, Boris, becomes two; the windows in front of it are the item's own.
    (106, "And Anna buys 12 apples for 3 dollars each and sells them on to Emil, so how much does Fritz pay for 12 apples?"),
    (109, "When will Emil give Dora 6 of the red pears that she picked, and Dora give Emil 4?"),
    # Numbers in words, and two that happen to become equal.
    (108, "So Anna buys twelve apples for twelve dollars each and sells them on to Emil, so how much does Emil pay for twelve apples?"),
]


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, h string")
    return docs, bench, find_leaks(docs, bench, **options)


def test_leaks_are_found_and_clean_texts_left_alone(spark):
    for options in ({}, {"broadcast_rows": 0}):
        _, _, found = run(spark, CLEAN + LEAKS + LEAKS[:1], **options)
        rows = found.collect()
        assert sorted((str(r.doc_id), r.item_id) for r in rows) == sorted([("200", 2), ("200", 2), ("201", 1), ("202", 3), ("None", 2), ("203", 1), ("106", 1), ("108", 1), ("109", 7)])
        assert {r.doc_id for r in rows if r.changed} == {201, 108, 109}


def test_documents_are_dropped(spark):
    docs, bench, _ = run(spark, CLEAN + LEAKS)
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in CLEAN)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(LEAKS, "doc_id long, text string")
    assert find_leaks(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert find_leaks(some, bench).count() == 0
    assert drop_leaks(some, bench).count() == len(LEAKS)


def tokens_of(text):
    marked = regex.sub(D._NAME, D.NAME, (text or "").translate({1: " ", 2: " ", 3: " "}))
    words = regex.findall(D._TOKEN, marked.lower())
    kind = lambda w: D.NAME if w[0] == D.NAME else D.NUMBER if w[0] in "0123456789" or w in D.NUMBERS else D.UNIT if w in D.UNITS else w
    return words, [kind(w) for w in words]


SLOTS = (D.NAME, D.NUMBER, D.UNIT)


def brute(docs, items):
    """The rules of the docstring, window by window."""
    out = set()
    for item_id, text in set(items):
        w, t = tokens_of(text)
        n = min(len(w), D.SIZE)
        if len(w) < D.MIN_TOKENS:
            continue
        literals = {j: sum(x not in SLOTS for x in t[j : j + n]) for j in range(len(w) - n + 1)}
        best = max(literals.values())
        wins = [j for j, k in literals.items() if k >= D.LITERALS or (best < D.LITERALS and k == best > 0)]
        for doc_id, doc in set(docs):
            dw, dt = tokens_of(doc)
            hits = defaultdict(list)
            for j in wins:
                for p in range(len(dt) - n + 1):
                    if dt[p : p + n] == t[j : j + n]:
                        hits[p - j].append(j)
            counted, changed = set(), False
            for diag, js in hits.items():
                slots = {(t[j + k], w[j + k], dw[j + k + diag]) for j in js for k in range(n) if t[j + k] in SLOTS}
                ok = len({(a, b) for a, b, _ in slots}) == len(slots)
                people = {(b, c) for a, b, c in slots if a == D.NAME}
                ok = ok and len({c for _, c in people}) == len(people)
                for j in js:
                    other = any(t[j + k] in SLOTS and w[j + k] != dw[j + k + diag] for k in range(n))
                    if ok or not other:
                        counted.add(j)
                        changed = changed or other
            if counted and len(counted) / len(wins) >= D.COVERAGE and len(counted) >= min(D.MIN_WINDOWS, len(wins)):
                out.add((doc_id, item_id, len(counted), len(wins), changed))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice("the cat sat on a red mat with Bob and Ann, who has 3 or twelve kg of 7.5 apples. Why? Carl".split())
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 6, 12, 30])))) for i in range(12)] + [(3, None), (4, "")]
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(15)] + [(90, None), (91, "")]
    swap = {"Bob": "Ann", "3": "9", "7.5": "8", "Ann,": "Bob,", "Carl": "Dora", "twelve": "12"}
    for i in range(40):
        w = (rnd.choice(items)[1] or "").split()
        rate = rnd.choice([0, 0.1, 1])
        w = [swap.get(x, x) if rnd.random() < rate else x for x in w]
        docs.append((100 + i, " ".join([word(), *w, word()])))
    frame = spark.createDataFrame([*docs, docs[20]], "doc_id long, text string").repartition(3)
    found = find_leaks(frame, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=1000).collect()
    got = {(r.doc_id, r.item_id, r.n_windows, r.item_windows, r.changed) for r in found}
    want = brute(docs, items)
    assert got == want and len(want) > 20 and any(w[4] for w in want)
