import math
import re
from collections import Counter

import pytest

from tessera.operators import sentences as S

PEOPLE = ["Smith", "Jones", "Weber", "Lopez", "Martin", "Rossi", "Keller", "Brandt"]
TEXTS = (
    [f"Then we met Dr. {p} near the old mill. He knew the river well. The boat was late, and the wind rose." for p in PEOPLE * 3]
    + [f"Wir sahen z.B. {p} am Ufer. Er kannte den Fluss. Am {i}. Mai kam das Boot." for i, p in enumerate(PEOPLE * 3, 3)]
    + [f"Hier soir Mme. {p} est partie. Elle connaissait la rive. Le vent montait, et elle riait." for p in PEOPLE * 3]
    # words that close the sentences above also stand inside others, as they do in any larger corpus
    + ["Near the mill the river rose well over the bank, late in the year."] * 6
    + ["Das Boot lag im Fluss und am Ufer, als wir kamen."] * 6
    + ["La rive est loin, et partie remise riait encore."] * 6
    + ["El mar es fuerte y el puente viejo."] * 6
    + [f"Ayer vimos a la Sra. {p} en el puente. Ella conoce el mar. El barco no vino, y el viento era fuerte." for p in PEOPLE * 3]
)


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS] + [(None,), ("",)], "body string").repartition(5)
    return S.train(rows)


def cases(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string").repartition(3)
    return {r.id: r.sentences for r in S.split(rows, model).collect()}


def test_abbreviations_of_four_languages_are_learnt(model):
    found = {r.type for r in model.abbreviations.collect()}
    assert {"dr", "z.b", "mme", "sra"} <= found
    assert not found & {"river", "mill", "well", "rose", "boot", "fluss", "mar", "rive"}
    assert ("##", "mai") in {(r.first, r.second) for r in model.collocations.collect()}


def test_scores_equal_the_formula(spark, model):
    words = [w for t in TEXTS for w in t.split()]
    types = Counter()
    ends = Counter()
    for w in words:
        core = re.sub(r"[.,]+$", "", w).lower()
        types[core] += 1
        ends[core] += w.endswith(".")
    n, p = len(words), sum(ends.values()) / len(words)
    got = {r.type: r.score for r in model.abbreviations.collect()}
    for t, score in got.items():
        k, rest, dots = ends[t], types[t] - ends[t], t.count(".")
        ratio = 2 * (k * math.log(0.99) + rest * math.log(0.01) - k * math.log(p) - rest * math.log(1 - p))
        size = len(t) - dots
        assert n and score == pytest.approx(ratio * math.exp(-size) * (dots + 1) * size**-rest)


def test_sentences(spark, model):
    texts = [
        "Ask Dr. Smith about it. He knows.",
        "It costs 3.5 million. That is a lot.",
        "Llegó tarde. ¿Qué pasó después? Nadie lo sabe.",
        "Il est parti. Été comme hiver, il revient.",
        "Il a dit non. « Pourquoi ? » demanda-t-elle.",
        "Am 7. Mai kam z.B. Brandt. Er ging.",
        "She saw the Dr. The boat was late.",
        "A first line\n\nand a second  one. (Then more.) J. Smith left!",
        "",
        None,
        " \n\n ",
    ]
    got = cases(spark, model, texts)
    assert got == {
        0: ["Ask Dr. Smith about it.", "He knows."],
        1: ["It costs 3.5 million.", "That is a lot."],
        2: ["Llegó tarde.", "¿Qué pasó después?", "Nadie lo sabe."],
        3: ["Il est parti.", "Été comme hiver, il revient."],
        4: ["Il a dit non.", "« Pourquoi ? » demanda-t-elle."],
        5: ["Am 7. Mai kam z.B. Brandt.", "Er ging."],
        6: ["She saw the Dr.", "The boat was late."],
        7: ["A first line", "and a second one.", "(Then more.)", "J. Smith left!"],
        8: [],
        9: [],
        10: [],
    }


def test_every_word_stays_and_repeated_rows_are_rows(spark, model):
    rows = spark.createDataFrame([(1, t) for t in TEXTS + [TEXTS[0]]], "id long, body string")
    got = sorted(" ".join(r.sentences) for r in S.split(rows, model).collect())
    assert got == sorted(" ".join(t.split()) for t in TEXTS + [TEXTS[0]])


def test_an_empty_corpus_teaches_nothing(spark):
    none = S.train(spark.createDataFrame([], "body string"))
    assert none.abbreviations.isEmpty() and none.openers.isEmpty() and none.collocations.isEmpty()
    assert cases(spark, none, ["One. Two. three."]) == {0: ["One.", "Two. three."]}


def test_types_are_counted_as_pairs_count_them(spark):
    """Abbreviations from distinct tokens are those from all pairs."""
    from tessera.operators import sentences as S

    texts = ["Dr. Dr. Abt. (Abt. 3.5) ends. \"Abt.\" abt, a.b. \n\n  ¶ x.  ", "", None, " Abt. No. 12, no! No? Straße. ZZ.\tq. r."] * 5
    rows = spark.createDataFrame([(t,) for t in texts], "body string")
    own = S.type_counts(rows)
    assert own.columns == ["type", "period", "n"]
    whole = S.counts(rows).groupBy("type", "period").agg(S.F.sum("n").alias("n"))
    as_set = lambda t: {tuple(r) for r in t.collect()}
    assert as_set(own) == as_set(whole) and own.count() == whole.count()
    assert as_set(S.abbreviations(own)) == as_set(S.abbreviations(S.counts(rows))) != set()
