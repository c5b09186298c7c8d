"""Sentences by a model that a corpus teaches without labels (FN3).

Three things are learnt from counts alone, after the published method for unsupervised sentence
boundary detection (Kiss and Strunk, 2006):

* abbreviations: types that keep a final period far more often than chance has it, weighed by
  their length, inner periods and occurrences without a period;
* openers: words that follow a sure end far more often than chance has it, or that occur in
  lower case and have a capital behind an end only;
* collocations: pairs across a period that belong together (a number and a month).

A short word that a corpus has before periods only counts as an abbreviation, whatever it is;
in a corpus of some size words also stand inside sentences, which the weights tell.

All counts come from one aggregate over the tokens, (what stood in front, if it ended in a
mark; the type; its period; its capital), so a text is read once and the tables grow with the
vocabulary.  The model is three small tables; applying it joins the candidates of a text to
them, and Spark broadcasts them where their measured size allows.

Tokens are runs without white space.  A blank line ends a sentence.  Sentences come back with
single blanks inside; null and empty texts have none; equal ids with the same text count as
rows of their own.  A capital, a digit or an opening quote has to follow an end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

_OPEN, _CLOSE = "[\"'“„‘(\\[«¿¡]", "[\"'”“’)\\]»]"
_BREAK = "¶"
#: Fixed values of the published method: thresholds of abbreviations, openers and collocations.
ABBREVIATION, OPENER, COLLOCATION = 0.3, 30.0, 7.88


@dataclass
class Model:
    """(type, score), (type), (first, second): abbreviations, openers and collocations."""

    abbreviations: DataFrame
    openers: DataFrame
    collocations: DataFrame


def tokens(text: Column) -> Column:
    """Runs without white space; blank lines and the start of the text as a mark of their own."""
    whole = F.concat(F.lit(f"{_BREAK} "), F.regexp_replace(text, r"\n[\x20\x09-\x0D]*\n", f" {_BREAK} "))
    return F.regexp_extract_all(whole, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def mark(token: Column) -> Column:
    """The marks that a token ends with, '' for none; ¶ for a blank line."""
    return F.when(token == _BREAK, _BREAK).otherwise(F.regexp_extract(token, f"([.!?…]+){_CLOSE}*$", 1))


def kind(token: Column) -> Column:
    """A token's type: lower case without quotes, brackets and marks around it; ## for numbers."""
    return _numbers(_core(token))


def _core(token: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(token, f"^{_OPEN}+", ""), f"([.!?…]+{_CLOSE}*|[,;:]|{_CLOSE})+$", ""))


def _numbers(core: Column) -> Column:
    return F.when(core.rlike(r"^[0-9][0-9.,]*$"), "##").otherwise(core)


def capital(token: Column) -> Column:
    """Whether a sentence may open with the token."""
    return token.rlike(f"^{_OPEN}*[\\p{{Lu}}\\p{{N}}]") | token.rlike(f"^{_OPEN}+$")


def counts(texts: DataFrame) -> DataFrame:
    """(before, end, type, period, capital, lower, n) over (body): tokens by what ended in front of them."""
    t = texts.select(tokens(F.coalesce("body", F.lit(""))).alias("a"))
    pairs = t.select(F.explode(F.arrays_zip("a", F.slice("a", 2, 2**31 - 1).alias("b"))).alias("p")).select("p.a", "p.b")
    end = mark(F.col("a"))
    own = pairs.where(F.col("b").isNotNull() & (F.col("b") != _BREAK)).select(
        F.when(end == ".", kind(F.col("a"))).otherwise("").alias("before"),
        end.alias("end"),
        kind(F.col("b")).alias("type"),
        (mark(F.col("b")) == ".").alias("period"),
        capital(F.col("b")).alias("capital"),
        F.col("b").rlike(f"^{_OPEN}*\\p{{Ll}}").alias("lower"),
    )
    return own.groupBy(*own.columns).agg(F.count("*").alias("n"))


def type_counts(texts: DataFrame) -> DataFrame:
    """(type, period, n) over (body), as ``abbreviations`` reads them: equal tokens are counted before any is looked at."""
    words = F.split(F.regexp_replace(F.coalesce("body", F.lit("")), r"\n[\x20\x09-\x0D]*\n", f" {_BREAK} "), r"[\x20\x09-\x0D]+")
    own = texts.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(~F.col("w").isin("", _BREAK))
    typed = own.select(_core(F.col("w")).alias("core"), (mark(F.col("w")) == ".").alias("period"), "n")
    return typed.select(_numbers(F.col("core")).alias("type"), "period", "n").groupBy("type", "period").agg(F.sum("n").alias("n"))


def _ll(k: Column, n: Column, p: Column) -> Column:
    """Log likelihood of k hits in n draws of chance p; what has no draws says nothing."""
    safe = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return k * F.ln(safe) + (n - k) * F.ln(1 - safe)


def association(both: Column, first: Column, second: Column, total: Column) -> Column:
    """How much more often ``second`` follows ``first`` than without it: a log likelihood ratio."""
    p, p1, p2 = second / total, both / first, (second - both) / F.greatest(F.lit(1), total - first)
    return 2 * (_ll(both, first, p1) + _ll(second - both, total - first, p2) - _ll(both, first, p) - _ll(second - both, total - first, p))


def abbreviations(table: DataFrame) -> DataFrame:
    """(type, with_period, without, score) of the types that count as abbreviations."""
    word = F.col("type").rlike(r"\p{L}")
    by = table.groupBy("type").agg(F.sum(F.when(F.col("period"), F.col("n")).otherwise(0)).alias("with_period"), F.sum("n").alias("all"))
    by = written(by)  # read twice
    total = by.agg(F.sum("all").alias("tokens"), F.sum("with_period").alias("periods"))
    own = by.where(word & (F.col("with_period") > 0)).crossJoin(F.broadcast(total))  # one row of totals
    inner = F.length("type") - F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    letters = (F.length("type") - inner).cast("double")
    k, n = F.col("with_period"), F.col("all")
    ratio = 2 * (_ll(k, n, F.lit(0.99)) - _ll(k, n, F.col("periods") / F.col("tokens")))
    score = ratio * F.exp(-letters) * (inner + 1) * F.exp(-(n - k) * F.ln(letters))
    found = own.select("type", "with_period", (n - k).alias("without"), score.alias("score"))
    return found.where(F.col("score") >= ABBREVIATION)


def _initial(c: Column) -> Column:
    return c.rlike(r"^\p{L}$")


def train(texts: DataFrame) -> Model:
    """The model that (body) teaches; an empty table teaches nothing."""
    table = written(counts(texts))
    short = written(abbreviations(table).select("type", "score"))
    per = table.groupBy("type").agg(
        F.sum("n").alias("all"),
        F.sum(F.when(F.col("lower"), F.col("n")).otherwise(0)).alias("small"),
        F.sum(F.when(F.col("capital") & (F.col("end") == ""), F.col("n")).otherwise(0)).alias("inside"),
    )
    # sure ends: marks behind what is no abbreviation, initial or number
    known = short.select(F.col("type").alias("before"), F.lit(True).alias("short"))
    behind = table.where("end <> ''").join(known, "before", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    sure = behind.where(F.col("end").isin("!", "?", _BREAK) | ((F.col("end") == ".") & ~F.col("short") & ~_initial(F.col("before")) & (F.col("before") != "##")))
    totals = F.broadcast(table.agg(F.sum("n").alias("tokens")).crossJoin(sure.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ends"))))  # one row
    word = F.col("type").rlike(r"\p{L}")
    follow = sure.groupBy("type").agg(F.sum("n").alias("both"))
    often = per.join(follow, "type", "left").na.fill({"both": 0}).crossJoin(totals).where(word)
    rate = association(F.col("both"), F.col("ends"), F.col("all"), F.col("tokens"))
    lift = F.col("both") * F.col("tokens") > F.col("all") * F.col("ends")
    openers = often.where(((F.col("both") > 0) & lift & (rate >= OPENER)) | ((F.col("small") > 0) & (F.col("inside") == 0))).select("type")
    # pairs across a period of what may not be an end
    loose = behind.where((F.col("end") == ".") & (F.col("short") | _initial(F.col("before")) | (F.col("before") == "##")) & word)
    pair = loose.groupBy(F.col("before").alias("first"), F.col("type").alias("second")).agg(F.sum("n").alias("both"))
    size = per.select(F.col("type"), F.col("all"))
    pair = pair.join(size.toDF("first", "n1"), "first").join(size.toDF("second", "n2"), "second").crossJoin(totals)
    more = (F.col("both") > 1) & (F.col("both") * F.col("tokens") > F.col("n1") * F.col("n2"))
    tied = pair.where(more & (association(F.col("both"), F.greatest("n1", "both"), F.greatest("n2", "both"), F.col("tokens")) >= COLLOCATION))
    return Model(short, written(openers), written(tied.select("first", "second")))


def split(texts: DataFrame, model: Model) -> DataFrame:
    """(columns of ``texts``, sentences): the sentences of each ``body``; the columns _row, _tokens and _cuts are taken.

    Only ends that need the model leave their text: a period with a capital behind it.
    """
    rows = written(texts.withColumn("_row", F.monotonically_increasing_id()))
    t = rows.select("_row", tokens(F.coalesce("body", F.lit(""))).alias("_tokens"))
    at = t.select("_row", F.posexplode(F.arrays_zip(F.col("_tokens").alias("a"), F.slice("_tokens", 2, 2**31 - 1).alias("b")))).select(
        "_row", (F.col("pos") + 1).alias("at"), F.col("col.a").alias("a"), F.col("col.b").alias("b")
    )
    end = mark(F.col("a"))
    found = at.select("_row", "at", end.alias("end"), kind(F.col("a")).alias("first"), kind(F.col("b")).alias("second"), (capital(F.col("b")) | (F.col("b") == _BREAK) | F.col("b").isNull()).alias("open"), (F.col("b") == _BREAK).alias("blank"))
    found = found.where(((F.col("end") != "") & F.col("open")) | F.col("blank"))
    flag = lambda table, *names: table.toDF(*names).distinct().withColumn(f"_{names[-1]}_known", F.lit(True))
    found = found.join(flag(model.abbreviations.select("type"), "first"), "first", "left")
    found = found.join(flag(model.openers, "second"), "second", "left")
    found = found.join(model.collocations.distinct().withColumn("tied", F.lit(True)), ["first", "second"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    loose = yes("_first_known") | _initial(F.col("first"))
    stays = (F.col("end") == ".") & ~F.coalesce("blank", F.lit(False)) & (yes("tied") | (loose & ~yes("_second_known")))
    cuts = found.where(~stays).groupBy("_row").agg(F.array_sort(F.collect_list("at")).alias("_cuts"))
    last = F.size("_tokens")
    ends = F.array_distinct(F.concat(F.coalesce("_cuts", F.array().cast("array<int>")), F.array(last)))
    spans = F.transform(ends, lambda e, i: F.slice("_tokens", F.when(i == 0, 1).otherwise(F.get(ends, i - 1) + 1), e - F.when(i == 0, 0).otherwise(F.get(ends, i - 1))))
    said = F.transform(spans, lambda s: F.array_join(F.filter(s, lambda w: w != _BREAK), " "))
    out = t.join(cuts, "_row", "left").select("_row", F.filter(said, lambda s: s != "").alias("sentences"))
    return rows.join(out, "_row").drop("_row")
