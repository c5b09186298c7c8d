"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Both sides become token templates: lower-cased words, with numbers (digits or words),
units of measure and names (a capitalised word that doesn't open a sentence) replaced
by typed placeholders.  Windows of SIZE template tokens are hashed and joined; hits of
one item in one document that lie on one diagonal form an occurrence.  A window whose
slots all hold the item's own values counts by itself.  A window with other values
counts only if the occurrence is consistent: each slot value of the item maps to a
single value of the document, and no two names of the item to one name (two numbers
may become equal by chance), so a question asked again with other numbers or names is
caught, while chance agreement of templates is not.  An item is found in a document
where the windows that count cover enough of the item's windows.

A name that opens a sentence keeps its letters, since nothing tells it from another
word there; windows over it match only if it stays.

Plan: benchmark windows are few and counted; up to BROADCAST_ROWS of them the join
is a broadcast, else a shuffled join on the hash.  Document windows of all lengths are
made in one pass next to the scan, and only hits leave it; slots are read from
the tokens of the documents that hit.  A window that many items share is joined
once and expanded on hits only.

Defined cases: null or empty texts and items hold no tokens and never match; items
of MIN_TOKENS to SIZE - 1 tokens use one window of their whole length, shorter ones
take no part; windows with fewer than LITERALS literal tokens take no part (unless
the item has no other); repeated benchmark rows are merged by item_id and text;
repeated documents are reported once for each (doc_id, text); extra columns aren't
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

SIZE = 8
MIN_TOKENS = 5
LITERALS = 4
COVERAGE = 0.25
MIN_WINDOWS = 3
BROADCAST_ROWS = 200_000

# Numbers in words (English, German, French, Spanish; without those that are articles too).
NUMBERS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt trente cent mille "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cien mil"
).split()

# Units of measure that become one placeholder, in the same languages.
UNITS = (
    "kg km cm mm mg ml lb lbs oz mph kmh mi ft gram grams kilogram kilograms kilometer kilometers kilometre kilometres "
    "meter meters metre metres centimeter centimeters mile miles inch inches foot feet yard yards liter liters litre litres "
    "gallon gallons pound pounds ounce ounces ton tons second seconds minute minutes hour hours day days week weeks month "
    "months year years dollar dollars cents euro euros percent degree degrees "
    "gramm kilogramm kilometer zentimeter meile meilen liter pfund tonne tonnen sekunde sekunden minute minuten stunde stunden "
    "tag tage woche wochen monat monate jahr jahre prozent grad "
    "gramme grammes kilogramme kilogrammes kilomètre kilomètres mètre mètres litre litres livre livres tonnes seconde secondes "
    "heure heures jour jours semaine semaines mois an ans année années pourcent degré degrés "
    "gramo gramos kilo kilos kilómetro kilómetros metro metros litro litros libra libras tonelada toneladas segundo segundos "
    "minuto minutos hora horas día días semana semanas mes meses año años dólar dólares grado grados"
).split()

NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
#: A capitalised word after a letter, digit, comma or semicolon and one space.
_NAME = r"(?<=[\p{L}\p{N},;] )(?=\p{Lu}\p{Ll}+(?![\p{L}\p{N}]))"
_TOKEN = "\x01?[\\p{L}\\p{M}\\p{N}]+(?:[.,]\\p{N}+)*"


def tokens(text: Column) -> Column:
    """Lower-cased tokens; a name carries the NAME mark in front."""
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT, "   "), _NAME, NAME)
    return F.regexp_extract_all(F.lower(marked), F.lit(_TOKEN), F.lit(0))


def template(words: Column) -> Column:
    """Tokens with typed placeholders instead of names, numbers and units."""
    one = lambda w: F.when(w.startswith(NAME), NAME).when(F.ascii(w).between(48, 57) | w.isin(NUMBERS), NUMBER).when(w.isin(UNITS), UNIT).otherwise(w)
    return F.transform(words, one)


def _windows(t: Column, n: Column, sizes: list[int]) -> Column:
    """(len, p, h) of each window of template tokens: its length, place from 1 and hash."""
    def of(size: int) -> Column:
        own = lambda i: F.struct(F.lit(size).alias("len"), i.alias("p"), F.xxhash64(F.slice(t, i, size)).alias("h"))
        none = F.array().cast("array<struct<len:int,p:int,h:bigint>>")
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), own)).otherwise(none)

    return F.concat(*map(of, sizes))


def _literals(t: Column, at: Column, size) -> Column:
    return F.size(F.filter(F.slice(t, at, size), lambda w: ~w.isin(NAME, NUMBER, UNIT)))


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, item, j, h, len, n_win, slots): one row for each informative window of each item.

    ``item`` numbers the distinct (item_id, text); slots are (type, value, offset) of the window.
    """
    items = (
        benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
        .distinct()
        .withColumn("item", F.xxhash64(F.col("item_id").cast("string"), "text"))
    )
    items = (
        items.withColumn("w", tokens(F.col("text")))
        .withColumn("t", template(F.col("w")))
        .withColumn("n", F.size("w"))
        .where(F.col("n") >= MIN_TOKENS)
    )
    items = items.withColumn("len", F.least(F.col("n"), F.lit(size)))
    wins = items.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("len") + 1)))
    wins = (
        wins.withColumn("h", F.xxhash64(F.slice("t", F.col("j"), F.col("len"))))
        .withColumn("lit", _literals(F.col("t"), F.col("j"), F.col("len")))
    )
    best = wins.groupBy("item").agg(F.max("lit").alias("best"))
    wins = (
        wins.join(best, "item")
        .where(
            (F.col("lit") >= LITERALS) | (
                (F.col("best") < LITERALS) & (F.col("lit") == F.col("best")) & (F.col("lit") > 0)
            )
        )
    )
    per = wins.groupBy("item").agg(F.count("*").alias("n_win"))
    slot = F.filter(
        F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda k: F.struct(F.element_at("t", F.col("j") + k).alias("kind"), F.element_at("w", F.col("j") + k).alias("value"), k.alias("k"))),
        lambda s: s["kind"].isin(NAME, NUMBER, UNIT),
    )
    return wins.join(per, "item").select("item_id", "item", "j", "h", "len", "n_win", slot.alias("slots"))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = SIZE,
    coverage: float = COVERAGE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, changed, th) for every item found in a document.

    ``changed``: some slot of the item has another value in the document.
    """
    bench = cut(benchmark_windows(benchmark, size))
    keys = bench.select("h", "len").distinct()
    sizes = sorted(r["len"] for r in bench.select("len").distinct().collect())
    if bench.count() <= broadcast_rows:
        bench, keys = F.broadcast(bench), F.broadcast(keys)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = (
        source.withColumn("w", tokens(F.col("text")))
        .select("doc_id", F.xxhash64("text").alias("th"), "w", template(F.col("w")).alias("t"), F.size("w").alias("n"))
    )
    empty = "doc_id %s, item_id %s, n_windows long, item_windows long, coverage double, changed boolean, th long" % (dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"])
    if not sizes:
        return docs.sparkSession.createDataFrame([], empty)
    # Texts that hit are few; their tokens are read again, in place of carrying all tokens along.
    hits = t.select("doc_id", "th", F.explode(_windows(F.col("t"), F.col("n"), sizes)).alias("w")).select("doc_id", "th", "w.*")
    hits = cut(hits.join(keys, ["h", "len"]).select("doc_id", "th", "h", "len", "p").distinct())
    found = cut(
        hits.join(bench, ["h", "len"])
        .withColumn("diag", F.col("p") - F.col("j"))
        .select("doc_id", "th", "item_id", "item", "n_win", "j", "diag", "slots")
    )
    slots = (
        found.where(F.size("slots") > 0)
        .select("doc_id", "th", "item", "diag", "j", F.explode("slots").alias("s"))
        .select(
            "doc_id",
            "th",
            "item",
            "diag",
            "j",
            F.col("s.kind").alias("kind"),
            F.col("s.value").alias("value"),
            (F.col("j") + F.col("s.k") + F.col("diag")).alias("at"),
        )
    )
    need = cut(slots.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct())
    if need.count() <= broadcast_rows:
        need = F.broadcast(need)
    words = (
        source.withColumn("_h", F.xxhash64("text"))
        .join(need, on=[F.col("doc_id").eqNullSafe(F.col("_id")), F.col("_h") == F.col("_th")], how="left_semi")
        .dropDuplicates(["doc_id", "_h"])
        .select(F.col("doc_id").alias("_id"), F.col("_h").alias("_th"), tokens(F.col("text")).alias("w"))
    )
    same = [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("th") == F.col("_th")]
    filled = cut(
        slots.join(words, same)
        .select("doc_id", "th", "item", "diag", "j", "kind", "value", F.element_at("w", F.col("at")).alias("own"))
        .distinct()
    )
    occurrence = ["doc_id", "th", "item", "diag"]
    forward = (
        filled.groupBy(*occurrence, "kind", "value")
        .agg((F.min("own") == F.max("own")).alias("ok"))
        .groupBy(*occurrence)
        .agg(F.bool_and("ok").alias("ok"))
    )
    names = (
        filled.where(F.col("kind") == NAME)
        .groupBy(*occurrence, "own")
        .agg((F.min("value") == F.max("value")).alias("ok"))
        .groupBy(*occurrence)
        .agg(F.bool_and("ok").alias("names_ok"))
    )
    altered = filled.groupBy(*occurrence, "j").agg(F.bool_or(F.col("own") != F.col("value")).alias("changed"))

    def beside(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
        """A left join in which null document ids are equal."""
        side = side.withColumnsRenamed({c: f"_{c}" for c in keys})
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        return rows.join(side, on, "left").drop(*[f"_{c}" for c in keys])

    judged = beside(beside(beside(found, forward, occurrence), names, occurrence), altered, [*occurrence, "j"])
    consistent = F.coalesce("ok", F.lit(True)) & F.coalesce("names_ok", F.lit(True))
    changed = F.coalesce("changed", F.lit(False))
    good = judged.where(~changed | consistent).select("doc_id", "th", "item_id", "item", "n_win", "j", changed.alias("changed"))
    per = (
        good.groupBy("doc_id", "th", "item_id", "item", "n_win")
        .agg(F.countDistinct("j").alias("n"), F.bool_or("changed").alias("changed"))
    )
    share = F.col("n") / F.col("n_win")
    return (
        per.where((share >= coverage) & (F.col("n") >= F.least(F.lit(MIN_WINDOWS), F.col("n_win"))))
        .select(
            "doc_id",
            "item_id",
            F.col("n").alias("n_windows"),
            F.col("n_win").alias("item_windows"),
            share.alias("coverage"),
            "changed",
            "th",
        )
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """``docs`` without the documents that hold an item of the benchmark."""
    id_, th = free_name(docs, "_tessera_id"), free_name(docs, "_tessera_th")
    found = cut(find_leaks(docs, benchmark, broadcast_rows=broadcast_rows, **options).select(F.col("doc_id").alias(id_), F.col("th").alias(th)).distinct())
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(found, on=[F.col("doc_id").eqNullSafe(F.col(id_)), key == F.col(th)], how="left_anti")
