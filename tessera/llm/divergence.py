"""Source divergence audit: how the words of each source of a language differ from the others'.

Terms are runs of letters (ASCII letters in lower case, and every character beyond
ASCII).  A language keeps the terms that at least ``least_docs`` of its documents hold;
a group (language, source) and the language itself give each kept term the smoothed share
p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)).

Pairs.  Most terms are missing in most groups and have the group's baseline there, the
share of count 0.  With d the difference of two baselines, the sum of |p - q| over all
kept terms is V * d, plus for each group the sum over its own terms of |p - other
baseline| - d (from its histogram of shares, so a row for each distinct share), plus for
the terms that both hold |p - q| - |p - baseline| - |baseline - q| + d.  The last part is
summed by blocks of terms, as matrices, without a row for each pair of a term.

Ranks.  The ``top`` terms of a group come from a radix selection: histograms of ten bits
of the value at a time give each group's threshold, and where more terms tie at it than
are wanted, histograms of two bytes of the UTF-8 text at a time.  No group is ever
gathered; what is sorted at the end is at most ``top`` rows a group.

Plan: tasks count terms before the one shuffle of counts, by (language, term), which also
serves the document frequencies; the table of groups is broadcast up to ``GROUPS`` rows and
joined by shuffles beyond.

Defined cases: null text, lang and source count as ''; a group without terms has count 0
everywhere; a language without kept terms has pairs of value 0; repeated rows count twice;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE, PRIOR, LEAST_DOCS, TOP = 1_000_000_000, 5, 30, 50
#: Groups that are broadcast at most.
GROUPS = 100_000
#: Entries that a task holds before it hands its counts on; bytes of a text that are split at once.
HELD, SLICE = 1 << 19, 1 << 20
#: Rows of a block of terms; shares that a tile of a block compares at once.
BLOCK, TILE = 1 << 13, 1 << 21
#: Shares are below 2**BITS; each round of the selection looks at STEP bits.
BITS, STEP = 30, 10

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: bytes):
    """The terms of a text, those of a bounded part at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        part = text[at:end].translate(_TABLE)
        while end < len(text) and part[-1] != 32:
            more = text[end : end + 4096].translate(_TABLE)
            stop = more.find(b" ") + 1 or len(more)
            part, end = part + more[:stop], end + stop
        yield part.split()
        at = end


def _count(batches):
    """Occurrences and documents of each term by (lang, source), summed over what one task reads."""
    n, docs = defaultdict(Counter), defaultdict(Counter)

    def flush():
        for (lang, source), own in n.items():
            words = list(own)
            held = docs[lang, source]
            for i in range(0, len(words), 1 << 16):
                part = words[i : i + (1 << 16)]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(part), pa.string()),
                    "source": pa.array([source] * len(part), pa.string()),
                    "term": pa.array(part, pa.binary()),
                    "n": pa.array([own[w] for w in part], pa.int64()),
                    "docs": pa.array([held[w] for w in part], pa.int64()),
                })
        n.clear()
        docs.clear()

    for batch in batches:
        for text, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
            own: set[bytes] = set()
            for words in _terms(text):
                n[lang, source].update(words)
                own.update(words)
            docs[lang, source].update(own)
        if sum(map(len, n.values())) > HELD:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n (in the group), total (in the language) and opens (true once for each kept term of a language)."""
    filled = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    raw = filled.withColumn("text", F.col("text").cast("binary")).mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    dealt = raw.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    grouped = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    wide = grouped.withColumns({"in_docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "first": F.min("source").over(term)})
    return wide.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "total", (F.col("first") == F.col("source")).alias("opens"))


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exact for counts of any size."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * ({count} + {PRIOR})) div nullif({total} + {PRIOR} * {kept}, 0)")


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= GROUPS else table


def _common(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Of the terms of a block that two groups hold: |p - q| - |p - base_q| - |base_p - q| + |base_p - base_q| by pair of groups."""
    t = t.sort_by([("term", "ascending"), ("source", "ascending")]).combine_chunks()
    names = t.column("source").combine_chunks().dictionary_encode()
    sources = sorted(names.dictionary.to_pylist(), key=str.encode)
    place = {s: i for i, s in enumerate(sources)}
    source = np.array([place[s] for s in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    p, base = t.column("p").to_numpy(), t.column("base").to_numpy()
    terms = t.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.diff(terms, prepend=-1))
    sizes = np.diff(np.append(starts, len(terms)))
    total = np.zeros(len(sources) ** 2 if len(sources) < 2048 else 0, np.int64)
    spread: dict[int, int] = {}

    def add(a, b, v):
        at = np.minimum(a, b) * len(sources) + np.maximum(a, b)
        if len(total):
            np.add.at(total, at, v)
        else:
            keys, turn = np.unique(at, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, turn, v)
            for k, s in zip(keys.tolist(), sums.tolist()):
                spread[k] = spread.get(k, 0) + s

    for m in np.unique(sizes):
        if m < 2:
            continue
        rows = starts[sizes == m][:, None] + np.arange(m)
        step = max(1, TILE // int(m))
        for i in range(0, len(rows), step):
            s, x, y = (c[rows[i : i + step]] for c in (source, p, base))
            for gap in range(1, int(m)):  # a term's groups against those ``gap`` places behind
                x1, x2, y1, y2 = x[:, :-gap], x[:, gap:], y[:, :-gap], y[:, gap:]
                add(s[:, :-gap].ravel(), s[:, gap:].ravel(), (abs(x1 - x2) - abs(x1 - y2) - abs(y1 - x2) + abs(y1 - y2)).ravel())
    at = np.flatnonzero(total) if len(total) else np.array(sorted(spread), np.int64)
    value = total[at] if len(total) else np.array([spread[k] for k in at.tolist()], np.int64)
    return pa.table({
        "lang": pa.array([key[0].as_py()] * len(at), pa.string()),
        "a": pa.array([sources[i] for i in at // max(1, len(sources))], pa.string()),
        "b": pa.array([sources[i] for i in at % max(1, len(sources))], pa.string()),
        "v": pa.array(value, pa.int64()),
    })


def pair_divergence(terms: DataFrame, groups: DataFrame, n_groups: int, blocks: int) -> DataFrame:
    """lang, a, b (a before b) and v, the sum of |p - q| over the language's kept terms, for all pairs of its groups.

    ``terms``: lang, source, term, p, base; ``groups``: lang, source, base (null without kept terms), kept.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"), "kept")
    gap = F.abs(F.col("base") - F.col("other_base"))
    both = groups.select("lang", "source", "base").join(_small(other, n_groups), "lang").where("source < item")
    start = both.select("lang", F.col("source").alias("a"), F.col("item").alias("b"), F.coalesce(F.col("kept") * gap, F.lit(0)).alias("v"))
    shares = terms.groupBy("lang", "source", "p", "base").agg(F.count("*").alias("k"))
    own = shares.join(_small(other, n_groups), "lang").where("source <> item").select(
        "lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"),
        (F.col("k") * (F.abs(F.col("p") - F.col("other_base")) - gap)).alias("v"),
    )
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block")
    common = terms.select("lang", block, "source", "term", "p", "base").groupBy("lang", "block").applyInArrow(_common, "lang string, a string, b string, v long")
    return start.unionByName(own).unionByName(common).groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))


def top_values(rows: DataFrame, keys: list[str], value: str, item: str, top: int, n_groups: int, bits: int = BITS, step: int = STEP) -> DataFrame:
    """The ``top`` rows of each group by value (largest first) and item (UTF-8 ascending), with their rank; items of a group differ.

    ``value`` is below 2**bits, ``bits`` a multiple of ``step``.
    """
    rows = rows.select(*keys, value, item)
    best = Window.partitionBy(*keys)
    #: prefix: the leading bits of each group's threshold so far; need: rows wanted among those that share them.
    bound = None
    for shift in range(bits - step, -1, -step):
        open_ = rows.withColumn("digit", F.shiftright(value, shift))
        if bound is not None:
            open_ = open_.join(_small(bound, n_groups), keys).where(F.shiftright("digit", step) == F.col("prefix"))
        else:
            open_ = open_.withColumn("need", F.lit(top).cast("long"))
        histogram = open_.groupBy(*keys, "digit", "need").agg(F.count("*").alias("n"))
        above = F.sum("n").over(best.orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, -1))
        found = histogram.withColumn("above", F.coalesce(above, F.lit(0))).where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
        bound = cut(found.select(*keys, F.col("digit").alias("prefix"), (F.col("need") - F.col("above")).alias("need"), "n"))
    # a group of fewer rows has no threshold: all of it stays
    marked = rows.join(_small(bound.select(*keys, "prefix", "need"), n_groups), keys, "left")
    kept = marked.where(F.col("prefix").isNull() | (F.col(value) > F.col("prefix"))).select(*keys, value, item)
    ties = cut(marked.where(F.col(value) == F.col("prefix")).select(*keys, value, item, "need"))
    at = 1
    while True:
        digit = F.hex(F.substring(F.col(item).cast("binary"), at, 2))
        histogram = ties.groupBy(*keys, F.col("need").alias("want"), digit.alias("cut")).agg(F.count("*").alias("n"))
        before = F.sum("n").over(best.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1))
        found = histogram.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") < F.col("want")) & (F.col("before") + F.col("n") >= F.col("want")))
        found = cut(found.select(*keys, "cut", (F.col("want") - F.col("before")).alias("left"), "n"))
        split = ties.join(_small(found, n_groups), keys)
        kept = kept.unionByName(split.where((digit < F.col("cut")) | ((digit == F.col("cut")) & (F.col("n") == F.col("left")))).select(*keys, value, item))
        if found.where("n > left").isEmpty():
            break
        ties = cut(split.where((digit == F.col("cut")) & (F.col("n") > F.col("left"))).select(*keys, value, item, F.col("left").alias("need")))
        at += 2
    return kept.withColumn("rank", F.row_number().over(best.orderBy(F.desc(value), item)))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank, as the module says."""
    terms = cut(term_counts(docs, least_docs))
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    by_group = terms.groupBy("lang", "source").agg(F.sum("n").alias("in_group"), F.count_if("opens").alias("opened"))
    sums = by_group.groupBy("lang").agg(F.sum("in_group").alias("in_lang"), F.sum("opened").alias("kept"))
    groups = named.join(by_group.drop("opened"), ["lang", "source"], "left").join(sums, "lang", "left").na.fill(0, ["in_group", "in_lang", "kept"])
    groups = cut(groups.withColumn("zero", F.lit(0)).select("lang", "source", "in_group", "in_lang", "kept", _share("zero", "in_group", "kept").alias("base")))
    n_groups, n_terms = groups.count(), terms.count()
    shares = terms.join(_small(groups, n_groups), ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "in_group", "kept").alias("p"), _share("total", "in_lang", "kept").alias("q"), "base"
    )
    pairs = pair_divergence(shares, groups, n_groups, max(1, n_terms // BLOCK))
    turned = pairs.select("lang", F.explode(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")))).alias("side"), F.col("v").alias("value"))
    ranked = turned.select("lang", "side.*", "value").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    risen = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = top_values(risen, ["lang", "source"], "value", "item", top, n_groups)
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(ranked, "pair").unionByName(columns(best, "term"))
