"""Map-reduce summaries around a leaf that a deployment brings (RC4), and re-embedding (RC3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import arrow_function
from ..functions.text import chunks
from .graph import cut
from .learn import label_matrix, train
from .vectors import mean_vectors

#: Characters that one call of the leaf gets; summaries that one call joins at most.
LIMIT, FAN = 12_000, 24


def _cut(limit: int):
    """A text in pieces of at most ``limit`` characters: at paragraphs, sentences, words, and inside a longer word."""

    def cut_(text: str) -> list[str]:
        return [piece[i : i + limit] for piece in chunks(text, limit, 0, 1, len) for i in range(0, len(piece), limit)]

    return arrow_function(cut_, "array<string>")


def summarize(texts: DataFrame, leaf: Callable[[Column], Column], limit: int = LIMIT, most: int = FAN, depth: int | None = None) -> DataFrame:
    """RC4: (document_id, summary) of texts (document_id, text); null where the leaf gives nothing.

    ``leaf`` is a column function from a text to its summary.  A text over the limit is cut at
    sentences into pieces, all of which reach the leaf.  Then, in rounds, neighbouring
    summaries of a document are numbered and joined, as many as the limit and ``most`` (two
    at least) allow, and summarised again, until one row is left for each document.  A row is keyed by (document, slot);
    a text of any length is a tree, and no call gets more than the limit.  So that every round
    at least halves a document's rows, a summary over half the limit is cut to half, less the
    room of its number, when it is joined.

    Pieces without a summary are left out; a single surviving one is the summary.  With
    ``depth``, after so many rounds what is left of a document is joined in one call, however
    long; with 0 every text goes to the leaf as it is.
    """
    said = lambda t: F.nullif(F.trim(leaf(t)), F.lit(""))
    rows = texts.select("document_id", "text")
    if depth == 0:
        return rows.select("document_id", said(F.col("text")).alias("summary"))
    long = F.coalesce(F.length("text") > limit, F.lit(False))
    done = rows.where(~long).select("document_id", said(F.col("text")).alias("summary"))
    pieces = rows.where(long).select("document_id", F.posexplode_outer(_cut(limit)(F.col("text"))).alias("slot", "text"))
    level = cut(pieces.select("document_id", "slot", said(F.col("text")).alias("said")))
    lost = level.groupBy("document_id").agg(F.max("said").alias("summary")).where("summary is null")
    done, level = done.unionByName(lost), level.where("said is not null")
    own = Window.partitionBy("document_id")
    at = own.orderBy("slot")
    turn = 0
    while True:
        level = cut(level.withColumn("n", F.count("*").over(own)))
        done = done.unionByName(level.where("n = 1").select("document_id", F.col("said").alias("summary")))
        level = level.where("n > 1")
        if level.isEmpty():
            return done
        turn += 1
        last = depth is not None and turn >= depth
        room = limit // 2 - 8
        part = F.col("said") if last else F.substring("said", 1, max(1, room))
        sized = level.select("document_id", "slot", part.alias("said"), F.row_number().over(at).alias("place"))
        # as many to a slot as fit if all were as long as the document's longest, with number, dot and line end
        fits = F.floor(F.lit(limit) / (F.max(F.length("said")).over(own) + 8))
        fan = F.greatest(F.lit(2), F.least(F.lit(most), fits))
        placed = sized.withColumn("above", F.lit(0).cast("long") if last else F.floor((F.col("place") - 1) / fan))
        numbered = F.row_number().over(Window.partitionBy("document_id", "above").orderBy("slot"))
        line = F.struct("slot", F.concat(numbered.cast("string"), F.lit(". "), F.col("said")).alias("line"))
        lines = placed.withColumn("line", line).groupBy("document_id", "above").agg(F.array_sort(F.collect_list("line")).alias("lines"))
        text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
        told = cut(lines.select("document_id", F.col("above").alias("slot"), said(text).alias("said")))
        lost = told.groupBy("document_id").agg(F.max("said").alias("summary")).where("summary is null")
        done, level = done.unionByName(lost), told.where("said is not null")


def reembed(
    chunk_vectors: DataFrame, sessions: DataFrame, labels: DataFrame
) -> tuple[DataFrame, list[tuple[int, list[float], float]], list[int]]:
    """RC3: what follows new chunk vectors (document_id, embedding).

    The documents' means; a model (session_id, weights, intercept) for every accepted
    session whose labels (session_id, document_id, label, source) still have both classes;
    and the sessions that lose theirs.  Sessions are few, one for each learned tag.
    """
    means = cut(mean_vectors(chunk_vectors, "document_id"))
    models, dropped = [], []
    for r in sessions.where("status = 'accepted'").select("session_id").orderBy("session_id").collect():
        own = labels.where(F.col("session_id") == r["session_id"]).drop("session_id")
        try:
            weights, intercept, _ = train(label_matrix(own, means))
            models.append((r["session_id"], weights, intercept))
        except ValueError:
            dropped.append(r["session_id"])
    return means, models, dropped
