"""Writers as pure functions from tables to tables (SK1-12, SK14-16, EN1, HP20-21).

Parquet has no MERGE; each function returns the table as it is after the write,
which a caller puts in a new path (``sinks`` below).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that an upsert overwrites; of all others the incoming value wins only if it isn't null.
OVERWRITE = ("title", "url_or_path", "fetch_status")
#: Columns that keep their stored value.
KEEP = ("ingested_at",)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], overwrite: tuple = OVERWRITE, keep: tuple = KEEP) -> DataFrame:
    """SK1: a row for each key, under the column policy; the last incoming row of a key counts."""
    s, i = stored.alias("s"), incoming.dropDuplicates(keys).alias("i")
    on = [F.col(f"s.{k}") == F.col(f"i.{k}") for k in keys]
    met = F.col(f"i.{keys[0]}").isNotNull()

    def value(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(f"s.{c}").alias(c)
        old, new = F.col(f"s.{c}"), F.col(f"i.{c}")
        if c in overwrite:
            return F.when(met, new).otherwise(old).alias(c)
        return F.coalesce(old, new).alias(c) if c in keep else F.coalesce(new, old).alias(c)

    return s.join(i, on, "full").select([value(c) for c in stored.columns])


def insert_new(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """SK2: ``stored`` and the incoming rows of new keys."""
    return stored.unionByName(incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def refresh_zotero(docs: DataFrame, incoming: DataFrame, fill: list[str]) -> DataFrame:
    """SK3: fill the columns that are null and overwrite url_or_path, for known zotero documents."""
    i = incoming.select(F.col("source_id").alias("_k"), F.col("url_or_path").alias("_url"), *[F.col(c).alias(f"_{c}") for c in fill])
    own = docs.join(i, (F.col("source") == "zotero") & (F.col("source_id") == F.col("_k")), "left")
    changed = {c: F.coalesce(c, f"_{c}") for c in fill} | {"url_or_path": F.when(F.col("_k").isNotNull(), F.col("_url")).otherwise(F.col("url_or_path"))}
    return own.withColumns(changed).select(docs.columns)


def replace_children(stored: DataFrame, incoming: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """SK4: the rows of the scoped keys are replaced by the incoming ones.

    For tags pass the incoming keys as scope (an empty list changes nothing); for
    collections pass every key looked at (an empty list clears).
    """
    return stored.join(scope.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def sync_tags(stored: DataFrame, desired: DataFrame, origin: str, scope: DataFrame, within: list[str] | None = None) -> DataFrame:
    """SK5: overlay tags of one origin on the scoped documents become the desired ones.

    ``within``: only tags of this vocabulary are removed or added.
    """
    mine = (F.col("origin") == origin) & (F.col("tag").isin(within) if within is not None else F.lit(True))
    want = desired.where(F.col("tag").isin(within)) if within is not None else desired
    want = want.select("document_id", "tag").distinct()
    held = stored.where(mine).join(scope.select("document_id"), "document_id", "left_semi")
    stale = held.join(want, ["document_id", "tag"], "left_anti").select("document_id", "tag", "origin")
    fresh = want.join(held.select("document_id", "tag"), ["document_id", "tag"], "left_anti").withColumn("origin", F.lit(origin))
    return stored.join(stale, ["document_id", "tag", "origin"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_tags(stored: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SK6: the table with the new overlay tags, and (applied, skipped)."""
    key = ["document_id", "tag", "origin"]
    once = rows.dropDuplicates(key)
    fresh = once.join(stored.select(*key), key, "left_anti")
    counts = (
        rows.agg(F.count("*").alias("all"))
        .crossJoin(fresh.agg(F.count("*").alias("applied")))
        .select("applied", (F.col("all") - F.col("applied")).alias("skipped"))
    )
    return stored.unionByName(fresh, allowMissingColumns=True), counts


def append(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """SK7: chunks appended, missing columns null."""
    return stored.unionByName(rows, allowMissingColumns=True)


def upsert_vectors(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """SK8: vectors by id; new ones replace."""
    return stored.join(rows.select("vector_id"), "vector_id", "left_anti").unionByName(rows.dropDuplicates(["vector_id"]))


def digest(payload: list[str]) -> Column:
    """SK9: sha256 of the payload as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*sorted(payload))).cast("binary"), 256)


def record_items(log: DataFrame, items: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """SK9: (key, digest, outcome) of offered items: new, changed or unchanged against the latest line of the log.

    Lines of the log have (key, digest, line_no).
    """
    last = log.groupBy(key).agg(F.max_by("digest", "line_no").alias("_old"))
    rows = items.withColumn("digest", digest(payload)).dropDuplicates([key, "digest"]).join(last, key, "left")
    outcome = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("digest"), "changed").otherwise("unchanged")
    return rows.withColumn("outcome", outcome).drop("_old")


def store_text(texts: DataFrame, incoming: DataFrame, now: int, full: str | None = None) -> DataFrame:
    """SK10: (document_id, text, char_count, full_char_count, content_hash, extracted_at), replaced by document; blank texts are not kept."""
    own = incoming.withColumn("text", F.trim("text")).where("text <> ''").withColumns({
        "char_count": F.length("text").cast("long"), "content_hash": F.sha2(F.col("text").cast("binary"), 256), "extracted_at": F.lit(now).cast("long"),
    })
    own = (
        own.withColumn("full_char_count", F.coalesce(full, "char_count") if full else F.col("char_count"))
        .select("document_id", "text", "char_count", "full_char_count", "content_hash", "extracted_at")
    )
    return texts.join(own.select("document_id"), "document_id", "left_anti").unionByName(own)


def record_fetch(docs: DataFrame, log: DataFrame, results: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """SK11: documents with what a fetch found (nulls change nothing), and the log with a line for each fetch."""
    changed = [c for c in results.columns if c in docs.columns and c != "id"]
    r = results.select(F.col("document_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in changed])
    new = docs.join(r, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in changed}).select(docs.columns)
    lines = results.select("document_id", F.lit(now).cast("long").alias("timestamp"), "http_status", "error_msg")
    return new, log.unionByName(lines, allowMissingColumns=True)


def upsert_labels(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """SK12: training labels by (session_id, document_id); the last of the batch (ordinal) wins."""
    key = ["session_id", "document_id"]
    last = batch.groupBy(*key).agg(F.max_by(F.struct("label", "source"), "ordinal").alias("l")).select(*key, "l.label", "l.source")
    return stored.join(last.select(*key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def decide_alias(aliases: DataFrame, alias: str, canonical: str, state: str) -> DataFrame:
    """SK15: accept (active), reject or unmerge one alias pair; one hop deep and one active canonical an alias.

    Accepting moves what folded into the alias on to the canonical, and resolves the
    canonical through its own fold first.
    """
    spark = aliases.sparkSession
    asked = spark.createDataFrame([(alias, canonical)], "a string, c string")
    if state == "active":
        onward = aliases.where("state = 'active'").select(F.col("alias").alias("c"), F.col("canonical").alias("to"))
        asked = asked.join(onward, "c", "left").select("a", F.coalesce("to", "c").alias("c")).where("a <> c")
    rows = aliases.crossJoin(F.broadcast(asked))
    pair = (F.col("alias") == F.col("a")) & (F.col("canonical") == F.col("c"))
    if state != "active":
        return rows.withColumn("state", F.when(pair, state).otherwise(F.col("state"))).drop("a", "c")
    moved = (F.col("state") == "active") & (F.col("canonical") == F.col("a"))
    other = (F.col("state") == "active") & (F.col("alias") == F.col("a")) & ~pair
    out = (
        rows.where(~(moved & (F.col("alias") == F.col("c"))))
        .withColumn("state", F.when(pair, "active").when(other, "rejected").otherwise(F.col("state")))
        .withColumn("canonical", F.when(moved, F.col("c")).otherwise(F.col("canonical")))
        .drop("a", "c")
    )
    fresh = (
        asked.select(F.col("a").alias("alias"), F.col("c").alias("canonical"))
        .join(aliases.select("alias", "canonical"), ["alias", "canonical"], "left_anti")
        .withColumn("state", F.lit("active"))
    )
    return out.unionByName(fresh, allowMissingColumns=True)


def purge(rows: DataFrame, doomed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """SK16: the table without the doomed rows, and (n) how many go."""
    return rows.join(doomed.select(*keys), keys, "left_anti"), rows.join(doomed.select(*keys), keys, "left_semi").agg(F.count("*").alias("n"))


def with_ids(rows: DataFrame, order: list, start: int = 1, id_col: str = "id") -> DataFrame:
    """Ids from ``start`` in this order, for tables of one run (bounded); large tables take sparse ids instead."""
    return rows.withColumn(id_col, (F.row_number().over(Window.orderBy(*order)) + F.lit(start - 1)).cast("long"))


def reject_image(rejections: DataFrame, incoming: DataFrame, key: str = "path") -> DataFrame:
    """HP20: image rejections by path (or by image, where paths repeat), the new reason replacing the old."""
    return upsert(rejections, incoming, [key], overwrite=("reason", "text_coverage", "image_type", "rejected_at"), keep=())


def upsert_reddit(items: DataFrame, incoming: DataFrame) -> DataFrame:
    """HP21: sidecar rows by document; nulls don't erase."""
    return upsert(items, incoming, ["document_id"], overwrite=("kind",), keep=())


def close_stale_runs(runs: DataFrame, now: int, after: int = 86400) -> DataFrame:
    """EN1: runs that never ended and began long ago are marked as aborted."""
    stale = F.col("finished_at").isNull() & (F.col("started_at") < now - after)
    return runs.withColumns(
        {
            "status": F.when(stale, "aborted").otherwise(F.col("status")),
            "finished_at": F.when(stale, F.lit(now).cast("long")).otherwise(F.col("finished_at")),
        }
    )
