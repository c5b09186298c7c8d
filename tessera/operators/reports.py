"""Reports, queues and counts (AG4-12, AG19-23, FL11, FL14-18, JN1-2, ST5)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from ..functions.numbers import HALF_WIDTH_DAYS, gaussian_kernel, month_centre
from ..functions.urls import extract_domain, has_fetch_handler, unfetchable_reason
from .browse import body_chunk

MACHINE_ORIGINS = ("llm", "cluster_l1", "cluster_l2", "learned")


def domain_frequency(docs: DataFrame) -> DataFrame:
    """AG4: (domain, n, by_status, unfetchable, has_handler); by_status lists status=n, sorted."""
    own = docs.withColumn("domain", extract_domain(F.col("url_or_path"))).where("domain is not null")
    per = own.groupBy("domain", "fetch_status").agg(F.count("*").alias("c"))
    states = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "fetch_status", F.col("c").cast("string")))), ",")
    out = (
        per.groupBy("domain")
        .agg(
            F.sum("c").alias("n"),
            states.alias("by_status"),
            F.sum(F.when(F.col("fetch_status") == "unfetchable", F.col("c")).otherwise(0)).alias("unfetchable"),
        )
    )
    return out.withColumn("has_handler", has_fetch_handler(F.col("domain")))


def domain_top(report: DataFrame, limit: int = 10) -> DataFrame:
    """AG5, ST5: (kind, place, domain, n) of the most frequent and of the most rejected domains."""
    def best(kind, rows, n):
        top = rows.orderBy(F.desc(n), "domain").limit(limit)
        return top.select(
            F.lit(kind).alias("kind"),
            F.row_number().over(Window.orderBy(F.desc(n), "domain")).alias("place"),
            "domain",
            F.col(n).alias("n"),
        )

    return best("count", report, "n").unionByName(best("unfetchable", report.where("unfetchable > 0"), "unfetchable"))


def sources_over_time(docs: DataFrame, granularity: str = "month") -> DataFrame:
    """AG6: (source, period, n) in UTC; any granularity but month is year."""
    shape = "yyyy-MM" if granularity == "month" else "yyyy"
    return (
        docs.where("date_added is not null")
        .groupBy("source", F.date_format(F.timestamp_seconds("date_added"), shape).alias("period"))
        .agg(F.count("*").alias("n"))
    )


def kernel_timeline(rows: DataFrame) -> DataFrame:
    """AG7, FN23, FN24: (label, period, weight): each timestamp's kernel at the centres of the months it reaches.

    Rows (label, ts) are first counted by (label, ts); each then reaches four months
    at most, so nothing is multiplied by the length of the grid.
    """
    own = (
        rows.where("ts is not null")
        .groupBy(
            F.coalesce(F.nullif("label", F.lit("")), F.lit("Unlabelled")).alias("label"),
            F.col("ts").cast("double").alias("ts"),
        )
        .agg(F.count("*").alias("n"))
    )
    first = F.add_months(F.trunc(F.timestamp_seconds("ts").cast("date"), "month"), -2)
    months = F.explode(F.sequence(first, F.add_months(first, 4), F.expr("interval 1 month")))
    days = (month_centre(F.col("month")) - F.col("ts")) / 86400.0
    reached = own.withColumn("month", months).withColumn("days", days).where(F.abs("days") <= HALF_WIDTH_DAYS)
    return (
        reached.groupBy("label", F.date_format("month", "yyyy-MM").alias("period"))
        .agg(F.sum(F.col("n") * gaussian_kernel(F.col("days"))).alias("weight"))
        .where("weight <> 0")
    )


def cluster_rows(assignments: DataFrame, clusters: DataFrame, docs: DataFrame, level: int = 1) -> DataFrame:
    """JN1: (label, ts) of the documents of a run's clusters."""
    own = assignments.where(F.col("level") == level).join(clusters.select("cluster_id", "label"), "cluster_id")
    return own.join(docs.select(F.col("id").alias("document_id"), F.col("date_added").alias("ts")), "document_id").select("label", "ts")


def status_report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """AG8, AG9: (source, total, pending, fetched, unfetchable, embedded) of each source."""
    has = chunks.select(F.col("document_id").alias("id")).distinct().withColumn("_e", F.lit(1))
    count = lambda s: F.sum((F.col("fetch_status") == s).cast("int")).alias(s)
    return (
        docs.join(has, "id", "left")
        .groupBy("source")
        .agg(
            F.count("*").alias("total"),
            count("pending"),
            count("fetched"),
            count("unfetchable"),
            F.count("_e").alias("embedded"),
        )
    )


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    """AG10."""
    return assignments.groupBy("run_id", "cluster_id").agg(F.count("*").alias("n"))


def run_diagnostics(assignments: DataFrame) -> DataFrame:
    """AG19: (run_id, clusters, smallest, largest, mean) of the clusters' sizes."""
    return (
        cluster_sizes(assignments)
        .groupBy("run_id")
        .agg(
            F.count("*").alias("clusters"),
            F.min("n").alias("smallest"),
            F.max("n").alias("largest"),
            F.round(F.avg("n"), 1).alias("mean"),
        )
    )


def noise_count(chunks: DataFrame, assignments: DataFrame, clusters: DataFrame, run_id: int) -> DataFrame:
    """AG11: (n_noise): the noise bucket's size, or, without one, chunked documents that have no first-level cluster."""
    own = assignments.where(F.col("run_id") == run_id)
    bucket = clusters.where((F.col("run_id") == run_id) & F.col("is_noise")).select("cluster_id")
    held = own.join(bucket, "cluster_id", "left_semi").agg(F.count("*").alias("held"))
    some = bucket.agg(F.count("*").alias("buckets"))
    rest = (
        chunks.agg(F.countDistinct("document_id").alias("chunked"))
        .crossJoin(own.where("level = 1").agg(F.countDistinct("document_id").alias("placed")))
    )
    return (
        held.crossJoin(some)
        .crossJoin(rest)
        .select(
            F.when(F.col("buckets") > 0, F.col("held"))
            .otherwise(F.greatest(F.lit(0), F.col("chunked") - F.col("placed")))
            .alias("n_noise")
        )
    )


def cluster_top_tags(assignments: DataFrame, tags: DataFrame, folds: DataFrame, sample: int = 200, top: int = 10) -> DataFrame:
    """AG12: (cluster_id, tag, n) of the most used folded tags among a cluster's first documents."""
    first = (
        assignments.withColumn("_n", F.row_number().over(Window.partitionBy("cluster_id").orderBy("document_id")))
        .where(F.col("_n") <= sample)
    )
    own = (
        first.join(tags, "document_id")
        .join(folds.where("origin = 'source'").select(F.col("raw").alias("tag"), "canonical", "display"), "tag")
    )
    per = own.groupBy("cluster_id", "canonical").agg(F.min("display").alias("tag"), F.countDistinct("document_id").alias("n"))
    return (
        per.withColumn("_n", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "tag")))
        .where(F.col("_n") <= top)
        .select("cluster_id", "tag", "n")
    )


def list_sizes(lists: DataFrame, items: DataFrame) -> DataFrame:
    """AG20."""
    n = items.groupBy("list_id").agg(F.count("*").alias("n"))
    return lists.join(n, "list_id", "left").select("list_id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def spend(calls: DataFrame) -> DataFrame:
    """AG23: (run_id, calls, chars_sent, artifacts) over a call log."""
    return (
        calls.groupBy("run_id")
        .agg(F.count("*").alias("calls"), F.sum("chars").alias("chars_sent"), F.sum("artifacts").alias("artifacts"))
    )


# ── queues ───────────────────────────────────────────────────────────────────


def ingest_queue(docs: DataFrame, chunks: DataFrame, source: str, limit: int | None = None) -> DataFrame:
    """FL14: (id, url_or_path, phase): pending documents, then fetched ones without chunks; once each."""
    own = docs.where((F.col("source") == source) & F.col("url_or_path").isNotNull() & (F.col("url_or_path") != ""))
    waiting = own.where("fetch_status = 'pending'").select("id", "url_or_path", F.lit(0).alias("phase"))
    orphans = (
        own.where("fetch_status = 'fetched'")
        .join(chunks.select(F.col("document_id").alias("id")), "id", "left_anti")
        .select("id", "url_or_path", F.lit(1).alias("phase"))
    )
    queue = waiting.unionByName(orphans)
    return queue.orderBy("phase", "id").limit(limit) if limit is not None else queue


def requeue_unfetchable(docs: DataFrame, log: DataFrame, source: str, cutoff: int) -> DataFrame:
    """FL15, JN2: (id) of unfetchable documents whose last attempt is old enough and whose url could work."""
    last = log.groupBy(F.col("document_id").alias("id")).agg(F.max("timestamp").alias("last"))
    own = docs.where((F.col("source") == source) & (F.col("fetch_status") == "unfetchable") & (F.coalesce("url_or_path", F.lit("")) != ""))
    return (
        own.join(last, "id", "left")
        .where((F.col("last").isNull() | (F.col("last") <= cutoff)) & unfetchable_reason(F.col("url_or_path")).isNull())
        .select("id")
    )


def summary_candidates(docs: DataFrame, chunks: DataFrame, sources: list[str]) -> DataFrame:
    """FL16: documents of these sources without summary that have body text."""
    body = chunks.where(body_chunk()).select(F.col("document_id").alias("id"))
    return docs.where(F.col("source").isin(sources) & F.col("generated_summary").isNull()).join(body, "id", "left_semi").select("id")


def rechunk_candidates(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """FL17: documents whose retained text is whole and not empty."""
    whole = texts.where("char_count > 0 and full_char_count <= char_count").select(F.col("document_id").alias("id"), "char_count")
    return docs.select("id").join(whole, "id")


def admitted_images(found: DataFrame, rejected: DataFrame) -> DataFrame:
    """FL18."""
    return found.join(rejected.select("path"), "path", "left_anti")


def pending_metadata(known: DataFrame, offered: DataFrame) -> DataFrame:
    """IN9: (source, n) of offered (source, source_id) that the archive doesn't have."""
    return (
        offered.join(known.select("source", "source_id"), ["source", "source_id"], "left_anti")
        .groupBy("source")
        .agg(F.count("*").alias("n"))
    )


def provenance(
    chunks: DataFrame,
    runs: DataFrame,
    run_id: int | None = None,
    provider: str | None = None,
    model: str | None = None,
    unknown: bool = False,
) -> DataFrame:
    """FL11: summary chunks of a run, of a provider's or model's runs, or of no known run."""
    own = chunks.where("chunk_pass = 'summary'")
    if unknown:
        return own.where("summary_run_id is null")
    if run_id is not None:
        return own.where(F.col("summary_run_id") == run_id)
    if provider is None and model is None:
        return own
    chosen = runs.where((F.col("provider") == provider if provider else F.lit(True)) & (F.col("model") == model if model else F.lit(True)))
    return own.join(chosen.select(F.col("run_id").alias("summary_run_id")), "summary_run_id", "left_semi")


# ── purge ────────────────────────────────────────────────────────────────────


def purge_counts(
    docs: DataFrame,
    chunks: DataFrame,
    texts: DataFrame,
    overlay: DataFrame,
    log: DataFrame,
    images: DataFrame,
    runs: DataFrame,
) -> DataFrame:
    """AG22: (target, n): what each purge would take."""
    bad = docs.where("fetch_status = 'unfetchable'").select(F.col("id").alias("document_id"))
    summary, full = repeated_chunks(chunks)
    count = {
        "summaries": chunks.where("chunk_pass = 'summary'"),
        "fetched_text": chunks.where(body_chunk()).join(docs.where("source <> 'image'").select(F.col("id").alias("document_id")), "document_id", "left_semi"),
        "document_texts": texts,
        "machine_tags": overlay.where(F.col("origin").isin(*MACHINE_ORIGINS)),
        "fetch_failures": log.join(bad, "document_id", "left_semi"),
        "vectors": chunks.where("vector_id is not null"),
        "clip_vectors": images.where("clip_vector_id is not null"),
        "image_text": chunks.join(images.where("indexed_at is not null").select("document_id"), "document_id", "left_semi"),
        "cluster_runs": runs,
        "duplicate_chunks": summary.unionByName(full),
    }
    out = None
    for target, rows in count.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(target).alias("target"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def _period(rows: list) -> int:
    """The least number of leading items that, repeated, make the whole; 0 if there is none shorter."""
    n = len(rows)
    return next((p for p in range(1, n // 2 + 1) if n % p == 0 and rows[p:] == rows[: n - p]), 0)


def repeated_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AG21: (id) of summary chunks that repeat an earlier one's text, and of full-text runs written again.

    Documents are grouped by length and page of their chunks; only digests of texts are compared.
    """
    again = Window.partitionBy("document_id", "text").orderBy("chunk_index", "id")
    summary = chunks.where("chunk_pass = 'summary'").withColumn("_n", F.row_number().over(again)).where("_n > 1").select("id")
    own = (
        chunks.where("chunk_pass = 'fulltext'")
        .select(
            "document_id",
            F.struct("chunk_index", "id", F.md5("text").alias("h"), F.col("page_start").cast("long").alias("p"))
            .alias("c"),
        )
    )
    whole = own.groupBy("document_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))

    def extra(ids, marks):
        out = []
        for i, m in zip(ids.to_pylist(), marks.to_pylist()):
            p = _period(m)
            out.append(i[p:] if p else [])
        return pa.array(out, pa.list_(pa.int64()))

    take = F.arrow_udf(extra, "array<long>", ArrowUDFType.SCALAR)
    ids = F.transform("cs", lambda c: c["id"])
    marks = F.transform("cs", lambda c: F.concat_ws("|", c["h"], F.coalesce(c["p"].cast("string"), F.lit(""))))
    return summary, whole.select(F.explode(take(ids, marks)).alias("id"))


def purge_source(tables: dict[str, DataFrame], source: str, keep_user_data: bool = True) -> dict[str, DataFrame]:
    """SK17: the archive's tables without a source; manual and learned tags and reading lists stay unless asked."""
    gone = tables["documents"].where(F.col("source") == source).select(F.col("id").alias("document_id"))
    out = dict(tables, documents=tables["documents"].where(F.col("source") != source))
    for name in ("chunks", "source_tags", "source_collections", "fetch_log", "document_texts", "cluster_assignments", "overlay_tags", "reading_list_items"):
        if name not in tables:
            continue
        rest = tables[name].join(gone, "document_id", "left_anti")
        if keep_user_data and name == "overlay_tags":
            rest = rest.unionByName(tables[name].where("origin in ('manual', 'learned')").join(gone, "document_id", "left_semi"))
        out[name] = tables[name] if keep_user_data and name == "reading_list_items" else rest
    return out
