"""Purges by target, source and provenance (SK16)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .browse import body_chunk
from .reports import MACHINE_ORIGINS, repeated_chunks

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Target:
    """Rows of one table, by its key; ``clears`` names columns that are emptied instead of rows removed.

    ``stamp`` is the column that holds the run that made a row; only such targets can
    be narrowed to a provenance.
    """

    table: str
    key: tuple[str, ...]
    rows: Callable[[Tables], DataFrame]
    clears: tuple[str, ...] = ()
    stamp: str | None = None


def _of_documents(t: Tables, name: str, condition: str) -> DataFrame:
    docs = t["documents"].where(condition).select(F.col("id").alias("document_id"))
    return t[name].join(docs, "document_id", "left_semi")


def _repeats(t: Tables) -> DataFrame:
    summary, full = repeated_chunks(t["chunks"])
    return t["chunks"].join(summary.unionByName(full), "id", "left_semi")


TARGETS = {
    "summaries": Target("chunks", ("id",), lambda t: t["chunks"].where("chunk_pass = 'summary'"), stamp="summary_run_id"),
    "fetched_text": Target("chunks", ("id",), lambda t: _of_documents(t, "chunks", "source <> 'image'").where(body_chunk())),
    "duplicate_chunks": Target("chunks", ("id",), _repeats),
    "document_texts": Target("document_texts", ("document_id",), lambda t: t["document_texts"]),
    "machine_tags": Target("overlay_tags", ("document_id", "tag", "origin"), lambda t: t["overlay_tags"].where(F.col("origin").isin(*MACHINE_ORIGINS))),
    "fetch_failures": Target("fetch_log", ("id",), lambda t: _of_documents(t, "fetch_log", "fetch_status = 'unfetchable'")),
    "vectors": Target("chunks", ("id",), lambda t: t["chunks"].where("vector_id is not null"), clears=("vector_id",)),
    "clip_vectors": Target("images", ("id",), lambda t: t["images"].where("clip_vector_id is not null"), clears=("clip_vector_id",)),
    "image_text": Target("chunks", ("id",), lambda t: t["chunks"].join(t["images"].where("indexed_at is not null").select("document_id"), "document_id", "left_semi")),
    "cluster_runs": Target("runs", ("run_id",), lambda t: t["runs"]),
}


def purge_target(
    tables: Tables,
    name: str,
    source: str | None = None,
    run_id: int | None = None,
    provider: str | None = None,
    model: str | None = None,
    unknown: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The target's table after the purge, and the rows that it takes.

    ``source`` narrows to documents of a source.  ``run_id``, ``provider`` and ``model``
    narrow to what such runs made, ``unknown`` to what bears no stamp; a target without
    stamps refuses them, since leaving a filter out would widen the purge.
    """
    if name not in TARGETS:
        raise ValueError(f"unknown purge target {name!r}; one of {sorted(TARGETS)}")
    target = TARGETS[name]
    narrowed = unknown or run_id is not None or provider is not None or model is not None
    if narrowed and target.stamp is None:
        raise ValueError(f"target {name!r} records no provenance")
    rows = target.rows(tables)
    if source is not None and "document_id" in rows.columns:
        own = tables["documents"].where(F.col("source") == source).select(F.col("id").alias("document_id"))
        rows = rows.join(own, "document_id", "left_semi")
    if unknown:
        rows = rows.where(F.col(target.stamp).isNull())
    elif narrowed:
        runs = tables["runs"]
        for column, value in (("run_id", run_id), ("provider", provider), ("model", model)):
            runs = runs if value is None else runs.where(F.col(column) == value)
        rows = rows.join(runs.select(F.col("run_id").cast("long").alias(target.stamp)), target.stamp, "left_semi").select(rows.columns)
    whole, keys = tables[target.table], rows.select(*target.key).distinct()
    if not target.clears:
        return whole.join(keys, list(target.key), "left_anti"), rows
    marked = whole.join(keys.withColumn("_gone", F.lit(True)), list(target.key), "left")
    emptied = {c: F.when(F.col("_gone"), None).otherwise(F.col(c)) for c in target.clears}
    return marked.withColumns(emptied).select(whole.columns), rows
