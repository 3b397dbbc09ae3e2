"""Admission of uploads, ingestion planning, library listing, cascade deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papergraph.sources.landed import first_per_key

MOST_BYTES, MOST_PAGES = 40 * 1024 * 1024, 50


def reject_reason(head: Column, n_bytes: Column, pages: Column, most_bytes: int = MOST_BYTES, most_pages: int = MOST_PAGES) -> Column:
    """The first rule that a file breaks; null if none."""
    return F.when(F.coalesce(F.substring(head, 1, 5), F.lit(b"")) != F.lit(b"%PDF-"), "not a PDF").when(n_bytes > most_bytes, "too large").when(pages > most_pages, "too many pages")


def admit(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files, and rejected ones with their reason (content, page_count)."""
    marked = files.withColumn("reason", reject_reason(F.col("content"), F.length("content"), F.col("page_count")))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def plan_ingest(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_key, action: one row a key; ready keys are skipped unless forced.

    ``create`` what is new, ``retry`` what failed or did not finish, ``refresh``
    what is forced. ``incoming``: doc_key, force.
    """
    asked = incoming.groupBy("doc_key").agg(F.max(F.coalesce("force", F.lit(False))).alias("force"))
    known = documents.select("doc_key", "status")
    action = F.when(F.col("status").isNull(), "create").when(F.col("status") != "ready", "retry").when(F.col("force"), "refresh")
    return asked.join(known, "doc_key", "left").select("doc_key", action.alias("action"), F.lit("fetched").alias("status")).where("action is not null")


def next_status(status: Column, error: Column) -> Column:
    """fetched, parsed, ready in turn; failed with an error."""
    return F.when(error.isNotNull() & (error != ""), "failed").when(status == "fetched", "parsed").when(status == "parsed", "ready").otherwise(status)


def list_documents(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; with a limit each task keeps its own top rows only."""
    ordered = documents.orderBy(F.desc("created_at"), F.desc("doc_id"))
    return ordered if limit is None else ordered.limit(limit)


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the rows of the documents listed."""
    gone = ids.select(key).distinct()
    return {name: t.join(gone, key, "left_anti") for name, t in tables.items()}


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each document (doc_id, ts, seq, status)."""
    return first_per_key(events, ["doc_id"], [F.desc("ts"), F.desc("seq")])
