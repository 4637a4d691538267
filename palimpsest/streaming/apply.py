"""Live changes applied to snapshots: each micro-batch resumes the pages it touches and writes them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.attribute import attribute, resume
from palimpsest.session import materialize
from palimpsest.sources.store import Store

MISSING, BEHIND, APPLIED = "snapshot_missing", "already_at_or_ahead", "applied"


def decide(events: DataFrame, meta: DataFrame) -> DataFrame:
    """(lang, page_id, start, end, outcome) for each page with events: the window (start, end] of revisions to take in.

    Pages without a snapshot are left alone; events at or behind the last stored revision do nothing. Ids are compared as
    numbers here, and only here.
    """
    to = events.groupBy(F.col("language").alias("lang"), "page_id").agg(F.max("rev_id").alias("end"))
    known = meta.select("lang", "page_id", F.coalesce("last_processed_revid", F.lit(0).cast("long")).alias("start"))
    rows = to.join(known, ["lang", "page_id"], "left")
    outcome = F.when(F.col("start").isNull(), MISSING).when(F.col("end") <= F.col("start"), BEHIND).otherwise(APPLIED)
    return rows.select("lang", "page_id", "start", "end", outcome.alias("outcome"))


def window(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """Revisions of the pages to apply whose ids are in (start, end], so that gaps before an event are filled."""
    rows = wanted.filter(F.col("outcome") == APPLIED).select("lang", "page_id", "start", "end")
    return history.join(rows, ["lang", "page_id"]).filter("rev_id > start and rev_id <= end").drop("start", "end")


def apply_batch(store: Store, events: DataFrame, history: DataFrame) -> DataFrame:
    """Take in a batch of page edits; (lang, page_id, start, end, outcome, applied)."""
    wanted = materialize(decide(events, store.meta), "apply-wanted")
    rows = materialize(window(history, wanted), "apply-rows")
    pages = wanted.filter(F.col("outcome") == APPLIED).select("lang", "page_id")
    if pages.head(1):
        store.write(resume(store.pages(pages), rows))
    counts = rows.filter(~F.coalesce("text_hidden", F.lit(False))).groupBy("lang", "page_id").agg(F.count("*").alias("applied"))
    return wanted.join(counts, ["lang", "page_id"], "left").withColumn("applied", F.coalesce("applied", F.lit(0).cast("long")))


def follow(edits: DataFrame, store: Store, history: Callable[[], DataFrame], checkpoint: str, seen: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Apply a stream of page edits until it stops. A batch that runs again finds its revisions stored and does nothing."""

    def batch(events: DataFrame, number: int) -> None:
        events = events.persist()
        done = apply_batch(store, events, history())
        if seen:
            seen(done, number)
        events.unpersist()

    return edits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()




def refold(store: Store, changed: DataFrame, history: DataFrame) -> DataFrame:
    """Attribute anew the stored pages of revisions that were hidden or shown, from `history` as it is now, up to the revision that
    they were stored with; (lang, page_id). Resuming can't do this: a hidden revision's tokens go to those after it."""
    pages = changed.select(F.col("language").alias("lang"), "page_id").distinct().join(store.meta.select("lang", "page_id", "last_processed_revid"), ["lang", "page_id"])
    pages = materialize(pages, "refold-pages")
    if pages.head(1):
        rows = history.join(pages, ["lang", "page_id"])
        end = F.max(F.when(F.col("rev_id") == F.col("last_processed_revid"), F.col("ord"))).over(W.partitionBy("lang", "page_id"))
        store.write(attribute(rows.withColumn("end", end).filter("ord <= coalesce(end, ord)").drop("end", "last_processed_revid")))
    return pages.select("lang", "page_id")
