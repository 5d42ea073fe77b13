"""Arriving references and texts, watched as streams. The tables are delivered as files in a folder; nothing is kept but the counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.fulltext import Query, indexed


def matching(docs: DataFrame, text: str) -> DataFrame:
    """The rows of a stream of texts (``entity_id, file_id, kind, name, body``) that match a query; no state."""
    return indexed(docs).where(Query(text).matches()).select("entity_id", "file_id", "kind", "name", "body")


def unresolved_by_window(refs: DataFrame, when: str = "arrived_at", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``start, target_kind, context, n, n_unresolved`` of a stream of references with an arrival time, per window.

    Rows later than ``late`` behind the newest are left out by the watermark; rows delivered twice within it count once.
    """
    once = refs.withWatermark(when, late).dropDuplicatesWithinWatermark(["ref_id"])
    counts = once.groupBy(F.window(when, window), "target_kind", "context").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target_entity_id").isNull()).alias("n_unresolved"))
    return counts.select(F.col("window.start").alias("start"), "target_kind", "context", "n", "n_unresolved")
