"""Per-key results where a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = {"target": "target_entity_id", "source": "source_entity_id"}


def _once(refs: DataFrame, *more: str) -> DataFrame:
    cols = ["ref_id", "source_entity_id", "target_entity_id", *more]
    return refs.select(cols).groupBy(cols).agg(F.lit(1).alias("one")).drop("one")


def _by_role(df: DataFrame) -> DataFrame:
    """One row for each role of a reference: ``key_role, entity_id, partner_id`` and the other columns."""
    pair = lambda role, key, other: F.struct(F.lit(role).alias("key_role"), F.col(key).alias("entity_id"), F.col(other).alias("partner_id"))
    a, b = ROLES["target"], ROLES["source"]
    return df.withColumn("r", F.explode(F.array(pair("target", a, b), pair("source", b, a)))).select("r.*", *[c for c in df.columns if c not in (a, b)])


def key_counts(refs: DataFrame) -> DataFrame:
    """``key_role, entity_id, n_rows``, null keys included: the rows of each key, counted map-side before anything is shuffled by key."""
    return _by_role(_once(refs)).groupBy("key_role", "entity_id").agg(F.count(F.lit(1)).alias("n_rows"))


def heavy_keys(refs: DataFrame, share: float = 0.025) -> DataFrame:
    """``key_role, entity_id, n_rows``: the non-null keys that hold at least ``share`` of the distinct rows, null-keyed rows included in the total.

    Keys are counted by algebraic aggregates: each task keeps a bounded hash table that spills, and only partial counts
    meet in the shuffle, so a key with a third of all rows costs one row per task. Empty tables give no rows.
    """
    counts = key_counts(refs)
    total = counts.where("key_role = 'target'").agg(F.sum("n_rows"))
    return counts.where(F.col("entity_id").isNotNull() & (F.col("n_rows") >= F.lit(share) * total.scalar()))


def key_profiles(refs: DataFrame) -> DataFrame:
    """For every non-null key of either role: ``n_rows, n_contexts, top_context, n_partners``, as ``key_role, entity_id, ...``.

    Distinct partners and contexts are reached by two levels of aggregation: (key, partner) pairs first, spread over all
    tasks, then one partial sum per key and task. A null partner is not counted as one; a null context is a context of its
    own; of equally frequent contexts the first in order is the top one (null last).
    """
    rows = _by_role(_once(refs, "context")).where("entity_id is not null")
    key = ["key_role", "entity_id"]
    partners = rows.groupBy(*key, "partner_id").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum("n").alias("n_rows"), F.count("partner_id").alias("n_partners"))
    ranked = F.struct(-F.col("n"), F.col("context").isNull(), F.col("context").alias("context"))
    contexts = rows.groupBy(*key, "context").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.count(F.lit(1)).alias("n_contexts"), F.min(ranked)["context"].alias("top_context"))
    return partners.join(contexts, key).select(*key, "n_rows", "n_contexts", "top_context", "n_partners")
