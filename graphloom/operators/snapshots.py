"""What changed between consecutive full snapshots of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import bounded_broadcast, key128, stem


def run_order(runs: DataFrame) -> DataFrame:
    """``run_id, prev_run, next_run`` of each distinct run; a series is ordered by parsed_at, then run_id.

    Runs given twice count once. A null source_path is a series of its own; a null parsed_at comes first.
    """
    w = Window.partitionBy("source_path").orderBy("parsed_at", "run_id")
    once = runs.groupBy("run_id").agg(F.min("source_path").alias("source_path"), F.min("parsed_at").alias("parsed_at"))
    return once.select("run_id", F.lag("run_id").over(w).alias("prev_run"), F.lead("run_id").over(w).alias("next_run"))


def newest_runs(runs: DataFrame) -> DataFrame:
    """``run_id`` of the last run of each series."""
    return run_order(runs).where(F.col("next_run").isNull()).select("run_id")


def snapshot_changes(entities: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, entity_id, change`` (added, removed, changed) of each snapshot against the one just before it.

    Both snapshots of a pair are united, tagged by side, and grouped by the record's key (file stem, kind, base_table, fm_id;
    null equals null), all in one aggregation shuffle whose rows are fixed-width: a 128-bit key, an id and a hash of
    name and calc_text per side. A record belongs to two pairs, as the later and as the earlier side.

    Rows without entity_id or fm_id and script steps are left out. Null name or calc_text differs from every text, also from the empty one.
    Rows given twice fall together. Several records of one snapshot with an equal key count as one, under the greatest
    entity_id, with the greatest content hash. A first snapshot yields no rows; empty tables yield none.
    """
    order = run_order(runs)
    dim = (
        files.select("file_id", "run_id", stem(F.col("name")).alias("stem")).distinct()
        .join(order, "run_id")
        .select("file_id", "stem", F.when(F.col("prev_run").isNotNull(), F.col("run_id")).alias("as_later"), F.col("next_run").alias("as_earlier"))
        .where("as_later is not null or as_earlier is not null")
    )
    rows = (
        entities.where("entity_id is not null and fm_id is not null and (kind is null or kind <> 'script_step')")
        .select("file_id", "entity_id", "kind", "base_table", "fm_id", F.xxhash64(F.col("name").isNull(), "name", F.col("calc_text").isNull(), "calc_text").alias("content"))
        .join(bounded_broadcast(dim), "file_id")
    )
    k1, k2 = key128(F.col("stem"), F.col("kind"), F.col("base_table"), F.col("fm_id"))
    tagged = rows.select(
        k1.alias("k1"), k2.alias("k2"), "entity_id", "content",
        F.explode(F.array(F.struct(F.col("as_later").alias("run_id"), F.lit(True).alias("later")), F.struct(F.col("as_earlier").alias("run_id"), F.lit(False).alias("later")))).alias("p"),
    ).where("p.run_id is not null")
    side = lambda later, c: F.max(F.when(F.col("p.later") == later, F.col(c)))
    both = tagged.groupBy(F.col("p.run_id").alias("run_id"), "k1", "k2").agg(
        side(True, "entity_id").alias("e_new"), side(True, "content").alias("c_new"), side(False, "entity_id").alias("e_old"), side(False, "content").alias("c_old")
    )
    change = F.when(F.col("e_old").isNull(), "added").when(F.col("e_new").isNull(), "removed").when(F.col("c_new") != F.col("c_old"), "changed")
    return both.select("run_id", F.coalesce("e_new", "e_old").alias("entity_id"), change.alias("change")).where("change is not null")
