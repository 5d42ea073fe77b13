"""References to records that do not exist in the run they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import Stages, bounded_broadcast, null_safe_join, stem

#: Place of the shared core file in every run; no real file has a negative id.
CORE_PLACE = -1
_NAMED_KEY = ["run_id", "own", "place_stem", "target_kind", "target_name", "target_to_name"]


def orphan_refs(refs: DataFrame, entities: DataFrame, core: DataFrame, files: DataFrame, core_stem: str) -> DataFrame:
    """``ref_id, target_kind, run_id, reason`` of each reference whose target its run doesn't hold.

    reason ``dead_id``: target_entity_id is neither an id of the run nor of the core file. reason ``no_name``: there is no
    target_entity_id, and nothing in the place that the reference names (target_file's file, else its own) fits target_kind and
    target_name; a field with target_to_name must lie in the base table of a table occurrence of that name.

    Distinct non-null foreign keys are anti-joined against the parent keys and the missing ones joined back, so a target
    that holds a third of all references is one key in the shuffle. Rows given twice count once; rows without ref_id are left out; refs with neither id nor
    name are no case; a null target_kind never fits; equal names in several places fit if any does. Empty tables give none.
    ``core_stem`` is the stem under which references name the core file. References are read once: what is looked up by id, what by name, and the names themselves are written
    and read from there.
    """
    st = Stages(refs.sparkSession, "orphans")
    dim = bounded_broadcast(files.select("file_id", "run_id", stem(F.col("name")).alias("stem")).distinct())
    core = core.select("entity_id", F.lit(CORE_PLACE).cast("long").alias("file_id"), "kind", "name", "base_table", "ext_file")
    core_ids = bounded_broadcast(core.select(F.col("entity_id").alias("target_entity_id")).distinct())
    asked = refs.where("ref_id is not null and (target_entity_id is not null or target_name is not null)").select("ref_id", "file_id", "target_kind", "target_name", "target_to_name", "target_file", "target_entity_id")
    located = st.put(asked.join(core_ids, "target_entity_id", "left_anti").join(dim.select("file_id", "run_id"), "file_id"), "located")

    by_id = located.where("target_entity_id is not null").select("ref_id", "target_kind", "run_id", "target_entity_id")
    wanted = by_id.select("target_entity_id", "run_id").distinct()
    held = entities.select("entity_id", "file_id").join(dim.select("file_id", "run_id"), "file_id").select(F.col("entity_id").alias("target_entity_id"), "run_id")
    dead = by_id.join(wanted.join(held, ["target_entity_id", "run_id"], "left_anti"), ["target_entity_id", "run_id"])

    by_name = located.where("target_entity_id is null and target_name is not null").select(
        "ref_id", "run_id", F.when(F.col("target_file").isNull(), F.col("file_id")).alias("own"), stem(F.col("target_file")).alias("place_stem"),
        "target_kind", "target_name", "target_to_name",
    )
    keys = st.put(by_name.select(_NAMED_KEY).distinct(), "keys")
    missing = null_safe_join(keys, _fitting(st, keys, entities, core, dim, core_stem), _NAMED_KEY, "left_anti")
    named = null_safe_join(by_name, missing, _NAMED_KEY, "left_semi").select("ref_id", "target_kind", "run_id")
    return (
        dead.select("ref_id", "target_kind", "run_id", F.lit("dead_id").alias("reason"))
        .unionByName(named.withColumn("reason", F.lit("no_name")))
        .distinct()
    )


def _places(df: DataFrame, own: str, named: str, dim: DataFrame, core_stem: str) -> DataFrame:
    """df with ``place``: the own file where no stem is named, else each file of the run with that stem, and the core file for its stem."""
    here = df.where(F.col(named).isNull()).withColumn("place", F.col(own))
    there = df.where(F.col(named).isNotNull())
    stems = dim.select(F.col("run_id"), F.col("stem").alias(named), F.col("file_id").alias("place"))
    return here.unionByName(there.join(stems, ["run_id", named])).unionByName(there.where(F.col(named) == core_stem).withColumn("place", F.lit(CORE_PLACE).cast("long")))


def _fitting(st: Stages, keys: DataFrame, entities: DataFrame, core: DataFrame, dim: DataFrame, core_stem: str) -> DataFrame:
    kinds = bounded_broadcast(keys.select(F.col("target_kind").alias("kind")).distinct(), 1000)
    own = entities.select("file_id", "kind", "name", "base_table", "ext_file").where("name is not null")
    wanted = F.col("kind").isin("table_occurrence", "field")
    # kinds that references ask for, and those that lead to fields; the rest (steps, objects) is most of the table
    named = own.unionByName(core.drop("entity_id").where("name is not null")).join(kinds.withColumn("asked", F.lit(True)), "kind", "left").where(wanted | F.col("asked")).drop("asked")
    named = st.put(named.distinct(), "named")
    placed = _places(keys, "own", "place_stem", dim, core_stem)
    qualified = (F.col("target_kind") == "field") & F.col("target_to_name").isNotNull()

    plain_parents = named.select(F.col("file_id").alias("place"), F.col("kind").alias("target_kind"), F.col("name").alias("target_name"))
    plain = placed.where(~F.coalesce(qualified, F.lit(False))).join(plain_parents, ["place", "target_kind", "target_name"], "left_semi").select(_NAMED_KEY)

    occurrences = named.where("kind = 'table_occurrence' and base_table is not null").select(
        F.col("file_id").alias("place"), F.col("name").alias("target_to_name"), F.col("base_table").alias("to_base"), stem(F.col("ext_file")).alias("ext_stem")
    ).distinct()
    hops = placed.where(qualified).join(occurrences, ["place", "target_to_name"]).withColumnRenamed("place", "to_place")
    fields = named.where("kind = 'field'").select(F.col("file_id").alias("place"), F.col("name").alias("target_name"), F.col("base_table").alias("to_base"))
    through = _places(hops, "to_place", "ext_stem", dim, core_stem).join(fields, ["place", "target_name", "to_base"], "left_semi").select(_NAMED_KEY)
    return plain.unionByName(through).distinct()
