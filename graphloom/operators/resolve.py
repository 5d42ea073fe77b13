"""Resolution of raw references to entities: a cascade of lookups, each a left join on a key with one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import stem

_ID_KINDS, _NAME_KINDS = ("script", "layout"), ("script", "layout", "table_occurrence", "value_list", "custom_function")


def _lookup(df: DataFrame, keys: list[str], to: str) -> DataFrame:
    """The smallest entity_id of each key as ``to``, and how many entities have it as ``to_n``."""
    rows = df.where(" and ".join(f"{k} is not null" for k in keys))
    return rows.groupBy(*keys).agg(F.min("entity_id").alias(to), F.count(F.lit(1)).alias(f"{to}_n"))


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.withColumnsRenamed(names)


def resolve(refs: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    """``refs`` with ``target_entity_id`` and ``ambiguous`` derived anew from the raw columns; the first rule that finds an entity wins.

    Within the reference's own file: fields by table occurrence, base table and name (any table where no occurrence is given), then
    through an occurrence of another file; scripts and layouts by id, else by name; occurrences, value lists and custom functions by
    name. References that name a file resolve in that file of the same run only (scripts and layouts) or in it as well (others).
    The smallest id wins; an unqualified field or a name fallback with several candidates is flagged ambiguous.

    Every lookup is aggregated to one row per key before it meets the references, so no join multiplies rows. Null keys find
    nothing; rows given twice must have been dropped; empty tables give empty results.
    """
    e = entities.select("entity_id", "file_id", "kind", "fm_id", "name", "base_table", "ext_file")
    f = files.select("file_id", "run_id", stem(F.col("name")).alias("stem"))
    by_name = _lookup(e.where(F.col("kind").isin(*_NAME_KINDS)), ["file_id", "kind", "name"], "c_name")
    by_id = _lookup(e.where(F.col("kind").isin(*_ID_KINDS)), ["file_id", "kind", "fm_id"], "c_id")
    fields = e.where("kind = 'field'")
    field_any = _lookup(fields, ["file_id", "name"], "c_leaf")
    field_in = _lookup(fields, ["file_id", "base_table", "name"], "c_field")
    occurrence = e.where("kind = 'table_occurrence' and name is not null").groupBy("file_id", "name").agg(F.min(F.struct("entity_id", "base_table", "ext_file")).alias("o"))
    occurrence = occurrence.select("file_id", F.col("name").alias("target_to_name"), F.col("o.base_table").alias("to_base"), stem(F.col("o.ext_file")).alias("to_stem"))

    r = refs.drop("target_entity_id", "ambiguous").join(f.select("file_id", "run_id"), "file_id", "left").join(occurrence, ["file_id", "target_to_name"], "left")
    r = r.withColumn("named_stem", stem(F.col("target_file")))
    place = f.groupBy("run_id", "stem").agg(F.min("file_id").alias("place"))
    r = r.join(_renamed(place, stem="to_stem", place="to_place"), ["run_id", "to_stem"], "left").join(_renamed(place, stem="named_stem", place="named_place"), ["run_id", "named_stem"], "left")

    is_field, inside = F.col("target_kind") == "field", F.col("target_file").isNull()
    r = r.join(_renamed(field_any, name="target_name"), ["file_id", "target_name"], "left")
    r = r.join(_renamed(field_in, base_table="to_base", name="target_name"), ["file_id", "to_base", "target_name"], "left")
    r = r.join(_renamed(field_in, file_id="to_place", base_table="to_base", name="target_name", c_field="c_ext", c_field_n="c_ext_n"), ["to_place", "to_base", "target_name"], "left")
    r = r.join(_renamed(by_id, kind="target_kind", fm_id="target_fm_id"), ["file_id", "target_kind", "target_fm_id"], "left")
    r = r.join(_renamed(by_name, kind="target_kind", name="target_name"), ["file_id", "target_kind", "target_name"], "left")
    far_id = _renamed(_lookup(e, ["file_id", "kind", "fm_id"], "c_far_id"), file_id="named_place", kind="target_kind", fm_id="target_fm_id")
    far_name = _renamed(_lookup(e, ["file_id", "kind", "name"], "c_far_name"), file_id="named_place", kind="target_kind", name="target_name")
    r = r.join(far_id, ["named_place", "target_kind", "target_fm_id"], "left").join(far_name, ["named_place", "target_kind", "target_name"], "left")

    unqualified = F.col("target_to_name").isNull()
    by_ids = F.col("target_kind").isin(*_ID_KINDS)
    near = (
        F.when(is_field, F.when(unqualified, F.col("c_leaf")).otherwise(F.coalesce("c_field", "c_ext")))
        .when(by_ids, F.when(inside, F.coalesce("c_id", "c_name")))
        .otherwise(F.col("c_name"))
    )
    far = F.when(~inside, F.coalesce("c_far_id", "c_far_name"))
    guess = F.when(is_field, unqualified & (F.col("c_leaf_n") > 1)).when(by_ids, inside & F.col("c_id").isNull() & (F.col("c_name_n") > 1))
    return r.select(
        *[c for c in refs.columns if c not in ("target_entity_id", "ambiguous")],
        F.coalesce(near, far).alias("target_entity_id"), F.coalesce(guess.cast("int"), F.lit(0)).alias("ambiguous"),
    )


def resolution_rate(refs: DataFrame) -> DataFrame:
    """``total, resolved, percent`` (whole percent, 0 of none)."""
    n = refs.agg(F.count(F.lit(1)).alias("total"), F.count("target_entity_id").alias("resolved"))
    return n.select("total", "resolved", F.expr("100 * resolved div greatest(total, 1)").alias("percent"))
