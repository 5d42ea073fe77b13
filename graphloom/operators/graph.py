"""The property graph of entities and references, and the views over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import table
from graphloom.functions.text import int_flag, json_field
from graphloom.operators.hierarchy import ancestors

SIDES = "array<struct<side:string,to:string,cascade_create:boolean,cascade_delete:boolean>>"
PREDICATES = "array<struct<op:string,left:string,right:string>>"


@dataclass
class Graph:
    """Entities, references and files, each row once; the views are DataFrames and, after ``register``, temporary views.

    Joins on entity ids may meet targets that hold a tenth of all references: they are left to adaptive execution, which
    splits skewed partitions, and aggregations count map-side first. Null ids match nothing and keep their row.
    """

    all_entities: DataFrame
    all_refs: DataFrame
    files: DataFrame
    #: Whether each row is there once already, as in a built index.
    unique: bool = False

    @classmethod
    def load(cls, spark: SparkSession, base: str, core: bool = True) -> Graph:
        """The tables below ``base``; rows given twice count once, the shared core file's entities are included if asked for."""
        entities = table(spark, base, "entities")
        if core:
            entities = entities.unionByName(table(spark, base, "core_entities"))
        return cls(entities, table(spark, base, "refs"), table(spark, base, "files").dropDuplicates(["file_id"]))

    def _once(self, rows: DataFrame, key: str) -> DataFrame:
        return rows if self.unique else rows.dropDuplicates([key])

    @property
    def entities(self) -> DataFrame:
        return self._once(self.all_entities, "entity_id")

    @property
    def refs(self) -> DataFrame:
        return self._once(self.all_refs, "ref_id")

    def entities_where(self, condition: Column | str) -> DataFrame:
        """Entities that fulfil a condition. Equal rows pass or fail together, so it comes before they are made one and reaches the scan."""
        return self._once(self.all_entities.where(condition), "entity_id")

    def refs_where(self, condition: Column | str) -> DataFrame:
        return self._once(self.all_refs.where(condition), "ref_id")

    def kind(self, kind: str) -> DataFrame:
        return self.entities_where(F.col("kind") == kind)

    def _usage(self, disabled: int, of: Column | str | None = None) -> DataFrame:
        e = self.entities
        src = e.select(F.col("entity_id").alias("source_entity_id"), F.col("kind").alias("s_kind"), F.col("name").alias("source_name"), F.col("parent_entity_id").alias("p_id"))
        parent = e.select(F.col("entity_id").alias("p_id"), F.col("kind").alias("source_parent_kind"), F.col("name").alias("source_parent_name"))
        # the source with its parent is one row per entity: it is built before it meets the larger table of references
        source = src.join(parent, "p_id", "left").withColumn("source_id", F.col("source_entity_id"))
        target = e.select(F.col("entity_id").alias("target_entity_id"), F.col("name").alias("t_name"), F.col("entity_id").alias("target_id"))
        own = F.col("disabled") == disabled
        r = self.refs_where(own if of is None else own & (F.expr(of) if isinstance(of, str) else of)).drop("source_kind")
        joined = r.join(source, "source_entity_id", "left").join(target, "target_entity_id", "left")
        return joined.select(
            "ref_id", "context", F.col("s_kind").alias("source_kind"), "source_name", "source_id", "source_parent_kind", "source_parent_name", "target_kind",
            F.coalesce("t_name", "target_raw").alias("target_name"), "target_raw", "target_id", int_flag(F.col("target_entity_id").isNotNull()).alias("resolved"),
            "ambiguous", "target_file", "trigger_event", "file_id",
        )

    def usage(self, of: Column | str | None = None) -> DataFrame:
        """Live references with the names of source, source's parent and target; ``of`` is a condition on the references alone."""
        return self._usage(0, of)

    def usage_disabled(self) -> DataFrame:
        """The same of references in dead code."""
        return self._usage(1)

    def _unreferenced(self, kind: str, *cols: str) -> DataFrame:
        by_target = self.refs_where("target_entity_id is not null").groupBy(F.col("target_entity_id").alias("entity_id")).agg(F.max((F.col("disabled") == 0).cast("int")).alias("live"), F.max((F.col("disabled") == 1).cast("int")).alias("only_disabled_refs"))
        e = self.kind(kind).select("entity_id", "file_id", *cols).join(by_target, "entity_id", "left")
        return e.where("coalesce(live, 0) = 0").select("entity_id", "file_id", *cols, F.coalesce("only_disabled_refs", F.lit(0)).alias("only_disabled_refs"))

    def unused_fields(self) -> DataFrame:
        """Fields without a live reference: a list for review, as references in text only are not captured."""
        return self._unreferenced("field", "base_table", "name", "field_type")

    def orphan_scripts(self) -> DataFrame:
        """Scripts that no live reference calls."""
        return self._unreferenced("script", "name", "grp")

    def unused_occurrences(self) -> DataFrame:
        """Table occurrences that no reference at all points to."""
        targets = self.refs.select(F.col("target_entity_id").alias("entity_id")).where("entity_id is not null").distinct()
        return self.kind("table_occurrence").select("entity_id", "file_id", "name").join(targets, "entity_id", "left_anti")

    def owning_layouts(self) -> DataFrame:
        """``entity_id, layout_id``: for layouts and everything below one, the nearest layout at or above it. Layouts have no parents here, so a node has one at most."""
        layouts = self.kind("layout").select(F.col("entity_id").alias("layout_id"))
        links = self.kind("layout_object").select(F.col("entity_id").alias("id"), F.col("parent_entity_id").alias("up"))
        below = ancestors(links).select(F.col("id").alias("entity_id"), F.col("anc").alias("layout_id")).join(layouts, "layout_id", "left_semi")
        return layouts.select(F.col("layout_id").alias("entity_id"), "layout_id").unionByName(below.select("entity_id", "layout_id"))

    def triggers(self) -> DataFrame:
        """Live script triggers with their event and owning layout; file-level ones have no layout."""
        e = self.entities
        r = self.refs_where("context = 'trigger' and disabled = 0").select("ref_id", "trigger_event", "source_entity_id", "target_entity_id", "target_raw", "file_id")
        src = e.select(F.col("entity_id").alias("source_entity_id"), F.col("kind").alias("source_kind"), F.col("name").alias("object_name"))
        lay = self.kind("layout").select(F.col("entity_id").alias("layout_id"), F.col("name").alias("layout_name"), F.col("fm_id").alias("layout_fm_id"))
        owner = self.owning_layouts().join(lay, "layout_id").withColumnRenamed("entity_id", "source_entity_id").drop("layout_id")
        target = e.select(F.col("entity_id").alias("target_entity_id"), F.col("name").alias("t_name"), F.col("fm_id").alias("script_fm_id"))
        joined = r.join(src, "source_entity_id", "left").join(owner, "source_entity_id", "left").join(target, "target_entity_id", "left")
        return joined.select("ref_id", "trigger_event", "source_kind", "object_name", "layout_name", "layout_fm_id", F.coalesce("t_name", "target_raw").alias("script_name"), "script_fm_id", int_flag(F.col("target_entity_id").isNotNull()).alias("resolved"), "file_id")

    def cascades(self) -> DataFrame:
        """One row per relationship side with cascading deletes: deleting table to victim table."""
        rel = self.kind("relationship").select("entity_id", "name", "file_id", json_field("extra_json", "$.sides", SIDES).alias("sides"))
        pairs = rel.select("entity_id", "name", "file_id", "sides", F.explode("sides").alias("s")).where("s.cascade_delete").select("*", F.explode("sides").alias("o")).where("s.side <> o.side")
        to = self.kind("table_occurrence").groupBy("file_id", "name").agg(F.min(F.struct("entity_id", "base_table"))["base_table"].alias("base"))
        of = lambda side, table_: to.select("file_id", F.col("name").alias(side), F.col("base").alias(table_))
        rows = pairs.select(F.col("entity_id").alias("relationship_id"), F.col("name").alias("relationship"), F.col("o.to").alias("deleting_to"), F.col("s.to").alias("victim_to"), "file_id")
        return rows.join(of("victim_to", "victim_table"), ["file_id", "victim_to"], "left").join(of("deleting_to", "deleting_table"), ["file_id", "deleting_to"], "left").select(
            "relationship_id", "relationship", "deleting_to", "deleting_table", "victim_to", "victim_table", "file_id"
        )

    def unresolved(self) -> DataFrame:
        """References without a target, dead ones included, counted by target kind and context."""
        return self.refs_where("target_entity_id is null").groupBy("target_kind", "context").agg(F.count(F.lit(1)).alias("n"))

    def ambiguous(self) -> DataFrame:
        """Live references of which several candidates fitted."""
        return self.usage("ambiguous = 1")

    def register(self, spark: SparkSession) -> None:
        """All tables and views under the names that ad-hoc SQL uses."""
        views = {
            "entities": self.entities, "refs": self.refs, "files": self.files, "v_usage": self.usage(), "v_usage_disabled": self.usage_disabled(), "v_unused_fields": self.unused_fields(),
            "v_orphan_scripts": self.orphan_scripts(), "v_triggers": self.triggers(), "v_cascades": self.cascades(), "v_unresolved": self.unresolved(), "v_ambiguous": self.ambiguous(),
        }
        for name, df in views.items():
            df.createOrReplaceTempView(name)
