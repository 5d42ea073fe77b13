"""Record operations of scripts with a context clue and a confidence tier: the state machine as window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import json_field
from graphloom.operators.graph import Graph

# Names of script steps by what they do.
CREATES = ("New Record/Request", "Duplicate Record/Request", "Import Records")
DELETES = ("Delete Record/Request", "Delete All Records", "Delete Portal Row", "Truncate Table")
FIND_ON = ("Enter Find Mode", "Modify Last Find")
FIND_OFF = ("Perform Find", "Enter Browse Mode", "Constrain Found Set", "Extend Found Set", "Show All Records")
OPENS, CLOSES, BRANCHES = ("If", "Loop"), ("End If", "End Loop"), ("Else", "Else If")
LAYOUT_SUFFIX = r"\(([A-Za-z0-9_ .\x{2022}-]+)\)\s*\]\s*$"
TABLE_NAMED = r'Table:\s*[\x{201c}"]([^\x{201d}"]+)[\x{201d}"]'

# What is said of an operation.
NOTE_NAMED, NOTE_CALLER = "table named in the step", "context set by caller"
NOTE_PORTAL, NOTE_IMPORT = "portal row: layout context is NOT the target table", "import target set by its field mapping (not in DDR text)"
NOTE_MAYBE, NOTE_RELATED = "conditional context", " (via Go to Related Record)"


def script_steps(g: Graph) -> DataFrame:
    """``script_id, entity_id, seq, step_type, step_text, flagged`` of the steps whose parent is a script."""
    scripts = g.kind("script").select(F.col("entity_id").alias("script_id"))
    s = g.kind("script_step").select(
        F.col("parent_entity_id").alias("script_id"), "entity_id", "seq", "step_type", json_field("extra_json", "$.step_text").alias("step_text"),
        F.coalesce(json_field("extra_json", "$.disabled", "boolean"), F.lit(False)).alias("flagged"),
    )
    return s.join(scripts, "script_id", "left_semi")


def record_ops(steps: DataFrame) -> DataFrame:
    """``script_id, entity_id, seq, op, step_type, tier, context, note, state`` of each step that creates or deletes records.

    Steps act on the layout that the last Go to Layout or Go to Related Record went to, as far as its text names a table occurrence;
    the clue is conditional once its block has closed or another branch runs instead. Depth is a running sum clamped at
    zero, find mode the last switch, the context the last change of layout, and "has its block closed since" a running minimum
    over the steps since then: all windows over one script in document order (entity_id), sorted once. Disabled steps
    change nothing but are listed. Nothing is dropped; a null step_type is no operation, a null step_text names nothing.
    """
    doc = Window.partitionBy("script_id").orderBy("entity_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.coalesce("step_text", F.lit(""))
    # U+2022 and curly quotes stand in the patterns as escapes
    named = F.regexp_extract(F.trim(text), LAYOUT_SUFFIX, 1)
    s = steps.withColumn("dead", F.col("flagged") | F.ltrim(text).startswith("//")).withColumn("st", F.when(~F.col("dead"), F.col("step_type")))
    is_in = lambda names: F.coalesce(F.col("st").isin(*names), F.lit(False))
    s = s.withColumn("move", F.when(is_in(OPENS), 1).when(is_in(CLOSES), -1).otherwise(0)).withColumn("raw", F.sum("move").over(doc))
    s = s.withColumn("depth", F.col("raw") - F.least(F.lit(0), F.min("raw").over(doc)))
    s = s.withColumn("find", F.coalesce(F.last(F.when(is_in(FIND_ON), True).when(is_in(FIND_OFF), False), ignorenulls=True).over(doc), F.lit(False)))
    related = F.coalesce(F.col("st").startswith("Go to Related"), F.lit(False))
    goes = (F.coalesce(F.col("st") == "Go to Layout", F.lit(False))) | related
    s = s.withColumn("ctx", F.sum(goes.cast("int")).over(doc)).withColumn("goes", F.when(goes, F.struct(F.when(named != "", named).alias("to"), F.col("depth").alias("set"), related.alias("related"))))
    s = s.withColumn("at", F.last("goes", ignorenulls=True).over(doc))
    since = Window.partitionBy("script_id", "ctx").orderBy("entity_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("closed", F.min(F.when(is_in(CLOSES), F.col("depth"))).over(since)).withColumn("branched", F.min(F.when(is_in(BRANCHES), F.col("depth"))).over(since))
    clue = F.col("at.to")
    maybe = F.coalesce(F.col("closed") < F.col("at.set"), F.lit(False)) | F.coalesce(F.col("branched") <= F.col("at.set"), F.lit(False)) | F.col("at.related")
    table_named = F.regexp_extract(text, TABLE_NAMED, 1)
    step, truncates = F.col("step_type"), (F.col("step_type") == "Truncate Table") & (table_named != "")
    tier = F.when(truncates, "confident").when(step.isin("Delete Portal Row", "Import Records") | clue.isNull() | maybe, "check").otherwise("likely")
    note = (
        F.when(truncates, NOTE_NAMED).when(step == "Delete Portal Row", NOTE_PORTAL)
        .when(step == "Import Records", NOTE_IMPORT).when(clue.isNull(), NOTE_CALLER)
        .when(maybe, F.concat(F.lit(NOTE_MAYBE), F.when(F.col("at.related"), F.lit(NOTE_RELATED)).otherwise(F.lit(""))))
    )
    ops = s.where(step.isin(*CREATES, *DELETES))
    return ops.select(
        "script_id", "entity_id", "seq", F.when(step.isin(*CREATES), "create").otherwise("delete").alias("op"), "step_type", tier.alias("tier"),
        F.when(truncates, table_named).otherwise(clue).alias("context"), note.alias("note"), F.when(F.col("dead"), "disabled").when(F.col("find"), "find").otherwise("live").alias("state"),
    )
