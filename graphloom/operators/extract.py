"""From nodes of design reports to entities, raw references and searchable texts: filters, one grouped attachment pass, joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import leaf_part, to_part
from graphloom.operators.fulltext import bubbled

TEXT_CUT = 2000


def _a(name: str) -> Column:
    return F.col("attrs").getItem(name)


def _in(mark: str) -> Column:
    return F.array_contains("within", mark)


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with dense numbers from 1 in the order of (file_no, ...): ranks within a file plus the counts of the files before."""
    counts = df.groupBy("file_no").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("file_no", (F.sum("__n").over(Window.orderBy("file_no")) - F.col("__n")).alias("__b"))  # one row per file
    rank = F.row_number().over(Window.partitionBy("file_no").orderBy(*order))
    return df.withColumn("__r", rank).join(before, "file_no").withColumn(name, (F.col("__b") + F.col("__r")).cast("long")).drop("__b", "__r")


def files_of(nodes: DataFrame) -> DataFrame:
    """``file_no, file_pos, file_id, name, path``: the File elements at the top of each report."""
    f = nodes.where("tag = 'File' and parent = 'FMPReport'").select("file_no", F.col("pos").alias("file_pos"), _a("name").alias("name"), _a("path").alias("path"))
    return _numbered(f, ["file_pos"], "file_id")


def _when_last(cond: Column, value: Column) -> Column:
    """The value of the last row that fulfils the condition; null values do not count."""
    ok = cond & value.isNotNull()
    return F.max_by(F.when(ok, value), F.when(ok, F.col("pos")))


def _all(cond: Column, value: Column) -> Column:
    """The values of the rows that fulfil the condition, in document order."""
    rows = F.array_sort(F.collect_list(F.when(cond, F.struct("pos", value.alias("v")))))
    return F.transform(rows, lambda r: r["v"])


def _joined(c: str, sep: str) -> Column:
    return F.when(F.size(c) > 0, F.array_join(c, sep))


def _attachments(nodes: DataFrame) -> DataFrame:
    """``file_no, key`` (an entity's position) and everything that elements below it add to it, in one aggregation."""
    tag = F.col("tag")
    owner_is, source_is = (lambda k: F.col("owner_kind") == k), (lambda k: F.col("source_kind") == k)
    to_source = (tag.isin("Calculation", "StepText") | ((tag == "Data") & _in("TextObj") & source_is("layout_object"))) & F.col("text").isNotNull()
    to_relation = (tag.isin("LeftTable", "RightTable", "JoinPredicate") & _in("Relationship")) | ((tag == "Field") & F.col("kind").isNull() & F.col("parent").isin("LeftField", "RightField"))
    to_owner = (
        ((tag == "Bounds") & (F.col("parent") == "Object") & owner_is("layout_object")) | (tag.isin("Storage", "AutoEnter") & (F.col("parent") == "Field") & owner_is("field"))
        | ((tag == "Serial") & (F.col("parent") == "AutoEnter") & owner_is("field")) | ((tag == "Field") & (F.col("parent") == "Lookup") & _in("AutoEnter") & owner_is("field") & (_a("name") != ""))
        | (tag.isin("Source", "ShowRelated", "PrimaryField", "SecondaryField") & owner_is("value_list")) | ((tag == "Field") & F.col("parent").isin("PrimaryField", "SecondaryField") & _in("ValueList") & owner_is("value_list"))
        | ((tag == "Text") & (F.col("parent") == "CustomValues") & owner_is("value_list") & F.col("text").isNotNull()) | ((tag == "FileReference") & (F.col("parent") == "Table") & owner_is("table_occurrence") & (_a("name") != ""))
    )
    key = F.when(to_source, F.col("source")).when(to_relation, F.col("relationship_pos")).when(to_owner, F.col("owner"))
    rows = nodes.withColumn("key", key).where("key is not null")
    calc, text = tag == "Calculation", F.col("text")
    hide, tip = source_is("layout_object") & _in("HideCondition"), source_is("layout_object") & _in("ToolTip")
    auto, valid = source_is("field") & _in("AutoEnter"), source_is("field") & _in("Validation")
    place = F.when(hide, "hide").when(tip, "tip").when(auto, "auto").when(valid, "valid").otherwise("own")
    truth = lambda n: _a(n) == "True"
    whole = lambda n: F.coalesce(_a(n), F.lit("0")).try_cast("double").cast("int")
    qualified = F.concat(F.coalesce(_a("table"), F.lit("")), F.lit("::"), F.coalesce(_a("name"), F.lit("")))
    bounds = F.concat(*[x for i, n in enumerate(("top", "left", "bottom", "right")) for x in ([F.lit(",")] if i else []) + [whole(n).cast("string")]])
    field_in = lambda slot: (tag == "Field") & (F.col("parent") == slot)
    options = F.struct(truth("show").alias("show"), truth("sort").alias("sort"))
    side = F.struct(F.when(tag == "LeftTable", "left").otherwise("right").alias("side"), _a("name").alias("to"), F.coalesce(truth("cascadeCreate"), F.lit(False)).alias("cascade_create"), F.coalesce(truth("cascadeDelete"), F.lit(False)).alias("cascade_delete"))
    g = rows.groupBy("file_no", "key").agg(
        _all(calc & (place == "own"), text).alias("calc"), _all(calc & (place == "auto"), text).alias("auto_calc"), _all(calc & (place == "valid"), text).alias("valid_calc"),
        _when_last(calc & (place == "hide"), text).alias("hide"), _when_last(calc & (place == "tip"), text).alias("tip"), _when_last(tag == "StepText", text).alias("step_text"),
        _all(tag == "Data", text).alias("runs"), _when_last(tag == "Bounds", bounds).alias("bounds"), _when_last(tag == "Storage", F.col("attrs")).alias("storage"),
        _when_last(tag == "AutoEnter", F.col("attrs")).alias("auto"), _when_last(tag == "Serial", F.col("attrs")).alias("serial"), _when_last(field_in("Lookup"), qualified).alias("lookup_source"),
        _when_last(tag == "Source", _a("value")).alias("vl_source"), _when_last(tag == "ShowRelated", _a("value")).alias("vl_related"), _all(tag == "Text", text).alias("vl_text"),
        *[_when_last(field_in(s), qualified).alias(f"{s}_name") for s in ("PrimaryField", "SecondaryField")], *[_when_last(tag == s, options).alias(f"{s}_opt") for s in ("PrimaryField", "SecondaryField")],
        _when_last(tag == "FileReference", _a("name")).alias("ext_file"), _all(tag.isin("LeftTable", "RightTable"), side).alias("sides"), _all(tag == "JoinPredicate", F.coalesce(F.nullif(_a("type"), F.lit("")), F.lit("Equal"))).alias("ops"),
        _all(field_in("LeftField"), qualified).alias("lefts"), _all(field_in("RightField"), qualified).alias("rights"),
    )
    return g.withColumns({"calc_text": _joined("calc", "\n"), "auto_calc": _joined("auto_calc", "\n"), "valid_calc": _joined("valid_calc", "\n"), "runs": _joined("runs", " ")}).drop("calc")


def _json_or_null(s: Column) -> Column:
    return F.nullif(F.to_json(s), F.lit("{}"))


def _slot(name: str) -> Column:
    opt = F.col(f"{name}_opt")
    show, sort = F.coalesce(opt["show"], F.when(opt.isNotNull(), F.lit(False))), F.coalesce(opt["sort"], F.when(opt.isNotNull(), F.lit(False)))
    return F.when(F.col(f"{name}_name").isNotNull(), F.struct(F.col(f"{name}_name").alias("field"), show.alias("show"), sort.alias("sort")))


def entities_of(nodes: DataFrame) -> DataFrame:
    """All entities with ``file_no, pos, end_pos, body_parts`` beside the public columns; ids are dense in document order over all files."""
    e = _numbered(nodes.where("kind is not null"), ["pos"], "entity_id").drop("text")
    ids = e.select("file_no", F.col("pos").alias("key"), "entity_id", F.col("attrs")["name"].alias("key_name"))
    ref = lambda key, **cols: ids.select("file_no", F.col("key").alias(key), *[F.col(c).alias(n) for n, c in cols.items()])
    e = e.join(ref("owner", parent_entity_id="entity_id"), ["file_no", "owner"], "left").join(ref("table_pos", table_name="key_name"), ["file_no", "table_pos"], "left").join(ref("group_pos", grp="key_name"), ["file_no", "group_pos"], "left")
    e = e.join(files_of(nodes).select("file_no", "file_pos", "file_id"), ["file_no", "file_pos"], "left")
    x = e.join(_attachments(nodes).withColumnRenamed("key", "pos"), ["file_no", "pos"], "left")

    kind = F.col("kind")
    is_ = lambda k: kind == k
    step = F.when(is_("script_step") & F.col("script_pos").isNotNull(), F.sum(is_("script_step").cast("int")).over(Window.partitionBy("file_no", "script_pos").orderBy("pos")))
    ends = F.array_join(F.transform("sides", lambda s: s["to"]), " :: ")
    name = F.when(is_("relationship"), F.nullif(ends, F.lit(""))).when(is_("layout_object"), F.nullif(_a("name"), F.lit(""))).otherwise(_a("name"))
    has_sides, has_ops = F.coalesce(F.size("sides") > 0, F.lit(False)), F.coalesce(F.size("ops") > 0, F.lit(False))
    predicates = F.transform("ops", lambda op, i: F.struct(op.alias("op"), F.get("lefts", i).alias("left"), F.get("rights", i).alias("right")))
    values = F.flatten(F.transform("vl_text", lambda t: F.filter(F.split(t, "\n"), lambda v: v != "")))
    has_text = F.coalesce(F.size("vl_text") > 0, F.lit(False))
    listed = is_("value_list") & (F.coalesce(F.col("vl_source") != "", F.lit(False)) | has_text | F.col("PrimaryField_name").isNotNull() | F.col("SecondaryField_name").isNotNull())
    extra = _json_or_null(F.struct(
        F.when(is_("layout_object"), _a("type")).alias("object_type"), F.when(is_("layout_object"), _a("key")).alias("key"),
        F.when(is_("custom_function"), _a("parameters")).alias("parameters"), F.when(is_("custom_function"), _a("functionArity")).alias("arity"),
        F.when(is_("relationship") & has_sides, F.col("sides")).alias("sides"), F.when(is_("relationship") & has_ops, predicates).alias("predicates"),
        F.when(listed, F.nullif("vl_source", F.lit(""))).alias("source"), F.when(listed, F.col("vl_related") == "True").alias("show_related"), F.when(listed, _slot("PrimaryField")).alias("primary"),
        F.when(listed, _slot("SecondaryField")).alias("secondary"), F.when(listed & has_text, values).alias("custom_values"),
        F.when(is_("script_step") & (_a("enable") == "False"), F.lit(True)).alias("disabled"), F.when(is_("field"), F.col("valid_calc")).alias("validation_calc"),
        F.when(is_("layout_object"), F.col("hide")).alias("hide_calc"), F.when(is_("layout_object"), F.col("tip")).alias("tooltip_calc"), F.when(is_("layout_object"), F.col("bounds")).alias("bounds"),
        F.when(is_("layout_object"), F.substring("runs", 1, TEXT_CUT)).alias("text"), F.col("step_text").alias("step_text"),
    ))
    auto = lambda n: F.col("auto").getItem(n)
    serial = lambda n: F.col("serial").getItem(n).alias(n)
    entered = _json_or_null(F.struct(
        F.col("auto_calc").alias("calc"), F.when(F.col("auto_calc").isNotNull(), F.coalesce(auto("calculation") == "True", F.lit(False))).alias("calc_active"), F.nullif(auto("value"), F.lit("")).alias("type"),
        F.when(F.col("serial").isNotNull(), F.struct(serial("increment"), serial("nextValue"), serial("generate"))).alias("serial"), F.col("lookup_source").alias("lookup_source"),
        F.when(F.col("lookup_source").isNotNull(), F.coalesce(auto("lookup") == "True", F.lit(False))).alias("lookup_active"), F.when(auto("lookup") == "True", F.lit(True)).alias("lookup"),
        (auto("alwaysEvaluate") == "True").alias("always_evaluate"), (auto("overwriteExistingValue") == "True").alias("overwrite_existing"),
        F.when(auto("allowEditing") == "False", F.lit(True)).alias("prohibit_editing"), F.when(auto("constant") == "True", F.lit(True)).alias("constant"),
    ))
    stored = F.when(F.col("storage").isNotNull(), F.when(F.col("storage")["storeCalculationResults"] == "False", 0).otherwise(1))
    return x.select(
        "file_no", "pos", "end_pos", "entity_id", F.coalesce("file_id", F.lit(0)).cast("long").alias("file_id"), "kind", _a("id").alias("fm_id"), name.alias("name"), "parent_entity_id",
        F.when(is_("field"), F.col("table_name")).when(is_("table_occurrence"), _a("baseTable")).alias("base_table"), _a("dataType").alias("data_type"), _a("fieldType").alias("field_type"), "calc_text",
        F.when(is_("script_step"), _a("name")).alias("step_type"), step.cast("int").alias("seq"), "grp", F.when(is_("base_table") & _a("records").rlike("^[0-9]+$"), _a("records").try_cast("long")).alias("records"), "ext_file",
        extra.alias("extra_json"), F.when(is_("field"), stored).alias("stored"), F.when(is_("field"), F.col("storage")["index"]).alias("indexed"),
        F.when(is_("field"), F.when(F.col("storage")["global"] == "True", 1).when(F.col("storage")["global"] == "False", 0)).alias("is_global"), F.when(is_("field"), entered).alias("auto_enter"),
        F.concat_ws(" ", name, F.when(is_("layout_object"), _a("type")), "calc_text", "step_text", "hide", "tip", "auto_calc", "valid_calc", "runs", F.nullif(F.array_join(values, " "), F.lit(""))).alias("own_text"),
        (is_("script_step") & (_a("enable") == "False")).alias("is_off"),
    )


def refs_of(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Raw references, without targets, numbered densely in the order in which they end (texts) or begin (elements)."""
    n = nodes.where("kind is null and not separator")
    tag, parent = F.col("tag"), F.col("parent")
    where_calc = F.when(_in("AutoEnter"), "auto_enter").when(_in("Validation"), "validation").otherwise("calc")
    none = F.lit(None).cast("string")
    qualified = F.concat(F.coalesce(_a("table"), F.lit("")), F.lit("::"), F.coalesce(_a("name"), F.lit("")))

    def rule(cond: Column, context: Column | str, target: str, name: Column, fm_id: Column = none, to: Column = none, raw: Column | None = None, at: str = "pos", event: Column = none, off: Column | None = None) -> DataFrame:
        return n.where(cond).select(
            "file_no", "file_pos", "pos", F.col(at).alias("at"), "source", "source_kind", "step_pos", "dead", (F.lit(context) if isinstance(context, str) else context).alias("context"), F.lit(target).alias("target_kind"),
            fm_id.alias("target_fm_id"), name.alias("target_name"), to.alias("target_to_name"), (name if raw is None else raw).alias("target_raw"), event.alias("trigger_event"), "owner",
            (F.lit(None).cast("boolean") if off is None else off).alias("off"), (tag == "Field").alias("is_field_element"),
        )

    by_attrs = dict(name=_a("name"), fm_id=_a("id"))
    fired = _in("WindowTriggers") | _in("ScriptTriggers") | (parent == "Trigger")
    named_script = F.coalesce(_a("name") != "", F.lit(False)) | F.coalesce(~_a("id").isin("0", ""), F.lit(False))
    pointing = F.when(parent == "Chunk", where_calc).when(parent == "Step", "step_target").when(parent.isin("PrimaryField", "SecondaryField"), F.when(_in("ValueList"), "value_list_field").otherwise("sort")).otherwise("join_predicate")
    text = F.col("text")
    has_leaf = leaf_part(text) != ""
    parts = [
        rule(tag == "Layout", "go_to_layout", "layout", **by_attrs),
        rule((tag == "ValueList") & (_a("name") != ""), "value_list_source", "value_list", **by_attrs),
        rule(tag == "FieldReference", F.when(_in("Layout"), "layout_object").otherwise("field_reference"), "field", leaf_part(_a("name")), _a("id"), to_part(_a("name")), _a("name")),
        rule(tag == "TableOccurrenceReference", "to_reference", "table_occurrence", **by_attrs),
        rule((tag == "Field") & (parent == "Lookup") & _in("AutoEnter") & (_a("name") != ""), "lookup", "field", _a("name"), _a("id"), _a("table"), qualified, off=F.lit(True)),
        rule((tag == "Field") & parent.isin("LeftField", "RightField", "Chunk", "PrimaryField", "SecondaryField", "Step"), pointing, "field", _a("name"), _a("id"), _a("table"), qualified),
        rule(tag.isin("LeftTable", "RightTable") & _in("Relationship"), "join_predicate", "table_occurrence", _a("name")),
        rule((tag == "Script") & ~F.coalesce(parent.isin("Group", "ScriptCatalog"), F.lit(False)) & named_script, F.when(fired, "trigger").otherwise("perform_script"), "script", event=F.when(fired, F.when(_in("WindowTriggers"), parent).otherwise(F.col("event"))), **by_attrs),
        rule((tag == "Name") & (parent == "FieldObj") & has_leaf, "layout_object", "field", leaf_part(text), to=to_part(text), raw=text, at="end_pos"),
        rule((tag == "Chunk") & (_a("type") == "CustomFunctionRef") & text.isNotNull(), "function_ref", "custom_function", text, at="end_pos"),
        rule((tag == "Chunk") & (_a("type") == "FieldRef") & has_leaf, where_calc, "field", leaf_part(text), to=to_part(text), raw=text, at="end_pos"),
    ]
    r = reduce(DataFrame.unionByName, parts)
    # a file marker inside the same step, before the reference, moves script and layout targets to that file
    marks = n.where((tag == "FileReference") & (parent == "Step") & (_a("name") != "")).select("file_no", F.col("parent_pos").alias("step_pos"), F.struct(F.col("pos").alias("p"), _a("name").alias("file")).alias("m")).groupBy("file_no", "step_pos").agg(F.array_sort(F.collect_list("m")).alias("marks"))
    last = F.element_at(F.filter("marks", lambda m: m["p"] < F.col("pos")), -1)["file"]
    looks = nodes.where("tag = 'AutoEnter' and owner_kind = 'field' and parent = 'Field'").groupBy("file_no", "owner").agg(F.max_by(_a("lookup"), "pos").alias("lookup_on"))
    e = entities.select("file_no", F.col("pos").alias("source"), F.col("entity_id").alias("source_entity_id"), F.col("kind").alias("s_kind"), "is_off")
    r = r.join(marks, ["file_no", "step_pos"], "left").join(looks, ["file_no", "owner"], "left").join(e, ["file_no", "source"], "left").join(files_of(nodes).select("file_no", "file_pos", "file_id"), ["file_no", "file_pos"], "left")
    lookup_off = F.coalesce(F.col("lookup_on") != "True", F.lit(True))
    dead = F.coalesce(F.col("is_off"), F.lit(False)) | F.when(F.col("off").isNotNull(), lookup_off).otherwise(F.col("dead"))
    return _numbered(r, ["at", "pos"], "ref_id").select(
        "ref_id", F.coalesce("file_id", F.lit(0)).cast("long").alias("file_id"), "source_entity_id", F.col("s_kind").alias("source_kind"), "context", "target_kind", "target_fm_id", "target_name", "target_to_name", "target_raw",
        F.when(F.col("target_kind").isin("script", "layout"), last).alias("target_file"), F.lit(None).cast("long").alias("target_entity_id"), F.lit(0).alias("ambiguous"), dead.cast("int").alias("disabled"), "trigger_event",
    )


def texts_of(entities: DataFrame) -> DataFrame:
    """``entity_id, file_id, kind, name, body``: each entity's text; layouts and objects also hold the texts of all objects below, in document order."""
    texts = entities.select("entity_id", "file_id", "kind", F.coalesce("name", F.lit("")).alias("name"), "parent_entity_id", F.col("own_text").alias("own"))
    return bubbled(texts).select("entity_id", "file_id", "kind", "name", "body").where(F.trim("body") != "")
