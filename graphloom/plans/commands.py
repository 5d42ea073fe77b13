"""Analyses in several steps: where-used, investigation of a script, mutations, trigger map, value lists, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import Stages
from graphloom.functions.text import json_field, like_ci, parsed
from graphloom.operators.closure import call_edges, chains, closure, next_hops, reach_parts, writable_inputs
from graphloom.operators.graph import Graph
from graphloom.operators.recordops import record_ops, script_steps

# Kinds that a bare name is looked up in.
NAMED_KINDS = ("field", "script", "layout", "table_occurrence", "custom_function", "value_list", "base_table")
TIERS = ("confident", "likely", "check")


def targets(g: Graph, term: str) -> DataFrame:
    """``entity_id, kind, label``: with ``::``, the fields of that name in the base table of that occurrence, in every file that has one; else
    the entities of exactly that name."""
    if "::" in term:
        to, leaf = term.split("::", 1)
        base = g.kind("table_occurrence").where(F.col("name") == to).groupBy("file_id").agg(F.min(F.struct("entity_id", "base_table"))["base_table"].alias("base_table"))
        return g.kind("field").where(F.col("name") == leaf).join(base, ["file_id", "base_table"]).select("entity_id", "kind", F.concat_ws("::", "base_table", "name").alias("label"))
    label = F.when(F.col("kind") == "field", F.concat_ws("::", "base_table", "name")).otherwise(F.col("name"))
    return g.entities_where((F.col("name") == term) & F.col("kind").isin(*NAMED_KINDS)).select("entity_id", "kind", label.alias("label"))


def where_used(g: Graph, term: str) -> DataFrame:
    """Live usages of each entity that the term names, per entity; an entity without any keeps one row with a null context."""
    u = g.usage("target_entity_id is not null").select(F.col("target_id").alias("entity_id"), "context", "source_kind", "source_parent_name", "source_name", "ambiguous")
    return targets(g, term).join(u, "entity_id", "left")


def mutations(g: Graph, like: str | None = None) -> DataFrame:
    """Record operations of all scripts with the script's name; ``like`` keeps those whose script name or context contains it, in any case."""
    scripts = g.kind("script").select(F.col("entity_id").alias("script_id"), F.col("name").alias("script_name"))
    ops = record_ops(script_steps(g)).join(scripts, "script_id")
    if like:
        ops = ops.where(F.contains(F.lower(F.concat_ws(" ", "script_name", "context")), F.lit(like.lower())))
    return ops.withColumn("tier_rank", F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")).cast("int") - 1)


def launch_sites(g: Graph) -> DataFrame:
    """``script_id, source_id, source_kind, source_name, context, layout_name, step_text, hide_calc``: layouts and objects that start a script, dead references included."""
    e = g.entities_where("kind in ('layout', 'layout_object')").select(F.col("entity_id").alias("source_id"), F.col("kind").alias("source_kind"), F.col("name").alias("source_name"), parsed("extra_json").alias("x"))
    r = g.refs_where("context in ('perform_script', 'trigger') and target_kind = 'script' and target_entity_id is not null").select(F.col("target_entity_id").alias("script_id"), F.col("source_entity_id").alias("source_id"), "context").distinct()
    lay = g.owning_layouts().join(g.kind("layout").select(F.col("entity_id").alias("layout_id"), F.col("name").alias("layout_name")), "layout_id").select(F.col("entity_id").alias("source_id"), "layout_name")
    get = lambda p, n: F.substring(F.try_variant_get("x", p, "string"), 1, n)
    return r.join(e, "source_id").join(lay, "source_id", "left").select("script_id", "source_id", "source_kind", "source_name", "context", "layout_name", get("$.step_text", 2000).alias("step_text"), get("$.hide_calc", 300).alias("hide_calc"))


def global_hygiene(g: Graph) -> DataFrame:
    """``var, writes, other_mentions``: the ``$$`` variables that steps set, the steps that set each, and the other steps that mention it by its whole name.

    Both counts come from one pass that takes every variable out of each step's text; nothing is compared pair by pair.
    """
    text = script_steps(g).select("entity_id", "step_text").where(F.contains("step_text", F.lit("$$")))
    var = r"\$\$[\p{L}\p{N}_.]+"
    named = text.select("entity_id", "step_text", F.explode(F.array_distinct(F.regexp_extract_all("step_text", F.lit(f"({var})"), 1))).alias("var"))
    writes = F.col("step_text").startswith("Set Variable [ $$") & (F.regexp_extract("step_text", rf"^Set Variable \[ ({var})", 1) == F.col("var"))
    return named.groupBy("var").agg(F.count_if(writes).alias("writes"), F.count_if(~writes).alias("other_mentions")).where("writes > 0")


def investigate(g: Graph, script: str) -> dict[str, DataFrame]:
    """What there is to know of the scripts of that name or FileMaker id, in sections: callers, launch_sites, callees, record_ops, chain, body.

    chain holds the record operations of everything that the scripts reach, each with its distance. Without an exact match, names
    that contain the text are taken.
    """
    own = g.kind("script").where((F.col("name") == script) | (F.col("fm_id") == script))
    if own.isEmpty():
        own = g.kind("script").where(like_ci(F.col("name"), f"%{script}%"))
    ids = own.select(F.col("entity_id").alias("script_id"))
    u = g.usage("target_entity_id is not null")
    callers = u.join(ids, u.target_id == ids.script_id).groupBy("script_id", "context", "source_kind", "source_parent_name", "source_name").agg(F.count(F.lit(1)).alias("n"))
    steps = script_steps(g)
    mine = steps.join(ids, "script_id", "left_semi")
    calls = g.usage("context = 'perform_script'").join(mine.select(F.col("entity_id").alias("source_id"), "script_id"), "source_id").select("script_id", "target_name").distinct()
    reach = closure(call_edges(g), ids)
    ops = record_ops(steps.join(reach.select(F.col("node").alias("script_id")).distinct(), "script_id", "left_semi"))
    names = g.kind("script").select(F.col("entity_id").alias("script_id"), F.col("name").alias("script_name"))
    chain = reach.select("root", F.col("node").alias("script_id"), "depth").join(ops, "script_id").join(names, "script_id")
    return {
        "scripts": own.select("entity_id", "file_id", "fm_id", "name", "grp"), "callers": callers, "launch_sites": launch_sites(g).join(ids, "script_id", "left_semi"), "callees": calls,
        "record_ops": record_ops(mine), "chain": chain, "body": mine.orderBy("script_id", "entity_id"),
    }


def chain_rollup(g: Graph) -> DataFrame:
    """For every script: ``script_id, n_scripts, n_deletes, n_creates, n_other`` over all scripts that it reaches, itself included (live operations; others apart)."""
    rest, members = reach_parts(call_edges(g), g.kind("script").select("entity_id"))
    per = record_ops(script_steps(g)).groupBy(F.col("script_id").alias("node")).agg(
        F.count_if((F.col("op") == "delete") & (F.col("state") == "live")).alias("d"), F.count_if((F.col("op") == "create") & (F.col("state") == "live")).alias("c"), F.count_if(F.col("state") != "live").alias("o")
    )
    per = Stages(g.refs.sparkSession, "rollup").put(per, "per")
    sums = lambda end: [F.count("node").alias(f"s{end}"), *[F.coalesce(F.sum(x), F.lit(0)).alias(f"{x}{end}") for x in "dco"]]
    own = rest.join(per, "node", "left").groupBy("root").agg(F.max("hub").alias("hub"), *sums(""))
    by_hub = members.join(per, "node", "left").groupBy("hub").agg(*sums("_hub"))
    rows = own.join(F.broadcast(by_hub), "hub", "left")  # as many rows as there are hubs, a few
    return rows.select(F.col("root").alias("script_id"), *[(F.col(x) + F.coalesce(f"{x}_hub", F.lit(0))).alias(n) for x, n in (("s", "n_scripts"), ("d", "n_deletes"), ("c", "n_creates"), ("o", "n_other"))])


def value_lists(g: Graph, pattern: str = "%") -> DataFrame:
    """Definition and number of live bindings of the value lists whose name is LIKE the pattern, in any case."""
    x = lambda p, k="string": F.try_variant_get("x", p, k)
    rows = g.kind("value_list").where(like_ci(F.col("name"), pattern)).select("entity_id", "name", parsed("extra_json").alias("x"))
    bound = g.refs_where("disabled = 0 and target_entity_id is not null").groupBy(F.col("target_entity_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(bound, "entity_id", "left").select(
        "entity_id", "name", x("$.source").alias("source"), x("$.primary.field").alias("primary_field"), x("$.secondary.field").alias("secondary_field"), x("$.show_related").alias("show_related"),
        F.size(F.coalesce(x("$.custom_values", "array<string>"), F.array().cast("array<string>"))).alias("n_values"), F.coalesce("n", F.lit(0).cast("long")).alias("bound"),
    )


def field_ids(g: Graph, names: list[str], must_exist: bool = True) -> DataFrame:
    """``entity_id`` of fields given as ``BaseTable::Field``; a name without a table is an error, and so is an unknown field, unless not ``must_exist``: it gives no row."""
    pairs = [n.split("::", 1) for n in names]
    if bad := [n for n, p in zip(names, pairs) if len(p) != 2]:
        raise ValueError(f"not of the form BaseTable::Field: {', '.join(bad)}")
    wanted = g.refs.sparkSession.createDataFrame(pairs, "base_table string, name string").distinct()
    found = g.kind("field").join(F.broadcast(wanted), ["base_table", "name"])  # as many rows as names were given
    if not must_exist:
        return found.select("entity_id")
    known = {(r.base_table, r.name) for r in found.select("base_table", "name").distinct().collect()}
    if missing := ["::".join(p) for p in pairs if tuple(p) not in known]:
        raise ValueError(f"unknown fields: {', '.join(missing)}")
    return found.select("entity_id")


def mutating_scripts(g: Graph, inputs: list[str], table: str | None = None, contains: bool = False, must_exist: bool = True) -> DataFrame:
    """``script_id, what``: scripts with a live step that targets a field behind the inputs, and with ``table`` those with a live record operation there."""
    fields = writable_inputs(g, field_ids(g, inputs, must_exist)).select("field_id").distinct()
    steps = script_steps(g)
    owner = steps.select(F.col("entity_id").alias("source_entity_id"), "script_id")
    writes = g.refs_where("context = 'step_target' and disabled = 0").join(fields, F.col("target_entity_id") == F.col("field_id")).join(owner, "source_entity_id")
    mutators = writes.select("script_id", F.concat(F.lit("writes "), F.coalesce("target_raw", "target_name")).alias("what"))
    if table:
        ops, clue = record_ops(steps).where("state = 'live'"), F.lower("context")
        ops = ops.where(F.contains(clue, F.lit(table.lower())) if contains else clue == table.lower())
        mutators = mutators.unionByName(ops.select("script_id", F.concat_ws(" ", "step_type", F.lit("on"), "context").alias("what")))
    return mutators


def entry_points(g: Graph) -> DataFrame:
    """``entity_id, n_launch_sites, called``: scripts that layouts or their objects start, and scripts that no script calls."""
    sites = launch_sites(g).groupBy(F.col("script_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    callees = call_edges(g).select(F.col("callee").alias("entity_id")).distinct().withColumn("called", F.lit(1))
    rows = g.kind("script").select("entity_id").join(sites, "entity_id", "left").join(callees, "entity_id", "left").where("n is not null or called is null")
    return rows.select("entity_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_launch_sites"), F.coalesce("called", F.lit(0)).alias("called"))


def trigger_map(g: Graph, inputs: list[str], table: str | None = None, recompute: str | None = None, contains: bool = False, must_exist: bool = True) -> DataFrame:
    """``script_id, script_name, depth, evidence, chain, n_launch_sites, verdict``: every entry point from which a script is reached that writes the inputs.

    Calculated inputs are expanded to the fields they are calculated from. Mutators are scripts with a live step that targets such a
    field, and with ``table`` those with a live record operation in that context (exactly, or containing it). Entry points are the
    scripts that lead there and are started from a layout or called by no script; with ``recompute`` the verdict says whether that
    script is in their reach. The chain follows a shortest way, the smallest id on ties. Unknown inputs are an error; if not
    ``must_exist``, nothing writes them and they add no rows, as in SQL.
    """
    names = g.kind("script").select(F.col("entity_id").alias("node"), "name")
    mutators = mutating_scripts(g, inputs, table, contains, must_exist)
    evidence = mutators.groupBy(F.col("script_id").alias("target")).agg(F.min("what").alias("evidence"))
    edges = call_edges(g)
    hops = next_hops(edges, evidence.select("target"))
    sites = launch_sites(g).groupBy(F.col("script_id").alias("node")).agg(F.count(F.lit(1)).alias("n_launch_sites"))
    called = edges.select(F.col("callee").alias("node")).distinct().withColumn("called", F.lit(True))
    entries = hops.join(sites, "node", "left").join(called, "node", "left").where("n_launch_sites is not null or called is null")
    rows = entries.join(chains(hops, names), "node").join(evidence, "target").join(names, "node")
    verdict = F.lit("")
    if recompute:
        target = g.kind("script").where(F.col("name") == recompute).select("entity_id")
        if target.isEmpty():
            raise ValueError(f"no script named {recompute}")
        to = next_hops(edges, target).select("node", F.lit(True).alias("covered"))
        rows = rows.join(to, "node", "left")
        verdict = F.when(F.col("covered"), "recompute-in-chain").otherwise("NO RECOMPUTE - gap candidate")
    return rows.select(F.col("node").alias("script_id"), F.col("name").alias("script_name"), "depth", "evidence", "chain", F.coalesce("n_launch_sites", F.lit(0).cast("long")).alias("n_launch_sites"), verdict.alias("verdict"))


def quiet_triggers(g: Graph, layouts: str, inputs: list[str], table: str | None = None) -> DataFrame:
    """Triggers on the layouts LIKE the pattern whose script leads to no script that writes the inputs, or isn't resolved."""
    hops = next_hops(call_edges(g), mutating_scripts(g, inputs, table).select("script_id").distinct())
    ids = g.refs_where("context = 'trigger'").select("ref_id", F.col("target_entity_id").alias("node"))
    rows = g.triggers().where(like_ci(F.col("layout_name"), layouts)).join(ids, "ref_id")
    return rows.join(hops.select("node"), "node", "left_anti").drop("node")


def stats(g: Graph) -> DataFrame:
    """``item, n``: entities by kind, references, resolved and disabled ones, and the resolved share in whole percent."""
    kinds = g.entities.groupBy(F.concat(F.lit("kind "), "kind").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    r = g.refs.agg(F.count(F.lit(1)).alias("refs"), F.count("target_entity_id").alias("resolved"), F.count_if(F.col("disabled") == 1).alias("disabled"))
    r = r.withColumn("percent", F.expr("100 * resolved div greatest(refs, 1)"))
    return kinds.unionByName(r.select(F.expr("stack(4, 'refs', refs, 'refs resolved', resolved, 'refs disabled', disabled, 'percent resolved', percent) as (item, n)")))
