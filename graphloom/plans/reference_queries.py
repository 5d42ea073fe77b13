"""Queries over the graph of entities and references, and the SQL that each is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import Stages
from graphloom.functions.text import glob, json_field, like_ci, parsed
from graphloom.operators.closure import call_edges, chains, closure, field_edges, next_hops, writable_inputs
from graphloom.operators.fulltext import ACCENTED, PLAIN, lengths, matching, postings, search, text_docs
from graphloom.operators.graph import PREDICATES, Graph
from graphloom.operators.recordops import record_ops, script_steps
from graphloom.operators.resolve import resolution_rate, resolve
from graphloom.plans import commands
from graphloom.sinks.index import summary

# Names in the shared core file and the tables that the parameterised queries ask for.
FIELD, SCRIPT_LIKE, LAYOUT_LIKE, VALUE_LIST = "KB_Tariff0::g_rank", "Recount Vendor", "%Dash%", "Canvas choices"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_CTES = {
    "e": """select distinct * from entities union all select * from core_entities""",
    "r": """select distinct * from refs""",
    "f": r"""select distinct file_id, run_id, name, regexp_replace(lower(name), '\.fmp12$', '') stem from files""",
    "u": """select r.ref_id, r.context, se.kind source_kind, se.name source_name, se.entity_id source_id, sp.kind source_parent_kind, sp.name source_parent_name, r.target_kind,
  coalesce(te.name, r.target_raw) target_name, r.target_raw, te.entity_id target_id, cast(r.target_entity_id is not null as int) resolved, r.ambiguous, r.target_file, r.trigger_event, r.file_id, r.disabled
  from r left join e se on se.entity_id = r.source_entity_id left join e sp on sp.entity_id = se.parent_entity_id left join e te on te.entity_id = r.target_entity_id""",
    "steps": """select s.entity_id, p.entity_id script_id, p.name script_name, s.seq, s.step_type, case when json_valid(s.extra_json) then json_extract_string(s.extra_json, '$.step_text') end step_text,
  coalesce(case when json_valid(s.extra_json) then json_extract_string(s.extra_json, '$.disabled') end, 'false') = 'true' flagged
  from e s join e p on p.entity_id = s.parent_entity_id and p.kind = 'script' where s.kind = 'script_step'""",
    "calls": """select distinct st.parent_entity_id caller, t.entity_id callee from r join e st on st.entity_id = r.source_entity_id join e p on p.entity_id = st.parent_entity_id and p.kind = 'script'
  join e t on t.entity_id = r.target_entity_id and t.kind = 'script' where r.context in ('perform_script', 'trigger') and r.disabled = 0""",
    "needs": """select distinct r.source_entity_id field, r.target_entity_id needs, s.field_type from r join e s on s.entity_id = r.source_entity_id and s.kind = 'field' join e t on t.entity_id = r.target_entity_id and t.kind = 'field'
  where r.context in ('calc', 'auto_enter') and r.disabled = 0""",
}


def _sql(sql: str) -> str:
    """``sql`` (a query, or further expressions and a query) behind those of the common table expressions that it names."""
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in _CTES.keys() - wanted:
            if re.search(rf"\b{name}\b", text):
                wanted.add(name)
                todo.append(_CTES[name])
    return "with recursive " + ",\n".join(f"{k} as ({v})" for k, v in _CTES.items() if k in wanted) + "\n" + sql


_U = "ref_id, context, source_kind, source_name, source_id, source_parent_kind, source_parent_name, target_kind, target_name, target_raw, target_id, resolved, ambiguous, target_file, trigger_event, file_id"


def _j(path: str, of: str = "extra_json") -> str:
    return f"case when json_valid({of}) then json_extract_string({of}, '{path}') end"


def _add(name: str, plan: Callable[[Graph], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda s, d: plan(Graph.load(s, d))
    if sql is not None:
        SQL[name] = _sql(sql)


# ---- views
_add("vw1_usage", Graph.usage, f"select {_U} from u where disabled = 0")
_add("vw2_usage_disabled", Graph.usage_disabled, f"select {_U} from u where disabled = 1")
_UNREF = "(select target_entity_id t, max(cast(disabled = 0 as int)) live, max(cast(disabled = 1 as int)) dead from r group by 1) x on x.t = e.entity_id"
_add("vw3_unused_fields", Graph.unused_fields, f"select entity_id, file_id, base_table, name, field_type, coalesce(dead, 0) only_disabled_refs from e left join {_UNREF} where kind = 'field' and coalesce(live, 0) = 0")
_add("vw4_orphan_scripts", Graph.orphan_scripts, f"select entity_id, file_id, name, grp, coalesce(dead, 0) only_disabled_refs from e left join {_UNREF} where kind = 'script' and coalesce(live, 0) = 0")
_CLIMB = """, up as (select entity_id, entity_id anc, kind, parent_entity_id, 0 n from e where kind in ('layout', 'layout_object')
  union all select up.entity_id, p.entity_id, p.kind, p.parent_entity_id, n + 1 from up join e p on p.entity_id = up.parent_entity_id where up.kind = 'layout_object' and p.kind in ('layout', 'layout_object') and n < 300),
owner as (select up.entity_id, anc layout_id, l.name layout_name, l.fm_id layout_fm_id from up join e l on l.entity_id = anc where up.kind = 'layout')
"""
_add("vw5_triggers", Graph.triggers, _CLIMB + """select ref_id, trigger_event, s.kind source_kind, s.name object_name, layout_name, layout_fm_id, coalesce(t.name, target_raw) script_name, t.fm_id script_fm_id,
  cast(target_entity_id is not null as int) resolved, r.file_id from r left join e s on s.entity_id = source_entity_id left join owner o on o.entity_id = source_entity_id left join e t on t.entity_id = target_entity_id where context = 'trigger' and disabled = 0""")
_SIDES = """, rel as (select entity_id, name, file_id, from_json(json_extract(extra_json, '$.sides'), '[{"side":"VARCHAR","to":"VARCHAR","cascade_create":"BOOLEAN","cascade_delete":"BOOLEAN"}]') sides from e
  where kind = 'relationship' and json_valid(extra_json) and json_type(extra_json, '$.sides') = 'ARRAY'),
side as (select entity_id, name, file_id, unnest(sides) s from rel),
occ as (select file_id, name, arg_min(coalesce(base_table, chr(0)), entity_id) base_table from e where kind = 'table_occurrence' group by all)
"""
_add("vw6_cascades", Graph.cascades, _SIDES + """select a.entity_id relationship_id, a.name relationship, b.s."to" deleting_to, nullif(ob.base_table, chr(0)) deleting_table, a.s."to" victim_to, nullif(oa.base_table, chr(0)) victim_table, a.file_id
  from side a join side b on a.entity_id = b.entity_id and a.s.side <> b.s.side left join occ oa on oa.file_id = a.file_id and oa.name = a.s."to" left join occ ob on ob.file_id = a.file_id and ob.name = b.s."to" where a.s.cascade_delete""")
_add("vw7_unresolved", Graph.unresolved, "select target_kind, context, count(*) n from r where target_entity_id is null group by all")
_add("vw8_ambiguous", Graph.ambiguous, f"select {_U} from u where disabled = 0 and ambiguous = 1")

# ---- resolution
_RS = """, n as (select file_id, kind, name, min(entity_id) id, count(*) n from entities_once group by all), i as (select file_id, kind, fm_id, min(entity_id) id from entities_once group by all),
fi as (select file_id, base_table, name, min(entity_id) id from entities_once where kind = 'field' group by all),
occ as (select file_id, name, min(entity_id) id from entities_once where kind = 'table_occurrence' group by all),
x as (select r.ref_id, r.target_kind, r.target_to_name, r.target_file, lf.id leaf, lf.n leaf_n, a.id near, b.id ext, si.id by_id, sn.id by_name, sn.n by_name_n, gi.id far_id, gn.id far_name from r left join f on f.file_id = r.file_id
  left join occ o on o.file_id = r.file_id and o.name = r.target_to_name left join entities_once t on t.entity_id = o.id
  left join n lf on lf.file_id = r.file_id and lf.kind = 'field' and lf.name = r.target_name
  left join fi a on a.file_id = r.file_id and a.base_table = t.base_table and a.name = r.target_name
  left join f fe on fe.run_id = f.run_id and fe.stem = regexp_replace(lower(t.ext_file), '\\.fmp12$', '')
  left join fi b on b.file_id = fe.file_id and b.base_table = t.base_table and b.name = r.target_name
  left join i si on si.file_id = r.file_id and si.kind = r.target_kind and si.fm_id = r.target_fm_id
  left join n sn on sn.file_id = r.file_id and sn.kind = r.target_kind and sn.name = r.target_name
  left join f fg on fg.run_id = f.run_id and fg.stem = regexp_replace(lower(r.target_file), '\\.fmp12$', '')
  left join i gi on gi.file_id = fg.file_id and gi.kind = r.target_kind and gi.fm_id = r.target_fm_id
  left join n gn on gn.file_id = fg.file_id and gn.kind = r.target_kind and gn.name = r.target_name),
res as (select ref_id, target_kind, coalesce(case when target_kind = 'field' then case when target_to_name is null then leaf else coalesce(near, ext) end when target_kind in ('script', 'layout') then case when target_file is null then coalesce(by_id, by_name) end else by_name end,
  case when target_file is not null then coalesce(far_id, far_name) end) target_entity_id,
  case when target_kind = 'field' and target_to_name is null and leaf_n > 1 then 1 when target_kind in ('script', 'layout') and target_file is null and by_id is null and by_name_n > 1 then 1 else 0 end ambiguous from x)
""".replace("entities_once", "(select distinct * from entities)")


def _resolved(s: SparkSession, d: str) -> DataFrame:
    g = Graph.load(s, d, core=False)
    return resolve(g.refs, g.entities, g.files)


QUERIES["rs_resolve"] = lambda s, d: _resolved(s, d).select("ref_id", "target_kind", "target_entity_id", "ambiguous")
SQL["rs_resolve"] = _sql(_RS + "select ref_id, target_kind, target_entity_id, ambiguous from res")
QUERIES["rs_rate"] = lambda s, d: resolution_rate(_resolved(s, d))
SQL["rs_rate"] = _sql(_RS + "select count(*) total, count(target_entity_id) resolved, 100 * count(target_entity_id) // greatest(count(*), 1) percent from res")

# ---- recipes
_LIVE = "from u where disabled = 0"
_add("q1_where_field", lambda g: g.usage((F.col("target_kind") == "field") & like_ci(F.col("target_raw"), FIELD)).select("ref_id", "context", "source_kind", "source_parent_name", "source_name"), f"select ref_id, context, source_kind, source_parent_name, source_name {_LIVE} and target_kind = 'field' and target_raw ilike '{FIELD}'")
_add("q1_where_leaf", lambda g: g.usage("target_kind = 'field'").where("target_name = 'g_rank'").groupBy("context").agg(F.count(F.lit(1)).alias("n")), f"select context, count(*) n {_LIVE} and target_kind = 'field' and target_name = 'g_rank' group by 1")
_add("q2_script_callers", lambda g: g.usage("target_kind = 'script'").where(F.col("target_name") == SCRIPT_LIKE).select("ref_id", "context", "source_kind", "source_parent_name", "source_name"), f"select ref_id, context, source_kind, source_parent_name, source_name {_LIVE} and target_kind = 'script' and target_name = '{SCRIPT_LIKE}'")
_add("q3_occurrence_refs", lambda g: g.usage("target_kind = 'table_occurrence'").select("ref_id", "context", "source_kind", "source_name", "target_name"), f"select ref_id, context, source_kind, source_name, target_name {_LIVE} and target_kind = 'table_occurrence'")
_add("q4_function_callers", lambda g: g.usage("target_kind = 'custom_function'").select("source_kind", "source_parent_name", "source_name").distinct(), f"select distinct source_kind, source_parent_name, source_name {_LIVE} and target_kind = 'custom_function'")
_add("q5_navigation", lambda g: g.usage("context = 'go_to_layout'").select("ref_id", F.col("source_parent_name").alias("script"), F.col("target_name").alias("layout")), f"select ref_id, source_parent_name script, target_name layout {_LIVE} and context = 'go_to_layout'")
_add("q6_outbound", lambda g: g.usage().join(script_steps(g).select(F.col("entity_id").alias("source_id"), "script_id"), "source_id").select("script_id", "ref_id", "context", "target_kind", "target_name"), "select script_id, ref_id, context, target_kind, target_name from u join steps on steps.entity_id = u.source_id where disabled = 0")
_add("q7_calc_fields", lambda g: g.usage("target_kind = 'field'").where("source_kind = 'field'").select("source_id", "ref_id", "target_raw"), f"select source_id, ref_id, target_raw {_LIVE} and source_kind = 'field' and target_kind = 'field'")
_add("q8_script_body", lambda g: script_steps(g).select("script_id", "entity_id", "seq", "step_type", "step_text"), "select script_id, entity_id, seq, step_type, step_text from steps")
_add("q9_layout_objects", lambda g: g.kind("layout_object").join(g.kind("layout").select(F.col("entity_id").alias("parent_entity_id"), F.col("name").alias("layout")), "parent_entity_id").select("entity_id", "layout", "name", *[json_field("extra_json", f"$.{k}").alias(a) for k, a in (("object_type", "object_type"), ("step_text", "launches"), ("hide_calc", "hidden_when"))]),
     f"select o.entity_id, l.name layout, o.name, {_j('$.object_type', 'o.extra_json')} object_type, {_j('$.step_text', 'o.extra_json')} launches, {_j('$.hide_calc', 'o.extra_json')} hidden_when from e o join e l on l.entity_id = o.parent_entity_id and l.kind = 'layout' where o.kind = 'layout_object'")
_VARS = ", vv as (select entity_id, step_text, unnest(list_distinct(regexp_extract_all(step_text, '\\$\\$[\\p{L}\\p{N}_.]+'))) var from steps where step_text like '%$$%'), ww as (select *, step_text like 'Set Variable [ $$%' and regexp_extract(step_text, '^Set Variable \\[ (\\$\\$[\\p{L}\\p{N}_.]+)', 1) = var sets from vv)"
_add("q11_global_hygiene", commands.global_hygiene, _VARS + " select var, count(*) filter (sets) writes, count(*) filter (not sets) other_mentions from ww group by 1 having count(*) filter (sets) > 0")
_add("q13_unused_by_table", lambda g: g.unused_fields().groupBy("base_table").agg(F.count(F.lit(1)).alias("n"), F.sum("only_disabled_refs").alias("n_dead")), f"select base_table, count(*) n, cast(sum(coalesce(dead, 0)) as bigint) n_dead from e left join {_UNREF} where kind = 'field' and coalesce(live, 0) = 0 group by 1")
_add("q15_unused_occurrences", Graph.unused_occurrences, "select entity_id, file_id, name from e where kind = 'table_occurrence' and not exists (select 1 from r where r.target_entity_id = e.entity_id)")
_add("q16_hotspots", lambda g: g.refs_where("target_kind = 'field' and target_entity_id is not null").groupBy(F.col("target_entity_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("uses")).join(g.entities.select("entity_id", F.concat("base_table", F.lit("::"), "name").alias("field")), "entity_id").orderBy(F.desc("uses"), "entity_id").limit(25),
     "select e.entity_id, base_table || '::' || name field, count(*) uses from r join e on e.entity_id = r.target_entity_id where target_kind = 'field' group by all order by uses desc, entity_id limit 25")
_add("q19_census", lambda g: g.entities.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "select kind, count(*) n from e group by 1")
_kids = lambda g, kind: g.entities_where(kind).groupBy(F.col("parent_entity_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
_add("q20_tables", lambda g: g.kind("base_table").join(_kids(g, "kind = 'field'"), "entity_id", "left").select("entity_id", "name", "records", F.coalesce("n", F.lit(0)).alias("fields")), "select b.entity_id, b.name, b.records, (select count(*) from e x where x.parent_entity_id = b.entity_id and x.kind = 'field') fields from e b where b.kind = 'base_table'")
_add("q21_scripts", lambda g: g.kind("script").join(_kids(g, "true"), "entity_id", "left").select("entity_id", "grp", "name", F.coalesce("n", F.lit(0)).alias("steps")), "select b.entity_id, b.grp, b.name, (select count(*) from e x where x.parent_entity_id = b.entity_id) steps from e b where b.kind = 'script'")
_add("q22_dependencies", lambda g: g.refs_where("disabled = 0 and context in ('calc', 'auto_enter', 'validation', 'lookup')").join(g.kind("field").select(F.col("entity_id").alias("source_entity_id"), F.col("name").alias("field")), "source_entity_id").join(g.entities.select(F.col("entity_id").alias("target_entity_id"), F.col("base_table").alias("of_table")), "target_entity_id", "left").select("ref_id", "field", "context", "target_name", "of_table"),
     "select r.ref_id, s.name field, r.context, r.target_name, t.base_table of_table from r join e s on s.entity_id = r.source_entity_id and s.kind = 'field' left join e t on t.entity_id = r.target_entity_id where r.disabled = 0 and r.context in ('calc', 'auto_enter', 'validation', 'lookup')")
_add("q23_unstored_calcs", lambda g: g.kind("field").where("field_type = 'Calculated' and stored = 0").select("entity_id", "base_table", "name"), "select entity_id, base_table, name from e where kind = 'field' and field_type = 'Calculated' and stored = 0")
_add("q24_storage", lambda g: g.kind("field").select("entity_id", "base_table", "name", ((F.col("stored") == 0) | (F.col("is_global") == 1)).cast("int").alias("forces_unstored")), "select entity_id, base_table, name, cast(stored = 0 or is_global = 1 as int) forces_unstored from e where kind = 'field'")
_add("q25_auto_enter", lambda g: g.kind("field").select("entity_id", "base_table", "name", json_field("auto_enter", "$.calc").alias("calc"), json_field("auto_enter", "$.calc_active").alias("active"), json_field("auto_enter", "$.type").alias("ae_type")).where("calc is not null").drop("calc"),
     f"select entity_id, base_table, name, {_j('$.calc_active', 'auto_enter')} active, {_j('$.type', 'auto_enter')} ae_type from e where kind = 'field' and {_j('$.calc', 'auto_enter')} is not null")
_add("q26_triggers_by_event", lambda g: g.triggers().where(like_ci(F.col("layout_name"), LAYOUT_LIKE)).groupBy("trigger_event", "layout_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("resolved") == 1).alias("n_resolved")), _CLIMB + f"select trigger_event, layout_name, count(*) n, count(target_entity_id) n_resolved from r join owner o on o.entity_id = source_entity_id where context = 'trigger' and disabled = 0 and layout_name ilike '{LAYOUT_LIKE}' group by all")
_add("q26_triggers_by_script", lambda g: g.triggers().where("script_name is not null").groupBy("script_name", "source_kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("layout_name").alias("n_layouts")), _CLIMB + "select coalesce(t.name, target_raw) script_name, s.kind source_kind, count(*) n, count(distinct layout_name) n_layouts from r left join e s on s.entity_id = source_entity_id left join owner o on o.entity_id = source_entity_id left join e t on t.entity_id = target_entity_id where context = 'trigger' and disabled = 0 and coalesce(t.name, target_raw) is not null group by all")
_add("q26_file_triggers", lambda g: g.triggers().where("source_kind is null").select("ref_id", "file_id", "trigger_event", "script_name", "resolved"), "select ref_id, r.file_id, trigger_event, coalesce(t.name, target_raw) script_name, cast(target_entity_id is not null as int) resolved from r left join e s on s.entity_id = source_entity_id left join e t on t.entity_id = target_entity_id where context = 'trigger' and disabled = 0 and s.kind is null")
_add("q27_serials", lambda g: g.kind("field").select("entity_id", "base_table", "name", json_field("auto_enter", "$.serial.nextValue").alias("next")).where("next is not null"), f"select entity_id, base_table, name, {_j('$.serial.nextValue', 'auto_enter')} as next from e where kind = 'field' and {_j('$.serial.nextValue', 'auto_enter')} is not null")
_add("q27_lookups", lambda g: g.kind("field").where(F.try_variant_get(parsed("auto_enter"), "$.lookup_source", "variant").isNotNull()).select("entity_id", "base_table", "name", json_field("auto_enter", "$.lookup_active").alias("active")), f"select entity_id, base_table, name, {_j('$.lookup_active', 'auto_enter')} active from e where kind = 'field' and json_valid(auto_enter) and json_exists(auto_enter, '$.lookup_source')")
_add("q28_non_equi", lambda g: g.kind("relationship").select("entity_id", "name", json_field("extra_json", "$.predicates", PREDICATES).alias("p")).where(F.exists("p", lambda p: p["op"] != "Equal")).select("entity_id", "name"),
     """select distinct entity_id, name from (select entity_id, name, unnest(cast(json_extract(extra_json, '$.predicates') as json[])) p from e where kind = 'relationship' and json_valid(extra_json) and json_type(extra_json, '$.predicates') = 'ARRAY') where json_extract_string(p, '$.op') <> 'Equal'""")
_add("q29_marked_objects", lambda g: g.kind("layout_object").select("entity_id", "name", json_field("extra_json", "$.text").alias("shown"), json_field("extra_json", "$.hide_calc").alias("hidden_when")).where("contains(shown, '<<') or contains(hidden_when, '$$')"),
     f"select entity_id, name, {_j('$.text')} shown, {_j('$.hide_calc')} hidden_when from e where kind = 'layout_object' and (contains({_j('$.text')}, '<<') or contains({_j('$.hide_calc')}, '$$'))")
_add("q30_change_surface", lambda g: g.entities_where(glob(F.col("calc_text"), "*Sum (*")).select("entity_id", F.col("base_table").alias("owner"), F.col("calc_text").alias("body")).unionByName(script_steps(g).where(glob(F.col("step_text"), "*Sort*")).select("entity_id", F.col("step_type").alias("owner"), F.col("step_text").alias("body"))), "select entity_id, base_table as owner, calc_text body from e where calc_text glob '*Sum (*' union all select entity_id, step_type, step_text from steps where step_text glob '*Sort*'")
_add("q31_naming", lambda g: g.kind("field").where(glob(F.col("name"), "zk_*")).groupBy("stored", "is_global").agg(F.count(F.lit(1)).alias("n")), "select stored, is_global, count(*) n from e where kind = 'field' and name glob 'zk_*' group by all")

# ---- joins, aggregates, sorts
_add("j_callers_count", lambda g: g.usage("target_kind = 'script' and target_entity_id is not null").where("target_id is not null").groupBy("target_id", "context", "source_kind", "source_parent_name", "source_name").agg(F.count(F.lit(1)).alias("n")), f"select target_id, context, source_kind, source_parent_name, source_name, count(*) n {_LIVE} and target_kind = 'script' and target_id is not null group by all")
_add("ag_stats", commands.stats, "select 'kind ' || kind item, count(*) n from e group by 1 union all select 'refs', count(*) from r union all select 'refs resolved', count(target_entity_id) from r union all select 'refs disabled', count(*) from r where disabled = 1 union all select 'percent resolved', 100 * count(target_entity_id) // greatest(count(*), 1) from r")
_add("ag_creators", lambda g: commands.mutations(g).where("op = 'create'").groupBy("step_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("script_id").alias("n_scripts")), "select step_type, count(*) n, count(distinct script_id) n_scripts from steps where step_type in ('New Record/Request', 'Duplicate Record/Request', 'Import Records') group by 1")
_add("snk4_summary", summary, "select kind item, count(*) n from e group by 1 union all select '_refs', count(*) from r union all select '_refs_resolved', count(target_entity_id) from r")

# ---- record operations
_OPS = """, s0 as (select *, flagged or ltrim(coalesce(step_text, '')) like '//%' dead from steps),
s1 as (select *, case when not dead then step_type end st from s0),
s2 as (select *, sum(case when st in ('If', 'Loop') then 1 when st in ('End If', 'End Loop') then -1 else 0 end) over d raw, case when st = 'Go to Layout' or st like 'Go to Related%' then 1 else 0 end goes from s1 window d as (partition by script_id order by entity_id)),
s3 as (select *, raw - least(0, min(raw) over d) depth, sum(goes) over d ctx, coalesce(last_value(case when st in ('Enter Find Mode', 'Modify Last Find') then true when st in ('Perform Find', 'Enter Browse Mode', 'Constrain Found Set', 'Extend Found Set', 'Show All Records') then false end ignore nulls) over d, false) find
  from s2 window d as (partition by script_id order by entity_id)),
s4 as (select *, first_value(depth) over c setd, first_value(st like 'Go to Related%') over c related, nullif(regexp_extract(first_value(coalesce(step_text, '')) over c, '\\(([A-Za-z0-9_ .\\x{2022}-]+)\\)\\s*\\]\\s*$', 1), '') tto,
  min(case when st in ('End If', 'End Loop') then depth end) over c closed, min(case when st in ('Else', 'Else If') then depth end) over c branched from s3 window c as (partition by script_id, ctx order by entity_id)),
s5 as (select *, case when ctx > 0 then tto end clue, ctx > 0 and (coalesce(closed < setd, false) or coalesce(branched <= setd, false) or coalesce(related, false)) maybe from s4),
ops as (select script_id, script_name, entity_id, seq, step_type, case when step_type in ('New Record/Request', 'Duplicate Record/Request', 'Import Records') then 'create' else 'delete' end op,
  case when cut <> '' then 'confident' when step_type in ('Delete Portal Row', 'Import Records') or clue is null or maybe then 'check' else 'likely' end tier, coalesce(nullif(cut, ''), clue) context,
  case when cut <> '' then 'table named in the step' when step_type = 'Delete Portal Row' then 'portal row: layout context is NOT the target table' when step_type = 'Import Records' then 'import target set by its field mapping (not in DDR text)' when clue is null then 'context set by caller'
    when maybe then 'conditional context' || case when related then ' (via Go to Related Record)' else '' end end note,
  case when dead then 'disabled' when find then 'find' else 'live' end state from (select *, case when step_type = 'Truncate Table' then regexp_extract(coalesce(step_text, ''), 'Table:\\s*[\\x{201c}"]([^\\x{201d}"]+)[\\x{201d}"]', 1) else '' end cut from s5)
  where step_type in ('Truncate Table', 'New Record/Request', 'Duplicate Record/Request', 'Import Records', 'Delete Record/Request', 'Delete All Records', 'Delete Portal Row'))
"""
_add("rec_ops", lambda g: record_ops(script_steps(g)), _OPS + "select script_id, entity_id, seq, op, step_type, tier, context, note, state from ops")
_add("cmd7_mutations", lambda g: commands.mutations(g, "vendor").select("script_id", "script_name", "entity_id", "op", "tier", "tier_rank", "state"), _OPS + "select script_id, script_name, entity_id, op, tier, case tier when 'confident' then 0 when 'likely' then 1 else 2 end tier_rank, state from ops where contains(lower(concat_ws(' ', script_name, context)), 'vendor')")

# ---- graph walks
_DOWN = ", reach as (select entity_id root, entity_id node from e where kind = 'script' union select root, callee from reach join calls on caller = node)"
_DEPTHS = ", deep as (select entity_id root, entity_id node, 0 depth from e where kind = 'script' union select root, callee, depth + 1 from deep join calls on caller = node where depth < 60)"
_add("gr3_call_edges", call_edges, "select caller, callee from calls")
_add("gr4_closure", lambda g: closure(call_edges(g), g.kind("script").select("entity_id")), _DEPTHS + " select root, node, min(depth) depth from deep group by all")
_HOPS = """, far as (select distinct script_id node, 0 depth from steps where {targets} union select caller, depth + 1 from far join calls on callee = node where depth < 60),
dist as (select node, min(depth) depth from far group by 1),
hop as (select caller node, min(callee) next_hop from calls join dist a on a.node = caller join dist b on b.node = callee and b.depth = a.depth - 1 group by 1),
chain as (select node, node target, name chain from dist join e on e.entity_id = node where depth = 0 union all select h.node, c.target, e.name || ' -> ' || c.chain from hop h join chain c on c.node = h.next_hop join e on e.entity_id = h.node)
"""
_add("gr5_upward", lambda g: next_hops(call_edges(g), script_steps(g).where("startswith(step_type, 'Delete')").select("script_id").distinct()), _HOPS.format(targets="step_type like 'Delete%'") + " select d.node, next_hop, d.depth from dist d left join hop h on h.node = d.node and d.depth > 0")
_add("gr6_chains", lambda g: chains(next_hops(call_edges(g), script_steps(g).where("startswith(step_type, 'Delete')").select("script_id").distinct()), g.kind("script").select(F.col("entity_id").alias("node"), "name")), _HOPS.format(targets="step_type like 'Delete%'") + " select node, target, chain from chain")
_CALC = ", x as (select entity_id input, entity_id anc, coalesce(field_type = 'Calculated', false) calculated, 0 depth from e where kind = 'field' union select x.input, n.needs, coalesce(t.field_type = 'Calculated', false), depth + 1 from x join needs n on n.field = x.anc join e t on t.entity_id = n.needs where x.calculated and depth < 60)"
_add("gr7_writable_inputs", lambda g: writable_inputs(g, g.kind("field").select("entity_id")), _CALC + " select input, anc field_id, min(depth) depth from x where not calculated group by all")
_add("gr_field_edges", field_edges, "select field, needs from needs")
_SITES = "sites as (select r.target_entity_id node, count(distinct (r.source_entity_id, r.context)) n from r join e s on s.entity_id = r.source_entity_id and s.kind in ('layout', 'layout_object') where r.context in ('perform_script', 'trigger') and r.target_kind = 'script' and r.target_entity_id is not null group by 1)"
_add("gr9_roots", commands.entry_points, ", " + _SITES + " select entity_id, coalesce(n, 0) n_launch_sites, cast(exists (select 1 from calls where callee = entity_id) as int) called from e left join sites on node = entity_id where kind = 'script' and (n is not null or not exists (select 1 from calls where callee = entity_id))")
_add("q33_reach", lambda g: closure(call_edges(g), g.kind("script").where(F.col("name") == SCRIPT_LIKE).select("entity_id")).join(g.kind("script").select(F.col("entity_id").alias("node"), F.col("name").alias("reached")), "node").select("root", "node", "reached"), _DOWN + f" select root, node, s.name reached from reach join e x on x.entity_id = root join e s on s.entity_id = node where x.name = '{SCRIPT_LIKE}'")

# ---- commands
_add("cmd1_where", lambda g: commands.where_used(g, FIELD), "select t.entity_id, t.kind, t.base_table || '::' || t.name \"label\", x.context, x.source_kind, x.source_parent_name, x.source_name, x.ambiguous from e t join (select file_id, name, arg_min(base_table, entity_id) base_table from e where kind = 'table_occurrence' group by all) o on o.file_id = t.file_id and o.base_table = t.base_table and o.name = 'KB_Tariff0' left join (select * from u where disabled = 0) x on x.target_id = t.entity_id where t.kind = 'field' and t.name = 'g_rank'")
_add("cmd4_cascades", lambda g: g.cascades().groupBy("victim_table").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("deleting_table").alias("n_from")), _SIDES + """select nullif(oa.base_table, chr(0)) victim_table, count(*) n, count(distinct nullif(ob.base_table, chr(0))) n_from
  from side a join side b on a.entity_id = b.entity_id and a.s.side <> b.s.side left join occ oa on oa.file_id = a.file_id and oa.name = a.s."to" left join occ ob on ob.file_id = a.file_id and ob.name = b.s."to" where a.s.cascade_delete group by 1""")
_add("cmd5_value_lists", lambda g: commands.value_lists(g, VALUE_LIST), f"select entity_id, name, {_j('$.source')} source, {_j('$.primary.field')} primary_field, {_j('$.secondary.field')} secondary_field, {_j('$.show_related')} show_related, cast(coalesce(case when json_valid(extra_json) and json_type(extra_json, '$.custom_values') = 'ARRAY' then json_array_length(extra_json, '$.custom_values') end, 0) as integer) n_values, (select count(*) from r where r.target_entity_id = e.entity_id and disabled = 0) bound from e where kind = 'value_list' and name ilike '{VALUE_LIST}'")
_add("cmd6_launch_sites", lambda g: commands.launch_sites(g).select("script_id", "source_id", "source_kind", "context", "layout_name"), _CLIMB + "select distinct r.target_entity_id script_id, s.entity_id source_id, s.kind source_kind, r.context, layout_name from r join e s on s.entity_id = r.source_entity_id and s.kind in ('layout', 'layout_object') left join owner o on o.entity_id = s.entity_id where r.context in ('perform_script', 'trigger') and r.target_kind = 'script' and r.target_entity_id is not null")
_add("cmd6_rollup", commands.chain_rollup, _OPS + _DOWN + ", per as (select script_id, count(*) filter (op = 'delete' and state = 'live') d, count(*) filter (op = 'create' and state = 'live') c, count(*) filter (state <> 'live') o from ops group by 1) select root script_id, count(*) n_scripts, cast(coalesce(sum(d), 0) as bigint) n_deletes, cast(coalesce(sum(c), 0) as bigint) n_creates, cast(coalesce(sum(o), 0) as bigint) n_other from reach left join per on per.script_id = node group by 1")
_add("cmd6_investigate_chain", lambda g: commands.investigate(g, SCRIPT_LIKE)["chain"], _OPS + f""", dn as (select entity_id root, entity_id node, 0 depth from e where kind = 'script' and name = '{SCRIPT_LIKE}' union select root, callee, depth + 1 from dn join calls on caller = node where depth < 60),
  dd as (select root, node, min(depth) depth from dn group by all) select root, script_id, depth, entity_id, seq, op, step_type, tier, context, note, state, script_name from dd join ops on ops.script_id = node""")
_WRITERS = """, writers as (select distinct s.script_id, 'writes ' || coalesce(r.target_raw, r.target_name) what from r join e t on t.entity_id = r.target_entity_id and t.kind = 'field' and t.base_table = 'KB_Tariff0' and t.name = 'g_rank' and coalesce(t.field_type, '') <> 'Calculated'
  join steps s on s.entity_id = r.source_entity_id where r.context = 'step_target' and r.disabled = 0)"""
_add("cmd8_trigger_map", lambda g: commands.trigger_map(g, [FIELD], must_exist=False), _WRITERS + _HOPS.format(targets="script_id in (select script_id from writers)") + """, sites as (select r.target_entity_id node, count(distinct (r.source_entity_id, r.context)) n from r join e s on s.entity_id = r.source_entity_id and s.kind in ('layout', 'layout_object')
  where r.context in ('perform_script', 'trigger') and r.target_kind = 'script' and r.target_entity_id is not null group by 1),
ev as (select script_id target, min(what) evidence from writers group by 1)
select d.node script_id, e.name script_name, d.depth, ev.evidence, c.chain, coalesce(s.n, 0) n_launch_sites, '' verdict from dist d join chain c on c.node = d.node join ev on ev.target = c.target join e on e.entity_id = d.node left join sites s on s.node = d.node
where s.n is not null or d.node not in (select callee from calls)""")

# ---- full text
_TEXT = f""", o as (select entity_id, kind, name, case when kind = 'layout_object' then parent_entity_id end up, concat_ws(' ', name, {_j('$.object_type')}, calc_text, {_j('$.step_text')}, {_j('$.hide_calc')}, {_j('$.tooltip_calc')}, {_j('$.calc', 'auto_enter')}, {_j('$.validation_calc')}, {_j('$.text')},
  array_to_string(case when json_valid(extra_json) and json_type(extra_json, '$.custom_values') = 'ARRAY' then cast(json_extract(extra_json, '$.custom_values') as varchar[]) end, ' ')) own from e),
above as (select o.entity_id, o.up from o join e p on p.entity_id = o.up and p.kind in ('layout', 'layout_object') union select above.entity_id, o.up from above join o on o.entity_id = above.up join e p on p.entity_id = o.up and p.kind in ('layout', 'layout_object')),
below as (select above.up entity_id, string_agg(own, ' ' order by o.entity_id) texts from above join o using (entity_id) where above.up <> o.entity_id and trim(own) <> '' group by 1),
t as (select o.entity_id, kind, name, concat_ws(' ', nullif(own, ''), texts) body from o left join below using (entity_id)),
w as (select entity_id, kind, ' ' || array_to_string(regexp_extract_all(translate(lower(coalesce(name, '')), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+'), ' ') || ' ' nn, ' ' || array_to_string(regexp_extract_all(translate(lower(body), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+'), ' ') || ' ' bb from t where trim(body) <> '')
"""


def _match(text: str) -> Callable[[Graph], DataFrame]:
    return lambda g: matching(postings(text_docs(g)), text).join(g.entities.select("entity_id", "kind"), "entity_id")


def _ranked(g: Graph, text: str, limit: int) -> DataFrame:
    docs = Stages(g.files.sparkSession, "docs").put(text_docs(g), "docs")
    return search(postings(docs), lengths(docs), text, limit)


_has = lambda x: f"(contains(nn, '{x}') or contains(bb, '{x}'))"
_add("fts2_term", _match("vendor"), _TEXT + f"select entity_id, kind from w where {_has(' vendor ')}")
_add("fts3_phrase", _match('"go to related"'), _TEXT + f"select entity_id, kind from w where {_has(' go to related ')}")
_add("fts4_prefix", _match("quot*"), _TEXT + f"select entity_id, kind from w where {_has(' quot')}")
_add("fts5_boolean", _match("sum AND (vendor OR batch) NOT length"), _TEXT + f"select entity_id, kind from w where {_has(' sum ')} and ({_has(' vendor ')} or {_has(' batch ')}) and not {_has(' length ')}")
_add("fts5_near", _match("NEAR(set field, 3) AND vendor"), _TEXT + f"select entity_id, kind from w where (regexp_matches(nn, ' set( [^ ]+){{0,3}} field | field( [^ ]+){{0,3}} set ') or regexp_matches(bb, ' set( [^ ]+){{0,3}} field | field( [^ ]+){{0,3}} set ')) and {_has(' vendor ')}")
_add("fts6_column", _match("name:vendor"), _TEXT + "select entity_id, kind from w where contains(nn, ' vendor ')")
_add("fts9_literal", _match('"set field'), _TEXT + f"select entity_id, kind from w where {_has(' set field ')}")
_TOKENS = """, p as (select entity_id, kind, 'name' col, unnest(string_split(trim(nn), ' ')) term from w where trim(nn) <> '' union all select entity_id, kind, 'body', unnest(string_split(trim(bb), ' ')) from w where trim(bb) <> '')"""
_add("fts7_ranked", lambda g: _ranked(g, "vendor batch", 50).select("entity_id", "kind", F.round("score", 6).alias("score")), _TEXT + _TOKENS + """, tf as (select entity_id, count(*) dl, count(*) filter (term = 'vendor') a, count(*) filter (term = 'batch') b from p group by 1),
  al as (select count(*) n, (select sum(dl) from tf) / count(*) avgdl, (select count(*) from tf where a > 0) da, (select count(*) from tf where b > 0) db from t where trim(body) <> ''),
  sc as (select entity_id, greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) score from tf, al where a > 0 and b > 0)
  select entity_id, kind, round(score, 6) score from sc join e using (entity_id) order by score desc, entity_id limit 50""")
_add("fts8_snippets", lambda g: _ranked(g, "currency", 30).select("entity_id", "match"), _TEXT + _TOKENS + """, tf as (select entity_id, count(*) dl, count(*) filter (term = 'currency') a from p group by 1),
  al as (select count(*) n, sum(dl) / count(*) avgdl, count(*) filter (a > 0) da from tf),
  best as (select entity_id, round(greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9) score from tf, al where a > 0 order by score desc, entity_id limit 30),
  ws as (select entity_id, string_split_regex(trim(body, ' '), '\\s+') words from t join best using (entity_id)),
  hits as (select *, coalesce(nullif(list_position(list_transform(words, lambda x: contains(translate(lower(x), '""" + f"{ACCENTED}', '{PLAIN}" + """'), 'currency')), true), 0), 1) hit from ws),
  cut as (select *, greatest(1, hit - 6) start from hits)
  select entity_id, case when start > 1 then '...' else '' end || array_to_string(list_transform(words[start:start + 11], lambda x, i: case when i + start - 1 = hit then '[' || x || ']' else x end), ' ') || case when len(words) >= start + 12 then '...' else '' end as match from cut""")
_add("fts1_postings", lambda g: postings(text_docs(g)).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("docs")), _TEXT + _TOKENS + "select term, count(*) n, count(distinct entity_id) docs from p group by 1")
_add("q10_layout_body", lambda g: text_docs(g).where("kind = 'layout'").select("entity_id", "name", "body"), _TEXT + "select entity_id, name, body from t where kind = 'layout' and trim(body) <> ''")


def q12_confirm(s: SparkSession, d: str) -> DataFrame:
    """Kinds in which the name of a written global occurs."""
    g = Graph.load(s, d)
    names = commands.global_hygiene(g).select(F.lower(F.regexp_replace("var", r"^\$+", "")).alias("term")).distinct()
    return postings(text_docs(g)).join(names, "term", "left_semi").select("term", "entity_id").distinct().join(g.entities.select("entity_id", "kind"), "entity_id").groupBy("term", "kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES["q12_confirm_global"] = q12_confirm
SQL["q12_confirm_global"] = _sql(_TEXT + _TOKENS + _VARS + ", g as (select distinct lower(regexp_replace(var, '^\\$+', '')) term from ww where sets) select term, kind, count(distinct entity_id) n from p join g using (term) group by all")


def sql_surface(s: SparkSession, d: str) -> DataFrame:
    """Ad-hoc SQL over the registered views, with a bound parameter."""
    Graph.load(s, d).register(s)
    return s.sql("select context, count(*) as n from v_usage where target_kind = :kind group by context", args={"kind": "layout"})


QUERIES["cmd3_sql"] = sql_surface
SQL["cmd3_sql"] = _sql(f"select context, count(*) n {_LIVE} and target_kind = 'layout' group by 1")
