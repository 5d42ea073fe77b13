"""Queries p2 to p6 over the parsed-report tables, and the SQL that each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import Stages, table
from graphloom.operators.heavy_keys import heavy_keys, key_profiles
from graphloom.operators.hierarchy import descendants, nested_sets
from graphloom.operators.nested import child_table, child_values, nested_nodes, nested_paths, read_child_tables, write_child_tables
from graphloom.operators.orphans import orphan_refs
from graphloom.operators.snapshots import snapshot_changes


#: The shared core file of the tables.
CORE_STEM = "kernelbox"


def _orphans(s: SparkSession, d: str) -> DataFrame:
    return orphan_refs(table(s, d, "refs"), table(s, d, "entities"), table(s, d, "core_entities"), table(s, d, "files"), CORE_STEM)


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return _orphans(s, d).select("ref_id", "target_kind", "run_id")


def p2_per_kind_and_run(s: SparkSession, d: str) -> DataFrame:
    counts = _orphans(s, d).groupBy("target_kind", "run_id").agg(F.count(F.lit(1)).alias("n_orphans"), F.count_if(F.col("reason") == "dead_id").alias("n_dead_ids"))
    period = table(s, d, "ddr_run").select("run_id", F.date_format("parsed_at", "yyyy-MM").alias("period")).distinct()
    return counts.join(period, "run_id").select("target_kind", "run_id", "period", "n_orphans", "n_dead_ids")


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(s, d, "entities"), table(s, d, "files"), table(s, d, "ddr_run"))


def p3_per_run(s: SparkSession, d: str) -> DataFrame:
    return p3_found(s, d).groupBy("run_id").agg(*[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("added", "removed", "changed")])


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return nested_paths(table(s, d, "entities"))


def _child_tables(s: SparkSession, d: str) -> DataFrame:
    """The child tables of all values, written by tag in one pass and read back."""
    path = f"{Stages(s, 'nested').root}/tables"
    write_child_tables(nested_nodes(table(s, d, "entities")), path)
    return read_child_tables(s, path)


def p4_tables(s: SparkSession, d: str) -> DataFrame:
    return _child_tables(s, d).select("entity_id", "src_field", "tag", "node_path", "parent_path", "n_members")


def p4_predicates(s: SparkSession, d: str) -> DataFrame:
    return child_table(_child_tables(s, d), "predicates")


def p4_values(s: SparkSession, d: str) -> DataFrame:
    return child_values(_child_tables(s, d))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(s, d, "refs")).select("key_role", "entity_id")


def p5_profiles(s: SparkSession, d: str) -> DataFrame:
    return key_profiles(table(s, d, "refs"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    sets = nested_sets(table(s, d, "entities")).where("up is not null")
    return sets.select(F.col("id").alias("entity_id"), F.col("root").alias("root_entity_id"), F.col("depth").cast("int").alias("node_depth"))


def p6_paths(s: SparkSession, d: str) -> DataFrame:
    sets = nested_sets(table(s, d, "entities"), label="name")
    return sets.select(F.col("id").alias("entity_id"), F.col("root").alias("root_entity_id"), F.col("depth").alias("node_depth"), (F.col("size") - 1).alias("n_descendants"), F.col("path").alias("node_path"))


def p6_descendants(s: SparkSession, d: str) -> DataFrame:
    return descendants(nested_sets(table(s, d, "entities"))).select(F.col("ancestor_id"), F.col("id").alias("entity_id"))


QUERIES = {f.__name__: f for f in (p2_found, p2_per_kind_and_run, p3_found, p3_per_run, p4_found, p4_tables, p4_predicates, p4_values, p5_found, p5_profiles, p6_found, p6_paths, p6_descendants)}

_FILES = "f as (select distinct file_id, run_id, regexp_replace(lower(name), '\\.fmp12$', '') stem from files)"

_P2 = f"""
with recursive {_FILES},
e as (select distinct entity_id, file_id, kind, name, base_table, ext_file from entities),
n as (select file_id place, kind, name, base_table, ext_file from e union all select -1, kind, name, base_table, ext_file from core_entities),
p as (select run_id, stem, file_id place from f union all select distinct run_id, 'kernelbox', -1 from f),
r as (select distinct r.ref_id, f.run_id, r.file_id, target_kind, target_name, target_to_name, target_file, target_entity_id from refs r join f on f.file_id = r.file_id),
dead as (select ref_id, target_kind, run_id, 'dead_id' reason from r where target_entity_id is not null
  and not exists (select 1 from e join f on f.file_id = e.file_id where e.entity_id = r.target_entity_id and f.run_id = r.run_id)
  and not exists (select 1 from core_entities c where c.entity_id = r.target_entity_id)),
b as (select ref_id, target_kind, run_id, target_name, target_to_name, file_id place from r where target_entity_id is null and target_name is not null and target_file is null
  union all select ref_id, target_kind, r.run_id, target_name, target_to_name, p.place from r join p on p.run_id = r.run_id and p.stem = regexp_replace(lower(target_file), '\\.fmp12$', '') where target_entity_id is null and target_name is not null),
q as (select * from b where target_kind = 'field' and target_to_name is not null),
o as (select q.ref_id, q.run_id, q.target_name, n.base_table, q.place, n.ext_file from q join n on n.place = q.place and n.kind = 'table_occurrence' and n.name = q.target_to_name),
h as (select ref_id, target_name, base_table, place from o where ext_file is null
  union all select ref_id, target_name, base_table, p.place from o join p on p.run_id = o.run_id and p.stem = regexp_replace(lower(ext_file), '\\.fmp12$', '')),
fit as (select b.ref_id from b join n on n.place = b.place and n.kind = b.target_kind and n.name = b.target_name where not (b.target_kind = 'field' and b.target_to_name is not null)
  union select h.ref_id from h join n on n.place = h.place and n.kind = 'field' and n.name = h.target_name and n.base_table = h.base_table),
found as (select * from dead union select ref_id, target_kind, run_id, 'no_name' from r where target_entity_id is null and target_name is not null and ref_id not in (select ref_id from fit))
"""

_P3 = f"""
with recursive runs as (select distinct run_id, source_path, parsed_at from ddr_run),
o as (select run_id, lag(run_id) over (partition by source_path order by parsed_at, run_id) prev from runs),
{_FILES},
e as (select distinct f.run_id, stem, kind, coalesce(base_table, '\\0') bt, fm_id, entity_id, name, calc_text from entities join f on f.file_id = entities.file_id where fm_id is not null and kind <> 'script_step'),
a as (select o.run_id, e.stem, e.kind, e.bt, e.fm_id, e.entity_id, e.name, e.calc_text from o join e on e.run_id = o.run_id where prev is not null),
b as (select o.run_id, e.stem, e.kind, e.bt, e.fm_id, e.entity_id, e.name, e.calc_text from o join e on e.run_id = o.prev),
found as (select coalesce(a.run_id, b.run_id) run_id, coalesce(a.entity_id, b.entity_id) entity_id,
  case when b.run_id is null then 'added' when a.run_id is null then 'removed' else 'changed' end change
  from a full join b on a.run_id = b.run_id and a.stem = b.stem and a.kind = b.kind and a.bt = b.bt and a.fm_id = b.fm_id
  where a.run_id is null or b.run_id is null or a.name is distinct from b.name or a.calc_text is distinct from b.calc_text)
"""

_P4 = r"""
with v as (select distinct entity_id, 'extra_json' src_field, extra_json v from entities where json_valid(extra_json) union select distinct entity_id, 'auto_enter', auto_enter from entities where json_valid(auto_enter)),
o as (select entity_id, src_field, case when json_type(v) = 'VARCHAR' then json_extract_string(v, '$') else v end v from v where json_type(v) in ('OBJECT', 'ARRAY', 'VARCHAR')),
p as (select entity_id, src_field, v from o where json_valid(v) and (v not like '"%') and json_type(v) in ('OBJECT', 'ARRAY')),
n as (select entity_id, src_field, t.fullkey node_path, t.type, t.key, t.value val, t.type = 'ARRAY' and list_distinct(json_type(t.value, '$[*]')) = ['OBJECT'] all_objects,
  '[' || array_to_string(list_transform(try_cast(t.value as json[]), lambda x: case when json_type(x) = 'OBJECT' then 'null' else coalesce(replace(cast(x as varchar), ' ', ''), 'null') end), ',') || ']' list_text from p, lateral (select * from json_tree(p.v)) t),
m as (select entity_id, src_field, key as name, val, list_text, type, substr(node_path, 1, length(node_path) - length(key) - 1) of from n where ends_with(node_path, '.' || key) and type <> 'OBJECT' and not coalesce(all_objects, false))
"""

_P5 = """
with recursive r as (select distinct ref_id, source_entity_id, target_entity_id, context from refs),
k as (select 'target' key_role, target_entity_id entity_id, source_entity_id partner, context from r union all select 'source', source_entity_id, target_entity_id, context from r)
"""

_P6 = """
with recursive e as (select distinct entity_id id, parent_entity_id up, name from entities),
l as (select e.id, case when p.id is not null then e.up end up, coalesce(e.name, '') name from e left join (select id from e) p on p.id = e.up),
down as (select id, id root, 0 depth, name path from l where up is null union all select l.id, d.root, d.depth + 1, d.path || ' / ' || l.name from l join down d on l.up = d.id),
caught as (select id, up from l where id not in (select id from down)),
climb as (select id, up anc from caught union select c.id, k.up from climb c join caught k on k.id = c.anc),
loops as (select id, min(anc) root from (select c.id, c.anc from climb c where c.anc in (select id from climb where id = anc)) group by id),
t as (select id, root, depth, path from down union all select id, root, -1, null from loops),
pairs as (select l.up ancestor_id, l.id entity_id from l join down on down.id = l.id where l.up is not null union all select l.up, p.entity_id from pairs p join l on l.id = p.ancestor_id where l.up is not null)
"""

SQL = {
    "p2_found": _P2 + "select distinct ref_id, target_kind, run_id from found",
    "p2_per_kind_and_run": _P2 + "select target_kind, found.run_id, strftime(parsed_at, '%Y-%m') period, count(*) n_orphans, count(*) filter (reason = 'dead_id') n_dead_ids from found join (select distinct run_id, parsed_at from ddr_run) t on t.run_id = found.run_id group by all",
    "p3_found": _P3 + "select run_id, entity_id, change from found",
    "p3_per_run": _P3 + "select run_id, count(*) filter (change = 'added') n_added, count(*) filter (change = 'removed') n_removed, count(*) filter (change = 'changed') n_changed from found group by 1",
    "p4_found": _P4 + r"select distinct entity_id, src_field, node_path, regexp_replace(regexp_replace(node_path, '(\[\d+\])+$', ''), '\.[^.\[\]]+$', '') parent_path from n where type = 'OBJECT' and node_path <> '$'",
    "p4_tables": _P4 + r"""select distinct o.entity_id, o.src_field, coalesce(nullif(regexp_extract(regexp_replace(o.node_path, '(\[\d+\])+$', ''), '\.([^.]+)$', 1), ''), 'root') tag, o.node_path,
  case when o.node_path <> '$' then regexp_replace(regexp_replace(o.node_path, '(\[\d+\])+$', ''), '\.[^.\[\]]+$', '') end parent_path, cast(case when o.type = 'ARRAY' then o.lone else (select count(*) from m where m.entity_id = o.entity_id and m.src_field = o.src_field and m.of = o.node_path) end as integer) n_members
  from (select *, cast(not all_objects as integer) lone from n where type = 'OBJECT' or node_path = '$') o""",
    "p4_predicates": _P4 + r"""select distinct entity_id, src_field, node_path, regexp_replace(regexp_replace(node_path, '(\[\d+\])+$', ''), '\.[^.\[\]]+$', '') parent_path, json_extract_string(val, '$.op') op, json_extract_string(val, '$.left') "left", json_extract_string(val, '$.right') "right" from n where type = 'OBJECT' and regexp_matches(node_path, '\.predicates(\[\d+\])*$')""",
    "p4_values": _P4 + r"""select distinct entity_id, src_field, of node_path, name, case when type in ('ARRAY', 'OBJECT') then list_text when type <> 'NULL' then json_extract_string(val, '$') end as value from m
  union select entity_id, src_field, '$', '', list_text from n where type = 'ARRAY' and node_path = '$' and not all_objects""",
    "p5_found": _P5 + "select key_role, entity_id from k where entity_id is not null group by 1, 2 having count(*) >= 0.025 * (select count(*) from r)",
    "p5_profiles": _P5 + """, c as (select key_role, entity_id, context, count(*) n from k group by all)
select k.key_role, k.entity_id, count(*) n_rows, any_value(n_contexts) n_contexts, any_value(top_context) top_context, count(distinct partner) n_partners from k
join (select key_role, entity_id, count(*) n_contexts, first(context order by n desc, context nulls last) top_context from c group by all) t on t.key_role = k.key_role and t.entity_id = k.entity_id group by 1, 2""",
    "p6_found": _P6 + "select t.id entity_id, t.root root_entity_id, t.depth node_depth from t join e on e.id = t.id where e.up is not null",
    "p6_paths": _P6 + "select t.id entity_id, t.root root_entity_id, cast(t.depth as bigint) node_depth, case when depth >= 0 then coalesce(n, 0) end n_descendants, path node_path from t left join (select ancestor_id, count(*) n from pairs group by 1) q on q.ancestor_id = t.id",
    "p6_descendants": _P6 + "select ancestor_id, entity_id from pairs",
}
