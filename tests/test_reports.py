"""Reports to index, views and commands, on our own two small reports."""

import json
import os
from collections import Counter
from pathlib import Path

import pytest

from graphloom import cli
from graphloom.operators.closure import call_edges, closure, revisits
from graphloom.plans import commands
from graphloom.sinks import index
from graphloom.sinks.report import mermaid, write_report
from graphloom.sinks.snippet import clipboard_class, script_xml, snippet
from graphloom.sources.report_xml import expand_manifest, run_row

DATA = Path(__file__).parent / "data"
GARDEN, SHED = str(DATA / "garden.xml"), str(DATA / "shed.xml")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("built")
    index.build(spark, GARDEN, str(root / "one"), "one")
    index.build(spark, [GARDEN, SHED], str(root / "two"), "two")
    return root


@pytest.fixture(scope="module")
def one(spark, built):
    return index.open_index(spark, str(built / "one"))


@pytest.fixture(scope="module")
def two(spark, built):
    return index.open_index(spark, str(built / "two"))


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def entity(g, kind, name):
    return g.kind(kind).where(f"name = '{name}'").first()


def test_kinds(one):
    n = {r.kind: r["count"] for r in one.entities.groupBy("kind").count().collect()}
    assert n == {
        "base_table": 2, "field": 12, "table_occurrence": 4, "relationship": 1, "layout_group": 2, "layout": 2, "layout_object": 4, "value_list": 2, "script_group": 1, "script": 3, "script_step": 21,
        "custom_function": 1, "account": 1, "privilege_set": 1, "extended_privilege": 1, "custom_menu": 1, "custom_menu_set": 1, "theme": 1, "external_data_source": 1,
    }
    ids = sorted(r.entity_id for r in one.entities.collect())
    assert ids == list(range(1, len(ids) + 1))


def test_attributes(one):
    f = entity(one, "field", "caption")
    assert (f.base_table, f.stored, f.indexed, f.is_global, f.field_type) == ("Bed", 0, "None", 1, "Calculated") and "Nicely" in f.calc_text
    on, off = json.loads(entity(one, "field", "auto_on").auto_enter), json.loads(entity(one, "field", "auto_off").auto_enter)
    assert on == {"calc": "Trim ( Bed::soil )", "calc_active": True, "always_evaluate": False, "overwrite_existing": True, "prohibit_editing": True}
    assert off == {"calc": "Bed::soil", "calc_active": False} and entity(one, "field", "auto_on").calc_text is None
    serial = json.loads(one.kind("field").where("name = 'code' and base_table = 'Bed'").first().auto_enter)
    assert serial == {"serial": {"increment": "1", "nextValue": "77", "generate": "OnCreation"}, "always_evaluate": False}
    assert json.loads(entity(one, "field", "looked").auto_enter) == {"lookup_source": "Plant::label", "lookup_active": True, "lookup": True}
    assert json.loads(entity(one, "field", "checked").extra_json) == {"validation_calc": "Bed::code > 0"}
    assert entity(one, "base_table", "Bed").records == 120 and entity(one, "base_table", "Shrub").records is None
    rel = one.kind("relationship").first()
    x = json.loads(rel.extra_json)
    assert rel.name == "Bed :: Plant" and [s["cascade_delete"] for s in x["sides"]] == [False, True]
    assert x["predicates"] == [{"op": "Equal", "left": "Bed::code", "right": "Plant::code"}, {"op": "LessThan", "left": "Bed::soil"}]
    assert json.loads(entity(one, "value_list", "Kinds").extra_json) == {"source": "Custom", "custom_values": ["loam", "clay", "sand"]}
    assert json.loads(entity(one, "value_list", "Labels").extra_json) == {"source": "Field", "show_related": False, "primary": {"field": "Plant::code", "show": True, "sort": True}, "secondary": {"field": "Plant::label", "show": True, "sort": False}}
    box = json.loads(entity(one, "layout_object", "box").extra_json)
    assert box == {"object_type": "Portal", "key": "1", "bounds": "1,2,30,40"} and "bounds" not in json.loads(entity(one, "layout_object", "go").extra_json)
    assert entity(one, "layout", "Overview").grp == "Inner" and entity(one, "script", "Water").grp == "Chores" and entity(one, "script", "Loose").grp is None
    assert entity(one, "table_occurrence", "far_Tool").ext_file == "Shed"
    steps = rows(one.kind("script_step").where("name = 'Perform Script'").orderBy("entity_id"), "seq", "extra_json")
    assert steps[0][0] == 1 and json.loads(steps[1][1])["disabled"] is True


def test_references(one, two):
    by = Counter((r.context, r.target_kind) for r in one.refs.collect())
    assert by[("trigger", "script")] == 2 and by[("lookup", "field")] == 2 and by[("join_predicate", "field")] == 3 and by[("join_predicate", "table_occurrence")] == 2
    assert by[("auto_enter", "field")] == 2 and by[("validation", "field")] == 1 and by[("calc", "field")] == 4 and by[("function_ref", "custom_function")] == 1
    assert by[("value_list_field", "field")] == 2 and by[("sort", "field")] == 1 and by[("step_target", "field")] == 1 and by[("layout_object", "field")] == 2
    assert by[("go_to_layout", "layout")] == 3 and by[("value_list_source", "value_list")] == 1 and by[("to_reference", "table_occurrence")] == 1 and by[("perform_script", "script")] == 6
    r = {(x.context, x.target_raw, x.disabled): x for x in one.refs.collect()}
    assert r[("auto_enter", "Bed::soil", 0)] and r[("auto_enter", "Bed::soil", 1)] and r[("lookup", "Plant::label", 1)] and r[("perform_script", "Prune", 1)]
    guess = r[("calc", "code", 0)]
    bed_code = one.kind("field").where("name = 'code' and base_table = 'Bed'").first().entity_id
    assert (guess.target_entity_id, guess.ambiguous) == (bed_code, 1)
    plant = [x for x in one.refs.collect() if x.target_raw == "Plant::code" and x.context == "join_predicate"][0]
    assert plant.target_entity_id == one.kind("field").where("name = 'code' and base_table = 'Shrub'").first().entity_id
    # a script of another file never resolves locally, though an id of the same number exists here
    far = [x for x in one.refs.collect() if x.target_raw == "Oil"]
    assert {x.target_entity_id for x in far} == {None} and {x.target_file for x in far} == {"Shed"}
    oil = entity(two, "script", "Oil").entity_id
    assert {x.target_entity_id for x in two.refs.collect() if x.target_raw == "Oil"} == {oil}
    assert [x.target_entity_id for x in one.refs.collect() if x.target_raw == "far_Tool::handle"] == [None]
    assert [x.target_entity_id for x in two.refs.collect() if x.target_raw == "far_Tool::handle"] == [entity(two, "field", "handle").entity_id]
    ids = sorted(x.ref_id for x in two.refs.collect())
    assert ids == list(range(1, len(ids) + 1))


def test_views(one):
    assert "only_in_sql" in {r.name for r in one.unused_fields().collect()}
    assert {(r.name, r.only_disabled_refs) for r in one.orphan_scripts().collect()} == {("Prune", 1)}
    assert {r.name for r in one.unused_occurrences().collect()} == {"far_Tool", "spare"}
    assert set(rows(one.triggers(), "trigger_event", "layout_name", "script_name")) == {("OnRecordLoad", "Overview", "Water"), ("OnFirstWindowOpen", None, "Loose")}
    assert rows(one.cascades(), "deleting_table", "victim_table") == [("Bed", "Shrub")]
    assert {(r.target_kind, r.n) for r in one.unresolved().collect()} == {("field", 1), ("script", 3)} or one.unresolved().count() == 2
    assert [r.target_raw for r in one.ambiguous().collect()] == ["code"]
    assert {r.target_raw for r in one.usage_disabled().collect()} == {"Bed::soil", "Plant::label", "Prune"}


def test_texts(spark, built):
    body = {r.name: r.body for r in index.docs(spark, str(built / "one")).collect()}
    assert "Hello <<Bed::soil>> twice" in body["Overview"] and "Hello" in body["box"] and body["Overview"].index("Hello") < body["Overview"].index("go")
    assert body["Kinds"] == "Kinds loam clay sand"


def test_record_operations(one):
    ops = rows(commands.mutations(one).where("script_name = 'Water'").orderBy("entity_id"), "step_type", "tier", "context", "state")
    assert ops == [
        ("New Record/Request", "likely", "Bed", "live"), ("Delete Record/Request", "likely", "Plant", "live"), ("Duplicate Record/Request", "check", "Plant", "live"), ("New Record/Request", "check", "Plant", "find"),
        ("Delete All Records", "check", "Plant", "disabled"), ("Delete Portal Row", "check", "Plant", "live"), ("Truncate Table", "confident", "Shrub", "live"),
    ]


def test_walks_and_commands(one, two):
    names = {r.entity_id: r.name for r in two.entities.collect()}
    edges = {(names[a], names[b]) for a, b in rows(call_edges(two))}
    assert edges == {("Loose", "Water"), ("Water", "Oil"), ("Prune", "Water")}
    reach = closure(call_edges(two), two.kind("script").select("entity_id"))
    assert {(names[r.root], names[r.node], r.depth) for r in reach.collect()} >= {("Loose", "Oil", 2), ("Loose", "Loose", 0)}
    assert {r.cyclic for r in revisits(call_edges(two), reach).collect()} == {False}
    t = commands.trigger_map(two, ["Bed::caption"], table="Shrub", recompute="Oil").collect()
    assert {(r.script_name, r.verdict) for r in t} == {("Loose", "recompute-in-chain"), ("Prune", "recompute-in-chain"), ("Water", "recompute-in-chain")}
    assert {r.chain for r in t} == {"Loose -> Water", "Prune -> Water", "Water"}
    with pytest.raises(ValueError):
        commands.trigger_map(two, ["caption"])
    with pytest.raises(ValueError):
        commands.trigger_map(two, ["Bed::nothing"])
    assert commands.trigger_map(two, ["Bed::nothing"], must_exist=False).count() == 0
    both = commands.trigger_map(two, ["Bed::nothing", "Bed::caption"], table="Shrub", recompute="Oil", must_exist=False)
    assert sorted(both.collect()) == sorted(t)
    w = commands.where_used(one, "Plant::label").collect()
    assert {r.context for r in w} == {"lookup", "value_list_field"} and {r.label for r in w} == {"Shrub::label"}
    parts = commands.investigate(two, "Water")
    assert {r.script_name for r in parts["chain"].collect()} == {"Water", "Oil"} and parts["callers"].count() >= 2
    assert {(r.var, r.writes) for r in commands.global_hygiene(one).collect()} == {("$$SEASON", 1)}
    assert {(r.name, r.n_values, r.bound) for r in commands.value_lists(one).collect()} == {("Kinds", 3, 1), ("Labels", 0, 0)}
    lines = [r.line for r in mermaid(call_edges(two).selectExpr("cast(caller as string) caller", "cast(callee as string) callee")).collect()]
    assert len(lines) == 3 and all(" --> " in x for x in lines)


def test_command_line(spark, built, capsys):
    path = str(built / "one")
    for args in (["where", path, "Bed::soil"], ["search", path, "soil"], ["stats", path], ["cascades", path, "Shrub"], ["valuelist", path, "k%"], ["investigate", path, "Water", "--chain"], ["mutations", path, "--like", "plant"],
                 ["sql", path, "select kind, count(*) as n from entities group by kind"], ["list", str(built)], ["trigger-map", path, "--inputs", "Bed::soil", "--layouts", "Over%"]):
        assert cli.main(args) == 0 and capsys.readouterr().out.strip()
    assert cli.main(["stats", str(built / "none")]) == 1 and capsys.readouterr().err.startswith("error:")


def test_report_page(spark, built, one, tmp_path):
    text = Path(write_report(one, index.meta(spark, str(built / "one")), str(tmp_path / "r.html"))).read_text()
    data = json.loads(text.split("const data=")[1].split(";\n")[0])
    assert len(data["entities"]) == one.entities.count() and len(data["edges"]) == one.refs.count() and "</script>" not in text.split("const data=")[1].split(";\n")[0]


def test_snippet(spark, tmp_path):
    xml = script_xml(GARDEN, "Water")
    out, n = snippet(xml)
    assert n == 17 and "StepText" not in out and "<Text>a&#13;b&#09;c</Text>" in out and '<Restore state="False"></Restore>' in out and "/>" not in out
    assert clipboard_class(out) == "XMSS" and clipboard_class("<Layout/>") == "XML2"
    wide = tmp_path / "wide.xml"
    wide.write_bytes(b"\xff\xfe" + Path(GARDEN).read_text().replace('<?xml version="1.0"?>', "").encode("utf-16-le"))
    assert script_xml(str(wide), "Water") == xml
    with pytest.raises(ValueError):
        script_xml(GARDEN, "Water", "7")


def test_hostile_inputs(spark, tmp_path, built):
    wide = tmp_path / "wide.xml"
    wide.write_bytes(b"\xff\xfe" + Path(GARDEN).read_text().replace('<?xml version="1.0"?>', "").encode("utf-16-le"))
    index.build(spark, str(wide), str(tmp_path / "wide"))
    a, b = index.open_index(spark, str(tmp_path / "wide")), index.open_index(spark, str(built / "one"))
    assert sorted(map(str, rows(a.entities))) == sorted(map(str, rows(b.entities))) and sorted(map(str, rows(a.refs))) == sorted(map(str, rows(b.refs)))
    bad = {"cut.xml": Path(GARDEN).read_text()[:3000], "bomb.xml": '<!DOCTYPE x [<!ENTITY a "b">]><FMPReport><File name="&a;"/></FMPReport>', "other.xml": "<root/>"}
    for name, text in bad.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):
            index.build(spark, str(tmp_path / name), str(tmp_path / "out"))
        assert not os.path.exists(tmp_path / "out")
    (tmp_path / "mine").mkdir()
    with pytest.raises(ValueError):
        index.build(spark, GARDEN, str(tmp_path / "mine"))
    assert not [x for x in os.listdir(tmp_path) if x.startswith(".building")]
    s = tmp_path / "Summary.xml"
    s.write_text('<FMPReport type="Summary"><File link="a.xml"/><File link="../b.xml"/><File link="/etc/passwd"/></FMPReport>')
    assert expand_manifest(str(s)) == [str(tmp_path / "a.xml")] and expand_manifest(GARDEN) is None
    assert run_row([GARDEN])["ddr_version"] == "21.0.1" and run_row([GARDEN])["creation_time"] == "08:15:00"
