"""The general operators against brute force on small tables: nulls, repeated rows, empty tables, clashing columns, skew."""

import json
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators.heavy_keys import heavy_keys, key_profiles
from graphloom.operators.hierarchy import descendants, nested_sets
from graphloom.operators.nested import _parse, _parse_deep, _payload, child_table, nested_nodes, nested_paths, read_child_tables, top_value, visit, write_child_tables
from graphloom.operators.orphans import orphan_refs
from graphloom.operators.recordops import record_ops
from graphloom.operators.snapshots import newest_runs, snapshot_changes

ENTITY = "entity_id long, file_id long, kind string, fm_id string, name string, parent_entity_id long, base_table string, calc_text string, ext_file string, extra_json string, auto_enter string, k1 string, run_id long, id long"
REF = "ref_id long, file_id long, source_entity_id long, context string, target_kind string, target_name string, target_to_name string, target_file string, target_entity_id long, stem string"
FILE, RUN = "file_id long, run_id long, name string, path string", "run_id long, source_path string, parsed_at timestamp, label string"


def table(spark, schema, rows):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute_tree(parent):
    out = {}
    for x in parent:
        path, at = [], x
        while at in parent and at not in path:
            path.append(at)
            at = parent[at]
        out[x] = (min(path[path.index(at):]), -1) if at in path else (path[-1], len(path) - 1)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_hierarchy(spark, seed):
    rnd = random.Random(seed)
    ids = rnd.sample(range(1000), 160)
    parent = {x: rnd.choice([None, rnd.choice(ids), rnd.choice(ids), 5000 + x]) for x in ids}
    for a, b in zip(ids[:40], ids[1:41]):
        parent[a] = b  # a long chain
    parent |= {x: ids[50] for x in ids[60:110]}  # one parent with many children
    rows = [{"entity_id": k, "parent_entity_id": v, "name": f"n{k}" if k % 7 else None} for k, v in parent.items()] * 2 + [{"entity_id": None, "parent_entity_id": 3}]
    numbered = nested_sets(table(spark, ENTITY, rows), label="name")
    sets = {r.id: r for r in numbered.collect()}
    want = brute_tree(parent)
    assert {k: (r.root, r.depth) for k, r in sets.items()} == want
    above = defaultdict(set)
    for x in parent:
        at = parent[x]
        while want[x][1] >= 0 and at in parent:
            above[at].add(x)
            at = parent[at]
    for a, r in sets.items():
        if r.depth >= 0:
            inside = {b for b, q in sets.items() if q.root == r.root and q.depth >= 0 and r.pre <= q.pre < r.pre + r.size} - {a}
            assert inside == above[a] and r.size == len(inside) + 1 and len(r.path.split(" / ")) == r.depth + 1
        else:
            assert r.pre is None and r.path is None
    pairs = descendants(numbered)
    assert got(pairs.select("ancestor_id", "id")) == sorted(((a, x) for a, s in above.items() for x in s), key=str)


def test_hierarchy_empty_and_loops(spark):
    assert nested_sets(table(spark, ENTITY, [])).count() == 0
    two = nested_sets(table(spark, ENTITY, [{"entity_id": 9, "parent_entity_id": 9}, {"entity_id": 1, "parent_entity_id": 9}, {"entity_id": 4, "parent_entity_id": 3}, {"entity_id": 3, "parent_entity_id": 4}, {"entity_id": 2, "parent_entity_id": 1}]))
    assert {(r.id, r.root, r.depth) for r in two.collect()} == {(9, 9, -1), (1, 9, -1), (2, 9, -1), (3, 3, -1), (4, 3, -1)}


def test_snapshots(spark):
    ts = lambda d: __import__("datetime").datetime(2024, 1, d)
    runs = table(spark, RUN, [{"run_id": 5, "source_path": "s", "parsed_at": ts(1)}, {"run_id": 2, "source_path": "s", "parsed_at": ts(2)}, {"run_id": 3, "source_path": "s", "parsed_at": ts(2)}, {"run_id": 5, "source_path": "s", "parsed_at": ts(1)}, {"run_id": 7, "source_path": None, "parsed_at": ts(1)}])
    files = table(spark, FILE, [{"file_id": 1, "run_id": 5, "name": "A.fmp12"}, {"file_id": 2, "run_id": 2, "name": "a"}, {"file_id": 3, "run_id": 3, "name": "A.FMP12"}, {"file_id": 4, "run_id": 7, "name": None}])
    e = lambda i, f, fm, name="x", calc=None, kind="field", base=None: {"entity_id": i, "file_id": f, "fm_id": fm, "name": name, "calc_text": calc, "kind": kind, "base_table": base}
    rows = [e(10, 1, "1"), e(10, 1, "1"), e(11, 1, "2"), e(12, 1, "3", None), e(13, 1, None), e(14, 1, "5", kind="script_step"), e(None, 2, "9"), e(20, 2, "1", "x "), e(21, 2, "3", ""), e(22, 2, "2", base=""), e(30, 3, "1", "x "), e(31, 3, "3", "", ""), e(40, 4, "1")]
    d = snapshot_changes(table(spark, ENTITY, rows), files, runs)
    assert got(d) == sorted([(2, 20, "changed"), (2, 21, "changed"), (2, 22, "added"), (2, 11, "removed"), (3, 31, "changed"), (3, 22, "removed")], key=str)
    assert got(newest_runs(runs)) == [(3,), (7,)]
    assert snapshot_changes(table(spark, ENTITY, []), table(spark, FILE, []), table(spark, RUN, [])).count() == 0


def test_orphans(spark):
    files = table(spark, FILE, [{"file_id": 1, "run_id": 1, "name": "Main.fmp12"}, {"file_id": 2, "run_id": 1, "name": "Other"}, {"file_id": 3, "run_id": 2, "name": "Main"}])
    e = lambda i, f, kind, name, base=None, ext=None: {"entity_id": i, "file_id": f, "kind": kind, "name": name, "base_table": base, "ext_file": ext}
    ents = [e(1, 1, "field", "a", "T"), e(2, 1, "table_occurrence", "to", "T"), e(3, 2, "field", "b", "U"), e(4, 1, "table_occurrence", "far", "U", "OTHER.fmp12"), e(5, 3, "script", "s"), e(6, 1, "script", None), e(7, 1, "table_occurrence", "core", "K", "KernelBox"), e(8, 1, "table_occurrence", "nobase")]
    core = [e(100, 1, "script", "kb"), e(101, 1, "field", "kf", "K")]
    r = lambda i, **k: {"ref_id": i, "file_id": 1, "target_kind": "field"} | k
    refs = [
        r(1, target_entity_id=1), r(2, target_entity_id=5), r(3, target_entity_id=100), r(4, target_entity_id=77), r(5, target_name="a"), r(6, target_name="A"), r(7, target_name="a", target_to_name="to"), r(8, target_name="b", target_to_name="far"),
        r(9, target_name="a", target_to_name="far"), r(10, target_name="kf", target_to_name="core"), r(11, target_kind="script", target_name="kb", target_file="KERNELBOX.fmp12"), r(12, target_kind="script", target_name="s"),
        r(13, target_name="b", target_file="other"), r(14, target_name="b", target_file="gone"), r(15), r(16, target_kind=None, target_name="a"), r(17, target_name="a", target_to_name="nobase"), r(18, target_kind="script", target_name="s", target_to_name="to"),
        r(4, target_entity_id=77), r(19, target_name="a", target_to_name="none"),
    ]
    d = orphan_refs(table(spark, REF, refs), table(spark, ENTITY, ents * 2), table(spark, ENTITY, core), files, "kernelbox")
    assert {(x.ref_id, x.reason) for x in d.collect()} == {(2, "dead_id"), (4, "dead_id"), *((i, "no_name") for i in (6, 9, 12, 14, 16, 17, 18, 19))} and d.count() == 10
    empty = orphan_refs(table(spark, REF, []), table(spark, ENTITY, []), table(spark, ENTITY, []), table(spark, FILE, []), "kernelbox")
    assert empty.count() == 0


def test_heavy_keys(spark):
    rows = [{"ref_id": i, "target_entity_id": 1 if i % 3 else None, "source_entity_id": i % 50, "context": None if i % 2 else "c"} for i in range(300)]
    df = table(spark, REF, rows + rows[:40])
    assert got(heavy_keys(df, 0.1).select("key_role", "entity_id", "n_rows")) == [("target", 1, 200)]
    p = {(r.key_role, r.entity_id): r for r in key_profiles(df).collect()}
    assert (p["target", 1].n_rows, p["target", 1].n_contexts, p["target", 1].n_partners, p["target", 1].top_context) == (200, 2, 50, "c") and len(p) == 51
    assert heavy_keys(table(spark, REF, [])).count() == 0 and key_profiles(table(spark, REF, [])).count() == 0


def naive_paths(value):
    out = []

    def walk(v, path, parent):
        if isinstance(v, dict):
            if path != "$":
                out.append((path, parent))
            for k, x in v.items():
                walk(x, f"{path}.{k}", path)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", parent)

    walk(value, "$", "$")
    return out


def rebuilt(text):
    """The value put together again from its flat rows."""
    rows = [(p, json.loads(_payload(node)[0])) for _, p, _, node in visit(top_value(text))]
    top = rows[0][1][""] if isinstance(json.loads(text), list) and rows[0][1] else [] if isinstance(json.loads(text), list) else rows[0][1]
    for path, own in rows[1:]:
        at, steps = top, re.findall(r"\.([^.\[]*)|\[(\d+)\]", path)
        steps = [int(i) if i else k for k, i in steps]
        for k, after in zip(steps, steps[1:] + [None]):
            new = own if after is None else [] if isinstance(after, int) else {}
            if isinstance(k, int):
                at.extend([None] * (k + 1 - len(at)))
                at[k] = new if at[k] is None else at[k]
            else:
                at.setdefault(k, new)
            at = at[k]
    return top


def test_nested_json(spark):
    rnd = random.Random(1)

    def make(depth):
        return rnd.choice([lambda: {rnd.choice("abcé"): make(depth - 1) for _ in range(rnd.randint(0, 3))}, lambda: [make(depth - 1) for _ in range(rnd.randint(0, 3))], lambda: rnd.choice([None, True, 1.5, -3, "x{}\n", '{"a": {}}'])])() if depth else rnd.choice([0, "s"])

    values = [make(5) for _ in range(300)]
    for v in values:
        text = json.dumps(v)
        assert _parse_deep(text) == _parse(text)
        if isinstance(v, (dict, list)):
            assert [(p, q) for _, p, q, _ in visit(top_value(text))] == [("$", None), *naive_paths(v)]
            assert rebuilt(text) == v
    deep = '{"a":' * 50_000 + "{}" + "}" * 50_000
    assert sum(1 for _ in visit(top_value(deep))) == 50_001
    for bad in ('{"a": {}', "{&quot;a&quot;: {}}", '{"a": NaN, "b": {}}', "{'a': {}}", '{"a": {},}', '{"a": {}} x', "[1,]", '{"a" {}}', '{"a":{}}}', '{"a":"\n","b":{}}', "", " ", '"{bad"', '"[{}]"', "12"):
        assert top_value(bad) is None, bad
        with pytest.raises(ValueError):
            _parse_deep(bad) if bad not in ('"{bad"', '"[{}]"', "12") else int("x")
    rows = [{"entity_id": 1, "extra_json": '{"s": [{"p": {}}, 3, [{}]]}'}, {"entity_id": 1, "extra_json": '{"s": [{"p": {}}, 3, [{}]]}'}, {"entity_id": 2, "auto_enter": json.dumps(json.dumps({"a": {"b": 1}}))}, {"extra_json": '{"a": {"b": {}}}'}, {"entity_id": 3, "extra_json": "{"}, {"entity_id": 4}, {"entity_id": 5, "extra_json": '"\\u007b\\"a\\": \\u007b}}"'}]
    d = nested_paths(table(spark, ENTITY, rows))
    assert got(d) == sorted([(1, "extra_json", "$.s[0]", "$"), (1, "extra_json", "$.s[0].p", "$.s[0]"), (1, "extra_json", "$.s[2][0]", "$"), (2, "auto_enter", "$.a", "$"), (5, "extra_json", "$.a", "$")], key=str)
    assert nested_paths(table(spark, ENTITY, [])).count() == 0


def test_nested_json_one_brace(spark):
    values = ['[{"a": 1}]', "[[{}]]", " \n[1, {}]", '{"a": [1]}', '[1, "x"]', '["{", {}']
    d = nested_paths(table(spark, ENTITY, [{"entity_id": i, "extra_json": v, "auto_enter": v} for i, v in enumerate(values)]))
    assert got(d) == sorted([(i, f, p, "$") for f in ("extra_json", "auto_enter") for i, p in ((0, "$[0]"), (1, "$[0][0]"), (2, "$[1]"))], key=str)


def test_child_tables(spark, tmp_path):
    rows = [{"entity_id": 1, "extra_json": '{"sides": [{"side": "left", "to": "x", "cascade_delete": true}, {"side": "right"}], "other": {"n": 1, "l": [1, {"k": 2}]}}'}]
    nodes = nested_nodes(table(spark, ENTITY, rows))
    sides = {r.node_path: r for r in child_table(nodes, "sides").collect()}
    assert sides["$.sides[0]"].cascade_delete is True and sides["$.sides[1]"].to is None
    assert child_table(nodes, "other").first().members == {"n": "1", "l": "[1,null]"}
    write_child_tables(nodes, str(tmp_path / "t"))
    back = read_child_tables(spark, str(tmp_path / "t"))
    assert {r.tag for r in back.collect()} == {"root", "sides", "other", "l"} and got(back) == got(nodes)
    odd = nested_nodes(table(spark, ENTITY, [{"entity_id": 1, "extra_json": '{"a": null, "b": 1.50, "a": [[1, {}], []], "": {"x": "y"}}'}, {"entity_id": 2, "auto_enter": '[1, [2, {"c": 1e400}]]'}, {"entity_id": 3, "auto_enter": "[{}]"}, {"entity_id": 4, "auto_enter": "{}"}, {"entity_id": 5, "auto_enter": "7"}]))
    assert [(r.entity_id, r.tag, r.node_path, r.parent_path, r.payload, r.n_members) for r in odd.orderBy("entity_id", "node_path").collect()] == [
        (1, "root", "$", None, '{"a": null, "b": 1.50, "a": [[1, null], []]}', 3), (1, "", "$.", "$", '{"x": "y"}', 1), (1, "a", "$.a[0][1]", "$", "{}", 0),
        (2, "root", "$", None, '{"": [1, [2, null]]}', 1), (2, "root", "$[1][1]", "$", '{"c": 1e400}', 1), (3, "root", "$", None, "{}", 0), (3, "root", "$[0]", "$", "{}", 0), (4, "root", "$", None, "{}", 0),
    ]
    write_child_tables(odd, str(tmp_path / "u"))
    assert got(read_child_tables(spark, str(tmp_path / "u"))) == got(odd)


def fold(steps):
    """A plain pass over one script's steps."""
    out, ctx, depth, find = [], None, 0, False
    for i, (st, to, off) in enumerate(steps):
        if not off:
            if st in ("If", "Loop"):
                depth += 1
            elif st in ("End If", "End Loop"):
                depth = max(0, depth - 1)
                ctx = (*ctx[:2], True) if ctx and ctx[1] > depth else ctx
            elif st == "Else":
                ctx = (*ctx[:2], True) if ctx and ctx[1] >= depth else ctx
            elif st == "Go to Layout":
                ctx = (to, depth, False) if to else None
            elif st == "Go to Related Record":
                ctx = (to, depth, True) if to else None
            elif st in ("Enter Find Mode", "Perform Find"):
                find = st == "Enter Find Mode"
        if st in ("New Record/Request", "Delete Record/Request"):
            out.append((i, ctx[0] if ctx else None, "check" if not ctx or ctx[2] else "likely", "disabled" if off else "find" if find else "live"))
    return out


def test_record_operations(spark):
    rnd = random.Random(4)
    kinds = ["If", "Loop", "End If", "End Loop", "Else", "Go to Layout", "Go to Related Record", "Enter Find Mode", "Perform Find", "New Record/Request", "Delete Record/Request", "Set Field", None]
    scripts = {s: [(rnd.choice(kinds), rnd.choice(["T", "U •", None]), rnd.random() < 0.15) for _ in range(40)] for s in range(30)}
    rows = [(s, s * 100 + i, i, st, f'{st} [ "x" ({to}) ]' if to else None, off) for s, steps in scripts.items() for i, (st, to, off) in enumerate(steps)]
    ops = record_ops(spark.createDataFrame(rows, "script_id long, entity_id long, seq int, step_type string, step_text string, flagged boolean"))
    want = [(s, i, c, t, z) for s, steps in scripts.items() for i, c, t, z in fold(steps)]
    assert got(ops.select("script_id", "seq", "context", "tier", "state")) == sorted(want, key=str)


def test_glob_and_names(spark):
    from graphloom.functions.text import glob, leaf_part, like_ci, to_part

    df = spark.createDataFrame([("A::b::c",), ("plain",), ("",), (None,), ("x*y",)], "s string")
    assert [tuple(r) for r in df.select(to_part(F.col("s")), leaf_part(F.col("s"))).collect()] == [("A", "b::c"), (None, "plain"), (None, ""), (None, None), (None, "x*y")]
    assert [r[0] for r in df.select(glob(F.col("s"), "*l?in*")).collect()] == [False, True, False, None, False]
    assert [r[0] for r in df.select(like_ci(F.col("s"), "PL%")).collect()] == [False, True, False, None, False]


def test_full_text(spark):
    from graphloom.operators.fulltext import Query, indexed, lengths, matching, postings, search

    d = spark.createDataFrame([(1, 1, "k", "Größe", "alpha beta gamma"), (2, 1, "k", "two", "beta alpha, alpha"), (3, 1, "k", None, "gammaray É"), (4, 1, "k", "", "")], "entity_id long, file_id long, kind string, name string, body string")
    posts = postings(d).cache()

    def hit(q):
        """By the index, and the same by the predicate that streams use."""
        found = {r.entity_id for r in matching(posts, q).collect()}
        assert found == {r.entity_id for r in indexed(d).where(Query(q).matches()).collect()}
        return found

    assert hit("alpha") == {1, 2} and hit('"alpha beta"') == {1} and hit("gamma*") == {1, 3} and hit("alpha NOT gamma") == {2} and hit("(gammaray OR two)") == {2, 3}
    assert hit("NEAR(alpha gamma, 1)") == {1} and hit("NEAR(gamma alpha, 0)") == set() and hit('NEAR("alpha alpha" beta, 0)') == {2} and hit("NEAR(alpha)") == set()
    assert {r.entity_id for r in matching(posts, "NEAR(alpha beta gamma, 1) OR two").collect()} == {1, 2}
    assert hit("body:two") == set() and hit("name:two") == {2} and hit("e") == {3} and hit('"unclosed') == set() and hit("alpha AND AND") == set() and hit("") == set() and hit("!!") == set()
    assert [r.entity_id for r in search(posts, lengths(d), "alpha").collect()] == [2, 1] and search(posts, lengths(d), "!!").count() == 0
    assert search(posts, lengths(d), "beta").where("entity_id = 1").first().match == "alpha [beta] gamma"


def test_closure(spark):
    from graphloom.operators.closure import closure, revisits
    from graphloom.operators.hierarchy import ancestors

    rnd = random.Random(3)
    edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(60)] + [(None, 1), (1, None)]
    e = spark.createDataFrame(edges, "caller long, callee long")
    roots = spark.createDataFrame([(i,) for i in range(0, 45, 3)] + [(None,)], "entity_id long")
    want = set()
    for r in range(0, 45, 3):
        seen, level, d = {r}, [r], 0
        while level:
            want |= {(r, x, d) for x in level}
            level = sorted({b for a, b in edges if a in level and b is not None} - seen)
            seen |= set(level)
            d += 1
    for n in (1000, 0):
        assert {tuple(x) for x in closure(e, roots, local_edges=n).collect()} == want
        assert {tuple(x) for x in closure(e, roots, max_depth=2, local_edges=n).collect()} == {w for w in want if w[2] <= 2}
    assert {tuple(x) for x in ancestors(e.toDF("id", "up")).join(roots.toDF("id"), "id").collect()} == {(r, x) for r, x, _ in want if r != x}
    line = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8), (8, 7)], "caller long, callee long")
    r = {x.root: (x.revisited, x.cyclic) for x in revisits(line, closure(line, spark.createDataFrame([(1,), (2,), (7,)], "x long"))).collect()}
    assert r == {1: (True, False), 2: (False, False), 7: (True, True)}


def test_closure_by_hubs(spark):
    """Pairs with hubs as without; the parts name what a hub reaches once, so they stay in proportion to the nodes."""
    from graphloom.operators.closure import closure, reach_parts

    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)] + [(x, 100) for x in range(0, 30, 2)] + [(100, x) for x in range(20, 50, 3)] + [(x, 101) for x in range(1, 15)] + [(101, x) for x in range(40, 60, 2)]
    e = spark.createDataFrame(edges, "caller long, callee long")
    roots = spark.createDataFrame([(i,) for i in [*range(60), 100, 101, 777]], "entity_id long")
    want = {tuple(x) for x in closure(e, roots, local_edges=0).collect()}
    for ways in (1, 6, 100, 10**6):
        got = closure(e, roots, hub_ways=ways).collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
        assert {tuple(x) for x in closure(e, roots, max_depth=2, hub_ways=ways).collect()} == {w for w in want if w[2] <= 2}
        rest, members = (x.collect() for x in reach_parts(e, roots, hub_ways=ways))
        pairs = [(r.root, r.node) for r in rest if r.node is not None] + [(r.root, m.node) for r in rest if r.hub is not None for m in members if m.hub == r.hub]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {w[:2] for w in want}
    ins = spark.range(2000).selectExpr("id as caller", "5000L as callee")
    star = ins.union(ins.selectExpr("5000L as caller", "caller + 10000 as callee"))
    rest, members = reach_parts(star, ins.select("caller"))
    assert (rest.count(), members.count()) == (4000, 2001)


def test_closure_is_stored_in_few_bytes(spark, tmp_path):
    """All pairs by way of a hub take a fraction of a byte each in Parquet; in tiles of any size they are the same."""
    from graphloom.operators.closure import closure

    ins, outs = spark.range(600).selectExpr("id as caller", "5000L as callee"), spark.range(20_000).selectExpr("5000L as caller", "id + 10000 as callee")
    e = ins.union(outs).union(spark.createDataFrame([(7, 10_005), (8, 9), (10_003, 10_004)], "caller long, callee long"))
    closure(e, ins.select("caller")).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < pairs.count() == 600 * 20_002 + 1
    near = {tuple(x) for x in pairs.where("depth < 2").collect()}
    assert near == {(i, i, 0) for i in range(600)} | {(i, 5000, 1) for i in range(600)} | {(7, 10_005, 1), (8, 9, 1)}
    assert pairs.where("depth > 2").isEmpty() and pairs.distinct().count() == 600 * 20_002 + 1

    rnd = random.Random(11)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)] + [(x, 100 + x % 2) for x in range(30)] + [(100 + x % 3 // 2, x) for x in range(20, 50)]
    e, roots = spark.createDataFrame(edges, "caller long, callee long"), spark.createDataFrame([(i,) for i in [*range(60), 100, 101, 777]], "entity_id long")
    want = sorted(tuple(x) for x in closure(e, roots, local_edges=0).collect())
    for n in (1, 7, 1000):
        for deepest in (None, 2):
            assert sorted(tuple(x) for x in closure(e, roots, max_depth=deepest, hub_ways=6, tile_nodes=n).collect()) == [w for w in want if deepest is None or w[2] <= deepest]


def test_closure_roots_are_dealt(spark):
    """Few bytes of roots make many pairs: they are searched for in many tasks, not merged into one."""
    from graphloom.operators.closure import closure

    e = spark.createDataFrame([(1, 2), (2, 3)], "caller long, callee long")
    roots = spark.createDataFrame([(i,) for i in range(1000)], "entity_id long")
    tasks = closure(e, roots).select(F.spark_partition_id().alias("task"), "root").distinct()
    assert tasks.select("task").distinct().count() >= 8


def test_streams(spark, tmp_path):
    from graphloom.streaming.watch import matching, unresolved_by_window

    docs = spark.createDataFrame([(1, 1, "k", "a", "alpha beta"), (2, 1, "k", "b", "beta")], "entity_id long, file_id long, kind string, name string, body string")
    docs.write.parquet(str(tmp_path / "docs"))
    q = matching(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), "alpha").writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.entity_id for r in spark.sql("select * from found").collect()] == [1]
    refs = spark.sql("select id as ref_id, timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, 0, cast(id as int) * 20) as arrived_at, 'script' as target_kind, 'trigger' as context, if(id % 2 = 0, null, id) as target_entity_id from range(6)")
    refs.union(refs).write.parquet(str(tmp_path / "refs"))
    q = unresolved_by_window(spark.readStream.schema(refs.schema).parquet(str(tmp_path / "refs"))).writeStream.format("memory").queryName("counts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = {str(r.start): (r.n, r.n_unresolved) for r in spark.sql("select * from counts").collect()}
    assert set(rows) <= {"2024-01-01 00:00:00", "2024-01-01 01:00:00"} and all(v[0] <= 3 for v in rows.values())
