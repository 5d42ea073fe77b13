"""Queries over our own small design reports, from XML to entities, references, texts, index and sinks; what they are compared with are fixed rows.

The reports and the rows (checked by hand against the XML) lie in ``tests/data``. The folder of tables that every query is given is not read here.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.cli import show
from graphloom.common import Stages
from graphloom.operators.extract import entities_of, files_of, refs_of, texts_of
from graphloom.operators.graph import Graph
from graphloom.operators.recordops import record_ops, script_steps
from graphloom.operators.resolve import resolve
from graphloom.plans import commands
from graphloom.sinks import index
from graphloom.sinks.report import mermaid, named_calls, write_health, write_report
from graphloom.sinks.snippet import clipboard_class, script_xml, snippet
from graphloom.sources.report_xml import encoding, expand_manifest, nodes, run_row

DATA = Path(__file__).resolve().parent.parent.parent / "tests" / "data"
REPORTS = [str(DATA / f"{n}.xml") for n in ("garden", "shed", "pots")]
ATTRIBUTES = ["data_type", "field_type", "calc_text", "step_type", "seq", "records", "ext_file", "stored", "indexed", "is_global", "auto_enter", "extra_json"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SCHEMAS: dict[str, str] = {}


def _query(schema: str):
    """Registers a query; its columns and their types are those of the fixed rows."""

    def add(f: Callable[[SparkSession], DataFrame]):
        name = f.__name__
        QUERIES[name], SCHEMAS[name] = (lambda s, d: f(s).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])), schema
        return f

    return add


def _parsed(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    st = Stages(s, "reports")
    n = st.put(nodes(s, REPORTS), "nodes")
    return n, st.put(entities_of(n), "entities")


def _rows(s: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


@_query("entity_id bigint, file_id bigint, kind string, fm_id string, name string, parent_entity_id bigint, grp string, base_table string")
def ex_entities(s: SparkSession) -> DataFrame:
    """All kinds of entities with their place in the document."""
    return _parsed(s)[1]


@_query("entity_id bigint, attribute string, value string")
def fin_attributes(s: SparkSession) -> DataFrame:
    """Everything that elements below an entity add to it, one row per attribute that is there."""
    e = _parsed(s)[1]
    return e.select("entity_id", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in ATTRIBUTES])).alias("x")).select("entity_id", "x.*").where("value is not null")


@_query("entity_id bigint, name string, body string")
def fin_texts(s: SparkSession) -> DataFrame:
    """Texts for the search, those of layouts and objects with all that is on them."""
    return texts_of(_parsed(s)[1])


@_query("ref_id bigint, file_id bigint, source_entity_id bigint, source_kind string, context string, target_kind string, target_fm_id string, target_name string, target_to_name string, target_raw string, target_file string, target_entity_id bigint, ambiguous int, disabled int, trigger_event string")
def rf_refs(s: SparkSession) -> DataFrame:
    """References by every rule, resolved over the three files."""
    n, e = _parsed(s)
    return resolve(refs_of(n, e), e.select(index.PUBLIC), files_of(n).withColumn("run_id", F.lit(1)))


@_query("file_id bigint, name string, path string, encoding string, entities bigint")
def src_files(s: SparkSession) -> DataFrame:
    """Files of several documents in one id space, whatever their encoding."""
    n, e = _parsed(s)
    kinds = _rows(s, [(i, encoding(p)) for i, p in enumerate(REPORTS)], "file_no int, encoding string")
    return files_of(n).join(kinds, "file_no").join(e.groupBy("file_id").agg(F.count(F.lit(1)).alias("entities")), "file_id")


@_query("nth int, file string")
def src_manifest(s: SparkSession) -> DataFrame:
    """Reports that a summary links to; links out of its folder are left out."""
    return _rows(s, [(i, str(Path(p).relative_to(DATA))) for i, p in enumerate(expand_manifest(str(DATA / "Summary.xml")))], "nth int, file string")


@_query("document string, error string")
def src_refused(s: SparkSession) -> DataFrame:
    """Documents that are refused: entity declarations, cut off, no report; and a target that is no index."""
    root, out = Stages(s, "refused").root, []
    for name in ("bad_dtd", "bad_cut", "bad_other"):
        try:
            index.build(s, str(DATA / f"{name}.xml"), f"{root}/{name}")
            out.append((name, "none"))
        except Exception as e:  # noqa: BLE001 - the kind of error is the result
            out.append((name, "refused" if not index.Files(s).exists(f"{root}/{name}") else f"left something: {e}"))
    index.Files(s).write(f"{root}/mine/notes.txt", "x")
    try:
        index.build(s, REPORTS[1], f"{root}/mine")
    except ValueError as e:
        out.append(("target", str(e).rpartition("/")[2]))
    return _rows(s, out, "document string, error string")


@_query("document string, ddr_version string, creation_time string, label string")
def src_run(s: SparkSession) -> DataFrame:
    """What the head of a report tells of its run."""
    return _rows(s, [(Path(p).stem, r["ddr_version"], r["creation_time"], r["label"]) for p in REPORTS for r in [run_row([p], Path(p).stem.upper() if "pots" in p else None)]], "document string, ddr_version string, creation_time string, label string")


_built: dict[str, str] = {}


def _index(s: SparkSession) -> str:
    """A folder with the index ``all`` of all three reports and an empty folder beside it; built once per application."""
    app = s.sparkContext.applicationId
    if app not in _built:
        root = Stages(s, "indexes").root
        index.build(s, REPORTS, f"{root}/all", "All three")
        index.Files(s).write(f"{root}/other/readme", "no index")
        _built[app] = root
    return _built[app]


def _graph(s: SparkSession) -> Graph:
    return index.open_index(s, f"{_index(s)}/all")


@_query("item string, n bigint")
def snk_summary(s: SparkSession) -> DataFrame:
    """Counts of an index that was written and opened."""
    return index.summary(_graph(s))


@_query("index string, label string, files int, status string")
def src9_catalog(s: SparkSession) -> DataFrame:
    """The indexes in a folder."""
    return _rows(s, [(x["index"], x.get("label"), x.get("files"), x["status"]) for x in index.catalog(s, _index(s))], "index string, label string, files int, status string")


@_query("kind string, name string, found string")
def snk_search(s: SparkSession) -> DataFrame:
    """A search over the stored inverted index: the objects and the layouts that hold them."""
    return index.find(s, f"{_index(s)}/all", 'soil AND ("hello" OR ganz) OR "ganz unten"').select("kind", F.coalesce("name", F.lit("")).alias("name"), F.col("match").alias("found"))


@_query("script string, entity_id bigint, op string, step_type string, tier string, context string, note string, state string")
def rec_ops_report(s: SparkSession) -> DataFrame:
    """Record operations of the reports' scripts, Truncate Table among them."""
    g = _graph(s)
    return record_ops(script_steps(g)).join(g.kind("script").select(F.col("entity_id").alias("script_id"), F.col("name").alias("script")), "script_id")


@_query("script_name string, depth int, evidence string, chain string, n_launch_sites bigint, verdict string")
def cmd8_options(s: SparkSession) -> DataFrame:
    """The trigger map with a table and the script that should recompute."""
    return commands.trigger_map(_graph(s), ["Bed::caption"], table="Shrub", recompute="Oil").unionByName(commands.trigger_map(_graph(s), ["Bed::soil"], recompute="Prune"))


@_query("trigger_event string, layout_name string, script_name string")
def cmd8_quiet(s: SparkSession) -> DataFrame:
    """Triggers on layouts that reach no script that writes a field."""
    return commands.quiet_triggers(_graph(s), "Over%", ["Bed::code"])


@_query("source bigint, target bigint, target_raw string, context string, ambiguous int")
def snk_report(s: SparkSession) -> DataFrame:
    """The edges as the report page holds them, read back from the page."""
    path = Path(s.sparkContext.getConf().get("spark.local.dir", "/tmp"), f"report-{s.sparkContext.applicationId}.html")  # the page is a file of the driver's
    write_report(_graph(s), {"label": "<Garden> & more"}, str(path))
    text = path.read_text()
    path.unlink()
    data = json.loads(text.split("const data=")[1].split(";\n")[0])
    assert "<title>&lt;Garden&gt; &amp; more</title>" in text and len(data["entities"]) == sum(data["counts"].values())
    return _rows(s, [(x["source"], x["target"], x["target_raw"], x["context"], x["ambiguous"]) for x in data["edges"]], "source long, target long, target_raw string, context string, ambiguous int")


@_query("script string, class string, steps int, snippet string")
def snk_snippet(s: SparkSession) -> DataFrame:
    """Scripts as clipboard snippets, from either encoding."""
    rows = []
    for path, name in ((REPORTS[0], "Water"), (REPORTS[0], "Prune"), (REPORTS[2], "Gießen")):
        text, n = snippet(script_xml(path, name))
        rows.append((name, clipboard_class(text), n, text))
    return _rows(s, rows, "script string, class string, steps int, snippet string")


@_query("line string")
def snk_chain(s: SparkSession) -> DataFrame:
    """Calls between scripts as lines of a flow chart, with their number."""
    return mermaid(named_calls(_graph(s)))


@_query("list string, name string, n bigint")
def snk_health(s: SparkSession) -> DataFrame:
    """The health lists, read back from their CSV files."""
    root = f"{Stages(s, 'health').root}/lists"
    write_health(_graph(s), root)
    read = lambda x: s.read.option("header", True).csv(f"{root}/{x}")
    one = F.lit(1).cast("long").alias("n")
    lists = [read(x).select(F.lit(x).alias("list"), "name", one) for x in ("unused_fields", "orphan_scripts", "unused_occurrences")]
    lists.append(read("unresolved").select(F.lit("unresolved").alias("list"), F.concat_ws(" ", "target_kind", "context").alias("name"), F.col("n").cast("long").alias("n")))
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).unionByName(lists[3])


@_query("nth int, line string")
def snk_table(s: SparkSession) -> DataFrame:
    """The text table: cells cut, nulls empty, rows beyond the limit counted."""
    rows = s.createDataFrame([(1, "x" * 100), (2, None), (3, "é")], "id int, text string").orderBy("id")
    return _rows(s, list(enumerate(show(rows, 2).split("\n"))), "nth int, line string")


def _literal(cell: str, kind: str) -> str:
    if cell == "\\N":
        return f"cast(null as {'varchar' if kind == 'string' else kind})"
    return f"cast({cell} as {kind})" if kind != "string" else "'" + cell.replace("'", "''") + "'"


def _fixed(name: str) -> str | None:
    """The fixed rows of a query as SQL."""
    path, columns = DATA / "expected" / f"{name}.csv", [c.split() for c in SCHEMAS[name].split(", ")]
    if not path.exists():
        return None
    with open(path, newline="", encoding="utf-8") as f:
        rows = ["(" + ", ".join(_literal(c, k) for c, (_, k) in zip(r, columns)) + ")" for r in csv.reader(f)]
    names = ", ".join(f'"{n}"' for n, _ in columns)
    return f"select * from (values\n" + ",\n".join(rows) + f") t({names})"


SQL = {name: sql for name in QUERIES if (sql := _fixed(name))}
