"""Design-report XML as a table of nodes: a batch data source with one partition per file, read in constant memory."""

from __future__ import annotations

import json
import os
from pathlib import Path
from xml.parsers import expat

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom import __version__
from graphloom.common import ship

# Which elements are entities: tag -> (kind, parents allowed, ancestor needed); the first rule that fits counts.
ENTITY_RULES: dict[str, list[tuple[str, tuple[str, ...] | None, str | None]]] = {
    "BaseTable": [("base_table", ("BaseTableCatalog",), None)],
    "Field": [("field", ("FieldCatalog",), None)],
    "Table": [("table_occurrence", None, "RelationshipGraph")],
    "Relationship": [("relationship", None, None)],
    "Group": [("script_group", None, "ScriptCatalog"), ("layout_group", None, "LayoutCatalog")],
    "Script": [("script", ("Group", "ScriptCatalog"), "ScriptCatalog")],
    "Layout": [("layout", ("LayoutCatalog", "Group"), "LayoutCatalog")],
    "Step": [("script_step", ("StepList",), None)],
    "Object": [("layout_object", None, "Layout")],
    "CustomFunction": [("custom_function", None, "CustomFunctionCatalog")],
    "ValueList": [("value_list", ("ValueListCatalog",), None)],
    "PrivilegeSet": [("privilege_set", ("PrivilegesCatalog",), None)],
    "Account": [("account", ("AccountCatalog",), None)],
    "ExtendedPrivilege": [("extended_privilege", ("ExtendedPrivilegeCatalog",), None)],
    "CustomMenu": [("custom_menu", ("CustomMenuCatalog",), None)],
    "CustomMenuSet": [("custom_menu_set", ("CustomMenuSetCatalog",), None)],
    "Theme": [("theme", ("ThemeCatalog",), None)],
    "OdbcDataSource": [("external_data_source", None, None)],
}
# Kinds that a reference is attributed to, elements whose text is read, ancestors that rules ask for, elements that rules read.
SOURCE_KINDS = frozenset("field custom_function script_step relationship layout layout_object value_list privilege_set custom_menu".split())
TEXT_TAGS = frozenset("Calculation StepText Chunk Name Text Data".split())
MARKS = frozenset("AutoEnter Validation HideCondition ToolTip Layout ValueList ScriptTriggers WindowTriggers Relationship TextObj".split())
READ_TAGS = TEXT_TAGS | frozenset(
    "File Bounds Storage AutoEnter Serial FileReference FieldReference TableOccurrenceReference Field LeftTable RightTable JoinPredicate Source ShowRelated PrimaryField SecondaryField Script Layout ValueList".split()
)
#: Menu separators: scripts and layouts of this name are neither entities nor references.
SEPARATOR = "-"

SCHEMA = (
    "file_no int, pos long, end_pos long, tag string, parent string, parent_pos long, file_pos long, kind string, separator boolean, owner long, owner_kind string, source long, source_kind string, "
    "table_pos long, group_pos long, script_pos long, relationship_pos long, step_pos long, within array<string>, event string, dead boolean, attrs map<string,string>, text string"
)
_STRINGS, _BOOLS = {"tag", "parent", "kind", "owner_kind", "source_kind", "event", "text"}, {"separator", "dead"}
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _arrow_type(name: str) -> pa.DataType:
    if name in _STRINGS:
        return pa.string()
    if name in _BOOLS:
        return pa.bool_()
    return {"file_no": pa.int32(), "within": pa.list_(pa.string()), "attrs": pa.map_(pa.string(), pa.string())}.get(name, pa.int64())


ARROW = pa.schema([(n, _arrow_type(n)) for n in _NAMES])


class _Open:
    """An element that is open, with what is nearest above it."""

    __slots__ = ("tag", "pos", "kind", "source_kind_pos", "attrs", "entity", "source", "marks", "near", "step", "event", "dead", "separator")


class NodeReader:
    """Turns parser events into rows of SCHEMA; an element's row comes when it closes, its numbers are those of its opening and closing."""

    def __init__(self, file_no: int, batch: int = 20_000):
        self.file_no, self.batch, self.rows, self.done = file_no, batch, [], []
        self.stack: list[_Open] = []
        self.clock, self.file_pos, self.slot, self.text = 0, None, None, []

    def _kind(self, tag: str, attrs: dict, tags: list[str]) -> tuple[str | None, bool]:
        for kind, parents, ancestor in ENTITY_RULES.get(tag, ()):
            if (parents is None or (tags and tags[-1] in parents)) and (ancestor is None or ancestor in tags):
                if kind in ("script", "layout") and (attrs.get("name") or "").strip() == SEPARATOR:
                    return None, True
                return kind, False
        return None, False

    def start(self, tag: str, attrs: dict) -> None:
        self.clock += 1
        up = self.stack[-1] if self.stack else None
        x = _Open()
        x.tag, x.pos, x.attrs = tag, self.clock, attrs
        tags = [o.tag for o in self.stack]
        x.kind, x.separator = self._kind(tag, attrs, tags)
        x.entity = (x.pos, x.kind) if x.kind else up.entity if up else None
        x.source = (x.pos, x.kind) if x.kind in SOURCE_KINDS else up.source if up else None
        x.marks = (up.marks | {tag} if tag in MARKS and tag not in up.marks else up.marks) if up else frozenset({tag} & MARKS)
        x.near = up.near if up else {}
        if x.kind in ("base_table", "script", "relationship", "script_group", "layout_group"):
            x.near = {**x.near, "group" if x.kind.endswith("group") else x.kind: x.pos}
        x.step = x.pos if tag == "Step" else up.step if up else None
        x.event = attrs.get("event") if tag == "Trigger" else up.event if up else None
        x.dead = up.dead if up else False
        if tag == "AutoEnter":
            x.dead = bool(tags and tags[-1] == "Field" and up.entity and up.entity[1] == "field" and attrs.get("calculation") == "False")
        if tag == "File" and tags and tags[-1] == "FMPReport":
            self.file_pos = x.pos
        self.stack.append(x)
        if tag in TEXT_TAGS:
            self.slot, self.text = tag, []

    def characters(self, data: str) -> None:
        if self.slot is not None:
            self.text.append(data)

    def end(self, tag: str) -> None:
        self.clock += 1
        x = self.stack.pop()
        text = None
        if self.slot == tag:
            text, self.slot, self.text = "".join(self.text).strip() or None, None, []
        if x.kind is None and tag not in READ_TAGS:
            return
        up = self.stack[-1] if self.stack else None
        above = up.entity if up else None
        source = (up.source if up else None) or above
        near = up.near if up else {}
        self.rows.append((
            self.file_no, x.pos, self.clock, tag, up.tag if up else None, up.pos if up else None, self.file_pos, x.kind, x.separator, *(above or (None, None)), *(source or (None, None)),
            near.get("base_table"), near.get("group"), near.get("script"), near.get("relationship"), up.step if up else None, sorted(up.marks) if up else [], up.event if up else None, up.dead if up else False,
            list(x.attrs.items()), text,
        ))
        if len(self.rows) >= self.batch:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.done.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), ARROW)], schema=ARROW))
            self.rows = []


def _refuse(*_):
    raise ValueError("the document declares a DTD or entities; refusing to parse it")


def read_nodes(path: str, file_no: int, chunk: int = 1 << 20):
    """Arrow batches of the nodes of one document; malformed XML and any DTD or entity declaration are errors."""
    reader, parser = NodeReader(file_no), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.characters
    parser.EntityDeclHandler = _refuse
    parser.StartDoctypeDeclHandler = lambda name, system, public, subset: _refuse() if subset else None
    with open_report(path) as f:
        while data := f.read(chunk):
            parser.Parse(data, False)
            yield from reader.done
            reader.done = []
        parser.Parse(b"", True)
    reader.flush()
    yield from reader.done


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p, i) for i, p in enumerate(self.paths)]

    def read(self, partition: _File):
        return read_nodes(partition.path, partition.number)


class ReportSource(DataSource):
    """``format("design_report")`` with the option ``paths``, a JSON list; files are numbered in its order."""

    @classmethod
    def name(cls) -> str:
        return "design_report"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]))


def open_report(path: str):
    """A document as a stream of bytes: a path on all machines, or any address that Arrow's file systems know."""
    if "://" in path:
        fs, inner = pafs.FileSystem.from_uri(path)
        return fs.open_input_stream(inner)
    return open(path, "rb")


class _Seen(Exception):
    """Enough of a document is read."""


def peek(path: str) -> tuple[dict, list[str]]:
    """The attributes of the root element, and, where its type is Summary, the links of the File elements below. Nothing else of a report is parsed.

    The parser finds the encoding out by itself; what is malformed before the root raises, as does any DTD with declarations.
    """
    root: dict = {}
    links: list[str] = []
    parser = expat.ParserCreate()

    def start(tag: str, attrs: dict) -> None:
        if not root:
            root.update(attrs or {"": ""})
            if attrs.get("type") != "Summary":
                raise _Seen
        elif tag == "File" and "link" in attrs:
            links.append(attrs["link"])

    parser.StartElementHandler, parser.EntityDeclHandler = start, _refuse
    parser.StartDoctypeDeclHandler = lambda name, system, public, subset: _refuse() if subset else None
    try:
        with open_report(path) as f:
            parser.ParseFile(f)
    except _Seen:
        pass
    return root, links


def encoding(path: str) -> str:
    """utf-16 where the file begins with that byte order mark, else utf-8."""
    with open_report(path) as f:
        return "utf-16" if f.read(2) == b"\xff\xfe" else "utf-8-sig"


def expand_manifest(path: str) -> list[str] | None:
    """The report files that a summary links to; None if the file is no summary. Links that lead out of its own folder are left out."""
    root, links = peek(path)
    if root.get("type") != "Summary":
        return None
    folder = Path(path).resolve().parent
    return [str(p) for p in ((folder / link).resolve() for link in links) if p.is_relative_to(folder)]


def report_files(paths: str | list[str]) -> list[str]:
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (expand_manifest(paths[0]) if len(paths) == 1 else None) or paths


def run_row(paths: list[str], label: str | None = None) -> dict:
    """What is known of a run without parsing its reports: the first one's root element tells version and creation time."""
    root, _ = peek(paths[0])
    return {"source_path": ";".join(p if "://" in p else os.path.abspath(p) for p in paths), "ddr_version": root.get("version"), "creation_time": root.get("creationTime"), "parser_version": __version__, "label": label or os.path.basename(paths[0])}


def nodes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The nodes of the documents, numbered in the order of the paths; the files must be visible to all executors."""
    ship(spark)
    spark.dataSource.register(ReportSource)
    return spark.read.format("design_report").option("paths", json.dumps([p if "://" in p else os.path.abspath(p) for p in paths])).load()
