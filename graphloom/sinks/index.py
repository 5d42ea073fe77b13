"""A built index: Parquet tables in a folder, published at once or not at all."""

from __future__ import annotations

import json
import sys
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import __version__
from graphloom.common import Stages
from graphloom.operators.extract import entities_of, files_of, refs_of, texts_of
from graphloom.operators.fulltext import lengths, postings, search
from graphloom.operators.graph import Graph
from graphloom.operators.resolve import resolve
from graphloom.sinks.files import Files
from graphloom.sources.report_xml import nodes, report_files, run_row

MARKER = "_index.json"
PUBLIC = (
    "entity_id file_id kind fm_id name parent_entity_id base_table data_type field_type calc_text step_type seq grp records ext_file extra_json stored indexed is_global auto_enter"
).split()


def is_index(spark: SparkSession, path: str) -> bool:
    return Files(spark).exists(f"{path}/{MARKER}")


def build(spark: SparkSession, paths: str | list[str], out: str, label: str | None = None, force: bool = False) -> DataFrame:
    """Parse reports (or the summary that links to them) into the index ``out`` and return its counts.

    All tables are written to a folder beside the target, which takes its place only on success: a failed build
    leaves what was there; what is needed on the way goes to the shared folder of stages. An existing target that is no index is refused unless ``force``. Nodes are parsed once. ``out`` may lie on any file system.
    """
    files, st = Files(spark), Stages(spark, "build")
    paths, out = report_files(paths), out.rstrip("/")
    if files.exists(out) and not force and not is_index(spark, out):
        raise ValueError(f"{out} exists and is no index; choose another folder or force it")
    above, _, name = out.rpartition("/")
    tmp = f"{above}/.building-{uuid.uuid4().hex}" if above else f".building-{uuid.uuid4().hex}"
    read = lambda t: spark.read.parquet(f"{tmp}/{t}")
    try:
        n = st.put(nodes(spark, paths), "nodes")
        found = files_of(n)
        if found.isEmpty():
            raise ValueError(f"{paths[0]} is no design report: it has no FMPReport/File")
        found.select("file_id", F.lit(1).cast("long").alias("run_id"), "name", "path").write.parquet(f"{tmp}/files")
        e = st.put(entities_of(n), "entities")
        e.select(PUBLIC).write.partitionBy("kind").parquet(f"{tmp}/entities")
        texts_of(e).write.parquet(f"{tmp}/text_docs")
        lengths(read("text_docs")).write.parquet(f"{tmp}/lengths")
        postings(read("text_docs")).hint("rebalance", "part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{tmp}/postings")
        resolve(refs_of(n, e), e.select(PUBLIC), read("files")).write.parquet(f"{tmp}/refs")
        files.write(f"{tmp}/{MARKER}", json.dumps(run_row(paths, label) | {"run_id": 1, "parsed_at": datetime.now(timezone.utc).isoformat()}))
        if files.exists(out):
            files.rename(out, f"{tmp}-old")
        files.rename(tmp, out)
        files.delete(f"{tmp}-old")
    except BaseException:
        files.delete(tmp)
        raise
    return summary(open_index(spark, out))


def open_index(spark: SparkSession, path: str) -> Graph:
    """The graph of an index; an older build is told on stderr and opened all the same."""
    if not is_index(spark, path):
        raise ValueError(f"no index at {path}")
    if (built := meta(spark, path).get("parser_version")) != __version__:
        print(f"warning: {path} was built by version {built}; this is {__version__}, rebuild it", file=sys.stderr)
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    return Graph(read("entities").select(PUBLIC), read("refs"), read("files"), unique=True)


def docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/text_docs")


def find(spark: SparkSession, path: str, text: str, limit: int | None = 50) -> DataFrame:
    """``search`` over the stored inverted index: only the parts that the query's words fall into are read, and of these their terms."""
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    return search(read("postings"), read("lengths"), text, limit)


def meta(spark: SparkSession, path: str) -> dict:
    return json.loads(Files(spark).read(f"{path}/{MARKER}"))


def summary(g: Graph) -> DataFrame:
    """``item, n``: entities by kind, most first, then references and resolved ones."""
    kinds = g.entities.groupBy(F.col("kind").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    r = g.refs.agg(F.count(F.lit(1)).alias("_refs"), F.count("target_entity_id").alias("_refs_resolved")).selectExpr("stack(2, '_refs', _refs, '_refs_resolved', _refs_resolved) as (item, n)")
    return kinds.unionByName(r).orderBy(F.desc("n"), "item")


def catalog(spark: SparkSession, root: str) -> list[dict]:
    """The indexes below a folder with label, time and version of their build, and a status: ok, older parser, source missing, source newer than build, or not an index."""
    files, out = Files(spark), []
    for name in files.folders(root):
        path = f"{root}/{name}"
        if name.startswith("."):
            continue
        if not is_index(spark, path):
            out.append({"index": name, "status": "not an index"})
            continue
        m = meta(spark, path)
        sources = [files.modified(x if "://" in x else f"file://{x}") for x in m["source_path"].split(";")]
        built = datetime.fromisoformat(m["parsed_at"]).timestamp()
        status = "source missing" if None in sources else "source newer than build" if max(sources) > built else "older parser" if m["parser_version"] != __version__ else "ok"
        out.append({"index": name, "label": m["label"], "built": m["parsed_at"], "parser": m["parser_version"], "files": len(sources), "bytes": files.size(path), "status": status})
    return out
