"""Command line: python -m graphloom.cli build|where|search|sql|stats|cascades|valuelist|investigate|mutations|trigger-map|list|report|health|chain|snippet ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans import commands
from graphloom.sinks import index
from graphloom.sinks.report import mermaid, named_calls, write_health, write_report
from graphloom.sinks.snippet import script_xml, snippet

CELL = 80


def show(df: DataFrame, limit: int = 200, full: bool = False) -> str:
    """A text table of at most ``limit`` rows, cells cut at CELL unless ``full``, null as nothing, and how many rows are left out."""
    rows = df.limit(limit + 1).collect()
    cells = [["" if v is None else str(v) for v in r] for r in rows[:limit]]
    width = [max(map(len, [c, *[r[i] for r in cells]])) for i, c in enumerate(df.columns)]
    width = width if full else [min(w, CELL) for w in width]
    line = lambda r: "  ".join(v[:w].ljust(w) for v, w in zip(r, width)).rstrip()
    out = [line(df.columns), line(["-" * w for w in width]), *map(line, cells)]
    if len(rows) > limit:
        out.append(f"... {df.count() - limit} more rows")
    return "\n".join(out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("--debug", action="store_true", help="show the traceback of an error")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        c.add_argument("--limit", type=int, default=200)
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), **v)
        return c

    yes = {"action": "store_true"}
    sub_build = add("build", out={"required": True}, label={}, force=yes)
    sub_build.add_argument("paths", nargs="+")
    add("where", "index", "term")
    add("search", "index", "query")
    add("sql", "index", "query", full=yes)
    add("stats", "index")
    add("cascades", "index").add_argument("table", nargs="?")
    add("valuelist", "index", "pattern")
    add("investigate", "index", "script", no_body=yes, chain=yes)
    add("mutations", "index", like={})
    add("trigger-map", "index", inputs={"required": True}, set_flag={}, table={}, recompute={}, layouts={})
    add("list", "root")
    add("report", "index", "out")
    add("health", "index", "out")
    add("chain", "index")
    add("snippet", "path", "script", id={}, out={})
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> str:
    if a.command == "build":
        s = index.build(spark, a.paths, a.out, a.label, a.force)
        n = {r.item: r.n for r in s.collect()}
        warn = "\nwarning: under 95 % of the references are resolved" if 100 * n["_refs_resolved"] < 95 * n["_refs"] else ""
        return show(s, a.limit) + warn
    if a.command == "list":
        return "\n".join("  ".join(f"{k}={v}" for k, v in x.items()) for x in index.catalog(spark, a.root))
    if a.command == "snippet":
        xml, n = snippet(script_xml(a.path, a.script, a.id))
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(xml)
            return f"{n} steps written to {a.out}"
        return xml
    g = index.open_index(spark, a.index)
    if a.command == "where":
        df = commands.where_used(g, a.term).orderBy("kind", "entity_id", "context", "source_kind", "source_parent_name", "source_name")
        return show(df, a.limit) if not df.isEmpty() else f"No entity named '{a.term}' found."
    if a.command == "search":
        return show(index.find(spark, a.index, a.query, a.limit).select("kind", "name", "match"), a.limit)
    if a.command == "sql":
        g.register(spark)
        return show(spark.sql(a.query), a.limit, a.full)
    if a.command == "stats":
        return show(commands.stats(g).orderBy(F.desc("n"), "item"), a.limit) + "\n\n" + show(g.unresolved().orderBy(F.desc("n")), a.limit)
    if a.command == "cascades":
        c = g.cascades()
        return show(c.where((c.victim_table == a.table) | (c.victim_to == a.table) if a.table else F.lit(True)).orderBy("victim_table", "deleting_table"), a.limit)
    if a.command == "valuelist":
        return show(commands.value_lists(g, a.pattern).orderBy("name"), a.limit)
    if a.command == "investigate":
        parts = commands.investigate(g, a.script)
        skip = ({"body"} if a.no_body else set()) | (set() if a.chain else {"chain"})
        return "\n\n".join(f"# {k}\n{show(v, a.limit)}" for k, v in parts.items() if k not in skip)
    if a.command == "mutations":
        return show(commands.mutations(g, a.like).orderBy("op", "tier_rank", "script_name", "seq"), a.limit)
    if a.command == "trigger-map":
        fields = [x.strip() for x in f"{a.inputs},{a.set_flag or ''}".split(",") if x.strip()]
        text = show(commands.trigger_map(g, fields, a.table, a.recompute).orderBy("script_name"), a.limit)
        if a.layouts:
            text += "\n\n# triggers on these layouts that reach no such script\n" + show(commands.quiet_triggers(g, a.layouts, fields, a.table), a.limit)
        return text
    if a.command == "chain":
        return "flowchart LR\n" + "\n".join(r.line for r in mermaid(named_calls(g)).orderBy("line").collect())
    if a.command == "health":
        write_health(g, a.out)
        return a.out
    write_report(g, index.meta(spark, a.index), a.out)
    return a.out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        print(run(spark, a))
    except (BrokenPipeError, KeyboardInterrupt):
        raise
    except Exception as e:  # noqa: BLE001
        if a.debug:
            raise
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
