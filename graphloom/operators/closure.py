"""Reachability over call and dependency edges: frontier joins, safe on cycles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import Stages, counted, map_batches
from graphloom.operators.graph import Graph


def call_edges(g: Graph) -> DataFrame:
    """``caller, callee``: scripts whose live steps perform a script or install it as a trigger, each pair once."""
    scripts = g.kind("script").select("entity_id")
    steps = g.entities.select(F.col("entity_id").alias("source_entity_id"), F.col("parent_entity_id").alias("caller"))
    r = g.refs_where("context in ('perform_script', 'trigger') and disabled = 0 and target_entity_id is not null").select("source_entity_id", F.col("target_entity_id").alias("callee"))
    pairs = r.join(steps, "source_entity_id").select("caller", "callee").where("caller is not null").distinct()
    return pairs.join(scripts.withColumnRenamed("entity_id", "caller"), "caller", "left_semi").join(scripts.withColumnRenamed("entity_id", "callee"), "callee", "left_semi").select("caller", "callee")


def field_edges(g: Graph, contexts: tuple[str, ...] = ("calc", "auto_enter")) -> DataFrame:
    """``field, needs``: fields and the fields that their live formulas mention, in the given contexts."""
    fields = g.kind("field").select("entity_id")
    r = g.refs_where(F.col("context").isin(*contexts) & (F.col("disabled") == 0)).select(F.col("source_entity_id").alias("field"), F.col("target_entity_id").alias("needs")).distinct()
    return r.join(fields.withColumnRenamed("entity_id", "field"), "field", "left_semi").join(fields.withColumnRenamed("entity_id", "needs"), "needs", "left_semi").select("field", "needs")


#: Edges up to this number (16 bytes each) are sent to every task, and each root's search runs there; more are joined level by level.
LOCAL_EDGES = 1_000_000
#: A node is a hub if this many ways lead through it (edges in times edges out); at most so many are told apart.
HUB_WAYS, HUBS = 4096, 4
#: A task lists pairs of about so many roots with so many of what a hub reaches, in blocks of so many roots: each node stands in a run beside roots
#: that recur, and a file's values fit a Parquet dictionary, so a pair takes 0.1 bytes there, not 4.6. Blocks divide 504, as many values as
#: Parquet packs at once, so that packed roots recur byte by byte.
TILE_ROOTS, TILE_NODES, BLOCK = 1024, 65_536, 168
_FAR = 1 << 40


def _distances(first, to, start: int):
    """Least number of steps from a node to each, -1 where there is no way; edges in rows: those of node i are to[first[i]:first[i + 1]]."""
    dist = np.full(len(first) - 1, -1, np.int32)
    dist[start], level, depth = 0, np.array([start]), 0
    while len(level):
        depth += 1
        n = first[level + 1] - first[level]
        nxt = np.unique(to[np.repeat(first[level] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        level = nxt[dist[nxt] < 0]
        dist[level] = depth
    return dist


def _rows(src, dst, n: int):
    return np.searchsorted(src, np.arange(n + 1), sorter=(by := np.argsort(src, kind="stable"))), dst[by]


def _hubbed(src, dst, hub_ways: int):
    """What the tasks search in: node ids, edges in rows, and hubs. A node that leads to hubs has the one that reaches most, and its distance to it."""
    nodes = np.unique(np.concatenate((src, dst)))
    n, a, b = len(nodes), np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    (first, to), (first_in, to_in) = _rows(a, b, n), _rows(b, a, n)
    ways = np.diff(first) * np.diff(first_in)
    best, up, most, hubs = np.full(n, -1, np.int8), np.zeros(n, np.int32), np.zeros(n, np.int64), []
    same = np.zeros(n, bool)  # on a loop with a hub, so they reach the same
    for h in (order := np.flatnonzero(ways >= hub_ways))[np.argsort(-ways[order], kind="stable")]:
        if same[h] or len(hubs) == HUBS:
            continue
        down, back = _distances(first, to, h), _distances(first_in, to_in, h)
        inside = np.flatnonzero(down >= 0)
        same |= (down >= 0) & (back >= 0)
        mine = (back >= 0) & (len(inside) > most)
        best[mine], up[mine], most[mine] = len(hubs), back[mine], len(inside)
        inside = inside[np.argsort(down[inside], kind="stable")]  # equal depths side by side
        hubs.append((inside, down[inside]))
    return nodes, first, to, best, up, hubs


def _searches(value, batches, max_depth: int | None, rest: bool):
    """(root, hub or -1, distance to it, nodes found, their depths, further columns) of a breadth-first search from each root.

    The search goes on only where it comes sooner than by the hub; with ``rest``, only outside the hub's reach. Nodes are places in the
    list of nodes; a root without edges has none, not even itself.
    """
    nodes, first, to, best, up, hubs = value
    starts, ends, nexts = first[:-1].tolist(), first[1:].tolist(), to.tolist()
    far = []
    for inside, down in hubs:
        f = np.full(len(nodes), _FAR)
        f[inside] = -_FAR if rest else down
        far.append(f.tolist())
    for batch in batches:
        roots = batch.column(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(nodes, roots), max(len(nodes) - 1, 0))
        known = nodes[at] == roots if len(nodes) else np.zeros(len(roots), bool)
        more = zip(*(c.to_pylist() for c in batch.columns[1:])) if batch.num_columns > 1 else [()] * len(roots)
        for root, i, there, x in zip(roots.tolist(), at.tolist(), known.tolist(), more):
            if not there:
                yield root, -1, 0, [], [], x
                continue
            hub = int(best[i])
            by, f = int(up[i]), far[hub] if hub >= 0 else None
            level = [i] if f is None or by + f[i] > 0 else []
            seen, depth, found, depths = set(level), 0, [], []
            while level:
                found.extend(level)
                depths.extend([depth] * len(level))
                depth += 1
                nxt = []
                if max_depth is None or depth <= max_depth:
                    for n in level:
                        for y in nexts[starts[n]:ends[n]]:
                            if y not in seen and (f is None or depth < by + f[y]):
                                seen.add(y)
                                nxt.append(y)
                level = nxt
            yield root, hub, by, found, depths, x


def _batch(columns, names=("root", "node", "depth")):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()))], names=list(names))


def _outside(sent, size: int = 50_000):
    """(root, node, hub): the nodes outside the hub's reach with -1, and the hub with the node -1."""

    def run(batches):
        ids = sent.value[0].tolist()
        rows: list[list] = [[], [], []]
        for root, hub, _, found, _, _ in _searches(sent.value, batches, None, True):
            own = [ids[x] for x in found] if found or hub >= 0 else [root]
            rows[0].extend([root] * (len(own) + (hub >= 0)))
            rows[1].extend([*own, -1] if hub >= 0 else own)
            rows[2].extend([-1] * len(own) + [hub] * (hub >= 0))
            if len(rows[0]) >= size:
                yield _batch(rows)
                rows = [[], [], []]
        if rows[0]:
            yield _batch(rows)

    return run


def _tile(nodes, down, tile: list[tuple], max_depth: int | None, size: int):
    """Pairs of some roots, each (root, distance to the hub, places of nodes found sooner, their depths), with some of what the hub reaches."""
    tile.sort(key=lambda x: x[:2][::-1])
    for b in range(0, len(tile), BLOCK):
        block = tile[b:b + BLOCK]
        roots, by = np.array([x[0] for x in block], np.int64), np.array([x[1] for x in block], np.int32)
        which, place, depth = np.repeat(np.arange(len(block)), [len(x[2]) for x in block]), np.concatenate([x[2] for x in block]), np.concatenate([x[3] for x in block])
        order = np.argsort(place, kind="stable")
        which, place, depth = which[order], place[order], depth[order]
        step = max(1, size // len(block))
        for c in range(0, len(nodes), step):
            node, deep = nodes[c:c + step], down[c:c + step, None] + by
            of = slice(*np.searchsorted(place, (c, c + step)))
            deep[place[of] - c, which[of]] = depth[of]
            columns = np.tile(roots, len(node)), np.repeat(node, len(block)), deep.ravel()
            if max_depth is not None:
                columns = [x[keep] for x in columns] if not (keep := columns[2] <= max_depth).all() else columns
            if len(columns[0]):
                yield _batch(columns)


def _pairs(sent, max_depth: int | None, tile_nodes: int, size: int = 50_000, held: int = 1_000_000):
    """(root, node, depth) of the roots (root, part). Of what a root's hub reaches, the given part is listed, with the distance to the hub
    added or the depth at which the search found it sooner; what else the root reaches comes with part 0."""

    def run(batches):
        nodes, hubs = sent.value[0], sent.value[5]
        places = []
        for inside, _ in hubs:
            places.append(p := np.full(len(nodes), -1))
            p[inside] = np.arange(len(inside))
        tiles: dict[tuple, list] = {}
        rows: list[list] = [[], [], []]
        n = 0

        def flush():
            for (hub, part), tile in tiles.items():
                of = slice(part * tile_nodes, (part + 1) * tile_nodes)
                yield from _tile(nodes[hubs[hub][0][of]], hubs[hub][1][of], tile, max_depth, size)
            tiles.clear()

        for root, hub, by, found, depths, (part,) in _searches(sent.value, batches, max_depth, False):
            own, depth = np.array(found, np.int64), np.array(depths, np.int32)
            if hub >= 0:
                p = places[hub][own]
                here = (p >= 0) & (p // tile_nodes == part)
                if part * tile_nodes < len(hubs[hub][0]):
                    tiles.setdefault((hub, part), []).append((root, by, p[here] - part * tile_nodes, depth[here]))
                    n += 1 + int(here.sum())
                own, depth = own[p < 0], depth[p < 0]
            if part == 0:
                own = nodes[own].tolist() if found or hub >= 0 else [root]
                rows[0].extend([root] * len(own))
                rows[1].extend(own)
                rows[2].extend(depth.tolist() if found or hub >= 0 else [0])
            if n >= held:
                yield from flush()
                n = 0
            if len(rows[0]) >= size:
                yield _batch(rows)
                rows = [[], [], []]
        yield from flush()  # first, so that the roots without a hub stand last in the file's dictionary
        if rows[0]:
            yield _batch(rows)

    return run


def _members(sent):
    """(hub, node) of all that each hub reaches."""

    def run(batches):
        nodes, hubs = sent.value[0], sent.value[5]
        for batch in batches:
            for k in batch.column(0).to_pylist():
                node = nodes[hubs[k][0]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), k, np.int32)), pa.array(node)], names=["hub", "node"])

    return run


def _begin(edges: DataFrame, roots: DataFrame, src: str, dst: str) -> tuple[Stages, DataFrame, int, DataFrame]:
    st = Stages(edges.sparkSession, "closure")
    e, n_edges = counted(st, edges.where(f"{src} is not null and {dst} is not null").select(F.col(src).alias("node"), F.col(dst).alias("to")).distinct(), "edges")
    return st, e, n_edges, roots.select(F.col(roots.columns[0]).cast("long").alias("root")).where("root is not null").distinct()


def _send(e: DataFrame, hub_ways: int):
    pairs = e.toArrow()
    return e.sparkSession.sparkContext.broadcast(_hubbed(pairs["node"].to_numpy(), pairs["to"].to_numpy(), hub_ways))


def _dealt(start: DataFrame) -> DataFrame:
    """The roots in a fixed number of parts: a few bytes each, they would otherwise be merged into one task that searches for all."""
    return start.repartition(max(16, 4 * start.sparkSession.sparkContext.defaultParallelism), "root")


def _tiled(start: DataFrame, n: int, value, tile_nodes: int) -> DataFrame:
    """``root, part``: each root once for every part of what hubs reach, a task for each part and share of the roots."""
    _, _, _, best, _, hubs = value
    parts = max([1, *(-(-len(inside) // tile_nodes) for inside, _ in hubs)])
    shares = max(16, 4 * start.sparkSession.sparkContext.defaultParallelism, -(-min(n, int((best >= 0).sum())) // TILE_ROOTS))
    tiles = start.select("root", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return tiles.repartitionById(shares * parts, (F.col("part") * shares + F.pmod(F.xxhash64("root"), F.lit(shares))).cast("int"))


def closure(edges: DataFrame, roots: DataFrame, src: str = "caller", dst: str = "callee", max_depth: int | None = None, local_edges: int = LOCAL_EDGES, hub_ways: int = HUB_WAYS, tile_nodes: int = TILE_NODES) -> DataFrame:
    """``root, node, depth``: everything that each root (one column) reaches, itself at depth 0, with the least number of steps.

    As long as there are at most LOCAL_EDGES edges (they are counted), they are broadcast and every task searches from its share of
    the roots; what a hub reaches is searched once, and its pairs are listed in an order that Parquet stores in few bytes. Beyond that
    all roots advance together, one level a round: the frontier joins the edges, and what its root has seen before is anti-joined away;
    each level is written to the shared folder, rounds = the greatest distance. Either way cycles end and diamonds count once. Null
    roots are dropped; roots without edges reach themselves; empty inputs give no rows.
    """
    st, e, n_edges, start = _begin(edges, roots, src, dst)
    if n_edges <= local_edges:
        sent = _send(e, hub_ways)
        return map_batches(_tiled(*counted(st, start, "roots"), sent.value, tile_nodes), _pairs(sent, max_depth, tile_nodes), "root long, node long, depth int")
    return _levels(st, e, start, max_depth)


def _levels(st: Stages, e: DataFrame, start: DataFrame, max_depth: int | None) -> DataFrame:
    frontier, n = counted(st, start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "level0")
    seen, depth = frontier, 0
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        nxt = frontier.join(e, "node").select("root", F.col("to").alias("node")).distinct().join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier, n = counted(st, nxt, f"level{depth}")
        seen = seen.unionByName(frontier)
    return seen


def reach_parts(edges: DataFrame, roots: DataFrame, src: str = "caller", dst: str = "callee", local_edges: int = LOCAL_EDGES, hub_ways: int = HUB_WAYS) -> tuple[DataFrame, DataFrame]:
    """The closure without its repetitions: ``root, node, hub`` and ``hub, node``.

    A root that leads to a hub has one row with that hub and a null node, for all that the second table lists, and a row with a null
    hub for each further node; the parts don't overlap. Beyond LOCAL_EDGES edges there are no hubs, and all pairs are rows.
    """
    st, e, n_edges, start = _begin(edges, roots, src, dst)
    if n_edges > local_edges:
        return _levels(st, e, start, None).select("root", "node", F.lit(None).cast("int").alias("hub")), e.sparkSession.createDataFrame([], "hub int, node long")
    sent = _send(e, hub_ways)
    rest = map_batches(_dealt(start), _outside(sent), "root long, node long, depth int")
    rest = rest.select("root", F.when(F.col("depth") < 0, F.col("node")).alias("node"), F.when(F.col("depth") >= 0, F.col("depth")).alias("hub"))
    hubs = e.sparkSession.range(0, len(sent.value[5]), 1, max(1, len(sent.value[5])))
    return rest, map_batches(hubs, _members(sent), "hub int, node long")


def next_hops(edges: DataFrame, targets: DataFrame, src: str = "caller", dst: str = "callee") -> DataFrame:
    """``node, next_hop, depth``: every node that leads to one of the targets, the first step of a shortest way there (smallest id on ties).

    Targets have depth 0 and no next hop. One joint search against the edges' direction; safe on cycles.
    """
    st = Stages(edges.sparkSession, "hops")
    e = st.put(edges.select(F.col(src).alias("from"), F.col(dst).alias("node")).distinct(), "edges")
    seen = frontier = st.put(targets.select(F.col(targets.columns[0]).alias("node"), F.lit(None).cast("long").alias("next_hop"), F.lit(0).alias("depth")).where("node is not null").distinct(), "level0")
    depth = 0
    while True:
        depth += 1
        step = frontier.join(e, "node").groupBy("from").agg(F.min("node").alias("next_hop")).select(F.col("from").alias("node"), "next_hop", F.lit(depth).alias("depth"))
        frontier, n = counted(st, step.join(seen.select("node"), "node", "left_anti"), f"level{depth}")
        if not n:
            return seen
        seen = seen.unionByName(frontier)


def chains(hops: DataFrame, names: DataFrame, separator: str = " -> ") -> DataFrame:
    """``node, target, chain``: next hops followed to the target, as names (``node, name``). Distances halve in each round."""
    st = Stages(hops.sparkSession, "chains")
    now, n = counted(st, hops.join(names, "node", "left").select("node", F.col("next_hop").alias("ptr"), F.array(F.coalesce("name", F.lit("?"))).alias("path"), F.col("node").alias("target")), "r0", F.count("ptr"))
    k = 0
    while n:
        far = now.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("path").alias("path2"), F.col("target").alias("target2"))
        k += 1
        now, n = counted(st, now.join(far, "ptr", "left").select("node", F.col("ptr2").alias("ptr"), F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat("path", "path2")).alias("path"), F.coalesce("target2", "target").alias("target")), f"r{k}", F.count("ptr"))
    return now.select("node", "target", F.array_join("path", separator).alias("chain"))


def writable_inputs(g: Graph, fields: DataFrame) -> DataFrame:
    """``input, field_id, depth``: the fields that a person or script can write and that the given ones (one column) are calculated from.

    Calculated fields are expanded through live calc and auto-enter dependencies; any other field is an end, and no search goes past it.
    """
    types = g.kind("field").select(F.col("entity_id").alias("field"), F.coalesce(F.col("field_type") == "Calculated", F.lit(False)).alias("calculated"))
    edges = field_edges(g).join(types, "field").where("calculated").select("field", "needs")
    reach = closure(edges, fields, "field", "needs")
    return reach.join(types.where("not calculated").select(F.col("field").alias("node")), "node").select(F.col("root").alias("input"), F.col("node").alias("field_id"), "depth")


def revisits(edges: DataFrame, reach: DataFrame, src: str = "caller", dst: str = "callee") -> DataFrame:
    """``root, revisited, cyclic``: whether a root's search met a node twice (a diamond does that too), and whether a true cycle lies in its reach."""
    inside = reach.select("root", F.col("node").alias(src)).join(edges, src).join(reach.select("root", F.col("node").alias(dst)), ["root", dst])
    degree = inside.groupBy("root").agg(F.count(F.lit(1)).alias("n_edges"))
    nodes = reach.groupBy("root").agg(F.count(F.lit(1)).alias("n_nodes"))
    own = closure(edges, edges.select(src), src, dst)
    back = own.join(edges.select(F.col(src).alias("node"), F.col(dst).alias("root")), ["root", "node"], "left_semi").select(F.col("root").alias("node")).distinct()
    cyclic = reach.join(back, "node", "left_semi").select("root").distinct().withColumn("cyclic", F.lit(True))
    return nodes.join(degree, "root", "left").join(cyclic, "root", "left").select("root", (F.coalesce("n_edges", F.lit(0)) > F.col("n_nodes") - 1).alias("revisited"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
