"""Parent-child links of unknown depth to full hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import Stages, counted

#: Sums over siblings are taken in so many blocks, so that the children of one parent are not sorted in one task. Neighbouring ids share a block.
BLOCKS, BLOCK_BITS = 4096, 12
#: Preorder numbers that one group of the sweep over ranges holds, at most one node each.
SWEEP_BITS = 16
SEPARATOR = " / "


def _no_long() -> Column:
    return F.lit(None).cast("long")


def _block(id_: str = "id") -> Column:
    return F.pmod(F.shiftright(id_, BLOCK_BITS), F.lit(BLOCKS))


def _by_shuffle(df: DataFrame) -> DataFrame:
    """The right side of a join whose size grows with the data: staged tables look small as files, so no broadcast is to be guessed from that."""
    return df.hint("merge")


def _nodes(rows: DataFrame, key: str, parent: str, label: str | None) -> DataFrame:
    """``id, up, inner`` (and ``label``): each node once, with the parent it was given, and whether any row names it as a parent.

    Rows without a key are left out; of several parents or labels given for one id the smallest counts.
    """
    nodes = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(parent).alias("up"), *([F.min(label).alias("label")] if label else []))
    named = rows.where(F.col(parent).isNotNull()).select(F.col(parent).alias("id")).distinct().withColumn("inner", F.lit(True))
    return nodes.join(_by_shuffle(named), "id", "left").withColumn("inner", F.col("inner").isNotNull())


def nested_sets(rows: DataFrame, key: str = "entity_id", parent: str = "parent_entity_id", label: str | None = None) -> DataFrame:
    """``id, up, root, depth, pre, size`` (and ``path``, if a label column is given): nested-set ranges [pre, pre + size) in one order of all trees.

    Upward pass: subtree sizes. Downward pass: siblings, those with children first, get consecutive preorder ranges by prefix
    sums of the sizes (the roots are siblings, too), and the offsets add up. Then the ranges tell the rest: a sweep over them in preorder finds
    the root of a node as the last root's range opened and its depth as the number of ranges open around it; x is a descendant of y if pre(x) lies
    in y's range. Each pass doubles the distance it covers in every round (the ancestor at distance 2^k), so depth d takes
    log2(d) rounds, round k over the inner nodes of depth 2^k or more only: leaves count into their parent before and take
    their place from it after.

    A root (parent null or not among the nodes) has depth 0 and is its own root; up is the parent as given. Nodes that no round
    reaches from a root lie on a loop or lead into one: depth -1, root the smallest id on that loop, pre, size and path null. A
    null label is an empty step of the path. Rows given twice count once; empty tables give no rows.
    """
    st = Stages(rows.sparkSession, "hierarchy")
    nodes = st.put(_nodes(rows, key, parent, label), "nodes")
    tag = ["label"] if label else []
    leaf, own = nodes.where("not inner").withColumn("block", _block()), nodes.where("inner")
    crowd = st.put(leaf.groupBy("up", "block").agg(F.count(F.lit(1)).alias("n")), "crowd")
    ids = own.select(F.col("id").alias("found"))
    inner = st.put(own.join(_by_shuffle(ids), F.col("up") == F.col("found"), "left").select("id", "up", "found", *tag), "inner")

    sizes, caught = _sizes(st, inner, crowd)
    known = _ranges(st, inner, sizes, tag)
    if caught is not None:
        loops = _loop_roots(st, inner.join(_by_shuffle(caught), "id", "left_semi").select("id", "up"))
        lost = loops.select("id", "root", F.lit(-1).cast("long").alias("depth"), _no_long().alias("pre"), _no_long().alias("size"), _no_long().alias("leaves_at"), *([F.lit(None).cast("string").alias("path")] if tag else []))
        known = known.unionByName(lost)
    known = st.put(known, "known")
    cols = ["id", "up", "root", "depth", "pre", "size", *(["path"] if tag else [])]
    return inner.select("id", "up").join(_by_shuffle(known), "id").select(cols).unionByName(_leaves(st, leaf, crowd, known, tag))


def _sizes(st: Stages, inner: DataFrame, crowd: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``id, size`` of inner nodes, and the ``id`` of those that are caught in loops, if any.

    Round k adds to each node the sizes, as far as known, of the nodes 2^k below it; only nodes with an ancestor that far go on.
    """
    leaves = crowd.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("n").alias("n"))
    start = inner.join(_by_shuffle(leaves), "id", "left").select("id", F.col("found").alias("ptr"), (1 + F.coalesce("n", F.lit(0))).alias("size"))
    own, waiting = counted(st, start, "own", F.count("ptr"))
    active, parts, k, before = own.where("ptr is not null"), [own.select("id", "size")], 0, -1
    while waiting and waiting != before:
        more = st.put(active.groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("size")), f"more{k}")
        parts.append(more)
        far = active.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"))
        on = active.join(_by_shuffle(far), "ptr").select("id", F.col("ptr2").alias("ptr"), "size")
        on = on.join(_by_shuffle(more.withColumnRenamed("size", "more")), "id", "left").select("id", "ptr", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        before = waiting
        active, waiting = counted(st, on, f"active{k}")
        if k:
            st.drop(f"active{k - 1}")
        k += 1
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("id").agg(F.sum("size").alias("size")), active.select("id") if waiting else None


def _sums_before(rows: DataFrame, group: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` (with ``id``) and the sum of ``value`` over the rows of the group that come before, in blocks and then within each."""
    rows = rows.withColumn("__block", _block())
    blocks = rows.groupBy(*group, "__block").agg(F.sum(value).alias("total"))
    start = blocks.select(*group, "__block", (F.sum("total").over(Window.partitionBy(*(group or [F.lit(0)])).orderBy("__block")) - F.col("total")).alias("__start"))
    within = F.sum(value).over(Window.partitionBy(*group, "__block").orderBy("id")) - value
    return rows.withColumn("__within", within).join(_by_shuffle(start), [*group, "__block"]).withColumn(name, F.col("__start") + F.col("__within")).drop("__start", "__within", "__block")


def _ranges(st: Stages, inner: DataFrame, sizes: DataFrame, tag: list[str]) -> DataFrame:
    """``id, root, depth, pre, size, leaves_at`` (and ``path``) of the inner nodes that a root leads to; leaves_at: where the ranges of its leaves begin."""
    placed = st.put(inner.join(_by_shuffle(sizes), "id").select("id", F.col("found").alias("up"), "size", *tag), "placed")
    step = [F.array(F.coalesce("label", F.lit(""))).alias("path")] if tag else []
    longer = [F.concat("path2", "path").alias("path")] if tag else []
    rooted = _sums_before(placed.where("up is null"), [], F.col("size"), "off").select("id", F.col("up").alias("ptr"), "off", *step)
    below = _sums_before(placed.where("up is not null"), ["up"], F.col("size"), "off").select("id", F.col("up").alias("ptr"), (1 + F.col("off")).alias("off"), *step)
    now, waiting = counted(st, rooted.unionByName(below), "down", F.count("ptr"))
    done, active, k, before = now.where("ptr is null").drop("ptr"), now.where("ptr is not null"), 0, -1
    while waiting and waiting != before:
        # off is the distance from ptr's place, or the place itself once there is no ptr any more
        target = done.withColumn("ptr", _no_long()).unionByName(active).select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("off").alias("off2"), *[F.col(c).alias("path2") for c in (["path"] if tag else [])])
        before = waiting
        now, waiting = counted(st, active.join(_by_shuffle(target), "ptr").select("id", F.col("ptr2").alias("ptr"), (F.col("off") + F.col("off2")).alias("off"), *longer), f"down{k}", F.count("ptr"))
        done, active, k = done.unionByName(now.where("ptr is null").drop("ptr")), now.where("ptr is not null"), k + 1
    filled = placed.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("filled"))
    full = placed.select("id", "size", F.col("up").isNull().alias("top")).join(_by_shuffle(done.withColumnRenamed("off", "pre")), "id").join(_by_shuffle(filled), "id", "left")
    full = st.put(full.select("id", "pre", "size", "top", (F.col("pre") + 1 + F.coalesce("filled", F.lit(0))).alias("leaves_at"), *([F.array_join("path", SEPARATOR).alias("path")] if tag else [])), "full")
    return full.join(_by_shuffle(_sweep(full)), "id").select("id", "root", "depth", "pre", "size", "leaves_at", *(["path"] if tag else []))


def _sweep(ranges: DataFrame) -> DataFrame:
    """``id, root, depth`` out of ranges (``id, pre, size, top``): how many other ranges hold a node's number, and whose is the outermost.

    The numbers are cut into groups of 2^SWEEP_BITS, in each of which at most as many ranges open, and as many places close; what is open
    at a group's begin is summed over groups.
    """
    opens = ranges.select(F.col("pre").alias("at"), F.lit(1).cast("long").alias("step"), "id", F.when(F.col("top"), F.struct("pre", "id")).alias("root"))
    closes = ranges.groupBy((F.col("pre") + F.col("size")).alias("at")).agg((-F.count(F.lit(1))).alias("step")).select("at", "step", _no_long().alias("id"), F.lit(None).cast("struct<pre:bigint,id:bigint>").alias("root"))
    events = opens.unionByName(closes).withColumn("part", F.shiftright("at", SWEEP_BITS))
    sums = events.groupBy("part").agg(F.sum("step").alias("step"), F.max("root").alias("root"))
    upto = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = sums.select("part", F.coalesce(F.sum("step").over(upto), F.lit(0)).alias("open0"), F.max("root").over(upto).alias("root0"))
    within = Window.partitionBy("part").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumn("open", F.sum("step").over(within)).withColumn("last", F.max("root").over(within)).where("id is not null")
    return seen.join(_by_shuffle(begin), "part").select("id", F.coalesce("last", "root0")["id"].alias("root"), (F.col("open0") + F.col("open") - 1).alias("depth"))


def ancestors(links: DataFrame) -> DataFrame:
    """``id, anc``: every node (``id, up``) with all that it reaches upward, itself left out; each round joins the pairs with themselves and so doubles the distance.

    Rounds = log2 of the depth; on a loop everything reaches everything. Rows without a parent give no pair.
    """
    st = Stages(links.sparkSession, "ancestors")
    pairs, n, k, before = *counted(st, links.where("id is not null and up is not null").select("id", F.col("up").alias("anc")).distinct(), "pairs"), 0, -1
    while n != before:
        far = pairs.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"))
        before = n
        pairs, n = counted(st, pairs.unionByName(pairs.join(far, "anc").select("id", F.col("anc2").alias("anc"))).distinct(), f"pairs{k}")
        k += 1
    return pairs.where("id <> anc")


def _loop_roots(st: Stages, caught: DataFrame) -> DataFrame:
    """``id, root`` of inner nodes on a loop or leading into one; root is the smallest id on the loop.

    low is the smallest id among a node and its ancestors nearer than 2^k, ptr the ancestor at 2^k. The pointers' targets only
    ever become fewer; when a round leaves as many, they are the nodes on loops. When no low changes either, the low of a
    node's target is that of its whole loop.
    """
    now, k, targets, moved = st.put(caught.select("id", F.col("up").alias("ptr"), F.col("id").alias("low"), F.lit(0).alias("moved")), "loop"), 0, -1, 1
    while True:
        row = now.agg(F.countDistinct("ptr").alias("targets"), F.sum("moved").alias("moved")).first()
        if k and row.targets == targets and not row.moved:
            break
        targets = row.targets
        far = now.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        now = st.put(now.join(_by_shuffle(far), "ptr").select("id", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).cast("int").alias("moved")), f"loop{k}")
        st.drop(f"loop{k - 1}" if k else "loop")
        k += 1
    return now.select("id", "ptr").join(_by_shuffle(now.select(F.col("id").alias("ptr"), F.col("low").alias("root"))), "ptr").select("id", "root")


def _leaves(st: Stages, leaf: DataFrame, crowd: DataFrame, known: DataFrame, tag: list[str]) -> DataFrame:
    """The same columns of the leaves: each block of a parent's leaves gets a stretch of its range, those without a parent follow behind all trees.

    ``crowd`` (up, block, n) takes the parents' places, so the leaves themselves are shuffled once, by block.
    """
    of = known.select(F.col("id").alias("up"), "root", "depth", "leaves_at", *([F.col("path").alias("above")] if tag else []))
    start = crowd.select("up", "block", (F.sum("n").over(Window.partitionBy("up").orderBy("block")) - F.col("n")).alias("start"), "n")
    start = st.put(start.join(_by_shuffle(of), "up", "left"), "stretches")
    lone = start.where("root is null").withColumn("id", F.xxhash64("up", "block"))
    end = F.coalesce(known.agg(F.max(F.col("pre") + F.col("size"))).scalar(), F.lit(0))
    free = _sums_before(lone, [], F.col("n"), "free")
    begin = start.where("root is not null").withColumn("begin", F.col("leaves_at") + F.col("start")).unionByName(free.withColumn("begin", end + F.col("free")).drop("id", "free"))
    rank = F.row_number().over(Window.partitionBy("up", "block").orderBy("id")) - 1
    on = (F.col("l.up").eqNullSafe(F.col("b.up"))) & (F.col("l.block") == F.col("b.block"))
    row = leaf.withColumn("rank", rank).alias("l").join(_by_shuffle(begin).alias("b"), on)
    caught = F.coalesce(F.col("b.depth") < 0, F.lit(False))
    own = F.coalesce("l.label", F.lit("")) if tag else None
    return row.select(
        "l.id", "l.up", F.coalesce("b.root", "l.id").alias("root"), F.when(caught, F.col("b.depth")).otherwise(F.coalesce(F.col("b.depth") + 1, F.lit(0).cast("long"))).alias("depth"),
        F.when(~caught, F.col("b.begin") + F.col("l.rank")).alias("pre"), F.when(~caught, F.lit(1).cast("long")).alias("size"),
        *([F.when(F.col("b.root").isNull(), own).otherwise(F.concat("b.above", F.lit(SEPARATOR), own)).alias("path")] if tag else []),
    )


def descendants(sets: DataFrame) -> DataFrame:
    """``ancestor_id, id``: every pair of a node and one of its descendants, out of nested-set ranges.

    Each range of more than one node is cut into at most 2 log2(size) aligned blocks of 2^j preorder numbers, each node looks
    for its number's blocks, and the two meet by equality of (root, j, block): no pair is compared that isn't a result.
    Nodes caught in loops have no ranges and give no rows.
    """
    ranged = sets.where("pre is not null")
    # blocks of [a, b): at level j those aligned 2^j blocks inside the range whose parent block is not inside it
    level = "explode(sequence(0, cast(ceil(log2(size)) as int)))"
    spans = ranged.where("size > 1").select("root", F.col("id").alias("ancestor_id"), F.col("pre").alias("a"), (F.col("pre") + F.col("size")).alias("b"), "size").withColumn("j", F.expr(level))
    first, last = F.expr("shiftright(a + shiftleft(1L, j) - 1, j)"), F.expr("shiftright(b, j) - 1")
    up_first, up_last = F.expr("shiftright(a + shiftleft(1L, j + 1) - 1, j + 1)"), F.expr("shiftright(b, j + 1) - 1")
    spans = spans.withColumns({"f": first, "l": last, "uf": up_first, "ul": up_last}).where("f <= l")
    whole = F.expr("uf <= ul")
    ends = F.when(whole, F.filter(F.array(F.when(F.expr("f < 2 * uf"), F.col("f")), F.when(F.expr("l > 2 * ul + 1"), F.col("l"))), lambda x: x.isNotNull())).otherwise(F.sequence("f", "l"))
    spans = spans.select("root", "ancestor_id", "j", F.explode(ends).alias("block"))
    tops = ranged.where("id = root").select("root", F.expr("cast(ceil(log2(size)) as int)").alias("levels"))
    points = ranged.select("root", "id", "pre").join(tops, "root").select("root", "id", "pre", F.explode(F.sequence(F.lit(0), "levels")).alias("j"))
    points = points.select("root", "id", "j", F.expr("shiftright(pre, j)").alias("block"))
    return spans.join(points, ["root", "j", "block"]).where("ancestor_id <> id").select("ancestor_id", "id")
