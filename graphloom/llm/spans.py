"""Long exact spans that records share.

Texts are cut into tokens at content-defined points: a point is the first smallest hash of the 8-grams in some window of
WINDOW consecutive ones, so it depends on nearby characters only. Any two texts that share a span of MIN_SPAN characters share a
chain of at least K whole tokens inside it. K consecutive tokens are an edge of a de Bruijn graph in token space; edges
that occur in several texts are the repeated part of the graph. Where all occurrences of an edge have one successor, and all
occurrences of that one have it as their predecessor, the path doesn't branch and is compacted: every occurrence runs through
the whole path. Compacted paths of MIN_SPAN characters or more are compared by their content as one piece; only windows of
MIN_SPAN characters that reach beyond a path, where all edges are repeated, are compared one by one.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import Stages, map_batches
from graphloom.llm.textnum import SpanHash, U, by_size, code_points, signed

GRAM = 8
K = 2

_EDGES = "h long, g long, tid long, idx int, nxt long, prv long"
_PIECES = "k1 long, k2 long, tid long, a int, b int"


def window_of(min_span: int) -> int:
    """Largest window for which MIN_SPAN characters hold K whole tokens between cuts that no outside character can move."""
    return (min_span - GRAM + 1) // (K + 1) if min_span >= 4 * GRAM else 1


def cuts(cp: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, SpanHash]:
    """Positions of the cuts, the text number of each, and the hash over the characters."""
    h = SpanHash(cp)
    n = len(cp)
    if n < GRAM + window - 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), h
    at = np.arange(n - GRAM + 1)
    low, where, span = h(at, at + GRAM), at, 1
    while span < window:  # minimum over spans that double, the first one on ties
        step = min(span, window - span)
        a, b = low[:-step], low[step:]
        take = a <= b
        low, where = np.where(take, a, b), np.where(take, where[:-step], where[step:])
        span += step
    end = np.repeat(off[1:], np.diff(off))[: len(where)]
    where = where[np.arange(len(where)) + window - 1 + GRAM <= end]
    where = where[np.concatenate(([True], where[1:] != where[:-1]))] if len(where) else where
    return where, np.searchsorted(off, where, "right") - 1, h


def edges(cp: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, SpanHash]:
    """Text number, ordinal within the text, first cut and last cut of each run of K tokens."""
    pos, text, h = cuts(cp, off, window)
    if len(pos) <= K:
        return *(np.empty(0, np.int64),) * 4, h
    same = text[K:] == text[:-K]
    first, last, text = pos[:-K][same], pos[K:][same], text[:-K][same]
    begin = np.concatenate(([True], text[1:] != text[:-1])) if len(text) else np.empty(0, bool)
    starts = np.flatnonzero(begin)
    idx = np.arange(len(text)) - np.repeat(starts, np.diff(np.append(starts, len(text))))
    return text, idx, first, last, h


def _edge_rows(window: int):
    def run(batches):
        for batch in batches:
            for keys, texts in by_size(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                cp, off = code_points(texts)
                text, idx, first, last, h = edges(cp, off, window)
                if not len(text):
                    continue
                h1, h2 = signed(h(first, last + GRAM)), signed(SpanHash(cp, 1)(first, last + GRAM))
                near = text[1:] == text[:-1]
                nxt = pa.array(np.append(h1[1:], 0), mask=np.append(~near, True))
                prv = pa.array(np.append(0, h1[:-1]), mask=np.append(True, ~near))
                tid = np.asarray(keys, np.int64)[text]
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(tid), pa.array(idx.astype(np.int32)), nxt, prv], names=["h", "g", "tid", "idx", "nxt", "prv"])

    return run


def _candidate_pieces(size: int, first: np.ndarray, last: np.ndarray, heads: np.ndarray, tails: np.ndarray, min_span: int, window: int):
    """Start and end of the spans of one text that have to be compared: compacted paths (edges heads[i] to tails[i]), and the windows that lie in none of them."""
    n = size - min_span + 1
    if n <= 0 or not len(heads):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    repeated = np.zeros(len(first) + 1, np.int64)
    np.add.at(repeated, heads, 1)
    np.add.at(repeated, tails + 1, -1)
    repeated = np.cumsum(repeated)[:-1] > 0
    run = np.flatnonzero(repeated)
    a, b = first[heads], last[tails] + GRAM
    long = b - a >= min_span
    a, b = a[long], b[long]
    # windows: around a repeated edge, around no single one in their inner part, and beyond every compacted path
    around, against = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)

    def add(to, lo, hi):  # window starts lo..hi
        lo, hi = np.maximum(lo, 0), np.minimum(hi, n - 1)
        ok = lo <= hi
        np.add.at(to, lo[ok], 1)
        np.add.at(to, hi[ok] + 1, -1)

    add(around, last[run] + GRAM - min_span, first[run])
    alone = ~repeated
    add(against, last[alone] - (min_span - GRAM + 1 - window), first[alone] - (window - 1))
    add(against, a, b - min_span)
    s = np.flatnonzero((np.cumsum(around)[:n] > 0) & (np.cumsum(against)[:n] == 0))
    return np.concatenate((a, s)), np.concatenate((b, s + min_span))


def _read_again(group: list[str], text: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of the spans [a, b) of texts, out of the texts themselves."""
    digest = b"".join(blake2b(group[t][x:y].encode("utf-8", "surrogatepass"), digest_size=16).digest() for t, x, y in zip(text.tolist(), a.tolist(), b.tolist()))
    pair = np.frombuffer(digest, np.int64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def _piece_rows(min_span: int, window: int):
    def run(batches):
        for batch in batches:
            keys, marks = batch.column(0).to_pylist(), batch.column(2)
            texts = batch.column(1).to_pylist()
            for own, group in by_size(zip(range(len(keys)), texts)):
                cp, off = code_points(group)
                text, _, first, last, h = edges(cp, off, window)
                bounds = np.searchsorted(text, np.arange(len(group) + 1))
                of, starts, ends = [], [], []
                for j, i in enumerate(own):
                    lo, hi, base = bounds[j], bounds[j + 1], off[j]
                    heads, tails = (marks[i].values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("head", "tail"))
                    a, b = _candidate_pieces(len(group[j]), first[lo:hi] - base, last[lo:hi] - base, heads, tails, min_span, window)
                    of.append(np.full(len(a), j, np.int64))
                    starts.append(a)
                    ends.append(b)
                of, a, b = np.concatenate(of), np.concatenate(starts), np.concatenate(ends)
                if not len(a):
                    continue
                base = off[of]
                k1, k2 = signed(h(a + base, b + base)), signed(SpanHash(cp, 1)(a + base, b + base))
                path = b - a > min_span  # these may be of any length, where sums modulo 2^64 can be made to agree
                k1[path], k2[path] = _read_again(group, of[path], a[path], b[path])
                tids = np.asarray([keys[i] for i in own], np.int64)[of]
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(tids), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["k1", "k2", "tid", "a", "b"])

    return run


def shared_spans(records: DataFrame, min_span: int = 80) -> DataFrame:
    """``id, shared_chars, n_chars``: for each record (``id`` long, ``text``) that shares anything, the number of its characters (code
    points) that lie in a run of ``min_span`` consecutive ones which also occurs in another record.

    Equal texts are compared once: a text that several records have is shared whole. Edges are counted map-side before the
    shuffle, so an edge in a third of all records is one row per task; no pairs of records are made. Paths are read again at their
    coordinates and compared by a 128-bit digest of their content, windows of ``min_span`` characters by two 64-bit sums. Null, empty and shorter texts share nothing; rows without an id are left out; a repetition within one record alone counts
    for nothing; rows given twice count once; other columns are ignored. Empty tables give no rows.
    """
    window = window_of(min_span)
    st = Stages(records.sparkSession, "spans")
    rows = st.put(records.select("id", "text").where((F.length("text") >= min_span) & F.col("id").isNotNull()).select("id", "text", F.xxhash64("text").alias("x1"), F.xxhash64(F.lit(5), F.reverse("text")).alias("x2")), "records")
    once = rows.groupBy("text").agg(F.min("id").alias("tid"), (F.min("id") < F.max("id")).alias("several"), F.first("x1").alias("x1"), F.first("x2").alias("x2"))
    texts = st.put(once, "texts")

    rings = map_batches(texts.select("tid", "text"), _edge_rows(window), _EDGES)
    count = lambda c: (F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1)))
    graph = rings.groupBy("h", "g").agg(F.min("tid").alias("t1"), F.max("tid").alias("t2"), count("nxt").alias("out"), count("prv").alias("inn")).where("t1 < t2")
    graph = st.put(graph.select("h", "g", "out", "inn"), "graph")  # written, so that the shuffle behind it can be freed
    found = rings.select("h", "g", "tid", "idx").join(graph, ["h", "g"])
    # an edge and the one before it in the text are one path if neither branches there; paths are numbered and compacted to their first and last edge
    along = Window.partitionBy("tid").orderBy("idx")
    joined = (F.lag("idx").over(along) == F.col("idx") - 1) & F.lag("out").over(along) & F.col("inn")
    steps = found.withColumn("begins", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("path", F.sum("begins").over(along))
    paths = steps.groupBy("tid", "path").agg(F.min("idx").alias("head"), F.max("idx").alias("tail"))
    marks = paths.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("head", "tail"))).alias("marks"))

    pieces = st.put(map_batches(texts.select("tid", "text").join(marks, "tid").select("tid", "text", "marks"), _piece_rows(min_span, window), _PIECES), "pieces")
    common = pieces.groupBy("k1", "k2").agg(F.min("tid").alias("t1"), F.max("tid").alias("t2")).where("t1 < t2").select("k1", "k2")
    common = st.put(common, "common")
    spans = pieces.join(common, ["k1", "k2"], "left_semi").groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["upto"], s["b"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["upto"], s["a"]))).alias("n")),
        lambda acc: acc["n"],
    )
    alone = texts.where("not several").select("tid", F.length("text").cast("long").alias("n_chars")).join(spans.select("tid", covered.alias("shared_chars")), "tid")
    copies = rows.select("id", "x1", "x2", F.length("text").cast("long").alias("n_chars")).join(texts.where("several").select("x1", "x2"), ["x1", "x2"], "left_semi").distinct()
    return alone.select(F.col("tid").alias("id"), "shared_chars", "n_chars").unionByName(copies.select("id", F.col("n_chars").alias("shared_chars"), "n_chars"))
