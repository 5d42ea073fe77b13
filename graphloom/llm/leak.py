"""Evaluation texts leaking into training text: a prefix-filtered join on word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import Stages, map_batches
from graphloom.llm.textnum import SpanHash, by_size, signed, words

#: Words of a shingle.
SHINGLE = 5
#: Bits of the map that tells which shingles an item may have: of this size whatever the number of items (2 MB), sent to every task.
MAP_BITS = 24
#: Words of a stretch of leaked text that is kept for the exact comparison.
STRETCH = 64

_ITEMS = "id long, window string, shingles array<long>"
_HITS = "id long, pos int, h long, run int, run_end int, words string"


def _word_hashes(texts: list[str]):
    """The texts in lower case, start, end and text number of their words, and the shingle at each word but the last ones of all."""
    low, start, end, text, h = words(texts)
    n = max(0, len(start) - SHINGLE + 1)
    at = np.arange(n)
    sh = signed(SpanHash(h(start, end))(at, at + SHINGLE)) if n else np.empty(0, np.int64)
    return low, start, end, text, sh


def _spelt(low: list[str], offset: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, a: int, b: int) -> str:
    """Words a to b, all of one text, with a blank between."""
    t, o = low[text[a]], offset[text[a]]
    return " ".join(t[x:y] for x, y in zip((start[a:b] - o).tolist(), (end[a:b] - o).tolist()))


def _offsets(low: list[str]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))


def _item_windows(run_words: int):
    """(id, window, shingles) of each run of ``run_words`` words."""
    per = run_words - SHINGLE + 1

    def run(batches):
        for batch in batches:
            for ids, texts in by_size(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                low, start, end, text, sh = _word_hashes(texts)
                n = len(start) - run_words + 1
                if n <= 0:
                    continue
                whole, offset = np.flatnonzero(text[run_words - 1 :] == text[:n]), _offsets(low)
                spelt = [_spelt(low, offset, start, end, text, a, a + run_words) for a in whole.tolist()]
                own = pa.array([sh[a : a + per] for a in whole.tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(ids, np.int64)[text[whole]]), pa.array(spelt, pa.string()), own], names=["id", "window", "shingles"])

    return run


def _hits(marked, run_words: int):
    """Places of a text whose shingle an item may have, with the run of such places they lie in if that is long enough for a window; and,
    without a shingle, the words of these runs in stretches that reach a window further than STRETCH words."""
    per = run_words - SHINGLE + 1

    def run(batches):
        bits = np.frombuffer(marked.value, np.uint8)
        for batch in batches:
            for ids, texts in by_size(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                low, start, end, text, sh = _word_hashes(texts)
                n = len(sh)
                if not n:
                    continue
                slot = sh & (8 * len(bits) - 1)
                hit = ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool) & (text[SHINGLE - 1 :] == text[:n])
                p = np.flatnonzero(hit)
                if not len(p):
                    continue
                head = np.concatenate(([True], (p[1:] != p[:-1] + 1) | (text[p[1:]] != text[p[:-1]])))
                first, size = np.flatnonzero(head), np.diff(np.append(np.flatnonzero(head), len(p)))
                begin = np.searchsorted(text, np.arange(len(ids)))[text[p]]
                long = np.repeat(size >= per, size)
                ran, ran_end = np.repeat(p[first], size) - begin, np.repeat(p[first] + size, size) - begin
                key = np.asarray(ids, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[text[p]]), pa.array((p - begin).astype(np.int32)), pa.array(sh[p]), pa.array(ran.astype(np.int32), mask=~long), pa.array(ran_end.astype(np.int32), mask=~long), pa.nulls(len(p), pa.string())],
                    names=[c.split()[0] for c in _HITS.split(", ")],
                )
                rows, offset = [], _offsets(low)
                for i in np.flatnonzero(size >= per).tolist():
                    a, b, o = int(p[first[i]]), int(p[first[i]] + size[i] + SHINGLE - 1), int(begin[first[i]])
                    for c in range(a, b - run_words + 1, STRETCH):
                        rows.append((int(key[text[a]]), c - o, None, a - o, None, _spelt(low, offset, start, end, text, c, min(b, c + STRETCH + run_words - 1))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=[c.split()[0] for c in _HITS.split(", ")])

    return run


def _map_of(items: DataFrame) -> bytes:
    """The map of all item shingles: at most 2^MAP_BITS / 64 numbers come to the driver."""
    h = items.select(F.explode("shingles").alias("h")).select(F.col("h").bitwiseAND((1 << MAP_BITS) - 1).alias("slot"))
    cells = h.groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64)
    return out.astype("<i8").tobytes()


def candidates(docs: DataFrame, items: DataFrame, run_words: int = 13, prefix: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the prefixes bring together: (``id, run, start, window``: where in a document which window would begin; the stretches to
    compare it with; ``item_id, window``). Without ``prefix`` every shingle of a window is joined instead of its prefix, which tells what the prefix saves."""
    st = Stages(docs.sparkSession, "leaks")
    per = run_words - SHINGLE + 1
    windows = st.put(map_batches(items.select("id", "text").where("id is not null and text is not null"), _item_windows(run_words), _ITEMS), "items")
    owners = windows.select(F.col("id").alias("item_id"), "window").distinct()
    marked = docs.sparkSession.sparkContext.broadcast(_map_of(windows))
    seen = st.put(map_batches(docs.select("id", "text").where("id is not null and text is not null"), _hits(marked, run_words), _HITS), "hits")
    hits = seen.where("h is not null")
    places = hits.groupBy("h").agg(F.count(F.lit(1)).alias("places"))
    shingles = windows.groupBy("window").agg(F.first("shingles").alias("shingles")).select("window", F.posexplode("shingles").alias("shift", "h"))
    ordered = shingles.join(places, "h", "left")
    rarest = ordered.groupBy("window").agg(F.count("places").alias("held"), F.min(F.struct("places", "h", "shift")).alias("first")).where(F.col("held") == per).select("window", "first.h", "first.shift")
    chosen = st.put(rarest if prefix else ordered.where("places is not null").select("window", "h", "shift"), "prefix")
    start = F.col("pos") - F.col("shift")
    # a window must lie in one run of places, from its first word to its last
    met = hits.where("run is not null").join(chosen.hint("merge"), "h").where((start >= F.col("run")) & (start + per <= F.col("run_end"))).select("id", "run", start.alias("start"), "window")
    return met, seen.where("h is null").select("id", "run", F.col("pos").alias("stretch"), "words"), owners


def leaks(docs: DataFrame, items: DataFrame, run_words: int = 13) -> DataFrame:
    """``item_id, doc_id, n_windows``: items (``id, text``) and documents (``id, text``) with ``run_words`` consecutive words in common, and
    how many of the item's distinct windows of that many words the document holds.

    Words are maximal runs of letters and digits, in lower case; the sets that are joined are the windows' shingles of five
    words. A window must be contained whole, so a prefix of one shingle is necessary: its rarest, rarity being the number of
    places in the corpus. Prefixes are joined with the corpus's places by a shuffle on the shingle. Bounds: a window with a
    shingle that the corpus lacks is dropped; the shingle's position in the window and in the document fixes where the
    window would begin, and from there to its end all places must have shingles of items. Then its words are compared exactly.

    The corpus is read once and never shuffled: of it only the places whose shingle an item may have are kept (by a map of
    fixed size, more of which are chance hits as items grow), and the words where these are dense enough for a window. Equal windows
    of several items are joined once.

    Rows without an id are left out. Null texts and texts shorter than ``run_words`` words are no case; rows given twice count once; empty tables give no rows.
    """
    met, stretches, owners = candidates(docs, items, run_words)
    base = F.col("run") + F.floor((F.col("start") - F.col("run")) / STRETCH).cast("int") * STRETCH
    spelt = F.array_join(F.slice(F.split("words", " "), F.col("start") - F.col("stretch") + 1, run_words), " ")
    sure = met.withColumn("stretch", base).join(stretches.hint("merge"), ["id", "run", "stretch"]).where(spelt == F.col("window")).select("id", "window").distinct()
    return sure.join(owners, "window").groupBy("item_id", F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_windows"))
