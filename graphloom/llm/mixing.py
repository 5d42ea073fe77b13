"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import Stages, map_batches

#: Folder with the vocabulary files of public tokenizers.
TOKENIZERS = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published splitting pattern of this byte-level vocabulary. A fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of one size in a source are summed in so many blocks, in parallel; the sums of the blocks are then added up.
BLOCKS = 256


def _count_tokens(name: str):
    def run(batches):
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], names=["id", "n_tokens", "source"])

    return run


def token_sizes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``id, n_tokens, source`` of each document with text (``id, text, source``), whole texts, by a public tokenizer's vocabulary file, which is sent to the executors."""
    path = path or f"{TOKENIZERS}/{VOCABULARY}"
    docs.sparkSession.sparkContext.addFile(path)
    return map_batches(docs.where((F.trim("text") != "") & F.col("id").isNotNull()).select("id", "text", "source"), _count_tokens(os.path.basename(path)), "id long, n_tokens long, source string")


def source_name(c: Column) -> Column:
    """A source's name without case and surrounding blanks."""
    return F.lower(F.trim(c))


def _uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only, so a task that runs again draws the same."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)) / F.lit(float(1 << 53))


class Mixture:
    """A mixture of the documents: ``drawn`` (``doc_id, source, n_tokens, copies``) and ``shares`` (one row per wanted source).

    Each wanted source gets target_share of the token total of all documents, unwanted sources' included. The expected copies of
    each of its documents are wanted tokens / tokens there are, at most max_repeats. Within a source, in a random order, the
    expected copies are summed up, one random offset is added, and a document is emitted once for each integer that its
    step of the sum crosses: its copies differ from the expectation by less than one, and so does the source's total.
    Sums are taken in blocks of a source and then over blocks, so no source is sorted in one task.

    Null or blank texts have no tokens and are never drawn, nor are rows without an id; sources are compared without case and outer blanks; a null source
    is not wanted; rows given twice count once (by id, text with most tokens); a wanted source without documents reaches a share of
    0; targets given twice count once (largest share). A share that max_repeats keeps from its target is told as ``capped``.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, seed: int = 1, tokenizer: str | None = None):
        st = Stages(docs.sparkSession, "mixture")
        sized = token_sizes(docs, tokenizer).groupBy("id").agg(F.max("n_tokens").alias("n_tokens"), F.min(source_name(F.col("source"))).alias("source"))
        sized = st.put(sized, "sized")
        wanted = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.max("n_tokens").alias("largest"))
        total = have.agg(F.sum("tokens")).scalar()
        rate = F.least(F.col("target_share") * F.col("total") / F.col("tokens"), F.col("max_repeats").cast("double"))
        self._plan = st.put(
            wanted.join(have, "source", "left").withColumn("total", F.coalesce(total, F.lit(0).cast("long")))
            .withColumn("rate", F.when(F.col("tokens") > 0, rate).otherwise(F.lit(0.0)))
            .withColumn("capped", F.col("rate") * F.coalesce("tokens", F.lit(0)) < F.col("target_share") * F.col("total") * (1 - 1e-9)),
            "plan",
        )
        # a document's step is its rate, the same for all of a source: the sum up to it is its rank times the rate
        rows = sized.join(self._plan.where("rate > 0").select("source", "rate"), "source")
        rows = rows.withColumn("draw", _uniform(seed, F.col("id"))).withColumn("block", F.floor(F.col("draw") * BLOCKS).cast("int"))
        sums = rows.groupBy("source", "n_tokens", "block").agg(F.count(F.lit(1)).alias("n"))
        before = lambda group, order: F.sum("n").over(Window.partitionBy(*group).orderBy(order)) - F.col("n")
        sizes = sums.groupBy("source", "n_tokens").agg(F.sum("n").alias("n"))
        sizes = sizes.select("source", "n_tokens", before(["source"], "n_tokens").alias("smaller"))
        blocks = sums.select("source", "n_tokens", "block", before(["source", "n_tokens"], "block").alias("before"))
        starts = blocks.join(sizes, ["source", "n_tokens"]).select("source", "n_tokens", "block", (F.col("smaller") + F.col("before")).alias("before"))
        rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "block").orderBy("draw", "id"))
        upto = (F.col("before") + F.col("nth")) * F.col("rate") + _uniform(seed + 1, F.col("source"))
        copies = (F.floor(upto) - F.floor(upto - F.col("rate"))).cast("long")
        numbered = rows.withColumn("nth", rank).join(starts, ["source", "n_tokens", "block"])
        self.drawn = st.put(numbered.select(F.col("id").alias("doc_id"), "source", "n_tokens", copies.alias("copies")).where("copies > 0"), "drawn")

    @property
    def shares(self) -> DataFrame:
        """``source, target_share, docs, tokens, drawn_docs, drawn_tokens, most_copies, actual_share, share_of_corpus, capped``."""
        got = self.drawn.groupBy("source").agg(F.count(F.lit(1)).alias("drawn_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"))
        all_drawn = got.agg(F.sum("drawn_tokens")).scalar()
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        out = self._plan.join(got, "source", "left").select("source", "target_share", zero("docs"), zero("tokens"), zero("drawn_docs"), zero("drawn_tokens"), zero("most_copies"), "total", "capped")
        return out.select("*", F.coalesce(F.try_divide("drawn_tokens", all_drawn), F.lit(0.0)).alias("actual_share"), F.coalesce(F.try_divide("drawn_tokens", "total"), F.lit(0.0)).alias("share_of_corpus")).drop("total")

    @property
    def kept(self) -> DataFrame:
        """``source, max_repeats, within_largest, repeats_kept``: 1 where the source's tokens differ from their target (or from what max_repeats allows) by at most its largest document, and where no document is drawn more often."""
        got = self.drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn"), F.max("copies").alias("most"))
        out = self._plan.join(got, "source", "left")
        off = F.abs(F.coalesce("drawn", F.lit(0)) - F.col("rate") * F.coalesce("tokens", F.lit(0)))
        return out.select("source", "max_repeats", (off <= F.coalesce("largest", F.lit(0)) + 1e-6).cast("int").alias("within_largest"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).cast("int").alias("repeats_kept"))
