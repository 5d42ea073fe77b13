"""Helpers that every operator shares: loading, size-checked broadcasts, materialised stages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows of a fixed-width dimension that is broadcast; beyond it Spark picks a shuffle join.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else ``df`` as it is (a shuffle join follows).

    The size is counted, never guessed: at most ``limit + 1`` rows are read for it.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def stem(name: Column) -> Column:
    """Lower-case file name without a final ``.fmp12``; null stays null."""
    return F.regexp_replace(F.lower(name), r"\.fmp12$", "")


def key128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns, null-aware (null differs from every value)."""
    parts = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(11), *parts), F.xxhash64(F.lit(-7), *reversed(parts))]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session's executors, wherever they run; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="graphloom-code-")  # on the driver, which serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = Path(__file__).resolve().parent
    with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(f"{folder}/{package.name}.zip")
    _shipped.add(sc.applicationId)


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stages:
    """Tables written to the folder that all executors share, to cut lineage between the rounds of an iteration.

    The folder is ``spark.checkpoint.dir`` where the cluster names one; where it is unset, a local master gets a
    temporary folder, removed when the process ends, and any other an error. A lost executor costs nothing: a later read finds files.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            base = tempfile.mkdtemp(prefix="graphloom-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        self.root = f"{base}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._clean)

    def _clean(self) -> None:
        """At the end of the process: results read these tables lazily, so they stay until then."""
        try:
            self.drop("")
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as the table ``name`` and return a DataFrame that reads it."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_SHUFFLE_CLEANUP, None)
        try:
            self.spark.conf.set(_SHUFFLE_CLEANUP, "true")
            df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(_SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete the table ``name`` (all of them, if empty); no later read may need it."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def counted(st: Stages, df: DataFrame, name: str, count: Column | None = None) -> tuple[DataFrame, int]:
    """``st.put``, and the number of rows (or what ``count`` aggregates to), told by the write itself."""
    seen = Observation()
    out = st.put(df.observe(seen, (F.count(F.lit(1)) if count is None else count).alias("n")), name)
    return out, seen.get["n"]


def null_safe_join(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``cols`` where null equals null; the result has the columns of ``left`` and, unless semi or anti, the others of ``right``."""
    right = right.withColumnsRenamed({c: f"{c}__r" for c in cols})
    on = [F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in cols]
    return left.join(right, on, how).drop(*[f"{c}__r" for c in cols])
