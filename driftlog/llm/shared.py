"""Shared folder, tables written for reuse, and input helpers of the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.package import ship_package


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none (tests, local mode) a folder of this machine is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="driftlog-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, files: int | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    ``files``: at most so many files, for tables known to be small beside what they are made from.
    ``path``: where, for a table that the caller drops when it has served.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    out = df if files is None else df.coalesce(files)
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written to the shared folder for one computation, removed together when they have served."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        self.paths.append(new_path(self.spark, name))
        return self.paths[-1]

    def written(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        return written(df, name, files, self.path(name))

    def drop(self) -> None:
        while self.paths:
            delete_path(self.spark, self.paths.pop())
        self.spark.sparkContext._jvm.System.gc()  # shuffles that made these tables are removed once nothing refers to them


#: most keys that ``spread_join`` calls hot, and rows under which no key is
MOST_HOT, LEAST_HOT = 50_000, 1000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Inner join with ``right``, a written table of one row a key; its column ``rows`` says how many rows of ``left`` have the key.

    Keys with many rows are broadcast, at most ``MOST_HOT`` of them since their rows add up to the whole;
    the others are joined by a shuffle, in which no key is large. ``left`` is read twice.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    limit = max(LEAST_HOT, total // MOST_HOT)
    hot, cold = F.broadcast(right.where(F.col(rows) > limit)), right.where(F.col(rows) <= limit)
    rest = left.join(F.broadcast(right.where(F.col(rows) > limit).select(*keys)), keys, "left_anti").join(cold, keys)
    return left.join(hot, keys).unionByName(rest)


def own_name(name: str, *frames: DataFrame) -> str:
    """``name``, made longer until no column of the frames has it (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written_one(df: DataFrame, name: str) -> DataFrame:
    """``written`` for a list of files or tasks: one row per task of the job that made it, in one file."""
    return written(df.repartition(1), name)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store through the cluster's own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null text as empty: extra columns cannot clash with names used inside."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Prepare for Python workers: they get this package, and so much at once at most (texts are long)."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def _tidied(f: Callable, batches: Iterator) -> Iterator:
    yield from f(batches)
    # a worker outlives its task: what the task freed goes back to the machine
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(f: Callable, *args) -> Callable:
    """``f`` with its first arguments, for ``mapInArrow``; the worker gives memory back when the task ends."""
    return partial(_tidied, partial(f, *args))


def one_per_task(df: DataFrame, n: int) -> DataFrame:
    """Few rows that each stand for much work (files), dealt out evenly."""
    return df.repartition(max(1, n))
