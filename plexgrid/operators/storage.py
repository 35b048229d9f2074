"""Cutting lineage through the folder that all machines share, and order without one big window."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that a result still reads; they go when the session's Python process ends.
_kept: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from ``spark.checkpoint.dir``.

    In local mode, where one machine does everything, a folder is made if the
    setting is absent; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="plexgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete_folders(paths: list[str]) -> None:
    """Delete folders through the file system that each belongs to; what is gone already is no error."""
    from pyspark import SparkContext

    jvm, active = SparkContext._jvm, SparkContext._active_spark_context
    if jvm is None:
        return
    conf = active._jsc.hadoopConfiguration() if active is not None and active._jsc is not None else jvm.org.apache.hadoop.conf.Configuration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def keep_till_exit(path: str) -> None:
    """Delete a folder when the session's Python process ends."""
    if not _kept:
        atexit.register(_at_exit)
    _kept.append(path)


def _at_exit() -> None:
    try:
        delete_folders(_kept)
    except Exception:  # noqa: BLE001 - the session may be gone, with its file systems
        pass


def local_path(spark: SparkSession, path: str) -> str | None:
    """Where ``path`` lies among the machine's own files; None if it is on another file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.makeQualified(found).toUri().getPath() if system.getUri().getScheme() == "file" else None


#: Rows and bytes that a worker holds before it writes them as one row group.
GROUP_ROWS, GROUP_BYTES = 1 << 16, 4 << 20


def write_by_workers(df: DataFrame, folder: str, through: Callable | None = None) -> None:
    """Parquet files of ``df`` in a folder of the machines' own files, a file a task, written by the Python workers.

    Hadoop starts three ``chmod`` processes a task for what it writes there;
    this starts none. ``through`` is a function of Arrow batches that the rows
    go through first, in the same worker. A file gets its name when it is whole,
    and those of tasks that didn't count are removed.
    """
    rows_most, bytes_most = GROUP_ROWS, GROUP_BYTES

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        import pyarrow.parquet as pq

        name = f"part-{uuid.uuid4().hex}.parquet"
        out, held, rows, size = None, [], 0, 0
        try:
            for b in through(batches) if through else batches:
                if not b.num_rows:
                    continue
                out = out or pq.ParquetWriter(f"{folder}/_{name}", b.schema)
                held.append(b)
                rows, size = rows + b.num_rows, size + b.nbytes
                if rows >= rows_most or size >= bytes_most:
                    out.write_table(pa.Table.from_batches(held))
                    held, rows, size = [], 0, 0
            if held:
                out.write_table(pa.Table.from_batches(held))
        finally:
            if out:
                out.close()
        if out:
            os.rename(f"{folder}/_{name}", f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    os.makedirs(folder)
    counted = {r["name"] for r in df.mapInArrow(put, "name string").collect()}
    for name in set(os.listdir(folder)) - counted:
        os.remove(f"{folder}/{name}")


class Scratch:
    """Tables that one run of an operator writes to the shared folder.

    Each ``written`` table cuts lineage, so a lost executor costs no
    recomputation of earlier steps. On leaving the ``with`` block all of them
    are deleted, but for those that ``keep`` named because the operator's result
    still reads them; these go when the session's process ends. With
    ``by_workers``, tables on the machines' own file system are written by the
    Python workers, for which their types must be known to Arrow.
    """

    def __init__(self, spark: SparkSession, name: str, by_workers: bool = False):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.local = local_path(spark, self.root) if by_workers else None
        self.made: dict[str, DataFrame] = {}
        self.kept: set[str] = set()
        self.count = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, error, trace) -> None:
        keep = set() if kind else self.kept
        delete_folders([p for p in self.made if p not in keep])
        for p in keep:
            keep_till_exit(p)

    def written(self, df: DataFrame, name: str, through: Callable | None = None, schema: str | None = None) -> DataFrame:
        """``df`` written and read again; with ``through``, what that function of Arrow batches makes of it, in ``schema``."""
        self.count += 1
        path = f"{self.root}/{name}-{self.count}"
        made = df.mapInArrow(through, schema) if through else df
        if self.local:
            write_by_workers(df, f"{self.local}/{name}-{self.count}", through)
        else:
            made.write.parquet(path)
        back = self.spark.read.schema(made.schema).parquet(path)
        self.made[path] = back
        return back

    def keep(self, *tables: DataFrame) -> None:
        self.kept |= {p for p, t in self.made.items() if any(t is k for k in tables)}

    def drop(self, table: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        for p in [p for p, t in self.made.items() if t is table]:
            delete_folders([p])
            del self.made[p]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again; it stays until the session's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep_till_exit(path)
    return spark.read.schema(df.schema).parquet(path)


def _dealt(df: DataFrame, order: list[str], n: int, name: str) -> DataFrame:
    """``df`` in order over partitions, written with ``_at``, which holds the partition above 33 bits of row number.

    Rows equal in ``order`` are dealt by a hash of the whole row, so many of
    them don't meet in one task.
    """
    ties = F.xxhash64(*df.columns)
    return written(df.repartitionByRange(n, *order, ties).sortWithinPartitions(*order, ties).withColumn("_at", F.monotonically_increasing_id()), name)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordinals(df: DataFrame, order: list[str], out: str = "new_ord", partitions: int | None = None) -> DataFrame:
    """``df`` numbered from 0 in the given order without bringing all rows into one task.

    Rows are dealt out by range, numbered in their partition, written once (a
    second evaluation could draw other ranges), and shifted by the sizes of the
    partitions before. The order of rows equal in ``order`` is that of a hash.
    """
    dealt = _dealt(df, order, partitions or _partitions(df), "ordinals")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part").withColumn(out, (row + F.col("_before")).cast("long")).drop("_part", "_at", "_before")


def quantiles(df: DataFrame, value: str, q: float, by: list[str] | None = None, out: str = "q") -> DataFrame:
    """(by, out): the exact quantile, between two values in proportion; nulls are left out.

    Equal values are counted first, so what is put in order are the distinct
    ones, over all tasks: neither a value that most rows hold nor a group's
    distinct values have to fit in one task.
    """
    by = by or []
    each = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = _dealt(each, [*by, "_v"], _partitions(df), "quantiles")
    part = F.shiftright("_at", 33)
    upto = dealt.withColumn("_part", part).withColumn("_upto", F.sum("_n").over(Window.partitionBy("_part").orderBy("_at")))
    sizes = dealt.groupBy(part.alias("_part")).agg(F.sum("_n").alias("_m"))  # a row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    o = upto.join(F.broadcast(before), "_part").select(*by, "_v", "_n", (F.col("_before") + F.col("_upto") - F.col("_n")).alias("_from"))
    ends = o.groupBy(*by).agg(F.min("_from").alias("_s"), F.sum("_n").alias("_all"))
    at = o.join(ends, by) if by else o.crossJoin(F.broadcast(ends))  # without groups, one row
    at = at.withColumns({"_t": F.lit(q) * (F.col("_all") - 1), "_k": F.col("_from") - F.col("_s")})
    holds = lambda k: (F.col("_k") <= k) & (k < F.col("_k") + F.col("_n"))
    two = at.where(holds(F.floor("_t")) | holds(F.ceil("_t")))
    share = F.first(F.col("_t") - F.floor("_t"))
    return two.groupBy(*by).agg((F.min("_v") * (1 - share) + F.max("_v") * share).alias(out))
