"""Sessions, and tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "loomgraph", **conf: str) -> SparkSession:
    """A session with adaptive execution; whatever the cluster sets stays."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a session without it, on one machine, gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(spark, "_loomgraph_scratch"):
        spark._loomgraph_scratch = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, spark._loomgraph_scratch, ignore_errors=True)
    return f"file://{spark._loomgraph_scratch}"


#: Rows a file of a small table holds, where the table's size is known beforehand.
FILE_ROWS = 250_000


def stash(df: DataFrame, name: str, at_most: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    With at_most rows known, a small table goes to few files: its rows are dealt anew once they
    are made, so that making them keeps its full width. clear_scratch() deletes it with all others.
    """
    return _written(df, name, at_most)[1]


def _written(df: DataFrame, name: str, at_most: int | None, plain: bool = False) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if at_most is not None:
        df = df.repartition(max(1, -(-at_most // FILE_ROWS)))
    writer = df.write.option("parquet.enable.dictionary", "false").option("compression", "none") if plain else df.write
    writer.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession) -> str:
    """Where this application keeps what it writes on its way; clear_scratch() deletes it."""
    return f"{scratch_root(spark)}/loomgraph/{spark.sparkContext.applicationId}"


def bucketed(df: DataFrame, by: str, n: int, name: str, *order: str, dealt: bool = False) -> tuple[str, DataFrame]:
    """df as a table of n buckets by a column, one file each, and its name: joins and groups by that column do not move it. DROP TABLE forgets it, clear_scratch() deletes its files.

    dealt: each bucket's rows are in one task already.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(n, by)).write.bucketBy(n, by).sortBy(by, *order).option("path", f"{own_folder(spark)}/{table}").saveAsTable(table)
    return table, spark.table(table)


def discard(spark: SparkSession, table: str) -> None:
    """Forget a bucketed() table and delete its files: nothing reads it any more."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    _delete(spark, f"{own_folder(spark)}/{table}")


def files_of(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    at, files = files_of(spark, path)
    files.delete(at, True)


def publish(spark: SparkSession, whole: str, final: str) -> bool:
    """Give a folder that is written whole its final name, at once; False, and the folder goes, if something has that name already."""
    source, files = files_of(spark, whole)
    to, _ = files_of(spark, final)
    files.mkdirs(to.getParent())
    done = not files.exists(to) and files.rename(source, to)
    # Of two renames at the same time, the later one lands inside the folder of the first.
    inside, _ = files_of(spark, f"{final}/{source.getName()}")
    if done and files.exists(inside):
        files.delete(inside, True)
        done = False
    files.delete(source, True)
    return done


#: What is told that a session's tables are gone.
_listeners: list[Callable[[SparkSession], None]] = []


def when_cleared(f: Callable[[SparkSession], None]) -> Callable[[SparkSession], None]:
    _listeners.append(f)
    return f


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that this session has written on its way; results not yet read are lost with them."""
    _delete(spark, own_folder(spark))
    for f in _listeners:
        f(spark)


class Steps:
    """Tables that an operator writes on its way to its result, deleted when it is done. What a result reads later must be a stash() of its own."""

    def __init__(self, spark: SparkSession):
        self.spark, self._tables = spark, []

    def __enter__(self) -> Steps:
        return self

    def written(self, df: DataFrame, name: str, at_most: int | None = None, plain: bool = False) -> DataFrame:
        """df as a table; plain for hashes, which no dictionary or compression makes smaller."""
        path, out = _written(df, name, at_most, plain)
        self._tables.append((path, out))
        return out

    def drop(self, table: DataFrame) -> None:
        """Delete one of them now: nothing reads it any more."""
        for path, own in self._tables:
            if own is table:
                _delete(self.spark, path)

    def __exit__(self, *_) -> None:
        for path, _ in self._tables:
            _delete(self.spark, path)
