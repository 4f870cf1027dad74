"""Tables that outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

class Scope:
    """Names of the tables staged while it is open, and those to keep."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.kept: list[DataFrame] = []

    def keep(self, *tables: DataFrame | None) -> None:
        self.kept += [t for t in tables if t is not None]


_local: dict[str, str] = {}  # application -> folder, where none is named
_marked: set[str] = set()
_open: list[Scope] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Without that setting, a session on one machine gets a temporary folder; on a cluster that is an
    error, as executors would write to their own disks."""
    root, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="eventweave-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        root = "file://" + _local[app]
    return root.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts its lineage; unlike a localCheckpoint, it outlives lost executors.

    An application's tables are in a folder of its own, which goes when its driver ends."""
    spark = df.sparkSession
    folder = _folder(spark)
    name = uuid.uuid4().hex
    path = f"{folder}/{name}"
    df.write.parquet(path)
    if _open:
        _open[-1].names.append(name)
    if folder not in _marked:
        _marked.add(folder)
        files, where = _files(spark, folder)
        files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def unstaged(*tables: DataFrame | None) -> None:
    """Deletes staged tables that no plan reads any more; tables read from elsewhere stay."""
    for df in tables:
        if df is not None:
            for name in _names(df):
                _delete(df.sparkSession, name)


@contextlib.contextmanager
def only_kept(spark: SparkSession) -> Iterator[Scope]:
    """What is staged inside goes at the end, but for what the tables given to keep() read; after an error it stays until the driver ends."""
    scope = Scope()
    _open.append(scope)
    try:
        yield scope
    finally:
        _open.remove(scope)
    held = {name for t in scope.kept for name in _names(t)}
    for name in scope.names:
        if name not in held:
            _delete(spark, name)
        elif _open:
            _open[-1].names.append(name)


def if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it has been counted to at most most_rows rows.

    Else df as it is: the join is then a shuffle join, which AQE splits where it is skewed."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def _folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/staged/{spark.sparkContext.applicationId}"


def _names(df: DataFrame) -> set[str]:
    """Names of the staged tables that df reads."""
    mark = f"/staged/{df.sparkSession.sparkContext.applicationId}/"
    return {f.partition(mark)[2].partition("/")[0] for f in df.inputFiles() if mark in f}


def _delete(spark: SparkSession, name: str) -> None:
    files, where = _files(spark, f"{_folder(spark)}/{name}")
    files.delete(where, True)


def _files(spark: SparkSession, folder: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
