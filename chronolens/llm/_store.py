"""Shared folders and staged tables.

Intermediate tables are written below the folder that the cluster names in
``spark.checkpoint.dir``, which every executor and the driver can reach.  Only in
local mode a folder of this process is used where that setting is absent; on a
cluster its absence is an error.  What a process has left there when it ends is
removed.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode without any."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="chronolens-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


#: Bytes of rows that go to a Python worker at once; by default Spark counts rows only.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session has a bound: 10,000 long
    texts in one batch would outgrow an executor."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


_paths: set[str] = set()


def _clear(spark: SparkSession) -> None:
    """At the end of the process: a session that has gone already can delete nothing."""
    with contextlib.suppress(Exception):
        remove(spark, list(_paths))


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_clear, spark)
    _paths.add(path)
    made = _scope.get()
    if made is not None:
        made.append(path)
    return path


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Lists the paths made inside the block, so that they can be removed."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(token)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes staged tables that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _paths.discard(p)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: what follows depends on replicated files, not on
    shuffle blocks of executors that may be lost.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = w
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
