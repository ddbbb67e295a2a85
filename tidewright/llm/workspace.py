"""Where operators keep intermediate tables, and how they cut lineage.

A cluster names a folder that all its machines share in ``spark.checkpoint.dir``.
Operators write intermediate tables there with Spark's own writers (so a lost
executor only costs a task retry) and read them back. Only where the setting is
absent and the master is local, as in tests, a folder of this process is
created; on a cluster without the setting operators raise.

Tables written inside a :class:`Scratch` block go when the block ends, but for
those that are kept; the shuffle files of a write go with the write.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_MEMOS: dict[str, Callable[[], None]] = {}


def hold(name: str, clear: Callable[[], None] | None = None) -> None:
    """Say which operator a Python worker now runs; other operators' memos are dropped.

    Workers outlive tasks, so without this a pipeline's memos would add up.
    """
    for other in [k for k in _MEMOS if k != name]:
        _MEMOS.pop(other)()
    if clear:
        _MEMOS[name] = clear


def _remove_own() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_remove_own)


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; made once where the session names none."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    own = tempfile.mkdtemp(prefix="tidewright-")
    _OWN.append(own)
    spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        _OWN.append(parsed.path)
    return path


class Scratch:
    """Deletes the tables written in its block when the block ends; blocks nest."""

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def keep(self, *tables: DataFrame) -> None:
        """Leave tables of this block to the block around it, if any."""
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            table = self.paths.pop(path)
            if len(Scratch._open) > 1:
                Scratch._open[-2].paths[path] = table

    def __exit__(self, *error: object) -> None:
        Scratch._open.remove(self)
        remove(self.spark, self.paths)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders on any file system."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for the executions inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession):
    """Executions inside drop their shuffle files at their end; none of them is run twice."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, size: str = "2m"):
    """Arrow batches that executions inside send to Python workers hold about ``size`` or one row."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    with shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if Scratch._open:
        Scratch._open[-1].paths[path] = table
    return table
