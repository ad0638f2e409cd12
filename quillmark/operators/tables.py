"""Index tables that queries share: made once for an application and a source, kept in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str, str], str] = {}
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """That of spark.checkpoint.dir; in local mode a temporary one where none is set; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quillmark-"))


def _changed(spark: SparkSession, source: str) -> str:
    """When a source was last written, as its file system tells it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    return str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime())


def stored(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` over a source, from ``make`` the first time; made again if the source was written since."""
    key = (spark.sparkContext.applicationId, f"{source} {_changed(spark, source)}", name)
    if key not in _made:
        path = f"{shared_folder(spark)}/quillmark/{name}-{abs(hash(key)):x}"
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)  # words stand there several times over
        _made[key] = path
    return spark.read.parquet(_made[key])


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, unless the session has stopped."""
    context = spark.sparkContext
    if getattr(context, "_jsc", None) is not None:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables that end the lineage of a job's steps, in the folder that the cluster shares: written once, read by what follows.

    Used as a context: its tables are deleted when it ends, whether the job succeeds or not; those that were ``kept`` stay
    until the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.count = spark, 0
        self.path = f"{shared_folder(spark)}/quillmark/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        _delete(self.spark, self.path)

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        return self._written(df, f"{self.path}/{self.count}")

    def kept(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}-kept"
        atexit.register(_delete, self.spark, path)
        return self._written(df, path)
