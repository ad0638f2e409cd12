"""Tables that must outlive an executor: they go to the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests); on a cluster an error,
    for executors would write to folders that nobody else sees."""
    named = spark.conf.get(_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"{_CONF} must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="quillmark-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/quillmark/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a path; a session that has already stopped leaves it to its owner."""
    context = spark.sparkContext
    if getattr(context, "_jsc", None) is None:
        return
    try:
        hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM is going down
        return


#: Bytes of an Arrow batch of texts; Spark's own bound of 64 MB holds for each task twice over, in the JVM and in Python.
BATCH_BYTES = 1 << 20

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; batches of its session's texts are kept to BATCH_BYTES from now on, whatever the texts' lengths."""
    df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.quillmark_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` made, as soon as nothing will be read from them again."""
    for table in tables:
        _delete(table.sparkSession, table.quillmark_path)
