"""Session helpers shared by all operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and the master is
    local (tests on one machine) a temporary folder is made, once per session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shelfmark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stash(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage with a table that outlives a lost executor, and what is
    read several times is computed once. ``partition_by`` gives each value of a column its folder, so that a
    filter on it reads those files alone; the column then comes last.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._stash_path = path
    return held


def forget(held: DataFrame) -> None:
    """Delete what ``stash`` wrote, once nothing reads it any more; a table that it didn't return stays."""
    if path := getattr(held, "_stash_path", None):
        context = held.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def release() -> None:
    """Give memory that this Python process has freed back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more; it does so once the driver collects garbage, by itself every half hour.

    The driver also gives back what Python and Java have freed outside the heap: a job of many small stages leaves hundreds of MB there.
    """
    release()
    spark.sparkContext._jvm.System.gc()
    with suppress(Py4JError):  # a virtual machine older than Java 17.0.9 can't
        _trim(spark)


def _trim(spark: SparkSession) -> None:
    """What ``jcmd System.trim_native_heap`` does, for the driver."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds, given = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
    for at, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[at] = jvm.java.lang.Class.forName(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(server, given)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bounds of the Arrow batches between Spark and Python, so that a task's memory doesn't depend on its rows' lengths.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and bound the session's Arrow batches."""
    import shutil
    from pathlib import Path

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    context = spark.sparkContext
    if getattr(context, "_shelfmark_shipped", False):
        return
    here = Path(__file__).resolve().parent
    place = Path(tempfile.mkdtemp(prefix="spark-ship-"))
    shutil.copytree(here, place / "tree" / here.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(place / here.name), "zip", place / "tree"))
    context._shelfmark_shipped = True
