"""Where intermediate tables live.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, the folder the
cluster names as shared by the driver and the executors.  Only a local session
without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this application."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="mergeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/mergeloom-{spark.sparkContext.applicationId}"


def trim_driver(spark: SparkSession) -> bool:
    """Give the native memory that the driver's JVM has freed back to the system; whether it can.

    The C library keeps what Spark's many threads free, each in an arena of its
    own.  A JVM without System.trim_native_heap goes on as it is.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        kinds = gateway.new_array(jvm.java.lang.Class, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(kind)
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)  # the server's own class is not exported
        values = gateway.new_array(jvm.java.lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe from the loss of any executor."""
    path = new_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    trim_driver(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(table: DataFrame) -> None:
    """Delete a table that written() gave, once nothing will read it any more."""
    remove(table.sparkSession, table.written_to)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_path() named."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def clear(spark: SparkSession) -> None:
    """Delete this application's scratch tables."""
    remove(spark, shared_dir(spark))
