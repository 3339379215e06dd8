"""Tables that outlive executors.

``durable`` writes a DataFrame as Parquet to the shared folder named by
``spark.checkpoint.dir`` and reads it back, which cuts its lineage; ``release``
deletes one that nothing needs any more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one where none is set, which only local mode allows."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            found = made.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillstack-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/quillstack-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what durable() wrote; nothing may read these tables afterwards."""
    for df in tables:
        path = getattr(df, "_durable_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(hadoop).delete(target, True)
