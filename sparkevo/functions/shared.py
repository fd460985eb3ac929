"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that was set; a temporary one where neither is and all runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkevo-"))
            made = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = made.get()
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path under the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/sparkevo-{uuid.uuid4().hex}-{name}"
    store, jpath = _path(spark, path)
    store.deleteOnExit(jpath)
    return path


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a saved table that nothing needs any more."""
    store, jpath = _path(df.sparkSession, df.saved_at)
    store.delete(jpath, True)


def free(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores added as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
