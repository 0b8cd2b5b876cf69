"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder of this application's tables, below spark.checkpoint.dir (a local folder only where that is unset)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or getattr(context, "_corpusforge_tables", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        folder = context._corpusforge_tables = "file://" + tempfile.mkdtemp(prefix="corpusforge-")
    return f"{folder.rstrip('/')}/corpusforge/{context.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has saved; for when its results are written, as they may still read them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table of its own and read it back: cuts the lineage, and survives lost executors."""
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
