"""The folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only where none is set (tests, one machine) is one made here."""
    conf = spark.sparkContext.getConf()
    if found := spark.conf.get(KEY, None) or conf.get(KEY):
        return found.rstrip("/")
    if found := spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{KEY} is not set: on a cluster the driver and the executors need a folder that they share")
    own = tempfile.mkdtemp(prefix="tessera-shared-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again: lineage ends here, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, in less space: for tables of texts."""
    return written(df, name, compression="zstd")


def dropped(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Lets go of frames that are out of use, so that the cleaner deletes their shuffle files now and not at some later collection."""
    gc.collect()
    spark._jvm.System.gc()
