"""Session helpers: shipping the package to executors and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch; Spark's default is 64 MB, of which the JVM and the worker of each task hold several copies.
BATCH_BYTES = 2 << 20


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers, once per SparkContext.

    The zip is served by the driver to every executor, so workers need neither
    a shared source folder nor PYTHONPATH.
    """
    sc = spark.sparkContext
    if getattr(sc, "_lexweave_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="lexweave-src-"), "lexweave_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(_ROOT):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lexweave", os.path.relpath(full, _ROOT)))
    sc.addPyFile(target)
    sc._lexweave_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Send Python BATCH_BYTES and a row at most at once, unless the application has set a size itself.

    No row is cut or left out: there are more batches. It holds for the session, as plans run after they are made."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one on a local master; on
    a cluster that is an error, as executors would write to disks of their own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(sc, "_lexweave_scratch", None) or tempfile.mkdtemp(prefix="lexweave-checkpoint-")
        sc._lexweave_scratch = folder
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lexweave/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage durably.

    Tables live as long as a result that reads them may be asked for; release() deletes them."""
    spark = df.sparkSession
    path = f"{_run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables this application has written by materialize(). Frames that read them end here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
