"""Reading tables and finding the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def small_batches(spark: SparkSession) -> None:
    """Batches on their way to Python end at BATCH_BYTES, unless the cluster names another size: rows hold whole texts."""
    if not spark.sparkContext.getConf().contains(BATCH_KEY):
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder named by the cluster. Where none is set, a temporary one, but only if all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/lodestar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, most: int, n: int | None = None) -> DataFrame:
    """At most `most` rows, those with the smallest hash of `key`; n: the number of rows, if known.

    A threshold on the hash first leaves about as many rows as are wanted, so that the cut to `most` sorts a set that
    does not grow with the table.
    """
    n = df.count() if n is None else n
    place = F.xxhash64(key)
    if n > most:
        share = min(1.0, (most + 4 * most**0.5) / n)
        df = df.where(place.bitwiseAND((1 << 52) - 1) < int(share * (1 << 52)))
    return df.orderBy(place.bitwiseAND((1 << 52) - 1), key).limit(most)


def unstage(*frames: DataFrame) -> None:
    """Deletes what staged() wrote, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for name in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
            if folder.getName().startswith("lodestar-"):
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
