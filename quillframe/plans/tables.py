"""Written tables in the folder that the cluster shares; they cut lineage and outlive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the cluster names no shared folder and all tasks run in the driver's process, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Keys are hot that hold more than one in so many rows; there are fewer than that.
HOT_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or LOCAL_CHECKPOINTS


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quillframe/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table made by written()."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def lookup(left: DataFrame, right: DataFrame, key: str, total: int, rows: str = "rows") -> DataFrame:
    """left joined with right, which has one row for each key and the number of left's rows with it; total is left's number of rows.

    Hot keys, fewer than HOT_KEYS, are broadcast, so that no task gets all the rows of one; the others meet by a shuffle.
    """
    hot = F.broadcast(right.filter(F.col(rows) * HOT_KEYS > total).drop(rows))
    cold = right.filter(F.col(rows) * HOT_KEYS <= total).drop(rows)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches handed to Python by rows and bytes, so that long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def spread(df: DataFrame) -> DataFrame:
    """df in as many parts as a shuffle has, if it comes in fewer (a few small files); else as it is."""
    n = parallelism(df.sparkSession)
    return df.repartition(n) if not df.isStreaming and df.rdd.getNumPartitions() < n else df


def keyed(df: DataFrame, key: str = "artifact_id") -> DataFrame:
    """df dealt out by its key before rows are taken apart, so that groupings by the key and more don't shuffle the parts."""
    return df.repartition(max(parallelism(df.sparkSession), 0 if df.isStreaming else df.rdd.getNumPartitions()), key)


def sums_before(df: DataFrame, keys: list[str], order: list[str], **sums: str) -> DataFrame:
    """df with the sum of columns (out=column) over the rows of the same keys that come before in order; rows equal in order come in any.

    Rows are dealt out by ranges, so that a hot key is in many parts: sums run within a part and are offset by those of the parts before.
    """
    marks = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    dealt = df.repartitionByRange(parallelism(df.sparkSession), *keys, *order).withColumn("__part", F.spark_partition_id())
    rows = written(dealt.withColumn("__of", F.xxhash64(F.lit(0), *marks)), "ranges")
    totals = rows.groupBy("__of", "__part").agg(*[F.sum(c).alias(f"__{out}") for out, c in sums.items()])
    ahead = Window.partitionBy("__of").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__of", "__part", *[F.coalesce(F.sum(f"__{out}").over(ahead), F.lit(0)).alias(f"__{out}") for out in sums])
    within = Window.partitionBy("__of", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumns({out: F.coalesce(F.sum(c).over(within), F.lit(0)) for out, c in sums.items()}).join(offsets, ["__of", "__part"])
    return run.withColumns({out: F.col(out) + F.col(f"__{out}") for out in sums}).drop("__of", "__part", *[f"__{out}" for out in sums])
