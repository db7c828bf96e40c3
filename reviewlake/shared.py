"""Tables and checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; checkpoints go there too. Where it is unset, a local session gets a temporary folder, and a
    cluster an error, as its nodes share no such folder."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and go on from the files, so that a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int | None = None, key: str = "pr") -> DataFrame:
    """df, written once to the shared folder in buckets of the key, sorted, one file each. Tables of one number of buckets join and group by
    the key without another shuffle. The number is that of the session's shuffle partitions, unless given."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def checkpointed(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
