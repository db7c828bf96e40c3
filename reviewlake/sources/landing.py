"""A landing table: rows by key in buckets of one folder, the last write of a key wins, replayed offline."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialise

#: Folders of a table. A bucket is what one write replaces, so it should hold some hundred MB: raise the number with the table.
BUCKETS = 64


def request_key(request: F.Column) -> F.Column:
    return F.sha2(request.cast("binary"), 256)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where nothing has landed yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def land(batch: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Put a batch into the table: of all rows of a key, landed and new, the one that is greatest by `order` stays.

    Only buckets that the batch has rows for are read and replaced, each as a whole, so readers see a bucket before or after a write.
    The merged rows are written aside first; a batch that is landed again, or a write that is done anew, gives the same table.
    Files are as many as buckets, not as keys. A table keeps the number of buckets that it began with.
    """
    spark = batch.sparkSession
    rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    held = read(spark, path)
    if held is not None:
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # `buckets` numbers at most
        rows = held.filter(F.col("bucket").isin(touched)).select(*rows.columns).unionByName(rows)
    last = F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")
    merged = materialise(rows.groupBy("bucket", *[F.col(k).alias(f"_{k}") for k in keys]).agg(last).select("r.*", "bucket"), "landing")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def replay(requests: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """requests with the landed columns, and error: `never landed` for those of which nothing has. Meets the table by bucket and key, so
    buckets that no request needs aren't read."""
    asked = requests.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    held = read(requests.sparkSession, path)
    if held is None:
        return requests.withColumn("error", F.lit("never landed"))
    found = held.withColumn("_found", F.lit(True))
    return asked.join(found, ["bucket", *keys], "left").withColumn("error", F.when(F.col("_found").isNull(), "never landed")).drop("bucket", "_found")


def write_bundles(bundles: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Put bundles (pr, head, fetched_at, ...) under path/heads, one for each head, and under path/latest, one for each change."""
    land(bundles, f"{path}/heads", ["pr", "head"], ["fetched_at"], buckets)
    land(bundles, f"{path}/latest", ["pr"], ["fetched_at", "head"], buckets)
