"""Incremental mode: a stream of listing files against the seen-set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.filters import normalise_listings, with_identity
from ..operators.store import new_listings


def run_available(spark: SparkSession, source: str, schema: StructType, seen_path: str, checkpoint: str, order: str = "ord") -> None:
    """Take what is new in ``source`` into the seen table; returns when all is taken.

    Each micro-batch appends the first listing of every fingerprint the table lacks. A
    batch that is replayed after a failure finds its rows in the table and appends none.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        # A file source watches folders: a single file is its folder with a name filter.
        stream = reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    else:
        stream = reader.parquet(source)

    def take(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        listings = with_identity(normalise_listings(batch))
        fresh = new_listings(listings, _seen(s, seen_path, listings.select("fingerprint").schema), order)
        fresh.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(seen_path)

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _seen(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.parquet(path).select("fingerprint")
    except Exception as error:  # the table is not there before the first batch
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return spark.createDataFrame([], schema)
        raise
