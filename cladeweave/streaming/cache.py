"""An incremental metadata cache: new rows are merged as they arrive, the first row of a key stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def grow_cache(arrivals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows of a stream ``sid, ...`` whose accession the cache at ``path`` lacks.

    Batches are idempotent: each has a partition ``batch=k`` of its own, overwritten when the batch is
    repeated, and looks only at batches before it.  Of the rows of a batch with one accession the smallest
    stays, so that it is defined which.  Only accessions are read of the rows that are known.
    """

    def compacted(spark: SparkSession) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=-1")
        return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def merge(batch: DataFrame, number: int) -> None:
        rows = F.min(F.struct(*(c for c in batch.columns if c != "sid"))).alias("r")
        new = batch.groupBy("sid").agg(rows).select("sid", "r.*").select(*batch.columns)
        if number or compacted(batch.sparkSession):
            known = _stored(batch.sparkSession, path, batch.schema).where(F.col("batch") < number)
            new = new.join(known.select("sid"), "sid", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.option("basePath", path)
    return (reader.schema(StructType(schema.fields).add("batch", "long")) if schema is not None else reader).parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).drop("batch")


def compact_cache(spark: SparkSession, path: str, to: str) -> None:
    """Rewrite a cache of many batches as one at another path; a stream goes on there with a new checkpoint."""
    read_cache(spark, path).write.mode("error").parquet(f"{to}/batch=-1")
