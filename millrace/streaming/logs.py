"""Job logs as streams: resumed runs, deduplicated appends, windows over event time."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def follow(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New JSON lines in a folder; half-written lines become rows of nulls."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def append_new(stream: DataFrame, target: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Append jobs that target does not have yet, the first record of each by order, and stop when all is read.

    A batch has a folder of its own, written over when the batch is run again, so a batch that failed half-way or was
    committed but not noted leaves no job twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spot = F.row_number().over(W.partitionBy(key).orderBy(order))
        fresh = batch.where(F.col(key).isNotNull()).withColumn("__n", spot).where("__n = 1").drop("__n")
        if number:
            done = spark.read.schema(StructType([*batch.schema.fields, StructField("batch", LongType())])).parquet(target)
            fresh = fresh.join(done.where(F.col("batch") < number).select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: Column, width: str, late: str) -> DataFrame:
    """Counts in tumbling windows; a stream forgets windows older than its latest time less late."""
    timed = events.withColumn("__t", F.col(time))
    if events.isStreaming:
        timed = timed.withWatermark("__t", late)
    per = timed.groupBy(F.window("__t", width).alias("w"), by.alias("by")).agg(F.count("*").alias("n"))
    return per.select(F.col("w.start").alias("start"), "by", "n")
