"""Reports as a stream of files: new Word files are parsed once, and the block table takes each report's latest blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.sources import docx


def arriving(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    return (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,doc}").option("maxFilesPerTrigger", most_files).load(path)
    )


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Start the query. A batch writes its own folder, named by batch, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        docx.blocks(batch.select("path", "content")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return arriving(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """Blocks of each report's last batch."""
    rows = spark.read.parquet(target)
    last = rows.groupBy("report_id").agg(F.max("batch").alias("b2")).withColumnRenamed("report_id", "r2")
    return rows.join(last, (F.col("report_id") == F.col("r2")) & (F.col("batch") == F.col("b2"))).drop("r2", "b2", "batch")
