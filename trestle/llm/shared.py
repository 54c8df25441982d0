"""Helpers shared by the corpus operators: tables, cut points, nesting."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: spark.checkpoint.dir; where it is unset, one beside the warehouse, shared too."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-trestle").rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trestle_path = path
    return out


def bucketed(df: DataFrame, column: str, label: str, buckets: int | None = None, compression: str = "zstd", *parts: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``column`` (inside folders by ``parts``): groups of it need no
    further shuffle."""
    spark = df.sparkSession
    name, path = f"trestle_{label}_{uuid.uuid4().hex}".replace("-", "_"), fresh_path(spark, label)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.partitionBy(*parts).bucketBy(n, column).option("path", path).option("compression", compression).saveAsTable(name)
    out = spark.table(name)
    out._trestle_path, out._trestle_name = path, name
    return out


def forget(*tables: DataFrame | None) -> None:
    """Remove tables written by :func:`cut` or :func:`bucketed` that nothing reads any more."""
    for df in tables:
        path, name = getattr(df, "_trestle_path", None), getattr(df, "_trestle_name", None)
        if name is not None:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path is not None:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs: it does so once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def nested(docs: DataFrame) -> DataFrame:
    """The whole row as one struct ``d``, so that no column of the input can clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; no words for null or blank text."""
    bare = F.btrim(text, F.lit(SPACE))
    empty = F.array().cast("array<string>")
    return F.when(F.length(bare) > 0, F.split(bare, "[\\x20\\x09-\\x0D]+")).otherwise(empty)
