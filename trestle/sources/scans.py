"""Scans of report files: archives, folders, parse caches, earlier results."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trestle.functions.text import SPLIT_MARKERS, matches_split
from trestle.operators.schema import record_error

REPORTS = (
    "report_id string, file_name string, extension string, source_metadata map<string,string>, blocks array<struct<source_id:string,text:string,"
    "kind:string,table_index:int,row_index:int,page:int,cells:array<string>>>"
)


def _in_split(name: str, split: str) -> bool:
    path = "/" + name.replace("\\", "/")
    if split not in SPLIT_MARKERS:
        return True
    return SPLIT_MARKERS[split] in path and not (split == "train" and SPLIT_MARKERS["labels"] in path)


#: File names that may be broadcast.
MOST_BROADCAST = 100_000


class _Entries(InputPartition):
    def __init__(self, names: list[tuple[int, str]]):
        self.names = names


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.split = options["path"], options.get("split", "")
        self.limit, self.n = int(options.get("limit", 0)), int(options.get("numPartitions", 8))
        self.names_only = "content" not in schema.fieldNames()

    def partitions(self):
        """The archive's listing alone decides: suffix, split and limit, before any entry is read."""
        with zipfile.ZipFile(self.path) as z:
            names = sorted(i.filename for i in z.infolist() if not i.is_dir())
        names = [n for n in names if n.lower().endswith((".docx", ".doc")) and _in_split(n, self.split)]
        rows = list(enumerate(names[: self.limit or None]))
        size = max(1, -(-len(rows) // self.n))
        return [_Entries(rows[k : k + size]) for k in range(0, len(rows), size)] or [_Entries([])]

    def read(self, partition):
        if self.names_only:
            yield from ((k, name) for k, name in partition.names)
            return
        with zipfile.ZipFile(self.path) as z:
            for k, name in partition.names:
                yield k, name, z.read(name)


class ReportArchive(DataSource):
    """``spark.read.format("report_archive").option("split", ...).load(zip)``; a schema without content reads names only."""

    @classmethod
    def name(cls) -> str:
        return "report_archive"

    def schema(self) -> str:
        return "position long, path string, content binary"

    def reader(self, schema):
        return _ArchiveReader(self.options, schema)


def archive(spark: SparkSession, path: str, split: str = "", limit: int = 0, names_only: bool = False) -> DataFrame:
    spark.dataSource.register(ReportArchive)
    reader = spark.read.format("report_archive").option("split", split).option("limit", limit)
    return (reader.schema("position long, path string") if names_only else reader).load(path)


def folder(spark: SparkSession, path: str, split: str = "", limit: int = 0) -> DataFrame:
    """Word files under a folder in any store that Spark reads, any case of suffix; ``after``, ``path`` order them: all
    .docx before all .doc. ``limit`` cuts by that order, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[dD][oO][cC]{,[xX]}").load(path)
    files = files.filter(matches_split(F.col("path"), split)).withColumn("after", F.lower("path").endswith(".doc").cast("int"))
    if limit:
        first = files.select("after", "path").orderBy("after", "path").limit(limit).select("path")
        files = files.join(F.broadcast(first) if limit <= MOST_BROADCAST else first, "path", "left_semi")
    return files.select("after", "path", "content")


def zipped(spark: SparkSession, path: str, split: str = "") -> DataFrame:
    """Word files (``position``, ``path``, ``content``) of archives in any store that Spark reads: each archive's bytes
    are opened by one task. :func:`archive` splits one large local archive among tasks instead."""

    def each(batches):
        for batch in batches:
            for data in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = sorted(i.filename for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith((".docx", ".doc")))
                    for k, name in enumerate(n for n in names if _in_split(n, split)):
                        yield pd.DataFrame({"position": [k], "path": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(each, "position long, path string, content binary")


def result_files(names: DataFrame) -> DataFrame:
    """Result documents among file names (``path``), without the stale ones of an older naming."""
    return names.filter(F.lower("path").endswith(".docx") & ~F.col("path").endswith("_结果.docx"))


def upload(spark: SparkSession, name: str, data: bytes) -> DataFrame:
    return spark.createDataFrame([(name, data)], "path string, content binary")


def parse_cache(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Cached reports. A file whose top level is no list is an error. Lenient: absent extension is .docx, absent blocks
    are none; strict: both are required."""
    whole = spark.read.option("wholetext", True).text(path)
    if whole.filter(~F.col("value").rlike(r"^\s*\[")).limit(1).count():
        raise ValueError("a parse cache holds a list of reports")
    rows = spark.read.schema(REPORTS).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    if strict:
        lack = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c))
        return rows.withColumns({"extension": lack("extension"), "blocks": lack("blocks")})
    return rows.withColumns({"extension": F.coalesce("extension", F.lit(".docx")), "blocks": F.coalesce("blocks", F.array().cast(rows.schema["blocks"].dataType))})


def write_cache(blocks: DataFrame, path: str) -> None:
    """Parsed blocks as a cache: a report per JSON line, blocks in order; replaced as a whole."""
    one = F.struct("block_pos", F.struct("source_id", "text", "kind", "table_index", "row_index", "page", "cells").alias("b"))
    rows = blocks.filter("source_id is not null").groupBy("report_id", "file_name", "extension").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["b"]).alias("blocks"))
    rows.write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_cache` wrote, a report per row."""
    return spark.read.schema(REPORTS).json(path)


def cached_blocks(reports: DataFrame) -> DataFrame:
    each = reports.select("report_id", "file_name", F.posexplode("blocks").alias("block_pos", "b"))
    return each.select("report_id", "file_name", F.col("block_pos").cast("long").alias("block_pos"), "b.*")


def prediction_records(spark: SparkSession, path: str, record_schema: str) -> DataFrame:
    payload = spark.read.schema(f"split string, records array<{record_schema}>").option("multiLine", True).json(path)
    if payload.filter("records is null").limit(1).count():
        raise ValueError("the predictions have no records")
    return payload.select("split", F.posexplode("records").alias("record_pos", "r")).select("split", "record_pos", "r.*")


def resume_records(spark: SparkSession, path: str) -> DataFrame:
    """``report_id``, ``record_pos``, ``record`` (JSON) of an earlier run that may be used again: successes with a valid
    prediction, the last of a report. A missing or broken file has none; a bad record is left out, others stay."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "report_id string, record_pos int, record string")
    payload = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    each = payload.select(F.posexplode(F.try_variant_get("v", "$.records", "array<variant>")).alias("record_pos", "r"))
    text = lambda k: F.try_variant_get("r", f"$.{k}", "string")
    prediction = F.to_json(F.try_variant_get("r", "$.prediction", "variant"))
    rows = each.select(text("report_id").alias("report_id"), text("status").alias("status"), prediction.alias("prediction"), "record_pos", F.to_json("r").alias("record"))
    good = rows.filter("report_id is not null").filter(F.coalesce(record_error(F.col("prediction")), F.lit("")) == "")
    return resumable(good.filter("prediction is not null"), F.col("record_pos")).select("report_id", "record_pos", "record")


def resumable(records: DataFrame, order: Column) -> DataFrame:
    """Successful records with a prediction; the last of a report counts."""
    good = records.filter("status = 'success' and prediction is not null and report_id is not null")
    w = Window.partitionBy("report_id").orderBy(order.desc())
    return good.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def work_list(reports: DataFrame, done: DataFrame, outputs: DataFrame) -> DataFrame:
    """Reports still to do: those without a success whose output file exists (``result``)."""
    reusable = done.join(outputs.select("result"), "result", "left_semi").select("report_id")
    return reports.join(reusable, "report_id", "left_anti")


def reusable_labels(listing: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Listed label files (label_file, crc32) whose cached parse is of this version and these bytes."""
    return listing.join(cache.filter(F.col("parser_version") == version), ["label_file", "crc32"])
