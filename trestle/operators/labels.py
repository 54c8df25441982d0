"""Label documents as records: summary fields, disease and recommendation rows, detail sections, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trestle.functions.text import comparable, comparable_each, comparable_literal, label_cells
from trestle.operators.evaluation import SUMMARY_FIELDS
from trestle.operators.ordered import SECTION_ENDS, SECTIONS, sections

# Header words of the label tables and the fields they stand for.
SUMMARY_HEADER = "字段"
RECOMMENDATION_COLUMNS = {"建议类别": "category", "建议内容": "content", "病害部位": "location"}
DISEASE_COLUMNS = {
    "病害部位": "location", "病害位置": "location", "病害类型": "disease_type", "病害描述": "description", "描述": "description", "是否新增": "is_new",
    "上一次定检状态": "previous_status", "发展程度": "development",
}
ROWS = "array<struct<row_pos:long,{}>>"
DISEASE_FIELDS, RECOMMENDATION_FIELDS = list(dict.fromkeys(DISEASE_COLUMNS.values())), list(dict.fromkeys(RECOMMENDATION_COLUMNS.values()))


def label_tables(blocks: DataFrame) -> DataFrame:
    """Rows of the tables that a label knows, with the table's ``head`` and ``target`` (summary, diseases or
    recommendations): ``c`` are the cells, ``nc`` the cells as they compare, ``n`` counts rows from 1."""
    rows = blocks.filter("kind = 'table' and table_index is not null").withColumn("c", label_cells(F.col("text"), F.col("cells")))
    w = Window.partitionBy("report_id", "table_index").orderBy(F.coalesce("row_index", F.lit(-1)), "block_pos")
    rows = rows.withColumn("nc", comparable_each(F.col("c"))).withColumns({"head": F.first("nc").over(w), "top": F.first("c").over(w), "n": F.row_number().over(w)})
    has = lambda x: F.array_contains("head", x)
    listed = has(SUMMARY_HEADER)
    target = (
        F.when(listed | F.get("head", 0).isin(*SUMMARY_FIELDS), "summary").when(has("建议类别") & has("建议内容"), "recommendations")
        .when(has("病害类型") & (has("病害部位") | has("病害位置")), "diseases")
    )
    rows = rows.withColumn("target", target).filter("target is not null")
    # a table without a header begins with its first field
    return rows.filter((F.col("n") > 1) | ((F.col("target") == "summary") & ~listed)).select("report_id", "block_pos", "source_id", "target", "head", "top", "c", "nc")


def _field(columns: dict[str, str], field: str) -> Column:
    """The cell under the last header that stands for a field; null where there is none."""
    names = F.array(*[F.lit(h) for h, f in columns.items() if f == field])
    at = F.filter(F.sequence(F.lit(0), F.size("head") - 1), lambda i: F.array_contains(names, F.get("head", i)))
    return F.get("c", F.try_element_at(at, F.lit(-1))).alias(field)


def parse_labels(blocks: DataFrame) -> DataFrame:
    """One row per label: ``summary`` (map; the last row of a field counts), ``diseases``, ``recommendations``, the four
    detail lists, and ``warnings`` (rows that don't fit their header; no summary). One aggregation per part."""
    reports = blocks.select("report_id").distinct()
    rows = label_tables(blocks)
    told = rows.filter((F.col("target") == "summary") & (F.size("c") >= 2) & F.get("nc", 0).isin(*SUMMARY_FIELDS))
    told = told.groupBy("report_id", F.get("nc", 0).alias("f")).agg(F.max_by(F.get("c", 1), "block_pos").alias("v"))
    summary = told.groupBy("report_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("f", "v")))).alias("summary"))
    full = rows.filter("target <> 'summary'").filter(F.exists("c", lambda x: x != "") & (F.col("c") != F.col("top")))
    fits = F.size("c") == F.size("head")
    bad = full.filter(~fits).groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("block_pos", F.concat("source_id", F.lit(": column count mismatch")).alias("w")))).alias("bad"))
    out = reports.join(summary, "report_id", "left").join(bad, "report_id", "left")
    for target, columns in (("diseases", DISEASE_COLUMNS), ("recommendations", RECOMMENDATION_COLUMNS)):
        fields = list(dict.fromkeys(columns.values()))
        item = F.struct(F.col("block_pos").alias("row_pos"), *[_field(columns, f) for f in fields])
        some = full.filter(fits & (F.col("target") == target)).groupBy("report_id").agg(F.array_sort(F.collect_list(item)).alias(target))
        kind = ROWS.format(",".join(f"{f}:string" for f in fields))
        out = out.join(some, "report_id", "left").withColumn(target, F.coalesce(target, F.array().cast(kind)))
    title = {comparable_literal(k): v for k, v in SECTIONS.items()}
    para = blocks.filter("kind = 'paragraph'").withColumn("title_", comparable(F.col("text")))
    inside = sections(para, title, [comparable_literal(x) for x in SECTION_ENDS], ["report_id"], "block_pos", F.col("title_"))
    texts = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("block_pos", "text")))), lambda x: x["text"])
    details = inside.groupBy("report_id").agg(*[texts(s).alias(s) for s in SECTIONS.values()])
    out = out.join(details, "report_id", "left")
    none = F.array().cast("array<string>")
    warnings = F.concat(F.coalesce(F.transform("bad", lambda x: x["w"]), none), F.when(F.col("summary").isNull(), F.array(F.lit("No recognized summary table"))).otherwise(none))
    return out.select(
        "report_id", F.coalesce("summary", F.create_map().cast("map<string,string>")).alias("summary"), "diseases", "recommendations",
        *[F.coalesce(s, none).alias(s) for s in SECTIONS.values()], warnings.alias("warnings"),
    )
