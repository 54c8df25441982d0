"""Operators that depend on the order of blocks within a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trestle.functions.text import numbered_items, row_cells

# What the report format prescribes.
STATUS = ["是", "否", "新增", "无"]
STATUS_TRUE, STATUS_FALSE = ["是", "新增", "有"], ["否", "非新增", "无"]
CONTEXT_WORDS = ["病害", "检测结论", "评估结论", "维护建议", "建议", "BCI", "评分", "等级", "桥梁概况"]
SECTIONS = {"（1）详细结论": "detailed_conclusion", "病害成因：": "disease_causes", "处置建议：": "disposal_recommendations", "安全影响：": "safety_impacts"}
SECTION_ENDS = ["（2）建议明细", "病害列表", "2、详细信息", "1、简要信息"]


def forward_fill(column: Column, keys: list[str], order: list[str]) -> Column:
    """The last value so far that isn't empty."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.nullif(column, F.lit("")), ignorenulls=True).over(w)


def first_island(rows: DataFrame, hit: Column, keys: list[str], pos: str) -> DataFrame:
    """The first run of rows that hit: those after it are cut, also when they hit."""
    w = Window.partitionBy(*keys)
    found = rows.withColumn("hit_", hit).withColumn("first_", F.min(F.when(F.col("hit_"), F.col(pos))).over(w))
    gap = F.min(F.when(~F.col("hit_") & (F.col(pos) > F.col("first_")), F.col(pos))).over(w)
    kept = found.withColumn("gap_", gap).filter((F.col(pos) >= F.col("first_")) & (F.col("gap_").isNull() | (F.col(pos) < F.col("gap_"))))
    return kept.drop("hit_", "first_", "gap_")


def source_recommendations(blocks: DataFrame) -> DataFrame:
    """Numbered items from the first block with the main marker (else a weaker one) on, up to the first gap."""
    w = Window.partitionBy("report_id")
    strong, weak = F.contains("text", F.lit("处置建议")), F.contains("text", F.lit("建议如下")) | F.contains("text", F.lit("维修建议"))
    start = F.coalesce(F.min(F.when(strong, F.col("block_pos"))).over(w), F.min(F.when(weak, F.col("block_pos"))).over(w))
    after = blocks.withColumn("start_", start).filter(F.col("block_pos") >= F.col("start_")).withColumn("items", numbered_items(F.col("text")))
    island = first_island(after, F.size("items") > 0, ["report_id"], "block_pos")
    ordered = F.array_sort(F.collect_list(F.struct("block_pos", "items")))
    return island.groupBy("report_id").agg(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["items"]))).alias("recommendations"))


def within_budget(rows: DataFrame, keys: list[str], order: list, size: Column, most_rows: int, most_size: int) -> DataFrame:
    """A prefix of each group in ``order``: at most so many rows, cut for good at the first row beyond the size."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum("size_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("rank_") - 1
    ranked = rows.withColumns({"rank_": F.row_number().over(w), "size_": size}).filter(F.col("rank_") <= most_rows)
    over = ranked.withColumn("over_", F.when(before + F.col("size_") > most_size, 1).otherwise(0))
    kept = over.withColumn("cut_", F.max("over_").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("cut_ = 0")
    return kept.withColumnRenamed("rank_", "rank").drop("size_", "over_", "cut_")


def context_pack(blocks: DataFrame, words: list[str] | None = None, most_rows: int = 32, most_size: int = 5000) -> DataFrame:
    """``report_id``, ``context``: blocks with a key word first, then in order, within the budget."""
    words = CONTEXT_WORDS if words is None else words
    key = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("text"), w))
    line = F.concat(F.lit("["), F.col("source_id"), F.lit("] "), F.col("text"))
    rows = blocks.filter(F.length("text") > 0).withColumns({"pri": F.when(key, 0).otherwise(1), "packed": line})
    kept = within_budget(rows, ["report_id"], ["pri", "block_pos"], F.length("packed"), most_rows, most_size)
    lines = F.array_sort(F.collect_list(F.struct("rank", "packed")))
    return kept.groupBy("report_id").agg(F.array_join(F.transform(lines, lambda x: x["packed"]), "\n").alias("context"))


def first_of(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key; null keys are a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def sections(blocks: DataFrame, openers: dict[str, str], ends: list[str], keys: list[str], pos: str, title: Column) -> DataFrame:
    """Rows that stand in an open section, with its name; a title opens, an end title closes, both are left out."""
    opens = F.create_map(*[F.lit(x) for pair in openers.items() for x in pair])
    mark = F.coalesce(F.try_element_at(opens, title), F.when(title.isin(ends), F.lit("")))
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    named = blocks.withColumn("mark_", mark).withColumn("section", F.last("mark_", ignorenulls=True).over(w))
    return named.filter(F.col("mark_").isNull() & (F.col("section") != "")).drop("mark_")


def table_headers(blocks: DataFrame) -> DataFrame:
    """Table rows with ``row_cells`` and the kind of their table, by its first row; recommendation wins over disease."""
    w = Window.partitionBy("report_id", "table_index").orderBy("row_index")
    head = F.regexp_replace(F.first("text").over(w), r"\s+", "")
    has = lambda *x: F.contains(F.col("head_"), F.lit(x[0])) & F.contains(F.col("head_"), F.lit(x[1]))
    kind = F.when(has("建议类别", "建议内容"), "recommendation").when(has("病害位置", "病害类型"), "disease")
    rows = blocks.filter("kind = 'table'").withColumns({"head_": head, "n_": F.row_number().over(w)}).withColumn("table_kind", kind)
    return rows.withColumn("c", row_cells(F.col("text"))).filter("n_ > 1 and table_kind is not null").drop("head_", "n_")


def disease_rows(blocks: DataFrame) -> DataFrame:
    """Records of the disease tables: continued rows take location and type from the rows above."""
    c = F.col("c")
    at = lambda i: F.get(c, i)
    rows = table_headers(blocks).filter("table_kind = 'disease'").filter(~(F.startswith(at(0), F.lit("1）病害")) | F.startswith(at(0), F.lit("2）照片"))))
    n = F.size(c)
    shape = F.when((n >= 4) & at(1).isin(STATUS), "a").when((n >= 5) & at(2).isin(STATUS), "b").when((n >= 4) & at(0).rlike(r"^[\p{Nd}\p{No}]+$"), "c").when(n >= 3, "d")
    rows = rows.withColumn("shape_", shape).filter("shape_ is not null")
    s = F.col("shape_")
    pick = lambda **k: F.coalesce(*[F.when(s == name, value) for name, value in k.items()])
    location, kind = pick(c=at(1), d=at(0)), pick(b=at(0), c=at(2), d=at(1))
    text = pick(a=at(0), b=at(1), c=at(3), d=at(2))
    status = pick(a=F.slice(c, 2, 3), b=F.slice(c, 3, 3), c=F.slice(c, 5, 3), d=F.slice(c, 4, 3))
    keys, order = ["report_id", "table_index"], ["row_index"]
    full = F.size("status_") >= 3
    out = rows.withColumns({"loc_": location, "kind_": kind, "description": text, "status_": status}).withColumns(
        {"location": forward_fill(F.col("loc_"), keys, order), "disease_type": forward_fill(F.col("kind_"), keys, order)}
    )
    new = F.when(F.get("status_", 0).isin(STATUS_TRUE), True).when(F.get("status_", 0).isin(STATUS_FALSE), False)
    out = out.withColumns({"is_new": F.when(full, new), "previous_status": F.when(full, F.get("status_", 1)), "development": F.when(full, F.get("status_", 2))})
    fields = ["location", "disease_type", "description", "is_new", "previous_status", "development"]
    first = first_of(out, ["report_id", *fields], ["table_index", "row_index"])
    return first.select("report_id", "source_id", "table_index", "row_index", *fields)


def recommendation_rows(blocks: DataFrame) -> DataFrame:
    c = F.col("c")
    rows = table_headers(blocks).filter("table_kind = 'recommendation'").filter((F.size(c) >= 3) & ~F.get(c, 0).isin("序号", ""))
    return first_of(rows.withColumn("content", F.get(c, 2)), ["report_id", "content"], ["table_index", "row_index"]).select("report_id", "source_id", "table_index", "row_index", "content")
