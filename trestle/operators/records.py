"""From blocks and model output to one clean record per report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trestle.functions.text import WS, file_stem, strip

# Field names and patterns of the record format.
STRINGS = [
    "bridge_name", "report_number", "inspection_date", "overall_grade", "previous_overall_grade", "disease_trend", "summary", "report_quality",
]
LISTS = ["key_risks", "detailed_conclusion", "disease_causes", "disposal_recommendations", "safety_impacts", "recommendations", "uncertain_fields"]
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
SCORE = rf"(?i)(?:BCI|总体(?:技术状况)?评分|总体评分){WS}*[=:：]?{WS}*{NUMBER}"
GRADE = rf"(?i)(?:总体(?:技术状况)?等级|总体等级|整体技术状况(?:等级)?评定为|技术状况等级评定为){WS}*(?:为|：|:)??{WS}*([A-DＡ-Ｄ]){WS}*级?"
COMPONENTS = {"superstructure": "上部结构评分", "substructure": "下部结构评分", "bridge_deck_system": "桥面系评分"}
NAMES = [rf"(?:工程名称|桥梁名称){WS}*[:：]{WS}*([^\n|]+)", rf"项目名称{WS}*[:：]{WS}*([^\n|]+)"]
DATE_HINT = rf"(20[0-9]{{2}}){WS}*[年/-]{WS}*([0-9]{{1,2}}){WS}*[月/-]{WS}*([0-9]{{1,2}}){WS}*日?"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(strip(F.regexp_extract(text, pattern, group)), F.lit(""))


def joined_text(blocks: DataFrame, keys: list[str], where: Column | None = None, name: str = "full_text") -> Column:
    """The texts of a report's blocks, in order, by line."""
    use = F.length("text") > 0
    rows = F.array_sort(F.collect_list(F.when(use if where is None else use & where, F.struct("block_pos", "text"))))
    return F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias(name)


def metadata_hints(blocks: DataFrame, first: int = 80) -> DataFrame:
    """Date, report number and score hints from a report's first blocks that aren't empty; the date's parts are not padded."""
    some = blocks.filter(F.length("text") > 0)
    ranked = some.withColumn("nth_", F.row_number().over(Window.partitionBy("report_id").orderBy("block_pos")))
    head = ranked.filter(F.col("nth_") <= first).groupBy("report_id").agg(joined_text(blocks, ["report_id"]))
    t = F.col("full_text")
    year = F.regexp_extract(t, DATE_HINT, 1)
    date = F.when(year != "", F.concat_ws("-", year, F.regexp_extract(t, DATE_HINT, 2), F.regexp_extract(t, DATE_HINT, 3)))
    return head.select(
        "report_id", F.expr("try_cast(nullif(regexp_extract(full_text, '(20[0-9]{2})', 0), '') as int)").alias("any_year"), date.alias("inspection_date_hint"),
        F.when(year != "", year.cast("int")).alias("inspection_year"), found(t, rf"报告编号{WS}*[:：]{WS}*([A-Za-z0-9-]+)").alias("report_number_hint"),
        F.expr("try_cast(nullif(regexp_extract(full_text, '(?i)\\\\bBCI\\\\s*[=:：]\\\\s*([0-9]+(?:[.][0-9]+)?)', 1), '') as double)").alias("bci_hint"),
    ).drop("any_year")


def source_facts(blocks: DataFrame) -> DataFrame:
    """Facts that stand in the text or the file's name; the first pattern that matches decides."""
    paragraph = F.col("kind") == "paragraph"
    texts = blocks.groupBy("report_id", "file_name").agg(joined_text(blocks, [], paragraph, "para"), joined_text(blocks, []))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(file_stem(F.col("file_name")), "^[^-]+-", ""), "[（(][^（）()]*[原现级][^（）()]*[）)]", ""), rf"报告(?:{WS}*[0-9]*)?$", "")
    from_name = F.when((F.length(stem) >= 2) & ~F.lower(stem).isin("sample", "test", "report"), stem)
    clean = lambda c: F.when(~c.rlike("年度|定期检测|结构设施"), c)
    named = [clean(found(F.col("para"), p)) for p in NAMES]
    date = found(F.col("para"), rf"(?:检测日期|检验日期|报告日期){WS}*[:：]{WS}*([^\n|]+)")
    scores = F.map_filter(
        F.map_from_entries(F.array(*[F.struct(F.lit(k), F.regexp_extract("full_text", rf"{v}{WS}*{NUMBER}", 1).try_cast("double")) for k, v in COMPONENTS.items()])),
        lambda k, v: v.isNotNull(),
    )
    return texts.select(
        "report_id", F.coalesce(from_name, *named).alias("bridge_name"), found(F.col("para"), rf"报告编号{WS}*[:：]{WS}*([A-Za-z0-9-]+)").alias("report_number"),
        date.alias("inspection_date"), F.regexp_extract(F.coalesce(date, F.lit("")), "(20[0-9]{2})", 1).try_cast("int").alias("inspection_year"),
        F.regexp_extract("full_text", SCORE, 1).try_cast("double").alias("overall_score"), found(F.col("full_text"), GRADE).alias("overall_grade"), scores.alias("component_scores"),
    )


def conclusion(blocks: DataFrame) -> DataFrame:
    """``summary``: the first block that states the conclusion at some length."""
    says = F.contains("text", F.lit("检测结论")) | F.contains("text", F.lit("总体结论")) | F.contains("text", F.lit("经综合评定"))
    rows = blocks.filter(says & (F.length(F.replace(F.col("text"), F.lit(" | "), F.lit(""))) > 40))
    parts = F.split("text", r" \| ")
    told = F.when(F.contains("text", F.lit(" | ")), F.when(F.get(parts, 0).isin("检测结论", "总体结论"), F.get(parts, 1)).otherwise(F.get(parts, 0))).otherwise(F.col("text"))
    return rows.groupBy("report_id").agg(F.min_by(told, F.col("block_pos")).alias("summary"))


def merged(*maps: Column) -> Column:
    """Right-most map wins by key, also with an explicit null, under any policy for repeated keys."""

    def over(first: Column, later: Column) -> Column:
        return F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(later), k)), later)

    return reduce(over, maps)


def key_wins(sources: list[tuple[Column, Column]]) -> Column:
    """Of (has the key, value) pairs, least to most important, the value of the last that has the key: a null counts."""
    out = F.lit(None)
    for has, value in sources:
        out = F.when(has, value).otherwise(out)
    return out


# --- strict validation of JSON records -------------------------------------------------------------------------------


def schema_error(payload: Column, strings: list[str], lists: list[str], others: list[str]) -> Column:
    """The first complaint about a JSON object: not an object, unknown keys, wrong types; null if there is none."""
    keys = F.json_object_keys(payload)
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in [*strings, *lists, *others]])))
    v = F.try_parse_json(payload)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    wrong_string = [F.when(~kind(k).isin("STRING", "VOID"), F.lit(f"{k} must be a string")) for k in strings]
    wrong_list = [F.when(~(F.startswith(kind(k), F.lit("ARRAY<STRING>")) | kind(k).isin("VOID", "ARRAY<VOID>")), F.lit(f"{k} must be a list of strings")) for k in lists]
    return F.coalesce(
        F.when(keys.isNull(), F.lit("record must be an object")),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown keys: "), F.array_join(unknown, ", "))), *wrong_string, *wrong_list,
    )


def lenient_number(payload: Column, key: str, kind: str) -> Column:
    """A number where the value can be read as one, else null; booleans count 0 and 1, fractions are cut for int."""
    raw = F.get_json_object(payload, f"$.{key}")
    value = F.when(raw == "true", F.lit(1.0)).when(raw == "false", F.lit(0.0)).otherwise(strip(raw).try_cast("double"))
    return value if kind == "double" else F.when(~F.isnan(value), F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))).cast("int")


# --- evidence --------------------------------------------------------------------------------------------------------


def clean_evidence(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Claims (report_id, pos, source_id, quote) whose source exists; the first per source; a wrong quote is repaired."""
    side = blocks.select(F.col("report_id").alias("r2"), F.col("source_id").alias("s2"), "text", "kind", "table_index", "row_index")
    known = claims.join(side, (F.col("report_id") == F.col("r2")) & (F.col("source_id") == F.col("s2"))).drop("r2", "s2")
    w = Window.partitionBy("report_id", "source_id").orderBy("pos")
    once = known.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1")
    right = (F.length("quote") > 0) & F.contains("text", F.col("quote"))
    return once.withColumn("quote", F.when(right, F.col("quote")).otherwise(F.substring("text", 1, 1200))).drop("rn_", "text")


def valid_ids(ids: Column, known: Column) -> Column:
    return F.array_distinct(F.filter(ids, lambda x: F.array_contains(known, x)))


def missing_evidence(referenced: DataFrame, evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """Evidence rows for sources that records refer to (report_id, source_id) and the evidence lacks."""
    lack = referenced.select("report_id", "source_id").distinct().join(evidence.select("report_id", "source_id"), ["report_id", "source_id"], "left_anti")
    side = blocks.select("report_id", "source_id", F.substring("text", 1, 1200).alias("quote"), "table_index", "row_index")
    return lack.join(side, ["report_id", "source_id"]).withColumn("kind", F.lit("table"))


def fill_from_model(rows: DataFrame, model: DataFrame, fields: list[str]) -> DataFrame:
    """Table rows (row_pos, location, disease_type) take null ``fields`` from the first model row (model_pos) that fits:
    location or type contains the other's, either way round.

    Each distinct location and each distinct type of a report finds its first model row among the report's distinct ones;
    rows only look these up, so that they are never paired with model rows.
    """
    order = [F.col("model_pos").isNull().alias("last"), F.col("model_pos").alias("pos")]
    given = model.select("report_id", "location", "disease_type", F.struct(*order, *[F.col(f).alias(f) for f in fields]).alias("m"))
    out = rows
    for k, c in (("loc_", "location"), ("type_", "disease_type")):
        texts = rows.select(F.col("report_id").alias("r1"), F.col(c).alias("t1")).filter(F.length("t1") > 0).distinct()
        told = given.filter(F.length(c) > 0).groupBy(F.col("report_id").alias("r2"), F.col(c).alias("t2")).agg(F.min("m").alias("m"))
        fits = (F.col("r1") == F.col("r2")) & (F.contains("t1", F.col("t2")) | F.contains("t2", F.col("t1")))
        first = texts.join(told, fits).groupBy("r1", "t1").agg(F.min("m").alias(k))
        out = out.join(first, (F.col("report_id") == F.col("r1")) & (F.col(c) == F.col("t1")), "left").drop("r1", "t1")
    out = out.withColumn("m_", F.least("loc_", "type_"))
    # of rows at one place, the one with the first model row stays
    w = Window.partitionBy("report_id", "row_pos").orderBy(F.coalesce("m_.last", F.lit(True)), "m_.pos")
    once = out.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1")
    return once.select(*[F.coalesce(c, f"m_.{c}").alias(c) if c in fields else F.col(c) for c in rows.columns])
