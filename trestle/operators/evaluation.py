"""Metrics of predictions against labels: fields, multisets, evidence, macro means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trestle.functions.text import CATEGORIES, as_text, base_name, comparable, comparable_each, shared_characters
from trestle.operators.ordered import SECTIONS
from trestle.operators.schema import record, record_error

# Label names and the fields they stand for.
SUMMARY_FIELDS = {
    "桥梁名称": "bridge_name", "报告编号": "report_number", "检测日期": "inspection_date", "报告日期": "inspection_date",
    "总体技术状况评分": "overall_score", "总体评分": "overall_score", "总体技术状况等级": "overall_grade", "总体等级": "overall_grade",
    "上部结构评分": "component_scores.superstructure", "上部结构等级": "component_scores.superstructure_grade",
    "下部结构评分": "component_scores.substructure", "下部结构等级": "component_scores.substructure_grade",
    "桥面系评分": "component_scores.bridge_deck_system", "桥面系等级": "component_scores.bridge_deck_system_grade",
    "上一次总体评分": "previous_overall_score", "上一次总体等级": "previous_overall_grade", "病害发展趋势与具体说明": "disease_trend",
    "总体结论": "summary", "主要风险点": "key_risks", "建议": "recommendation_counts",
}
DATE = r"^(20[0-9]{2})[年/-]([0-9]{1,2})(?:月|[-/]([0-9]{1,2})|月([0-9]{1,2})日)?$"
TOLERANCE = 0.005
MACRO = [
    "summary_field_accuracy", "summary_character_f1", "detailed_character_f1", "disease_record_recall", "disease_status_recall", "recommendation_recall",
    "evidence_coverage",
]


def _date(c: Column) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(c, DATE, k), F.lit("")).cast("int")
    return F.when(c.rlike(DATE), F.array_join(F.filter(F.array(part(1), part(2), F.coalesce(part(3), part(4))), lambda x: x.isNotNull()).cast("array<string>"), "-")).otherwise(c)


def category_counts(c: Column) -> Column:
    """The counts of the three categories in a text, absent as 0."""
    return F.array(*[F.coalesce(F.nullif(F.regexp_extract(c, rf"([0-9]+)条{k}", 1), F.lit("")).cast("int"), F.lit(0)) for k in CATEGORIES])


def counted(categories: Column) -> Column:
    """The text of category counts of a list of categories."""
    n = lambda k: F.size(F.filter(categories, lambda x: x == k)).cast("string")
    return F.concat_ws("、", *[F.concat(n(k), F.lit(f"条{k}")) for k in CATEGORIES])


def field_equal(label: Column, value: Column, path: Column) -> Column:
    """Equality as the field asks for: scores within a tolerance, grades without suffix, dates by parts, counts by kind."""
    return same_value(comparable(label), comparable(value), path)


def same_value(a: Column, b: Column, path: Column) -> Column:
    """:func:`field_equal` of values that are comparable already."""
    x, y = a.try_cast("double"), b.try_cast("double")
    grade = lambda c: F.upper(F.regexp_replace(c, "级$", ""))
    plain = a == b
    score = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= TOLERANCE).otherwise(plain)
    counts = (F.size(F.regexp_extract_all(a, F.lit(rf"[0-9]+条(?:{'|'.join(CATEGORIES)})"), F.lit(0))) > 0) & (F.array_join(category_counts(a).cast("array<string>"), ",") == F.array_join(category_counts(b).cast("array<string>"), ","))
    return (
        F.when((a == "") & (b == ""), True).when((a == "") | (b == ""), False)
        .when(path.rlike("(score|superstructure|substructure|bridge_deck_system)$"), score)
        .when(path.rlike("grade$"), grade(a) == grade(b)).when(path.rlike("date$"), _date(a) == _date(b)).when(path == "recommendation_counts", counts).otherwise(plain)
    )


def text_f1(a: Column, b: Column) -> Column:
    """Multiset overlap of the characters of two comparable texts: 2 * shared / (n1 + n2); two empty texts are 1."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * shared_characters(a, b) / total)


def list_recall(expected: Column, actual: Column) -> Column:
    """Multiset recall of two short lists (the rows of one record); without expected rows 1 iff there are no others."""
    count = lambda rows, x: F.size(F.filter(rows, lambda y: y == x))
    hits = F.aggregate(F.transform(F.array_distinct(expected), lambda x: F.least(count(expected, x), count(actual, x))), F.lit(0), lambda x, y: x + y)
    return F.when(F.size(expected) > 0, hits / F.size(expected)).when(F.size(actual) == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def multiset_recall(labels: DataFrame, predictions: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    """Per key: n_labels, n_predictions, hits (sum of smaller counts) and recall; without labels 1 iff no predictions."""
    a = labels.groupBy(*keys, *signature).agg(F.count("*").alias("n_label"), F.lit(0).cast("long").alias("n_pred"))
    b = predictions.groupBy(*keys, *signature).agg(F.lit(0).cast("long").alias("n_label"), F.count("*").alias("n_pred"))
    both = a.unionByName(b).groupBy(*keys, *signature).agg(F.sum("n_label").alias("x"), F.sum("n_pred").alias("y"))
    out = both.groupBy(*keys).agg(F.sum("x").alias("n_labels"), F.sum("y").alias("n_predictions"), F.sum(F.least("x", "y")).alias("hits"))
    empty = F.when(F.col("n_predictions") == 0, 1.0).otherwise(0.0)
    return out.withColumn("recall", F.when(F.col("n_labels") == 0, empty).otherwise(F.col("hits") / F.col("n_labels")))


def character_f1(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Multiset overlap of two texts' characters as they compare (NFKC, no white space); two empty texts are 1."""
    rows = pairs.select(*keys, comparable(F.col(left)).alias("a_"), comparable(F.col(right)).alias("b_"))
    return rows.select(*keys, (F.length("a_") + F.length("b_")).cast("long").alias("total"), text_f1(F.col("a_"), F.col("b_")).alias("f1"))


# How a detail text states a summary field.
TOLD = {
    "总体评分": r"总体技术状况评分\s*([0-9]+(?:\.[0-9]+)?)", "总体等级": r"总体技术状况等级(?:为)?\s*([A-D]级)", "上部结构评分": r"上部结构评分\s*([0-9]+(?:\.[0-9]+)?)",
    "下部结构评分": r"下部结构评分\s*([0-9]+(?:\.[0-9]+)?)", "桥面系评分": r"桥面系评分\s*([0-9]+(?:\.[0-9]+)?)",
    "上一次总体评分": r"与上(?:一年度|一次)[^。\n]{0,50}?总体评分\s*([0-9]+(?:\.[0-9]+)?)",
}


def consistency_issues(labels: DataFrame) -> DataFrame:
    """Labels against themselves (``label_file``, ``summary`` map, ``detail`` text, optional list ``categories`` of the
    recommendation rows): summary fields that the detail text contradicts, counts that the rows contradict. Issues only:
    nothing is rewritten."""
    field = lambda name, told, reason: F.struct(F.lit(name).alias("field"), F.lit(SUMMARY_FIELDS[name]).alias("path"), told.alias("told"), F.try_element_at("summary", F.lit(name)).alias("label"), F.lit(reason).alias("reason"))
    made = [field(name, F.regexp_extract("detail", pattern, 1), "summary_detail_conflict") for name, pattern in TOLD.items()]
    if "categories" in labels.columns:
        made.append(field("建议", F.when(F.size("categories") > 0, counted(F.col("categories"))).otherwise(""), "summary_row_counts_conflict"))
    rows = labels.select("label_file", F.explode(F.array(*made)).alias("r")).filter("r.told <> '' and r.label <> ''")
    bad = rows.filter(~field_equal(F.col("r.label"), F.col("r.told"), F.col("r.path")))
    return bad.select("label_file", F.col("r.field").alias("field"), F.col("r.label").alias("summary_value"), F.col("r.told").alias("detail_value"), F.col("r.reason").alias("reason"))


def audit_counts(labels: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: labels checked, labels with a conflict."""
    return labels.agg(F.count("*").alias("records_checked")).crossJoin(issues.agg(F.countDistinct("label_file").alias("reports_with_conflicts")))


def macro(scores: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Means over scored records, rounded to 6; null without records."""
    return scores.agg(F.count("*").alias("n_scored"), *[F.round(F.avg(m), 6).alias(m) for m in metrics or MACRO])


def evidence_coverage(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per report: claims, those whose quote stands in the named source, and the share."""
    side = blocks.select(F.col("report_id").alias("r2"), F.col("source_id").alias("s2"), "text")
    ok = F.coalesce(F.contains("text", F.col("quote")), F.lit(False))
    rows = claims.join(side, (F.col("report_id") == F.col("r2")) & (F.col("source_id") == F.col("s2")), "left").withColumn("ok", ok)
    out = rows.groupBy("report_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_valid"))
    return out.withColumn("coverage", F.when(F.col("n") == 0, 0.0).otherwise(F.col("n_valid") / F.col("n")))


def require_train(split: str) -> None:
    """Raised before any label is opened."""
    if split != "train":
        raise ValueError("only predictions of the train split can be scored against labels")


def match_predictions(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """``records`` (record_pos, file_name, ..) with ``train_file`` and ``label_file`` of their pair, or an ``error``.

    A record's file is looked up by path, then by bare name if just one pair has it; the first record of a file counts.
    """
    byname = pairs.select("train_file", "label_file", base_name(F.col("train_file")).alias("name_"))
    alone = byname.groupBy("name_").agg(F.count("*").alias("n_"), F.min(F.struct("train_file", "label_file")).alias("one_")).filter("n_ = 1").drop("n_")
    by_path = pairs.select(F.col("train_file").alias("path_"), F.struct("train_file", "label_file").alias("whole_"))
    named = records.withColumn("asked_", F.coalesce("file_name", F.lit(""))).join(by_path, F.col("asked_") == F.col("path_"), "left")
    named = named.join(alone, base_name(F.col("asked_")) == F.col("name_"), "left").withColumn("pair_", F.coalesce("whole_", "one_"))
    w = Window.partitionBy("pair_").orderBy("record_pos")
    first = F.when(F.col("pair_").isNotNull(), F.row_number().over(w))
    error = F.when(F.col("pair_").isNull(), "missing/ambiguous pair or duplicate prediction").when(first > 1, "duplicate prediction for the same original")
    return named.withColumn("error_", error).select(*records.columns, F.col("pair_.train_file").alias("train_file"), F.col("pair_.label_file").alias("label_file"), F.col("error_").alias("match_error"))


def _predicted(r: Column) -> Column:
    """Path -> the predicted value as text, for the fields that a label's summary can name."""
    pairs = []
    for path in dict.fromkeys(SUMMARY_FIELDS.values()):
        if path == "recommendation_counts":
            value = counted(F.transform(r["recommendation_details"], lambda d: d["category"]))
        elif "." in path:
            value = F.try_element_at(r[path.split(".")[0]], F.lit(path.split(".")[1]))
        else:
            value = as_text(r[path], T.ArrayType(T.StringType()) if path == "key_risks" else T.StringType())
        pairs += [F.lit(path), F.coalesce(value.cast("string"), F.lit(""))]
    return F.create_map(*pairs)


#: What tells rows apart, by metric: list of the label, list of the prediction, fields.
ROW_METRICS = {
    "disease_record_recall": ("diseases", "diseases", ["location", "disease_type", "description"]),
    "disease_status_recall": ("diseases", "diseases", ["location", "disease_type", "description", "is_new", "previous_status", "development"]),
    "recommendation_recall": ("recommendations", "recommendation_details", ["category", "content", "location"]),
}


def _signatures(rows: Column, fields: list[str], typed: bool) -> Column:
    text = lambda d, f: as_text(d[f], T.BooleanType() if typed and f == "is_new" else T.StringType())
    return F.transform(rows, lambda d: F.concat_ws("\x01", *[text(d, f) for f in fields]))


def score_records(rows: DataFrame) -> DataFrame:
    """Metrics of each record against its label: ``record_pos``, ``file_name``, ``status``, ``prediction`` (JSON),
    ``label`` (a struct as :func:`labels.parse_labels` makes it) and ``sources`` (source_id -> text of its report) in.

    All rows of a record are in the record's row, so that nothing is shuffled here. A record that failed scores as empty.
    """
    given = F.when(F.coalesce(F.col("status"), F.lit("")).isin("", "success"), F.coalesce("prediction", F.lit("{}"))).otherwise(F.lit("{}"))
    t = rows.withColumn("r", record(given))
    fields = F.filter(F.map_entries("label.summary"), lambda e: e["key"].isin(*SUMMARY_FIELDS))
    paths = F.create_map(*[F.lit(x) for pair in SUMMARY_FIELDS.items() for x in pair])
    t = t.withColumns({"f_": fields, "told_": _predicted(F.col("r"))})
    t = t.withColumns({"a_": comparable_each(F.transform("f_", lambda e: e["value"])), "b_": comparable_each(F.transform("f_", lambda e: F.try_element_at("told_", F.try_element_at(paths, e["key"]))))})
    names = list(SECTIONS.values())
    listed = T.ArrayType(T.StringType())
    t = t.withColumns({
        "da_": comparable_each(F.array(*[as_text(F.col(f"label.{s}"), listed) for s in names])), "db_": comparable_each(F.array(*[as_text(F.col(f"r.{s}"), listed) for s in names])),
        **{f"{m}_a": comparable_each(_signatures(F.col(f"label.{x}"), fs, False)) for m, (x, _, fs) in ROW_METRICS.items()},
        **{f"{m}_b": comparable_each(_signatures(F.col(f"r.{y}"), fs, True)) for m, (_, y, fs) in ROW_METRICS.items()},
    })
    each = F.transform(F.sequence(F.lit(1), F.size("f_")), lambda i: F.struct(
        F.element_at("f_", i)["key"].alias("field"), same_value(F.element_at("a_", i), F.element_at("b_", i), F.try_element_at(paths, F.element_at("f_", i)["key"])).alias("equal"),
        text_f1(F.element_at("a_", i), F.element_at("b_", i)).alias("f1"),
    ))
    t = t.withColumn("each_", F.when(F.size("f_") > 0, each).otherwise(F.array().cast("array<struct<field:string,equal:boolean,f1:double>>")))
    stated = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.get("da_", i) != "")
    t = t.withColumn("detail_", F.transform(stated, lambda i: text_f1(F.get("da_", i), F.get("db_", i))))
    holds = lambda e: F.coalesce(F.contains(F.try_element_at("sources", e["source_id"]), e["quote"]), F.lit(False))
    t = t.withColumns({"good_": F.array_distinct(F.transform(F.filter("r.evidence", holds), lambda e: e["source_id"])), "invalid_evidence_count": F.size(F.filter("r.evidence", lambda e: ~holds(e)))})
    mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda x, y: x + y) / F.size(xs)).otherwise(F.lit(0.0))
    covered = F.size(F.filter("r.diseases", lambda d: F.arrays_overlap(d["evidence_ids"], F.col("good_"))))
    return t.select(
        "record_pos", "file_name", mean(F.transform("each_", lambda x: x["equal"].cast("int").cast("double"))).alias("summary_field_accuracy"),
        mean(F.transform("each_", lambda x: x["f1"])).alias("summary_character_f1"), mean(F.col("detail_")).alias("detailed_character_f1"),
        F.map_from_entries(F.transform("each_", lambda x: F.struct(x["field"], x["equal"]))).alias("fields"),
        *[list_recall(F.col(f"{m}_a"), F.col(f"{m}_b")).alias(m) for m in ROW_METRICS],
        F.when(F.size("r.diseases") > 0, covered / F.size("r.diseases")).otherwise(F.lit(0.0)).alias("evidence_coverage"), "invalid_evidence_count",
    )


def evaluate_predictions(records: DataFrame, split: str, pairs: DataFrame, labels: DataFrame, blocks: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``summary`` (one row), ``scores`` and ``failures`` of predictions against their labels.

    ``records``: record_pos, file_name, status, prediction (JSON); ``labels``: parsed, by label_file; ``blocks``: of the
    originals, by train_file. A record without a pair of its own, with a label that warns, or with an invalid prediction
    is a failure.
    """
    require_train(split)
    asked = records.filter(F.col("record_pos") < limit) if limit else records
    known = match_predictions(asked.select("record_pos", "file_name", "status", "prediction"), pairs)
    parsed = labels.select(F.col("label_file").alias("l2_"), F.struct(*[c for c in labels.columns if c != "label_file"]).alias("label"))
    sources = blocks.groupBy(F.col("train_file").alias("t2_")).agg(F.map_from_entries(F.collect_list(F.struct("source_id", "text"))).alias("sources"))
    full = known.join(parsed, F.col("label_file") == F.col("l2_"), "left").join(sources, F.col("train_file") == F.col("t2_"), "left")
    valid = record_error(F.coalesce("prediction", F.lit("null")))
    error = F.coalesce(
        "match_error", F.when(F.col("label").isNull(), "the label can't be read"), F.when(F.size("label.warnings") > 0, F.array_join("label.warnings", "; ")),
        F.when(F.col("status") == "success", valid),
    )
    full = full.withColumn("error", error)
    failures = full.filter("error is not null").select("record_pos", "file_name", "error")
    scores = score_records(full.filter("error is null"))
    counts = full.agg(
        F.count("*").alias("prediction_records"), F.count_if(F.col("error").isNull()).alias("matched"), F.count_if(F.col("error").isNotNull()).alias("evaluation_failures"),
        F.count_if((F.col("status") == "success") & F.col("error").isNull()).alias("valid_"),
    )
    total = F.col("prediction_records")
    share = lambda c: F.when(total > 0, F.col(c) / total).otherwise(F.lit(0.0))
    means = macro(scores).crossJoin(scores.agg(F.coalesce(F.sum("invalid_evidence_count"), F.lit(0)).alias("invalid_evidence_count")))
    summary = means.crossJoin(counts).crossJoin(pairs.agg(F.count("*").alias("paired")))
    summary = summary.withColumns({"complete": (total > 0) & (F.col("evaluation_failures") == 0), "evaluation_coverage": share("matched"), "json_validity": share("valid_")})
    return summary.drop("valid_", "n_scored"), scores, failures
