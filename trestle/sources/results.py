"""Result documents: a Word file per record, laid out as the format prescribes; every value redacted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trestle.functions.text import displayed, recommendation_category, redact_text, result_name
from trestle.operators.schema import record
from trestle.sources.docx import document

# Headings and rows of a result document.
TITLE, SOURCE, ERROR = "信息提取报告", "源文件：", "错误信息："
NO_RESULT = "模型未生成预测结果。本文件仅保留处理状态，不代表评测答案。"
SUMMARY_HEAD, SUMMARY_LEAD = "1、简要信息", "从报告中提取桥梁定检的概要结论与关键指标，输出内容包括："
DETAIL_HEAD, CONCLUSION_HEAD, ADVICE_HEAD, DISEASE_HEAD = "2、详细信息", "（1）详细结论", "（2）建议明细", "病害列表"
SUMMARY_COLUMNS = ["字段", "示例", "说明"]
SUMMARY_ROWS = [
    ("桥梁名称", "bridge_name", "桥梁全称"), ("报告编号", "report_number", "检测报告编号"), ("报告日期", "inspection_date", "报告出具日期"),
    ("总体评分", "overall_score", "总体技术状况评分"), ("总体等级", "overall_grade", "总体技术状况等级"),
    ("上部结构评分", "component_scores.superstructure", "上部结构技术状况评分"), ("上部结构等级", "component_scores.superstructure_grade", "上部结构技术状况等级"),
    ("下部结构评分", "component_scores.substructure", "下部结构技术状况评分"), ("下部结构等级", "component_scores.substructure_grade", "下部结构技术状况等级"),
    ("桥面系评分", "component_scores.bridge_deck_system", "桥面系技术状况评分"), ("桥面系等级", "component_scores.bridge_deck_system_grade", "桥面系技术状况等级"),
    ("上一次总体评分", "", "上一次定检总体技术状况评分"), ("上一次总体等级", "", "上一次定检总体技术状况等级"),
    ("病害发展趋势与具体说明", "", "与上一次定检相比病害的发展趋势和定量描述"), ("总体结论", "summary", "总体结论的简要说明"),
    ("主要风险点", "key_risks", "比较严重或突出的病害描述"), ("建议", "recommendations", "显示建议的情况说明"),
]
ADVICE_COLUMNS = ["序号", "建议类别", "建议内容", "病害部位"]
DISEASE_COLUMNS = ["序号", "病害部位", "病害类型", "病害描述", "是否新增", "上一次定检状态", "发展程度"]
WIDTHS = {"summary": [1.45, 3.55, 1.5], "advice": [0.45, 1.0, 4.25, 0.8], "diseases": [0.35, 0.9, 0.8, 2.3, 0.55, 0.9, 0.7]}


def _value(r: Column, path: str) -> Column:
    text = T.StringType()
    if not path:
        return displayed(F.lit(None).cast("string"), text)
    if "." in path:
        return displayed(F.try_element_at(r["component_scores"], F.lit(path.split(".")[1])), text)
    if path in ("key_risks", "recommendations"):
        return redact_text(F.array_join(r[path], "；"))
    return displayed(r[path].cast("string"), text)


def _numbered(rows: Column, cells) -> Column:
    """Rows of text cells, the first of which counts from 1."""
    return F.transform(rows, lambda x, i: F.array((i + 1).cast("string"), *cells(x)))


def result_rows(records: DataFrame) -> DataFrame:
    """What a document shows, as text: ``file_name``, ``source``, ``error``, ``shown`` (there is a prediction), and the
    rows of its three tables. ``records``: file_name, prediction (JSON), error."""
    r = F.col("r")
    text = T.StringType()
    rows = records.withColumn("r", F.when(F.col("prediction").isNotNull(), record(F.col("prediction"))))
    disease = lambda d: [*[displayed(d[k], text) for k in ("location", "disease_type", "description")], displayed(d["is_new"], T.BooleanType()), displayed(d["previous_status"], text), displayed(d["development"], text)]
    conclusion = F.concat(F.when(F.length(r["summary"]) > 0, F.array(r["summary"])).otherwise(F.array().cast("array<string>")), r["key_risks"])
    return rows.select(
        result_name(F.col("file_name")).alias("file_name"), redact_text(F.col("file_name")).alias("source"), redact_text(F.coalesce("error", F.lit(""))).alias("error"), r.isNotNull().alias("shown"),
        F.array(*[F.array(F.lit(a), _value(r, p), F.lit(c)) for a, p, c in SUMMARY_ROWS]).alias("summary"), F.transform(conclusion, redact_text).alias("conclusion"),
        _numbered(r["recommendations"], lambda x: [recommendation_category(x), redact_text(x), F.lit("")]).alias("advice"), _numbered(r["diseases"], disease).alias("diseases"),
    )


def render_results(records: DataFrame) -> DataFrame:
    """``file_name``, ``content``: a result document per record."""

    def each(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                items: list = [{"title": TITLE}, SOURCE + row["source"]]
                if row["error"]:
                    items.append(ERROR + row["error"])
                if not row["shown"]:
                    items.append(NO_RESULT)
                else:
                    table = lambda name, head, empty=(): ([head, *([list(x) for x in row[name]] or empty)], WIDTHS[name])  # noqa: B023, E731
                    items += [SUMMARY_HEAD, SUMMARY_LEAD, table("summary", SUMMARY_COLUMNS), DETAIL_HEAD, CONCLUSION_HEAD, *row["conclusion"], ADVICE_HEAD]
                    items += [table("advice", ADVICE_COLUMNS, [[""] * 4]), DISEASE_HEAD, table("diseases", DISEASE_COLUMNS)]
                out.append((row["file_name"], document(items)))
            yield pd.DataFrame(out, columns=["file_name", "content"])

    return result_rows(records).mapInPandas(each, "file_name string, content binary")
