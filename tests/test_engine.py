"""The engine's own operators: queries against SQL on a small table, and behaviours on hand-made reports."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from trestle.functions import text as X
from trestle.operators import evaluation, model, ordered, pairing, records, retrieval
from trestle.plans import catalogue
from trestle.sources import docx, scans, sinks
from trestle.streaming import ingest

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["block_explode", "pipe_table_cells", "search_topk", "context_pack", "evidence_clean", "row_recall", "alias_components", "field_match"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS FROM '{SF}/{f}'")
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))


def test_text_functions(spark):
    c = F.col("a")
    assert one(spark, X.normalize_text(c), a=" x \ty\n\n\n\nz ") == "x y\n\nz"
    assert one(spark, X.strip(c), a="\x1c　x\x85") == "x"
    assert set(one(spark, X.ngrams(c), a="Ab c")) == {"ab", "bc", "abc"}
    assert one(spark, X.redact_text(c), a="联系人：王小明 13812345678 a.b@c.org") == "联系人：[姓名已脱敏] [电话已脱敏] [邮箱已脱敏]"
    assert one(spark, X.numbered_items(c), a="1、清理；（2）修补\n3.更换") == ["清理", "修补", "更换"]
    assert one(spark, X.row_cells(c), a="a | a |  | b | a") == ["a", "b", "a"]
    assert one(spark, X.recommendation_category(c), a="立即加强") == "立即处置"
    assert one(spark, X.comparable(c), a="Ａ１ ﾊ") == "A1ハ"
    assert one(spark, X.year_of(c), a="r/2013年/x.docx") == "2013年"
    assert one(spark, X.matches_split(c, "train"), a="赛题一_训练集标签/a") is False


def _report(spark):
    items = ["桥梁名称：测试桥", [["病害位置", "病害类型", "描述", "是否新增"], ["1号桥墩", "裂缝", "竖向裂缝", "新增"]], "处置建议", "1、清理；2、修补", "其他", "3、不算"]
    return docx.blocks(scans.upload(spark, "a/sample.docx", docx.document(items)))


def test_docx_blocks_and_failures(spark):
    rows = _report(spark).orderBy("block_pos").collect()
    assert [r.source_id for r in rows[:3]] == ["paragraph:0", "table:0:0", "table:0:1"] and rows[2].cells == ["1号桥墩", "裂缝", "竖向裂缝", "新增"]
    bad = docx.blocks(spark.createDataFrame([("x.docx", b"no"), ("y.doc", b"no")], "path string, content binary")).collect()
    assert all(r.error for r in bad) and len(bad) == 2


def test_tables_facts_and_islands(spark):
    blocks = _report(spark)
    assert [(r.location, r.disease_type, r.description) for r in ordered.disease_rows(blocks).collect()] == [("1号桥墩", "裂缝", "竖向裂缝")]
    assert ordered.source_recommendations(blocks).first().recommendations == ["清理", "修补"]
    assert records.source_facts(blocks).first().bridge_name == "测试桥"
    assert "[paragraph:0]" in ordered.context_pack(blocks).first().context


def test_retrieval_and_answers(spark):
    blocks = _report(spark)
    hit = retrieval.evidence(blocks, retrieval.search(blocks, "裂缝")).orderBy("rank").first()
    assert hit.source_id == "table:0:1"
    assert retrieval.search(blocks, "zzzz").count() == 0
    asked = spark.createDataFrame([(1, "裂缝"), (2, "zzzz")], "query_id long, query string")
    rid = hit.report_id

    def backend():
        return lambda system, user, most: f'<think>x</think>```json\n{{"answer": "yes", "confidence": "high", "evidence_ids": ["{rid}/table:0:1", "no"]}}\n```'

    got = {r.query_id: r for r in model.answers(blocks, asked, backend).collect()}
    assert got[1].status == "success" and got[1].cited == [f"{rid}/table:0:1"] and got[2].status == "no_evidence"


def test_evaluation_metrics(spark):
    eq = lambda a, b, p: one(spark, evaluation.field_equal(F.col("a"), F.col("b"), F.col("p")), a=a, b=b, p=p)
    assert eq("87.50", "87.504", "overall_score") and not eq("2013年10月", "2013年10月01日", "inspection_date") and eq("2013年10月1日", "2013-10-01", "inspection_date")
    assert eq("b级", "B", "overall_grade") and eq("1条立即处置", "1条立即处置、0条尽快维修", "recommendation_counts") and not eq("", "x", "summary")
    two = spark.createDataFrame([(1, "a"), (1, "a")], "k int, s string")
    assert evaluation.multiset_recall(two, two.limit(1), ["k"], ["s"]).first().recall == 0.5
    with pytest.raises(ValueError):
        evaluation.require_train("test")


def test_pairing_and_split(spark):
    names = ["r/赛题一_训练集/2013年/甲桥.docx", "r/赛题一_训练集/2013年/01-001乙大桥.docx", "r/赛题一_训练集标签/2013年/甲桥-无对比年度的信息提取报告.docx", "r/赛题一_训练集标签/2014年/丙桥.docx"]
    train, labels = pairing.inventory(spark.createDataFrame([(n,) for n in names], "path string"))
    pairs, unmatched, unused = pairing.pair_files(train, labels)
    assert [(r.train_file, r.label_file) for r in pairs.collect()] == [(names[0], names[2])]
    assert unmatched.first().reason == "missing_or_ambiguous_label" and unused.first().label_file == names[3]
    rows = spark.createDataFrame([(f"r/{x}.docx", f"l/{x}.docx") for x in ("甲长江大桥", "甲大桥", "乙桥", "丙桥")], "train_file string, label_file string")
    split, groups = pairing.group_split(rows, "s")
    by = {r.train_file: (r.bridge_group, r.split) for r in split.collect()}
    assert by["r/甲长江大桥.docx"] == by["r/甲大桥.docx"] and groups.count() == 3
    again = {r.train_file: (r.bridge_group, r.split) for r in pairing.group_split(rows.orderBy(F.desc("train_file")), "s")[0].collect()}
    assert again == by


def test_archive_source(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for n in ("r/初赛测试集/b.DOCX", "r/初赛测试集/a.docx", "r/赛题一_训练集/c.docx", "r/x.txt"):
            z.writestr(n, docx.document([n]))
    got = [r.path for r in scans.archive(spark, str(path), "test").orderBy("position").collect()]
    assert got == ["r/初赛测试集/a.docx", "r/初赛测试集/b.DOCX"] and scans.archive(spark, str(path), names_only=True).count() == 3
    assert docx.blocks(scans.archive(spark, str(path), "train")).first().text.endswith("c.docx")


def test_sinks_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a.docx", "r", "blocked", None, None), (1, "", "r", "success", None, None)], "record_pos int, file_name string, report_id string, status string, prediction string, error string")
    assert {r.record_pos: r.problem for r in sinks.problems(rows).collect()} == {0: "no error given", 1: "file_name is missing"}
    sinks.write_audit(rows, str(tmp_path / "audit"))
    assert spark.read.text(str(tmp_path / "audit")).count() == 2 and sinks.manifest(rows, "x", "test").first().blocked == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(docx.document(["hello"]))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert ingest.latest(spark, str(tmp_path / "out")).first().text == "hello"
    assert io.BytesIO(docx.document(["x"])).read(2) == b"PK"
