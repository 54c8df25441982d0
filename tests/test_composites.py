"""Whole jobs on hand-made reports: extraction, labels, evaluation, preparation, result documents, resume, SQL names."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trestle.functions import sql
from trestle.functions import text as X
from trestle.operators import evaluation, extraction, labels, model, ordered, pairing, records, retrieval, schema
from trestle.plans import preparation
from trestle.sources import docx, results, scans, sinks

REPORT = ["桥梁名称：测试桥", [["病害位置", "病害类型", "描述", "是否新增"], ["1号桥墩", "裂缝", "竖向裂缝", "新增"]], "处置建议", "1、清理；2、修补", "总体技术状况评分 88.5"]
LABEL = [
    "1、简要信息", [["字段", "示例"], ["桥梁名称", "测试桥"], ["总体评分", "87.50"], ["总体等级", "Ｂ级"], ["建议", "1条立即处置、0条尽快维修、0条预防性养护"]],
    "（1）详细结论", "总体技术状况评分 87.5，等级B", "（2）建议明细", [["序号", "建议类别", "建议内容", "病害部位"], ["1", "立即处置", "清理", "桥面"]],
    "病害列表", [["序号", "病害部位", "病害类型", "病害描述", "是否新增"], ["1", "桥面", "裂缝", "长", "是"], ["", "", "", "", ""]],
]


def _blocks(spark, items, name="a/01-测试桥报告.docx"):
    return docx.blocks(scans.upload(spark, name, docx.document(items)))


def _one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def _made():
    """A backend's maker; made here, so that workers get it by value."""

    def backend():
        def ask(system, user):  # takes no token limit
            if "bridge_name" in system:
                return '```JSON\n{"bridge_name":"m","overall_grade":"B","key_risks":["a","a"]}\n```'
            if "recommendation_details" in system:
                return '<think>{</think>{"diseases":[{"location":"桥墩","measurement":"2mm"}],"evidence":[{"source_id":"paragraph:0","quote":"bad"},{"source_id":"zz","quote":"q"}]}'
            raise AssertionError

        return ask

    return backend


def test_extraction_prefers_the_report_and_ties_it_to_evidence(spark):
    row = extraction.extract_reports(_blocks(spark, REPORT), _made()).first()
    got = json.loads(row.prediction)
    assert row.status == "success" and got["bridge_name"] == "测试桥" and got["overall_score"] == 88.5 and got["overall_grade"] == "B"
    assert got["key_risks"] == ["a"] and got["recommendations"] == ["清理", "修补"] and list(got) == [x.split(":")[0] for x in schema._fields(schema.RECORD)]
    assert [(d["description"], d["measurement"], d["evidence_ids"]) for d in got["diseases"]] == [("竖向裂缝", "2mm", ["table:0:1"])]
    assert [(e["source_id"], e["quote"], e["kind"]) for e in got["evidence"]] == [("paragraph:0", "桥梁名称：测试桥", "paragraph"), ("table:0:1", "1号桥墩 | 裂缝 | 竖向裂缝 | 新增", "table")]
    assert "latency_ms" in row.model and "detail_latency_ms" in row.model


def test_extraction_falls_back_and_blocks(spark):
    def short():
        return lambda system, user, most: "{}" if most == 64 else "no json"

    def wrong():
        return lambda system, user, most: '{"zz": 1}'

    def none():
        raise model.ModelUnavailable("no weights")

    blocks = _blocks(spark, REPORT)
    assert json.loads(extraction.extract_reports(blocks, short).first().prediction)["overall_score"] == 88.5
    assert extraction.extract_reports(blocks, wrong).first().error == "unknown keys: zz"
    row = extraction.extract_reports(blocks, none).first()
    assert row.status == "blocked" and row.prediction is None and "no weights" in row.error
    assert extraction.extract_reports(blocks.limit(0), none).count() == 0


@pytest.mark.parametrize("text", ['```JSON\n{"a": 1}\n```', '<THINK>{"b": 2}</think> so {x} {"a": 1} end', '{"a": 1} ```json {"b" ```', '```\nnothing\n``` {"a": 1}'])
def test_json_out_of_answers(text):
    assert model.extract_json(text) == {"a": 1}


def test_labels_are_parsed_whole(spark):
    got = labels.parse_labels(_blocks(spark, LABEL)).first()
    assert got.summary["总体评分"] == "87.50" and got.detailed_conclusion == ["总体技术状况评分 87.5，等级B"] and got.warnings == []
    assert [(d.location, d.disease_type, d.description, d.is_new, d.development) for d in got.diseases] == [("桥面", "裂缝", "长", "是", None)]
    assert [(r.category, r.content, r.location) for r in got.recommendations] == [("立即处置", "清理", "桥面")]
    bare = labels.parse_labels(_blocks(spark, ["x", [["总体评分", "1"], ["其他", "2"]], [["病害类型", "病害位置"], ["a"]]])).first()
    assert bare.summary == {"总体评分": "1"} and bare.warnings == ["table:1:1: column count mismatch"]
    assert labels.parse_labels(_blocks(spark, ["x"])).first().warnings == ["No recognized summary table"]


def _case(spark):
    prediction = {
        "bridge_name": "测试桥", "overall_score": 87.5, "overall_grade": "B", "detailed_conclusion": ["总体技术状况评分87.5，等级B"],
        "diseases": [{"location": "桥面", "disease_type": "裂缝", "description": "长", "is_new": True, "evidence_ids": ["paragraph:0"]}],
        "recommendation_details": [{"category": "立即处置", "content": "清理", "location": "桥面"}],
        "evidence": [{"source_id": "paragraph:0", "quote": "1、简要"}, {"source_id": "x", "quote": "y"}],
    }
    rows = [(0, "r/a.docx", "success", json.dumps(prediction)), (1, "a.docx", "success", "{}"), (2, "zz.docx", "failed", None), (3, "r/b.docx", "blocked", None), (4, "c.docx", "success", '{"zz": 1}')]
    records_ = spark.createDataFrame(rows, "record_pos long, file_name string, status string, prediction string")
    pairs = spark.createDataFrame([(f"r/{x}.docx", f"l/{x}.docx") for x in "abcd"], "train_file string, label_file string")
    blocks = _blocks(spark, LABEL)
    parsed = labels.parse_labels(blocks).drop("report_id").crossJoin(pairs.select("label_file"))
    return records_, pairs, parsed, blocks.crossJoin(pairs.select("train_file"))


def test_predictions_are_evaluated(spark):
    records_, pairs, parsed, blocks = _case(spark)
    summary, scores, failures = evaluation.evaluate_predictions(records_, "train", pairs, parsed, blocks)
    got = {r.record_pos: r for r in scores.collect()}
    assert set(got) == {0, 3} and all(got[0][m] == 1.0 for m in ("summary_field_accuracy", "detailed_character_f1", "disease_status_recall", "recommendation_recall", "evidence_coverage"))
    assert got[0].invalid_evidence_count == 1 and got[0].fields["总体等级"] and got[3].summary_field_accuracy == 0.0
    assert {r.record_pos: r.error for r in failures.collect()} == {1: "duplicate prediction for the same original", 2: "missing/ambiguous pair or duplicate prediction", 4: "unknown keys: zz"}
    s = summary.first()
    assert (s.prediction_records, s.matched, s.evaluation_failures, s.paired, s.complete, s.json_validity) == (5, 2, 3, 4, False, 0.2) and s.summary_field_accuracy == 0.5
    assert evaluation.evaluate_predictions(records_, "train", pairs, parsed, blocks, limit=1)[0].first().complete
    empty = evaluation.evaluate_predictions(records_.limit(0), "train", pairs, parsed, blocks)[0].first()
    assert empty.summary_field_accuracy is None and empty.complete is False and empty.evaluation_coverage == 0.0
    with pytest.raises(ValueError):
        evaluation.evaluate_predictions(records_, "test", pairs, parsed, blocks)


def test_metrics_compare_normalised_texts(spark):
    two = spark.createDataFrame([(1, "Ａ b", "AB"), (2, "", None), (3, "aab", "ab")], "k int, a string, b string")
    assert {r.k: round(r.f1, 6) for r in evaluation.character_f1(two, ["k"], "a", "b").collect()} == {1: 0.5, 2: 1.0, 3: 0.8}
    label = spark.createDataFrame([("l", {"总体评分": "90", "总体等级": "A级", "建议": "1条立即处置"}, "总体技术状况评分 88，总体技术状况等级为 B级", ["立即处置", "立即处置"])], "label_file string, summary map<string,string>, detail string, categories array<string>")
    issues = evaluation.consistency_issues(label)
    assert {(r.field, r.detail_value) for r in issues.collect()} == {("总体评分", "88"), ("总体等级", "B级"), ("建议", "2条立即处置、0条尽快维修、0条预防性养护")}
    assert tuple(evaluation.audit_counts(label, issues).first()) == (1, 1)


def test_names_of_reports(spark):
    c = F.col("p")
    assert _one(spark, X.report_code(c), p="x/０１-００１ 乙大桥.docx") == "01-001"
    assert _one(spark, X.bridge_key(c), p="01-001-乙大桥检测报告.docx") == "乙大桥"
    assert _one(spark, X.bridge_aliases(c), p="k1+200.docx") == ["k1+200"]
    assert _one(spark, X.bridge_aliases(c), p="甲长江公路大桥-k1+200.docx") == ["甲大桥-", "甲长江公路大桥-"]
    assert _one(spark, X.bridge_aliases(c), p="无名桥k1+200.docx") == ["无名桥k1+200"]
    names = ["r/赛题一_训练集/2013年/０１-００１ 乙河公路特大桥左幅.docx", "r/赛题一_训练集标签/2013年/01-001乙河公路特大桥左辐.docx"]
    pairs = pairing.pair_files(*pairing.inventory(spark.createDataFrame([(n,) for n in names], "path string")))[0].first()
    assert pairs.match_method == "unique_year_code_and_name" and pairs.name_similarity >= 0.85


def test_preparation_pairs_parses_and_splits(spark, tmp_path):
    names = [f"r/赛题一_训练集/2013年/{x}桥.docx" for x in "甲乙丙"] + [f"r/赛题一_训练集标签/2013年/{x}桥-无对比年度的信息提取报告.docx" for x in "甲乙丙丁"]
    files = [(n, bytearray(docx.document([[["字段", "示例"], ["桥梁名称", f"{x}桥"], ["总体评分", "9"]], "（1）详细结论", "总体技术状况评分 8"]))) for n, x in zip(names[3:5], "甲乙", strict=True)]
    files.append((names[5], bytearray(b"broken")))
    made = preparation.prepare_training(spark.createDataFrame([(n,) for n in names], "path string"), "seed", spark.createDataFrame(files, "path string, content binary"))
    s = made["summary"].first()
    assert (s.train_count, s.label_count, s.paired_count, s.unused_label_count, s.parsed_labels, s.label_parse_failures, s.label_consistency_flags, s.group_count) == (3, 4, 3, 1, 2, 1, 2, 3)
    assert s.training_reports + s.validation_reports == 3 and s.validation_reports == 1
    preparation.write_artefacts({k: made[k] for k in ("pairs", "summary")}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/pairs")).count() == 3


def test_results_are_laid_out_and_redacted(spark):
    done = extraction.extract_reports(_blocks(spark, [*REPORT, "检测结论 | 联系人：王小明，总体情况良好，各构件技术状况符合要求，建议按时养护并继续观察。经综合评定为优，结构安全可靠"]), _made())
    got = docx.parse(results.render_results(done).first().content)
    tables = {}
    for _, _, kind, table, _, cells in got:
        if kind == "table":
            tables.setdefault(table, []).append(cells)
    assert [len(t) for t in tables.values()] == [18, 3, 2] and [len(t[0]) for t in tables.values()] == [3, 4, 7]
    assert tables[2][1][1:5] == ["1号桥墩", "裂缝", "竖向裂缝", "无"] and "王小明" not in "".join(x[1] for x in got)
    blocked = spark.createDataFrame([("a.docx", None, "why 13812345678")], "file_name string, prediction string, error string")
    assert [x[1] for x in docx.parse(results.render_results(blocked).first().content)][2] == "错误信息：why [电话已脱敏]"


def test_resume_skips_what_is_broken(spark, tmp_path):
    path = tmp_path / "predictions.json"
    assert scans.resume_records(spark, str(path)).count() == 0
    path.write_text("{nope")
    assert scans.resume_records(spark, str(path)).count() == 0
    rows = [{"report_id": "a", "status": "success", "prediction": {"summary": "1"}}, {"report_id": "a", "status": "success", "prediction": {"summary": "2"}}, 7, {"report_id": "b", "status": "success", "prediction": {"zz": 1}}, {"report_id": "c", "status": "failed", "prediction": {}}, {"report_id": "d", "status": "success", "prediction": None}]
    path.write_text(json.dumps({"records": rows}))
    assert [(r.report_id, json.loads(r.record)["prediction"]["summary"]) for r in scans.resume_records(spark, str(path)).collect()] == [("a", "2")]


def test_caches_folders_and_failures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("b.Docx", "a.DOC", "c.docx", "d.txt"):
        (tmp_path / "in" / n).write_bytes(docx.document([n]))
    files = scans.folder(spark, str(tmp_path / "in"))
    assert [r.path.rsplit("/", 1)[1] for r in files.orderBy("after", "path").collect()] == ["b.Docx", "c.docx", "a.DOC"] and scans.folder(spark, str(tmp_path / "in"), limit=1).count() == 1
    blocks = docx.blocks(files)
    scans.write_cache(blocks, str(tmp_path / "cache"))
    assert {r.text for r in scans.cached_blocks(scans.read_cache(spark, str(tmp_path / "cache"))).collect()} == {"b.Docx", "c.docx"}
    with pytest.raises(Exception, match="no converter"):
        docx.blocks(files, fail_fast=True).collect()
    (tmp_path / "one.json").write_text('[{"report_id": "x", "file_name": "x.docx"}]')
    row = scans.parse_cache(spark, str(tmp_path / "one.json")).first()
    assert row.extension == ".docx" and row.blocks == []
    with pytest.raises(Exception, match="missing"):
        scans.parse_cache(spark, str(tmp_path / "one.json"), strict=True).collect()
    (tmp_path / "two.json").write_text('{"report_id": "x"}')
    with pytest.raises(ValueError):
        scans.parse_cache(spark, str(tmp_path / "two.json"))
    names = spark.createDataFrame([("a.docx",), ("a_结果.docx",), ("b.txt",)], "path string")
    assert [r.path for r in scans.result_files(names).collect()] == ["a.docx"]


def test_predictions_and_labels_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a.docx", "r", "success", "13812345678", "m", "e", "now")], "record_pos int, file_name string, report_id string, status string, note string, model string, error string, created_at string")
    sinks.write_predictions(rows, "src", "train", str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p/manifest")).first().success == 1 and spark.read.json(str(tmp_path / "p/records")).first().note == "[电话已脱敏]"
    sinks.write_standard(rows, str(tmp_path / "s"))
    assert set(spark.read.json(str(tmp_path / "s")).columns) == {"record_pos", "file_name", "report_id", "status", "note"}
    with pytest.raises(RuntimeError):
        sinks.check_outputs({"records": 2, "files": 1}, 2)
    (tmp_path / "r.json").write_text('{"split": "train", "records": [{"file_name": "a"}, {"file_name": "b"}]}')
    assert [r.file_name for r in scans.prediction_records(spark, str(tmp_path / "r.json"), "struct<file_name:string>").orderBy("record_pos").collect()] == ["a", "b"]
    listing, cache = spark.createDataFrame([("l", 7)], "label_file string, crc32 long"), spark.createDataFrame([("l", 7, "v1", "x"), ("l", 8, "v1", "y")], "label_file string, crc32 long, parser_version string, label string")
    assert [r.label for r in scans.reusable_labels(listing, cache, "v1").collect()] == ["x"] and scans.reusable_labels(listing, cache, "v2").count() == 0


def test_search_equals_the_postings(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé中文0_") for _ in range(rng.randint(1, 9)))
    rows = [(i % 5, i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(9, 1, None), (9, 2, "😀 Ab_c+d é")]
    blocks = spark.createDataFrame(rows, "report_id int, block_pos int, text string").withColumn("source_id", F.col("block_pos").cast("string"))
    asked = spark.createDataFrame([(i, " ".join(word() for _ in range(4))) for i in range(12)] + [(98, ""), (99, "ab_c+dé")], "query_id int, query string")
    retrieval.write_index(blocks, str(tmp_path / "index"))
    again, posts = retrieval.read_index(spark, str(tmp_path / "index"))
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "report_id", "block_pos", "score").collect())
    for within in (None, 3):
        assert rows(retrieval.search_batch(blocks, asked, 5, within)) == rows(retrieval.search_batch(again, asked, 5, within, posts)) != []
    found = retrieval.evidence(blocks, retrieval.search(blocks, "ab_c+dé", 1))
    assert found.groupBy().agg(retrieval.context_lines(found).alias("x")).first().x == "[2] 😀 Ab_c+d é"
    assert retrieval.search_batch(blocks, asked.filter("query_id = 98")).count() == 0 and retrieval.search_batch(blocks.limit(0), asked).count() == 0


@pytest.mark.parametrize("passes", [100_000, 20, 1])
def test_search_in_passes(spark, monkeypatch, passes):
    blocks = spark.createDataFrame([(1, i, f"text {i} of {i * 7}") for i in range(50)], "report_id int, block_pos int, text string")
    asked = spark.createDataFrame([(i, f"of {i * 7}") for i in range(6)], "query_id int, query string")
    want = sorted(tuple(r) for r in retrieval.search_batch(blocks, asked, 3).select("query_id", "rank", "block_pos", "score").collect())
    monkeypatch.setattr(retrieval, "MOST_GRAMS", passes)
    assert sorted(tuple(r) for r in retrieval.search_batch(blocks, asked, 3).select("query_id", "rank", "block_pos", "score").collect()) == want


def test_functions_by_name(spark):
    assert "docx_blocks" in sql.register(spark)
    row = spark.sql("select redact_text('联系人：王小明 13812345678') a, normalize_text(' x \t y') b, compact_text('A b') c, report_id('x') d, recommendation_category('日常') e").first()
    assert tuple(row) == ("联系人：[姓名已脱敏] [电话已脱敏]", "x y", "ab", "2d711642b726b044", "预防性养护")
    spark.createDataFrame([(bytearray(docx.document(REPORT)),)], "content binary").createOrReplaceTempView("files")
    assert spark.sql("select text from files, lateral docx_blocks(content) where kind = 'paragraph' order by block_pos").first().text == REPORT[0]


def test_records_merge_and_conclusions(spark):
    row = spark.sql("select map('a', 1, 'b', 2) x, map('b', cast(null as int), 'c', 3) y").select(records.merged(F.col("x"), F.col("y")).alias("m")).first()
    assert row.m == {"a": 1, "b": None, "c": 3}
    long = "经综合评定，" + "很" * 50
    assert records.conclusion(_blocks(spark, ["短检测结论", f"检测结论 | {long}", long])).first().summary == long
    assert [r.content for r in ordered.recommendation_rows(_blocks(spark, [[["序号", "建议类别", "建议内容"], ["1", "立即处置", "清理"], ["2", "立即处置", "清理"]]])).collect()] == ["清理"]
    assert len(_one(spark, X.utc_now(), a=1)) == 25 and _one(spark, X.utc_now(), a=1).endswith("+00:00")
    assert _one(spark, X.block_id(F.col("k"), F.col("i"), F.col("r")), k="table", i=1, r=2) == "table:1:2"


def test_components_of_a_long_chain_and_a_common_alias(spark):
    chain = [(i, [f"a{i}", f"a{i + 1}"]) for i in range(40)] + [(100 + i, ["all", f"x{i}"]) for i in range(200)] + [(999, [])]
    got = {r.n: r.component for r in pairing.alias_components(spark.createDataFrame(chain, "n long, names array<string>"), "n", "names").collect()}
    assert {got[i] for i in range(40)} == {0} and {got[100 + i] for i in range(200)} == {100} and got[999] == 999


def test_holdout_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(pairing, "MOST_SORTED", 10)
    rows = spark.createDataFrame([(f"g{i}",) for i in range(157)], "name string")
    got = pairing.holdout(rows, F.col("name"), "s").orderBy("rank", "identity").collect()
    assert [r.split for r in got] == ["validation"] * 31 + ["train"] * 126


def test_fuzzy_pairs_equal_brute_force(spark):
    import difflib

    rng = random.Random(3)
    rows = [("".join(rng.choice("abc") for _ in range(8)),) * 2 for _ in range(40)]
    made = spark.createDataFrame([(i, a, rows[(i + 1) % 40][0]) for i, (a, _) in enumerate(rows)], "k int, a string, b string")
    got = {r.k: r.ratio for r in made.select("k", pairing.sequence_ratio("a", "b").alias("ratio")).collect()}
    assert got == {i: difflib.SequenceMatcher(None, a, rows[(i + 1) % 40][0]).ratio() for i, (a, _) in enumerate(rows)}


def test_near_pairs_compare_a_name_once(spark):
    import difflib

    names = ["old plate", "cold plate", "hot ring", "hot gear", None, "", "straße 1", "strase 1"]
    rows = [(i, i % 3 or None, names[i * 7 % 8]) for i in range(96)]
    calls = spark.sparkContext.accumulator(0)
    real = pairing.sequence_ratio.func

    def counted(a, b):
        calls.add(len(a))
        return real(a, b)

    made = spark.createDataFrame(rows, "k int, g int, name string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pairing, "sequence_ratio", F.pandas_udf(counted, "double"))
        got = sorted(tuple(r) for r in pairing.near_pairs(made, ["g"], "k", "name").collect())
    ratio = lambda a, b: difflib.SequenceMatcher(None, a or "", b or "").ratio()
    assert got == [(i, j, ratio(a, b)) for i, g, a in rows for j, h, b in rows if i < j and g is not None and g == h and ratio(a, b) >= pairing.FUZZY]
    assert calls.value <= 2 * 7 * 7


def test_filling_pairs_distinct_texts_not_rows(spark):
    rows = spark.createDataFrame([(i % 2, i, ["deck north", "pier", None, ""][i % 4], ["crack", "wide crack", "rust"][i % 3], None) for i in range(600)], "report_id int, row_pos int, location string, disease_type string, development string")
    told = spark.createDataFrame([(j % 3, 500 - j, ["deck", "", "pier 2"][j % 3], ["", "rust", "crack"][j % 3] if j % 2 else None, None if j % 7 == 0 else f"d{j}") for j in range(500)], "report_id int, model_pos int, location string, disease_type string, development string")
    fits = lambda a, b: bool(a) and bool(b) and (a in b or b in a)
    told_rows = sorted(told.collect(), key=lambda m: m.model_pos)
    first = lambda r: next((m.development for m in told_rows if m.report_id == r.report_id and (fits(r.location, m.location) or fits(r.disease_type, m.disease_type))), None)
    filled = records.fill_from_model(rows, told, ["development"])
    assert {r.row_pos: r.development for r in filled.collect()} == {r.row_pos: first(r) for r in rows.collect()}
    plan = filled._jdf.queryExecution().executedPlan()
    filled.collect()
    sizes, stack = [], [plan]
    while stack:
        node = stack.pop()
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            sizes.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())] + ([node.executedPlan()] if "AdaptiveSparkPlan" in node.nodeName() else []) + ([node.plan()] if "QueryStage" in node.nodeName() else [])
    assert sizes and max(sizes) <= 600


def test_search_in_pieces_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdéß深") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    blocks = spark.createDataFrame([(i // 7, i % 7, t) for i, t in enumerate(texts)], "report_id long, block_pos long, text string").repartition(2)
    asked = spark.createDataFrame([(q, texts[q * 11] + " " + words[q]) for q in range(30)] + [(30, "zzz")], "query_id int, query string")
    grams = lambda df, c: {r[0]: set(r[1]) for r in df.select(c, X.ngrams(F.col("text" if "text" in df.columns else "query"))).collect()}
    held = grams(blocks.withColumn("i", F.col("report_id") * 7 + F.col("block_pos")), "i")
    want = set()
    for q, own in grams(asked, "query_id").items():
        df = {g: sum(g in h for h in held.values()) for g in own}
        scores = {i: sum(retrieval.SCALE // df[g] for g in own & h) for i, h in held.items() if own & h}
        want |= {(q, k + 1, i // 7, i % 7, scores[i]) for k, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:8])}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = {tuple(r) for r in retrieval.search_batch(blocks, asked).select("query_id", "rank", "report_id", "block_pos", "score").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_scores_are_exact_beyond_floats(monkeypatch):
    np = retrieval.np
    monkeypatch.setattr(retrieval, "DENSE", 1)
    for big in (1, 1 << 54):
        table = retrieval.Weights([(0, [0, 1, 2]), (1, [2])], np.array([5, big, 3]), np.array([9, 1, 1]))
        assert table.scores(np.array([0, 0, 2, 2]), np.array([0, 1, 1, 2]), 3).tolist() == [[5 + big, 0], [0, 0], [big + 3, 3]]


def test_large_steps_are_sorted_lists(monkeypatch):
    grams = ["ab", "abc", "bcd", "cd", "abcd", "tokens", "深度"]
    texts = ["abcd", "", "xcdx", "a深度b", "tokens,ab"]
    want = [(i, k) for i, t in enumerate(texts) for k, g in enumerate(grams) if g in t]
    for most in (retrieval.MOST_STEPS, 1):
        monkeypatch.setattr(retrieval, "MOST_STEPS", most)
        assert list(zip(*(x.tolist() for x in retrieval.GramTable(grams).found(texts)))) == want


def test_lines_are_normalized_once_and_hits_are_broadcast(spark, tmp_path):
    from trestle.plans import catalogue

    spark.createDataFrame([(1, "a\u2003 b\t c\n\u2003\n\n x ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    blocks = catalogue.line_blocks(spark, str(tmp_path))
    assert [tuple(r) for r in blocks.select("block_pos", "text").collect()] == [(0, "a\u2003 b c"), (3, "x")]
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("trim") == 1
    hits = spark.range(3).select(F.col("id").alias("report_id"), F.lit(0).cast("long").alias("block_pos"))
    assert "ResolvedHint (strategy=broadcast)" in retrieval.evidence(blocks, hits, few=True)._jdf.queryExecution().analyzed().toString()


def test_top_grams_equal_counting_all(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("aab cé深-") for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["zz token-9 zz"] * 90
    blocks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "report_id long, block_pos long, text string").repartition(3)
    want = retrieval.document_frequency(retrieval.postings(blocks)).orderBy(F.desc("df"), "gram").collect()
    for n in (1, 20, 60, 5000):
        made = retrieval.top_grams(blocks, n)
        assert made.collect() == want[:n] and "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_word_files_are_handed_on_in_small_batches(monkeypatch):
    rows = ((f"f{i}", b"x" * 1000) for i in range(5000))
    made = list(docx._bounded(rows, docx.FILES))
    assert sum(b.num_rows for b in made) == 5000 and max(b.nbytes for b in made) < 2 * docx.PIECE
    whole = docx.pa.RecordBatch.from_pylist([{"a": i} for i in range(100)])
    assert [len(x) for x in docx._slices([whole])] == [16] * 6 + [4]


def test_ideographs_need_no_python(spark, monkeypatch):
    import re
    import unicodedata

    kept = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and re.search(X.STABLE, chr(c))]
    assert len(kept) > 20_000 and unicodedata.normalize("NFKC", "".join(kept)) == "".join(kept)
    fails = F.udf(lambda v: 1 / 0 if v is not None else None, "string")
    monkeypatch.setattr(X, "_nfkc", fails)
    assert _one(spark, X.comparable(F.col("a")), a="2 条立即处置、0条。") == "2条立即处置、0条。"
