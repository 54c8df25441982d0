"""Reports to records: what a model reads, corrected by what stands in the report, checked and tied to its evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.operators import model, ordered, records
from trestle.operators.pairing import checkpointed
from trestle.operators.schema import DETAIL_TEXTS, DISEASE, DISEASE_TEXTS, EVIDENCE, OTHERS, TEXT_LISTS, TEXTS, record, record_error, record_json

QUOTE = 1200
#: Parts asked for: system prompt, tokens; and what is asked when that gave no JSON.
PARTS = {
    "summary": ("Read the report's fragments and return one JSON object with the keys " + ", ".join([*TEXTS, "inspection_year", "overall_score", "component_scores", "key_risks"]) + ". Copy values; unknown values are null.", 256),
    "detail": ("Read the report's fragments and return one JSON object with the keys " + ", ".join([*TEXT_LISTS[1:], *OTHERS[3:]]) + f". Each of diseases has {', '.join(DISEASE_TEXTS)}, is_new, evidence_ids; each of recommendation_details has {', '.join(DETAIL_TEXTS)}; each of evidence has source_id and a quote copied from that fragment.", 512),
}
FALLBACK = ("Return the JSON object {} and nothing else.", 64)
VALUES = "map<string,variant>"


def _told(users: DataFrame, backend: Callable, part: str) -> DataFrame:
    """``report_id`` and, by part, the JSON that the model gave for it, an ``error`` if even the short prompt failed."""
    system, most = PARTS[part]
    ask = lambda rows, text, n, c: model.generate(rows.select(F.col("report_id").alias("id"), F.lit(text).alias("system"), F.col(c).alias("user"), F.lit(n).alias("max_tokens")), backend)
    first = checkpointed(ask(users, system, most, "user"))
    again = users.join(first.filter("value is null").select("id"), F.col("report_id") == F.col("id"), "left_semi")
    second = checkpointed(ask(again, FALLBACK[0], FALLBACK[1], "brief"))
    both = first.filter("value is not null").unionByName(second)
    return both.select(F.col("id").alias(f"id_{part}"), F.col("value").alias(part), F.col("error").alias(f"{part}_error"), F.col("model").alias(f"{part}_model"))


def table_diseases(blocks: DataFrame, detail: DataFrame) -> DataFrame:
    """``report_id``, ``diseases``: rows of the report's own tables; what they leave open is taken from the model's rows
    (``detail``: report_id, detail as JSON) that fit."""
    own = ordered.disease_rows(blocks).withColumn("row_pos", F.col("table_index").cast("long") * 2**31 + F.coalesce("row_index", F.lit(-1)))
    own = own.select("report_id", "row_pos", "source_id", "location", "disease_type", "description", "is_new", "previous_status", "development", F.lit(None).cast("string").alias("measurement"))
    item = F.try_variant_get(F.try_parse_json("detail"), "$.diseases", "array<variant>")
    rows = detail.select("report_id", F.posexplode(item).alias("model_pos", "v"))
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string").alias(k)
    guesses = rows.select("report_id", "model_pos", text("location"), text("disease_type"), F.try_variant_get("v", "$.is_new", "boolean").alias("is_new"), *[text(k) for k in ("previous_status", "development", "measurement")])
    full = records.fill_from_model(own, guesses, ["is_new", "previous_status", "development", "measurement"])
    one = F.struct(*[F.col(k) for k in ("location", "disease_type", "description", "is_new", "previous_status", "development", "measurement")], F.array("source_id").alias("evidence_ids"))
    return full.groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_pos", one.alias("d")))), lambda x: x["d"]).alias("diseases"))


def clean_record(r: Column, sources: Column) -> Column:
    """A typed record tied to its report (``sources``: source_id -> text): evidence of known sources, the first of each,
    wrong quotes repaired; ids of unknown sources and repeated rows go; evidence that rows refer to is added."""
    known = lambda s: F.try_element_at(sources, s)
    listed = F.filter(r["evidence"], lambda e: known(e["source_id"]).isNotNull())
    ids = lambda es: F.transform(es, lambda e: e["source_id"])
    once = F.filter(listed, lambda e, i: F.array_position(ids(listed), e["source_id"]) == i + 1)
    right = lambda e: (F.length(e["quote"]) > 0) & F.contains(known(e["source_id"]), e["quote"])
    quoted = F.transform(once, lambda e: e.withField("quote", F.when(right(e), e["quote"]).otherwise(F.substring(known(e["source_id"]), 1, QUOTE))))
    diseases = F.array_distinct(F.transform(r["diseases"], lambda d: d.withField("evidence_ids", F.array_distinct(F.filter(d["evidence_ids"], lambda s: known(s).isNotNull())))))
    lack = F.filter(F.array_except(F.flatten(F.transform(diseases, lambda d: d["evidence_ids"])), ids(quoted)), lambda s: F.length(known(s)) > 0)
    none = F.lit(None).cast("int")
    added = F.transform(lack, lambda s: F.struct(s.alias("source_id"), F.substring(known(s), 1, QUOTE).alias("quote"), F.lit("table").alias("kind"), none.alias("table_index"), none.alias("row_index"), none.alias("page")).cast(EVIDENCE))
    out = r.withField("evidence", F.concat(quoted, added)).withField("diseases", diseases.cast(f"array<{DISEASE}>"))
    for name in ("key_risks", "recommendations", "standards"):
        out = out.withField(name, F.array_distinct(r[name]))
    return out


def extract_reports(blocks: DataFrame, backend: Callable) -> DataFrame:
    """``report_id``, ``file_name``, ``status``, ``prediction`` (JSON), ``error``, ``model`` of every report in ``blocks``.

    Precedence by key: the model's summary, its details, facts that the text states, then whole tables and lists of the
    report. A report without an answer, or with one that breaks the format, is ``blocked``.
    """
    reports = blocks.select("report_id", "file_name").distinct()
    hints = records.metadata_hints(blocks).select(F.col("report_id").alias("h2"), F.to_json(F.struct("inspection_date_hint", "inspection_year", "report_number_hint", "bci_hint")).alias("hints"))
    pack = ordered.context_pack(blocks).select(F.col("report_id").alias("c2"), "context")
    users = reports.join(hints, F.col("report_id") == F.col("h2"), "left").join(pack, F.col("report_id") == F.col("c2"), "left")
    whole = F.to_json(F.struct("file_name", F.col("hints").alias("source_metadata_hints"), F.coalesce("context", F.lit("")).alias("report_fragments")))
    users = checkpointed(users.select("report_id", "file_name", whole.alias("user"), F.to_json(F.struct(F.col("file_name").alias("report_file"))).alias("brief")))
    out = users.select("report_id", "file_name")
    for part in PARTS:
        out = out.join(_told(users, backend, part), F.col("report_id") == F.col(f"id_{part}"), "left")
    facts = records.source_facts(blocks).join(records.conclusion(blocks), "report_id", "left")
    stated = facts.select(F.col("report_id").alias("f2"), F.to_json(F.struct(*[F.col(c) if c != "component_scores" else F.when(F.size(c) > 0, F.col(c)).alias(c) for c in facts.columns if c != "report_id"])).alias("facts"))
    tables = table_diseases(blocks, out.filter("detail is not null").select("report_id", "detail")).withColumnRenamed("report_id", "t2")
    told = ordered.source_recommendations(blocks).select(F.col("report_id").alias("r2"), "recommendations")
    listed = ordered.recommendation_rows(blocks).groupBy(F.col("report_id").alias("l2")).agg(F.transform(F.array_sort(F.collect_list(F.struct("table_index", "row_index", "content"))), lambda x: x["content"]).alias("listed"))
    texts = blocks.groupBy(F.col("report_id").alias("s2")).agg(F.map_from_entries(F.collect_list(F.struct("source_id", "text"))).alias("sources"))
    for side, key in ((stated, "f2"), (tables, "t2"), (told, "r2"), (listed, "l2"), (texts, "s2")):
        out = out.join(side, F.col("report_id") == F.col(key), "left")
    values = lambda c: F.from_json(F.coalesce(c, F.lit("{}")), VALUES)
    lists = F.to_json(F.struct(F.col("diseases"), F.when(F.size("recommendations") > 0, F.col("recommendations")).otherwise(F.col("listed")).alias("recommendations")))
    payload = F.to_json(records.merged(*[values(F.col(c)) for c in ("summary", "detail", "facts")], values(lists)))
    out = checkpointed(out.withColumn("payload", F.when(F.col("summary").isNotNull() & F.col("detail").isNotNull(), payload)))
    error = F.coalesce("summary_error", "detail_error", F.when(F.col("payload").isNotNull(), record_error(F.col("payload"))))
    done = out.withColumn("why_", error).withColumn("clean_", F.when(F.col("why_").isNull(), record_json(clean_record(record(F.col("payload")), F.col("sources")))))
    latency = F.map_filter(F.create_map(F.lit("detail_latency_ms"), F.try_element_at("detail_model", F.lit("latency_ms"))), lambda k, v: v.isNotNull())
    return done.select(
        "report_id", "file_name", F.when(F.col("why_").isNull(), "success").otherwise("blocked").alias("status"), F.col("clean_").alias("prediction"),
        F.coalesce("why_", F.lit("")).alias("error"), records.merged(F.col("summary_model"), latency).alias("model"),
    )
