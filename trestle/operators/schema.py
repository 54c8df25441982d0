"""The record of a report: its typed form, and the strict check of JSON that claims to be one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trestle.operators.records import lenient_number

# Field names and order of the record format.
TEXTS = ["bridge_name", "report_number", "inspection_date", "overall_grade", "previous_overall_score", "previous_overall_grade", "disease_trend", "summary"]
TEXT_LISTS = ["key_risks", "detailed_conclusion", "disease_causes", "disposal_recommendations", "safety_impacts", "recommendations", "standards"]
OTHERS = ["inspection_year", "overall_score", "component_scores", "diseases", "recommendation_details", "evidence"]
DISEASE_TEXTS = ["location", "disease_type", "description", "previous_status", "development", "measurement"]
DETAIL_TEXTS = ["category", "content", "location"]
EVIDENCE_KEYS = ["source_id", "quote", "kind", "table_index", "row_index", "page"]
EVIDENCE = "struct<source_id:string,quote:string,kind:string,table_index:int,row_index:int,page:int>"
DISEASE = "struct<location:string,disease_type:string,description:string,is_new:boolean,previous_status:string,development:string,measurement:string,evidence_ids:array<string>>"
DETAIL = "struct<category:string,content:string,location:string>"
RECORD = (
    "struct<bridge_name:string,report_number:string,inspection_date:string,inspection_year:int,overall_score:double,overall_grade:string,"
    "component_scores:map<string,string>,previous_overall_score:string,previous_overall_grade:string,disease_trend:string,summary:string,key_risks:array<string>,"
    "detailed_conclusion:array<string>,disease_causes:array<string>,disposal_recommendations:array<string>,safety_impacts:array<string>,"
    f"diseases:array<{DISEASE}>,recommendations:array<string>,recommendation_details:array<{DETAIL}>,standards:array<string>,evidence:array<{EVIDENCE}>>"
)


def _kind(item: Column, path: str) -> Column:
    """The type of a variant's part as text; null where it is absent."""
    return F.schema_of_variant(F.try_variant_get(item, path, "variant"))


def _unknown(item: Column, allowed: list[str]) -> Column:
    """Names of an object's keys beyond ``allowed``."""
    keys = F.json_object_keys(F.to_json(item))
    return F.array_join(F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))), ", ")


def _bad(*checks: tuple[Column, Column | str]) -> Column:
    """The message of the first check that holds; null if none does."""
    out = F.lit(None).cast("string")
    for wrong, message in reversed(checks):
        out = F.when(wrong, F.lit(message) if isinstance(message, str) else message).otherwise(out)
    return out


def _not_text(item: Column, path: str) -> Column:
    return ~F.coalesce(_kind(item, path), F.lit("VOID")).isin("STRING", "VOID")


def _not_object(item: Column) -> Column:
    return ~F.startswith(F.schema_of_variant(item), F.lit("OBJECT"))


def _items_error(v: Column, key: str, item_error) -> Column:
    """A list of objects, or absent: the first complaint about the list or one of its items."""
    kind = F.coalesce(_kind(v, f"$.{key}"), F.lit("VOID"))
    items = F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
    first = F.get(F.filter(F.transform(items, item_error), lambda e: e.isNotNull()), 0)
    return F.when(kind != "VOID", F.when(F.startswith(kind, F.lit("ARRAY")), first).otherwise(F.lit(f"{key} must be a list")))


def _disease_error(d: Column) -> Column:
    ids = F.coalesce(F.try_variant_get(d, "$.evidence_ids", "array<variant>"), F.array().cast("array<variant>"))
    kind = _kind(d, "$.evidence_ids")
    return _bad(
        (_not_object(d), "each of diseases must be an object"),
        (_unknown(d, [*DISEASE_TEXTS, "is_new", "evidence_ids"]) != "", F.concat(F.lit("unknown keys in disease: "), _unknown(d, [*DISEASE_TEXTS, "is_new", "evidence_ids"]))),
        (kind.isNotNull() & ~F.startswith(kind, F.lit("ARRAY")), "disease.evidence_ids must be a list"),
        *[(_not_text(d, f"$.{k}"), f"disease.{k} must be a string or null") for k in DISEASE_TEXTS],
        (~F.coalesce(_kind(d, "$.is_new"), F.lit("VOID")).isin("BOOLEAN", "VOID"), "disease.is_new must be true, false or null"),
        (F.exists(ids, lambda x: F.schema_of_variant(x) != "STRING"), "disease.evidence_ids must hold strings only"),
    )


def _detail_error(d: Column) -> Column:
    return _bad(
        (_not_object(d), "each of recommendation_details must be an object"),
        (_unknown(d, DETAIL_TEXTS) != "", F.concat(F.lit("unknown keys in recommendation_details: "), _unknown(d, DETAIL_TEXTS))),
        *[(_not_text(d, f"$.{k}"), f"recommendation_details.{k} must be a string or null") for k in DETAIL_TEXTS],
    )


def _evidence_error(e: Column) -> Column:
    told = lambda k: F.coalesce(_kind(e, f"$.{k}"), F.lit("")) == "STRING"
    return _bad(
        (_not_object(e), "each of evidence must be an object"),
        (_unknown(e, EVIDENCE_KEYS) != "", F.concat(F.lit("unknown keys in evidence: "), _unknown(e, EVIDENCE_KEYS))),
        (~(told("source_id") & told("quote")), "evidence.source_id and evidence.quote must be strings"),
    )


def record_error(payload: Column) -> Column:
    """The first complaint about a record in JSON, nested parts included; null if there is none. Scores and years that
    can't be read are no complaint: they become null."""
    v = F.try_parse_json(payload)
    kind = lambda k: F.coalesce(_kind(v, f"$.{k}"), F.lit("VOID"))
    entries = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "array<variant>"), F.array().cast("array<variant>"))
    known = [*TEXTS, *TEXT_LISTS, *OTHERS]
    return F.coalesce(
        _bad((F.coalesce(_not_object(v), F.lit(True)), "record must be an object"), (_unknown(v, known) != "", F.concat(F.lit("unknown keys: "), _unknown(v, known)))),
        *[_bad((_not_text(v, f"$.{k}"), f"{k} must be a string or null")) for k in TEXTS],
        _items_error(v, "diseases", _disease_error), _items_error(v, "recommendation_details", _detail_error), _items_error(v, "evidence", _evidence_error),
        *[_bad(((kind(k) != "VOID") & (~F.startswith(kind(k), F.lit("ARRAY")) | F.exists(entries(k), lambda x: F.schema_of_variant(x) != "STRING")), f"{k} must be a list of strings")) for k in TEXT_LISTS],
    )


def record(payload: Column) -> Column:
    """The typed record of JSON that has no :func:`record_error`, with its defaults: absent lists are empty, evidence
    without a source or a quote goes, blank evidence ids go, a score or a year that can't be read is null."""
    r = F.from_json(payload, RECORD)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    lists = {k: empty(r[k], "array<string>") for k in TEXT_LISTS}
    diseases = F.transform(empty(r["diseases"], f"array<{DISEASE}>"), lambda d: d.withField("evidence_ids", F.filter(empty(d["evidence_ids"], "array<string>"), lambda x: F.length(x) > 0)))
    quoted = F.filter(empty(r["evidence"], f"array<{EVIDENCE}>"), lambda e: (F.length(e["source_id"]) > 0) & (F.length(e["quote"]) > 0))
    made = {
        **lists, "diseases": diseases, "evidence": F.transform(quoted, lambda e: e.withField("kind", F.coalesce(e["kind"], F.lit("paragraph")))),
        "recommendation_details": empty(r["recommendation_details"], f"array<{DETAIL}>"), "component_scores": F.coalesce(r["component_scores"], F.create_map().cast("map<string,string>")),
        "overall_score": lenient_number(payload, "overall_score", "double"), "inspection_year": lenient_number(payload, "inspection_year", "int"),
    }
    names = [x.split(":")[0] for x in _fields(RECORD)]
    return F.struct(*[made.get(n, r[n]).alias(n) for n in names])


def _fields(ddl: str) -> list[str]:
    """Top-level fields of a struct's type."""
    out, depth, at = [], 0, 0
    body = ddl[len("struct<") : -1]
    for k, ch in enumerate(body):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(body[at:k])
            at = k + 1
    return [*out, body[at:]]


def record_json(typed: Column) -> Column:
    """A typed record as JSON in the fixed order; nulls stay, but for evidence."""
    evidence = F.transform(typed["evidence"], lambda e: F.parse_json(F.to_json(e)))
    return F.to_json(F.struct(*[(evidence if n == "evidence" else typed[n]).alias(n) for n in (x.split(":")[0] for x in _fields(RECORD))]), {"ignoreNullFields": "false"})
