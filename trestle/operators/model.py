"""The model stage: a pluggable backend, JSON extraction, and question answering over evidence."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.operators import retrieval
from trestle.operators.pairing import checkpointed

#: Hits that are handed to all tasks.
FEW = 500_000
ANSWER = "status string, answer string, confidence string, cited array<string>, error string"
FENCE = r"(?is)```(?:json)?\s*(.*?)```"
THOUGHT = r"(?is)<think>.*?</think>"


class ModelUnavailable(RuntimeError):
    """No backend, no weights or no libraries: rows are blocked, not failed."""


def extract_json(text: str) -> dict:
    """The first JSON object in a model's answer: its thoughts left out, what is fenced before what is not."""
    bare, read = re.sub(THOUGHT, "", text), json.JSONDecoder()
    for part in [*re.findall(FENCE, bare), bare]:
        for start in (m.start() for m in re.finditer(r"\{", part)):
            try:
                return read.raw_decode(part, start)[0]
            except ValueError:
                continue
    raise ValueError("no JSON object")


def json_text(column: Column) -> Column:
    """The text from the first to the last brace of an answer, fenced or bare, as a column; null if there is none."""
    bare = F.regexp_replace(column, THOUGHT, "")
    fenced = F.regexp_extract(bare, FENCE, 1)
    return F.nullif(F.regexp_extract(F.when(F.contains(fenced, F.lit("{")), fenced).otherwise(bare), r"(?s)(\{.*\})", 1), F.lit(""))


def _ask(model, system: str, user: str, most: int) -> str:
    """A backend may take the token limit or not."""
    try:
        return model(system, user, most)
    except TypeError:
        return model(system, user)


def generate(prompts: DataFrame, backend: Callable[[], Callable[[str, str, int], str]], retries: int = 2) -> DataFrame:
    """``id``, ``value`` (JSON), ``error`` and ``model`` (the backend's ``metadata``, and the seconds taken) for prompts
    (id, system, user, max_tokens). The backend is made once a task; an answer without JSON is asked for again."""

    def each(batches):
        model, why = None, ""
        try:
            model = backend()
        except Exception as e:
            why = f"{type(e).__name__}: {e}"
        about = {str(k): str(v) for k, v in getattr(model, "metadata", {}).items()}
        for batch in batches:
            out = []
            for key, system, user, most in batch[["id", "system", "user", "max_tokens"]].itertuples(index=False):
                value, error, began = None, why, time.monotonic()
                for k in range(1 + retries if model else 0):
                    try:
                        told = _ask(model, system + ("\nOnly one JSON object." if k else ""), user, int(most))
                        value, error = json.dumps(extract_json(told), ensure_ascii=False), None
                        break
                    except ValueError as e:
                        error = f"{type(e).__name__}: {e}"
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        break
                out.append((key, value, error, {**about, "latency_ms": str(round(1000 * (time.monotonic() - began)))} if model else about))
            yield pd.DataFrame(out, columns=["id", "value", "error", "model"])

    return prompts.mapInPandas(each, "id string, value string, error string, model map<string,string>")


def answers(blocks: DataFrame, questions: DataFrame, backend, k: int = 12, posts: DataFrame | None = None, shown: str = "query") -> DataFrame:
    """Per question (query_id, query): status, answer, confidence, and the cited evidence, always with its report.
    ``shown``: the column that the model reads, where it differs from what is searched for."""
    # k rows a question: cut, so that the search runs once, and their number is known before their blocks are read
    found = checkpointed(retrieval.search_batch(blocks, questions, k, posts=posts))
    hits = retrieval.evidence(blocks, found, few=found.count() <= FEW)
    # cut again for the prompts and the check of what they cite
    hits = checkpointed(hits.withColumn("address", F.concat_ws("/", "report_id", "source_id")))
    given = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("address"), F.lit("] "), F.col("quote")).alias("line"))))
    packed = hits.groupBy("query_id").agg(F.array_join(F.transform(given, lambda x: x["line"]), "\n").alias("evidence"))
    asked = questions.join(packed, "query_id", "left")
    system = "Answer from the evidence lines only, in JSON: answer, confidence (high, medium, low), evidence_ids."
    user = F.concat(F.lit("Question: "), F.col(shown), F.lit("\nEvidence:\n"), F.col("evidence"))
    prompts = asked.filter("evidence is not null").select(F.col("query_id").cast("string").alias("id"), F.lit(system).alias("system"), user.alias("user"), F.lit(512).alias("max_tokens"))
    told = generate(prompts, backend).drop("model")
    got = asked.join(told, F.col("query_id").cast("string") == F.col("id"), "left")
    confidence = F.get_json_object("value", "$.confidence")
    cited = F.coalesce(F.from_json(F.get_json_object("value", "$.evidence_ids"), "array<string>"), F.array().cast("array<string>"))
    out = got.select(
        "query_id", F.when(F.col("evidence").isNull(), "no_evidence").when(F.col("value").isNull(), "blocked").otherwise("success").alias("status"),
        F.coalesce(F.get_json_object("value", "$.answer"), F.lit("")).alias("answer"), F.when(confidence.isin("high", "medium", "low"), confidence).otherwise("low").alias("confidence"),
        cited.alias("cited"), "error",
    )
    valid = hits.groupBy("query_id").agg(F.collect_set("address").alias("known"))
    kept = F.coalesce(F.filter("cited", lambda x: F.array_contains("known", x)), F.array().cast("array<string>"))
    return out.join(valid, "query_id", "left").withColumn("cited", kept).drop("known")
