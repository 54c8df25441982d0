"""The text functions by name in SQL, and Word files as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from trestle.functions.text import CATEGORIES, MASKS, WS
from trestle.sources.docx import parse


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(value: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        value = f"regexp_replace({value}, {_quoted(pattern)}, {_quoted(by)})"
    return value


def _strip(value: str) -> str:
    return _replaced(value, [(f"^{WS}+|{WS}+$", "")])


#: name -> (type of the result, body over the argument ``s``); expressions, so that they fold into the calling query.
FUNCTIONS = {
    "normalize_text": ("STRING", _strip(_replaced("coalesce(s, '')", [("\u00a0", " "), (r"[ \t\r\f\x0B]+", " "), (r"\n{3,}", "\n\n")]))),
    "compact_text": ("STRING", _replaced("lower(coalesce(s, ''))", [(f"{WS}+", "")])),
    "redact_text": ("STRING", _replaced("s", MASKS)),
    "recommendation_category": (
        "STRING",
        f"CASE WHEN contains(s, '立即') OR contains(s, '应急') THEN '{CATEGORIES[0]}' WHEN contains(s, '日常') OR contains(s, '加强') OR contains(s, '标识') OR contains(s, '规范') THEN '{CATEGORIES[2]}' ELSE '{CATEGORIES[1]}' END",
    ),
    "report_id": ("STRING", "substring(sha2(s, 256), 1, 16)"),
}


@udtf(returnType="block_pos int, source_id string, text string, kind string, table_index int, row_index int, cells array<string>")
class DocxBlocks:
    """``SELECT .. FROM files, LATERAL docx_blocks(content)``: the blocks of a Word file's bytes."""

    def eval(self, content: bytes):
        for k, (source_id, text, kind, table, row, cells) in enumerate(parse(bytes(content)) if content is not None else ()):
            yield k, source_id, text, kind, table, row, cells


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {body}")
    spark.udtf.register("docx_blocks", DocxBlocks)
    return [*FUNCTIONS, "docx_blocks"]
