"""Column functions over text. All stay in the JVM but :func:`nfkc` off :data:`STABLE`."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it, and the four separators that Java's class leaves out.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same, one by one.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Texts that NFKC leaves as they are: ASCII, the unified ideographs and their comma and stop; none of these joins another.
STABLE = r"^[\x00-\x7F\u3001\u3002\u4e00-\u9fff]*$"
GRAM_SIZES = (2, 3, 4)

# Labels, categories and patterns that the data format prescribes.
CATEGORIES = ["立即处置", "尽快维修", "预防性养护"]
SENSITIVE_KEYS = [
    "phone", "mobile", "email", "address", "contact", "reviewer", "approver", "联系人", "责任人", "负责人", "检测人员", "检查人员",
    "报告编制人", "编制人", "复核人", "审核人", "批准人", "签字人", "姓名", "电话", "手机", "邮箱", "地址",
]
PERSON_LABELS = "联系人|责任人|负责人|检测人员|检查人员|报告编制人|编制人|复核人|审核人|批准人|签字人|姓名"
ADDRESS_LABELS = "联系地址|通讯地址|收件地址|家庭住址|现住址|住址"
MASKS = [
    (r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])", "[电话已脱敏]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[邮箱已脱敏]"),
    (r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])", "[证件号已脱敏]"),
    (rf"((?:{PERSON_LABELS}){WS}*[:：]{WS}*)[\u4e00-\u9fff]{{2,4}}", "$1[姓名已脱敏]"),
    (rf"((?:{ADDRESS_LABELS}){WS}*[:：]{WS}*)[^，,；;\r\n。]{{3,80}}", "$1[地址已脱敏]"),
]
SPLIT_MARKERS = {"test": "/初赛测试集/", "train": "/赛题一_训练集/", "labels": "/赛题一_训练集标签/"}


def chained(column: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, column)


def strip(column: Column) -> Column:
    return F.regexp_replace(column, rf"^{WS}+|{WS}+$", "")


def normalize_text(column: Column) -> Column:
    """No-break spaces and runs of blanks to one space, at most one empty line in a row, stripped; null is ''."""
    c = F.coalesce(column, F.lit(""))
    # patterns only where there is something to change: most lines have single blanks, which cost a match each
    odd = reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in ("\u00a0", "  ", "\t", "\r", "\f", "\x0b", "\n\n\n")])
    told = F.when(odd, chained(c, ("\u00a0", " "), (r"[ \t\r\f\x0B]+", " "), (r"\n{3,}", "\n\n"))).otherwise(c)
    return F.btrim(told, F.lit(SPACES))


def compact(column: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), f"{WS}+", "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def ngrams(column: Column) -> Column:
    """Distinct 2- to 4-character grams of the compact text, and its ASCII tokens."""
    none = F.array().cast("array<string>")

    def grams(ch: Column) -> Column:
        one = lambda n: F.when(
            F.size(ch) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(ch) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(ch, i, n), ""))
        ).otherwise(none)
        return F.concat(*[one(n) for n in GRAM_SIZES])

    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    tokens = lambda c: F.regexp_extract_all(c, F.lit(r"([a-z0-9_+.-]{2,})"), F.lit(1))
    return F.array_distinct(bound(compact(column), lambda c: F.concat(bound(chars(c), grams), tokens(c))))


def numbered_items(column: Column) -> Column:
    found = F.regexp_extract_all(column, F.lit(rf"(?:^|[\r\n；;]){WS}*[（(]?(?U:\d)+[）).、.]{WS}*([^\r\n；;]+)"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def label_cells(text: Column, cells: Column) -> Column:
    """Cells as stored, else the text's parts; blanks stay."""
    return F.coalesce(cells, F.transform(F.split(text, r"\|"), strip))


def row_cells(text: Column) -> Column:
    """Parts of a row's text without blanks and without repeats side by side (merged cells)."""
    full = F.filter(F.transform(F.split(text, r"\|"), strip), lambda x: x != "")
    return bound(full, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.coalesce(F.get(a, i - 1), F.lit("")))))


def redact_text(column: Column) -> Column:
    return chained(column, *MASKS)


def is_sensitive(key: str) -> bool:
    return any(k in key.lower() for k in SENSITIVE_KEYS)


def redact_value(column: Column, kind: T.DataType, key: str = "", strict: bool = False) -> Column:
    """Redact along a type: a string under a sensitive key whole, other strings by pattern; list items take the key.

    Fields of a nested struct, and keys of a map, are judged by their own names only. ``strict`` also hides numbers
    under sensitive keys.
    """
    if isinstance(kind, T.StringType):
        return F.when(column.isNotNull(), F.lit("[已脱敏]")) if is_sensitive(key) else redact_text(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: redact_value(x, kind.elementType, key, strict))
    if isinstance(kind, T.StructType):
        fields = [redact_value(column[f.name], f.dataType, f.name, strict).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        hit = lambda k: reduce(lambda a, s: a | F.contains(F.lower(k), F.lit(s)), SENSITIVE_KEYS, F.lit(False))
        return F.transform_values(column, lambda k, v: F.when(v.isNull(), v).when(hit(k), F.lit("[已脱敏]")).otherwise(redact_text(v)))
    return F.lit(None).cast(kind) if strict and is_sensitive(key) else column


def redact_row(df):
    """Every column of ``df`` redacted by its name and type."""
    return df.select(*[redact_value(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def displayed(column: Column, kind: T.DataType) -> Column:
    """Text for a result table: missing, yes / no, joined lists, and redacted strings."""
    if isinstance(kind, T.BooleanType):
        return F.when(column.isNull(), "无").when(column, "是").otherwise("否")
    if isinstance(kind, T.ArrayType):
        items = F.array_join(F.transform(column, lambda x: displayed(x, kind.elementType)), "；")
        return F.when(column.isNull(), "无").when(F.size(column) == 0, "未提取").otherwise(items)
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("："), displayed(e["value"], kind.valueType)))
        return F.when(column.isNull(), "无").when(F.size(column) == 0, "未提取").otherwise(F.array_join(pairs, "；"))
    return F.coalesce(redact_text(column.cast("string")), F.lit("无"))


def recommendation_category(column: Column) -> Column:
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(column, F.lit(w)) for w in words])
    return F.when(has("立即", "应急"), CATEGORIES[0]).when(has("日常", "加强", "标识", "规范"), CATEGORIES[2]).otherwise(CATEGORIES[1])


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def result_name(path: Column) -> Column:
    return F.concat(file_stem(path), F.lit(".docx"))


def utc_now() -> Column:
    """The time in UTC to the second, whatever the session's zone."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.concat(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def report_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def block_id(kind: Column, index: Column, row: Column) -> Column:
    return F.concat_ws(":", kind, index.cast("string"), row.cast("string"))


def matches_split(path: Column, split: str) -> Column:
    p = F.concat(F.lit("/"), F.regexp_replace(path, r"\\", "/"))
    if split not in SPLIT_MARKERS:
        return F.lit(True)
    hit = F.contains(p, F.lit(SPLIT_MARKERS[split]))
    return hit & ~F.contains(p, F.lit(SPLIT_MARKERS["labels"])) if split == "train" else hit


def year_of(path: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p.rlike("^20[0-9]{2}年$"))
    return F.coalesce(F.get(parts, 0), F.lit(""))


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in v])


def nfkc(column: Column) -> Column:
    """NFKC; texts that it can't change never leave the JVM: Python is handed a null for them."""
    plain = column.rlike(STABLE)
    return F.when(column.isNull() | plain, column).otherwise(_nfkc(F.when(~plain, column)))


def nfkc_each(column: Column) -> Column:
    """NFKC of each string of a list; lists of texts that it can't change never leave the JVM."""
    plain = F.forall(column, lambda x: F.coalesce(x, F.lit("")).rlike(STABLE))
    return F.when(column.isNull() | plain, column).otherwise(_nfkc_each(F.when(~plain, column)))


def shared_characters(a: Column, b: Column) -> Column:
    """How many characters two texts share, as multisets. A character is counted by what is left without it, so that no
    list of all characters is made."""
    n = lambda text, ch: F.length(text) - F.length(F.replace(text, ch, F.lit("")))
    chars = F.filter(F.array_distinct(F.split(a, "")), lambda x: x != "")
    return F.aggregate(F.transform(chars, lambda ch: F.least(n(a, ch), n(b, ch))), F.lit(0), lambda x, y: x + y)


def as_text(column: Column, kind: T.DataType) -> Column:
    """A label or predicted value as one text: lists joined, truth values as words, null as ''."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(F.transform(column, lambda x: as_text(x, kind.elementType)), "；"), F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.when(column.isNull(), "").when(column, "是").otherwise("否")
    return F.coalesce(column.cast("string"), F.lit(""))


def comparable(column: Column, kind: T.DataType | None = None) -> Column:
    """For equality of label values (strings, or of the given type): NFKC, all white space gone, null is ''."""
    return F.regexp_replace(nfkc(as_text(column, kind or T.StringType())), f"{WS}+", "")


def comparable_each(column: Column) -> Column:
    """:func:`comparable` of each string of a list; a null list is empty."""
    filled = F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    return F.transform(nfkc_each(filled), lambda x: F.regexp_replace(x, f"{WS}+", ""))


def comparable_literal(text: str) -> str:
    """:func:`comparable` of a constant."""
    return "".join(unicodedata.normalize("NFKC", text).split())


# --- names of report files -------------------------------------------------------------------------------------------

# What the naming format of report files prescribes.
_STEM_STEPS = [
    (r"(?:[- ·_]*(?:含有|含|有|无)对比年度).*", ""),
    (r"[- ·_]*信息提[提]?取(?:报告)?.*", ""),
    (r"\.docx?$", ""),
    (r"(?:桥梁)?(?:检测评估|检测|评估|定检)?报告", ""),
    (r"(?:20[0-9]{2}[.年/-][0-9]{1,2}[.月/-][0-9]{1,2}日?|20[0-9]{2}年度)$", ""),
    ("匝道桥", "匝道"),
    (r"(k[0-9]+\+[0-9]+)小桥$", "$1"),
    (rf"(?:{WS}|[()【】\[\]、·_])+", ""),
]


def normalized_stem(path: Column) -> Column:
    c = F.lower(nfkc(file_stem(path)))
    for k, (pattern, by) in enumerate(_STEM_STEPS):
        c = F.regexp_replace(strip(c) if k == 2 else c, pattern, by)
    return c


def report_code(path: Column) -> Column:
    """The number that a name begins with; read from the normalised stem, so that wide digits and blanks don't hide it."""
    return F.regexp_extract(normalized_stem(path), r"^([0-9]{6}-[0-9]{3}|[0-9]{2}-[0-9]{3}|[0-9]{1,3})(?=[-\u4e00-\u9fff])", 1)


def bridge_key(path: Column) -> Column:
    """The bridge's name in a file name: without its number, a leading year, and marks of the edition."""
    stem, code = normalized_stem(path), report_code(path)
    bare = F.when(code != "", F.ltrim(F.substr(stem, F.length(code) + 1), F.lit("-"))).otherwise(stem)
    return F.btrim(chained(bare, ("^20[0-9]{2}年", ""), ("[0-9]{8}修改后最后定稿|全|报告", "")), F.lit("-"))


def bridge_aliases(path: Column) -> Column:
    """Sorted names by which a report's bridge may be known; chainage tells unnamed bridges and footbridges apart.

    A named bridge goes by its name without chainage (by the whole key, if nothing else is left), and by that name
    without the words that some reports leave out.
    """

    def names(key: Column) -> Column:
        named = key.rlike("[\u4e00-\u9fff]") & ~key.rlike("无名|人行天桥")
        plain = F.regexp_replace(key, r"k[0-9]+\+[0-9]+(?:\.[0-9]+)?", "")
        both = bound(F.when(plain == "", key).otherwise(plain), lambda b: F.array(b, F.regexp_replace(b, "长江|公路|立交", "")))
        return F.when(named, both).otherwise(F.array(key))

    return F.array_sort(F.array_distinct(F.filter(bound(bridge_key(path), names), lambda x: x != "")))
