"""Quality rules as a bitmask ledger, DataFrame functions only.

Every rule is evaluated once per document and leaves one bit in ``fail_bits`` beside the measurements.
A policy is a versioned mask over those bits, so that a policy change or an ablation re-reads the ledger
(a few longs per document) and never the texts.

Defined cases: null or blank text has no words and fails ``few_words``; repeated rows give one ledger row
each; an empty table gives an empty ledger; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.llm.shared import nested, text_of, words_of

WINDOW = 5

#: Bit of each rule and the condition, over the measurements, under which a document fails it.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

#: Policies are never edited; a change gets a new version.
POLICIES: dict[str, int] = {"base": BASE, "v1": sum(BIT.values())}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more; ``hashes`` has one hash per window, in order."""
    at = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(pairs: Column) -> Column:
        same = lambda k, x: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
        hit = F.filter(pairs, lambda x, k: F.when(k > 0, same(k - 1, x)).otherwise(False) | same(k + 1, x))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x)

    # transform over a one-item array binds a value that is used more than once
    bind = lambda value, f: F.get(F.transform(F.array(value), f), 0)
    return bind(bind(at, starts), covered)


def measured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` plus the measurements; one narrow projection chain, no shuffle."""
    words = F.col("_w")
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    none = F.array().cast("array<bigint>")
    first = docs.select(*keep, text_of(docs).alias("_t")).select("*", words_of(F.col("_t")).alias("_w"), lines.alias("_l"))
    n = F.size(words)
    window = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )
    second = first.withColumn("_h", F.when(n >= WINDOW, window).otherwise(none))
    h = F.col("_h")
    names = [c for c in first.columns if c not in ("_t", "_w", "_l")]
    return second.select(
        *names,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(h)) < F.size(h), _repeat_words(h)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep``, the measurements and ``fail_bits`` (bigint): bit k set if rule k fails."""
    bits = sum(
        (F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)) for name, condition in RULES), F.lit(0)
    ).cast("long")
    return measured(docs, keep).withColumn("fail_bits", bits)


def passes(mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0


def judged(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """Ledger of ``documents`` with the verdict of a policy; base failures always reject."""
    mask = POLICIES[policy] | BASE
    return ledger(docs, [F.col("doc_id")]).select(
        "*", (~passes(BASE)).alias("base_failed"), passes(mask).alias("kept")
    )


def kept_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents, all columns as given, that the policy keeps."""
    d = nested(docs)
    led = ledger(d.withColumn("text", F.col("d.text").cast("string")), [F.col("d")])
    # exploded, so that the filter isn't pushed below the measurements: there each window would split the text anew
    led = led.select("d", F.explode(F.array("fail_bits")).alias("fail_bits"))
    return led.filter(passes(POLICIES[policy] | BASE)).select("d.*")


def ablation(led: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """One row per policy and rule: documents failing the rule, and those that only this rule rejects.

    Reads ledger rows only. Partial aggregation leaves one row per mask and task before the shuffle.
    """
    masks = F.array(
        *[F.struct(F.lit(p).alias("policy"), F.lit(m).cast("long").alias("mask")) for p, m in (policies or POLICIES).items()]
    )
    by_mask = led.groupBy("fail_bits").count()
    each = by_mask.select("*", F.explode(masks).alias("p")).withColumn("hit", F.col("fail_bits").bitwiseAND(F.col("p.mask")))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for r, b in BIT.items()])
    flat = each.select("*", F.explode(rules).alias("r")).filter(F.col("p.mask").bitwiseAND(F.col("r.bit")) != 0)
    inside = F.col("hit").bitwiseAND(F.col("r.bit")) != 0
    return flat.groupBy(F.col("p.policy").alias("policy"), F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(inside, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(inside & (F.bit_count("hit") == 1), F.col("count")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("hit") != 0, F.col("count")).otherwise(0)).alias("n_rejected"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS u FROM documents),
w AS (SELECT u, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT u, i, words[i:i + 4] AS g FROM w, unnest(range(1, len(words) - 3)) AS r(i)),
hit AS (SELECT u, i FROM g QUALIFY count(*) OVER (PARTITION BY u, g) >= 2),
rep AS (SELECT u, count(DISTINCT i + k) AS n FROM hit, unnest(range(5)) AS s(k) GROUP BY u),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_own,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (u)),
f AS (
  SELECT *, n_lines - n_own AS n_dup_lines,
    ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
     + 8 * (100 * (n_lines - n_own) > 30 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
     + 32 * (word_chars > 25 * n_words)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, fail_bits,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM f
"""
