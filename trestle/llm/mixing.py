"""Mixing sources to target weights: budgets over a domain - language - source tree. DataFrame functions only.

Weights go down the tree. A node never gets more than its subtree can supply (tokens x most epochs), and what a child
cannot supply goes to its siblings by weight; so a shortage leaves a parent only when no sibling can take it.
A leaf with budget b and t tokens is read b // t times in full, and the rest of b is a prefix of one more epoch in the
order of a hash seeded by that epoch. The prefix ends at a cut (hash, doc_id), found by radix: sums over the first 12
bits of the hash, then over the next 12 inside one bucket, then the few documents of one sub-bucket. The decision for
a document is then a comparison with its leaf's cut: no leaf, however large, is sorted or collected.

Defined cases: null text has no tokens; null language or source are nodes named ''; a leaf without tokens gets nothing;
a division's remainder, fewer tokens than children, is
given to none of them; the prefix is the longest whose tokens do not exceed the rest, so no document is cut; rows with equal doc_id in a leaf
stand or fall together; equal capacity per weight is settled by name; an empty table gives no rows; other columns are
kept by ``mixed_documents`` and ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trestle.llm.shared import cut, nested, text_of, words_of

LEAF = ["domain", "language", "src"]
#: A leaf table up to this many rows (some 100 bytes each) is broadcast; a longer one is joined by shuffle.
MOST_BROADCAST = 20_000


@dataclass(frozen=True)
class Mix:
    """Production mix. ``domains``: name, weight, pattern of its sources; the first that fits counts."""

    domains: tuple = (("web", 50, "^src[0-9]$"), ("reference", 30, "^src1[0-4]$"), ("other", 20, ""))
    languages: dict = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    sources: dict = field(default_factory=dict)
    other_weight: int = 10
    most_epochs: int = 2
    #: Tokens to give out per 1000 tokens of the corpus.
    per_mille: int = 1000
    seed: str = "mix-1"


def _table(column: Column, weights: dict, other: int) -> Column:
    out = F.lit(other)
    for name, weight in weights.items():
        out = F.when(column == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def _leaf(mix: Mix) -> list[Column]:
    src = F.coalesce(F.col("source").cast("string"), F.lit(""))
    domain = F.lit(None).cast("string")
    for name, _, pattern in reversed(mix.domains):
        domain = F.when(src.rlike(pattern), F.lit(name)).otherwise(domain)
    return [domain.alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"), src.alias("src")]


def fill(nodes: DataFrame, parents: list[str], name: str, out: str) -> DataFrame:
    """Water-filling: ``budget`` of each parent among its children by ``weight``, none above ``cap``; column ``out``.

    Children are taken by cap per weight; those below the level get their cap, the others share the rest by weight.
    """
    own = Window.partitionBy(*parents)
    order = own.orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(own) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    marked = nodes.withColumns({"rest_": rest, "weights_": weights}).withColumn("full_", F.col("cap") * F.col("weights_") <= F.col("rest_") * F.col("weight"))
    left = F.col("budget") - F.sum(F.when(F.col("full_"), F.col("cap")).otherwise(0)).over(own)
    share = F.sum(F.when(F.col("full_"), F.lit(0)).otherwise(F.col("weight"))).over(own)
    got = marked.withColumns({"left_": left, "share_": share})
    level = F.when(F.col("full_"), F.col("cap")).otherwise(F.expr("(left_ * weight) div share_"))
    return got.withColumn(out, level).drop("rest_", "weights_", "full_", "left_", "share_")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``tokens`` per leaf in; ``budget`` per leaf out, root to leaves."""
    caps = leaves.withColumn("cap", F.col("tokens") * mix.most_epochs)
    langs = caps.groupBy("domain", "language").agg(F.sum("cap").alias("cap"))
    tops = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    # a row per domain: as many as the mix names
    one = tops.withColumn("all_", F.lit(0)).withColumn("budget", F.least(F.expr(f"(sum(tokens) over () * {mix.per_mille}) div 1000"), F.expr("sum(cap) over ()")))
    weight = _table(F.col("domain"), {n: w for n, w, _ in mix.domains}, mix.other_weight)
    one = fill(one.withColumn("weight", weight), ["all_"], "domain", "given").select("domain", F.col("given").alias("budget"))
    two = langs.join(one, "domain").withColumn("weight", _table(F.col("language"), mix.languages, mix.other_weight))
    two = fill(two, ["domain"], "language", "given").select("domain", "language", F.col("given").alias("budget"))
    three = caps.join(two, ["domain", "language"]).withColumn("weight", _table(F.col("src"), mix.sources, mix.other_weight))
    return fill(three, ["domain", "language"], "src", "given").select(*LEAF, "tokens", F.col("given").alias("budget"))


def _hash(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    """60 bits, the same in any SQL engine."""
    text = F.concat(F.lit(f"{mix.seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _with_leaf(rows: DataFrame, leaves: DataFrame, n_leaves: int) -> DataFrame:
    names = [F.col(c).alias(f"{c}_") for c in LEAF]
    side = leaves.select(*names, *[c for c in leaves.columns if c not in LEAF])
    side = F.broadcast(side) if n_leaves <= MOST_BROADCAST else side
    same = (F.col("domain") == F.col("domain_")) & (F.col("language") == F.col("language_")) & (F.col("src") == F.col("src_"))
    return rows.join(side, same).drop(*[f"{c}_" for c in LEAF])


def _first_over(sums: DataFrame, key: str) -> DataFrame:
    """Of each leaf the first ``key`` whose running total, from ``base``, exceeds ``rest``; ``base`` becomes the total before it."""
    w = Window.partitionBy(*LEAF).orderBy(key)
    run = F.col("base") + F.sum("n").over(w)
    return (
        sums.withColumn("run", run).filter(F.col("run") > F.col("rest")).withColumn("k", F.row_number().over(w)).filter("k = 1")
        .select(*LEAF, key, (F.col("run") - F.col("n")).alias("base"))
    )


def cuts(sizes: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """Per leaf: full epochs and the cut of the part epoch. ``sizes``: leaf, doc_id, n_tokens."""
    leaves = cut(budgets(sizes.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), mix).filter("tokens > 0").withColumn("full", F.expr("budget div tokens"))
                 .withColumn("rest", F.expr("budget - full * tokens")), "mix-leaves")
    n_leaves = leaves.count()
    rows = _with_leaf(sizes, leaves.select(*LEAF, "full", "rest"), n_leaves)
    rows = rows.withColumn("h", _hash(mix, F.col("full"), F.col("doc_id"))).withColumns({"b1": F.expr("h div 281474976710656"), "b2": F.expr("(h div 68719476736) % 4096")})
    one = rows.groupBy(*LEAF, "rest", "b1").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.lit(0).cast("long"))
    one = _first_over(one, "b1").withColumnsRenamed({"b1": "c1", "base": "base1"})
    two = _with_leaf(rows, one, n_leaves).filter("b1 = c1").groupBy(*LEAF, "rest", "b2", "c1", F.col("base1").alias("base")).agg(F.sum("n_tokens").alias("n"))
    two = _first_over(two, "b2").join(one.drop("base1"), LEAF).withColumnsRenamed({"b2": "c2", "base": "base2"})
    last = _with_leaf(rows, two, n_leaves).filter("b1 = c1 and b2 = c2").groupBy(*LEAF, "rest", "c1", "c2", "base2", "h", "doc_id").agg(F.sum("n_tokens").alias("n"))
    run = last.withColumn("run", F.col("base2") + F.sum("n").over(Window.partitionBy(*LEAF).orderBy("h", "doc_id")))
    inside = F.when(F.col("run") <= F.col("rest"), F.struct("h", "doc_id"))
    below = F.struct((F.col("c1") * 281474976710656 + F.col("c2") * 68719476736 - 1).alias("h"), F.lit(2**63 - 1).cast("long").alias("doc_id"))
    ends = run.groupBy(*LEAF).agg(F.coalesce(F.max(inside), F.first(below)).alias("end"))
    out = leaves.join(ends, LEAF, "left").select(*LEAF, "tokens", "budget", "full", F.col("end.h").alias("cut_h"), F.col("end.doc_id").alias("cut_id"))
    return cut(out, "mix-cuts"), n_leaves


def _sizes(docs: DataFrame, mix: Mix, *more: Column) -> DataFrame:
    return docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), *_leaf(mix), F.size(words_of(text_of(docs))).cast("long").alias("n_tokens"))


def _epochs(rows: DataFrame, leaves: DataFrame, n_leaves: int, mix: Mix) -> DataFrame:
    """Rows once for each epoch in which they are read; column ``epoch``."""
    held = _with_leaf(rows, leaves.select(*LEAF, "full", "cut_h", "cut_id"), n_leaves).withColumn("h", _hash(mix, F.col("full"), F.col("doc_id")))
    inside = (F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (F.col("doc_id") <= F.col("cut_id")))
    none = F.array().cast("array<bigint>")
    whole = F.when(F.col("full") > 0, F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).otherwise(none)
    part = F.when(inside, F.array(F.col("full"))).otherwise(none)
    return held.withColumn("epoch", F.explode(F.concat(whole, part))).drop("full", "cut_h", "cut_id", "h")


def mixed(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """``doc_id``, ``domain``, ``language``, ``src``, ``n_tokens``, ``epoch`` of everything the mix reads."""
    mix = mix or Mix()
    sizes = cut(_sizes(docs, mix), "mix-sizes")
    leaves, n = cuts(sizes, mix)
    return _epochs(sizes, leaves, n, mix).select("doc_id", *LEAF, "n_tokens", F.col("epoch").cast("int").alias("epoch"))


def mixed_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The documents, all columns as given, once for each epoch in which the mix reads them."""
    mix = mix or Mix()
    leaves, n = cuts(cut(_sizes(docs, mix), "mix-sizes"), mix)
    d = nested(docs)
    rows = d.select("d", F.col("d.doc_id").cast("long").alias("doc_id"), F.col("d.source").alias("source"), F.col("d.lang").alias("lang"))
    rows = rows.select("d", "doc_id", *_leaf(mix))
    return _epochs(rows, leaves, n, mix).select("d.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), '^src[0-9]$') THEN 'web' WHEN regexp_matches(coalesce(source, ''), '^src1[0-4]$') THEN 'reference' ELSE 'other' END AS domain,
    coalesce(lang, '') AS language, coalesce(source, '') AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, language, src, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * 2 AS cap FROM d GROUP BY ALL),
w1 AS (SELECT domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'web' THEN 50 WHEN 'reference' THEN 30 ELSE 20 END::BIGINT AS weight,
  least((sum(sum(tokens)) OVER () * 1000)::BIGINT // 1000, (sum(sum(cap)) OVER ())::BIGINT) AS budget FROM leaf GROUP BY domain),
r1 AS (SELECT *, budget - coalesce(sum(cap) OVER o, 0)::BIGINT AS rest, (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER o, 0)::BIGINT AS ws
  FROM w1 WINDOW o AS (ORDER BY cap / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f1 AS (SELECT domain, CASE WHEN cap * ws <= rest * weight THEN cap ELSE ((budget - (sum(CASE WHEN cap * ws <= rest * weight THEN cap ELSE 0 END) OVER ())::BIGINT) * weight)
  // nullif((sum(CASE WHEN cap * ws <= rest * weight THEN 0 ELSE weight END) OVER ())::BIGINT, 0) END AS budget FROM r1),
w2 AS (SELECT domain, language, sum(cap)::BIGINT AS cap, CASE language WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 ELSE 10 END::BIGINT AS weight, any_value(budget) AS budget
  FROM leaf JOIN f1 USING (domain) GROUP BY domain, language),
r2 AS (SELECT *, budget - coalesce(sum(cap) OVER o, 0)::BIGINT AS rest, (sum(weight) OVER (PARTITION BY domain))::BIGINT - coalesce(sum(weight) OVER o, 0)::BIGINT AS ws
  FROM w2 WINDOW o AS (PARTITION BY domain ORDER BY cap / weight, language ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f2 AS (SELECT domain, language, CASE WHEN cap * ws <= rest * weight THEN cap ELSE ((budget - (sum(CASE WHEN cap * ws <= rest * weight THEN cap ELSE 0 END) OVER p)::BIGINT) * weight)
  // nullif((sum(CASE WHEN cap * ws <= rest * weight THEN 0 ELSE weight END) OVER p)::BIGINT, 0) END AS budget FROM r2 WINDOW p AS (PARTITION BY domain)),
w3 AS (SELECT domain, language, src, tokens, cap, 10::BIGINT AS weight, budget FROM leaf JOIN f2 USING (domain, language)),
r3 AS (SELECT *, budget - coalesce(sum(cap) OVER o, 0)::BIGINT AS rest, (sum(weight) OVER (PARTITION BY domain, language))::BIGINT - coalesce(sum(weight) OVER o, 0)::BIGINT AS ws
  FROM w3 WINDOW o AS (PARTITION BY domain, language ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f3 AS (SELECT domain, language, src, tokens, CASE WHEN cap * ws <= rest * weight THEN cap ELSE ((budget - (sum(CASE WHEN cap * ws <= rest * weight THEN cap ELSE 0 END) OVER p)::BIGINT) * weight)
  // nullif((sum(CASE WHEN cap * ws <= rest * weight THEN 0 ELSE weight END) OVER p)::BIGINT, 0) END AS budget FROM r3 WINDOW p AS (PARTITION BY domain, language)),
e AS (SELECT d.*, budget // tokens AS whole, budget - (budget // tokens) * tokens AS rest,
  ('0x' || substr(md5('mix-1:' || (budget // tokens)::VARCHAR || ':' || doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM d JOIN f3 USING (domain, language, src) WHERE tokens > 0),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, src ORDER BY h, doc_id) AS run FROM e)
SELECT doc_id, domain, language, src, n_tokens, epoch::INTEGER AS epoch FROM s, unnest(range(whole + 1)) AS r(epoch) WHERE epoch < whole OR run <= rest
"""
