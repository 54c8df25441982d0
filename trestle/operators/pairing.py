"""Pairing report files with label files, groups of one bridge, and a leakage-safe split."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trestle.functions.text import bridge_aliases, bridge_key, matches_split, normalized_stem, report_code, shared_characters, year_of

FUZZY, FRACTION = 0.85, 0.2
#: Places that one task may sort.
MOST_SORTED = 100_000
# How a pair was found.
BY_NAME, BY_CODE = "normalized_name", "unique_year_code_and_name"


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def near_pairs(rows: DataFrame, keys: list[str], key: str, name: str, least: float = FUZZY) -> DataFrame:
    """``k1``, ``k2``, ``ratio``: rows with equal ``keys`` and near-equal names, the smaller ``key`` first.

    Names are compared once, however many rows bear them; what bounds a ratio, lengths and then shared characters, rules
    pairs out before Python. Rows meet only by names that are near: the work grows with the names and the result.
    """
    own = rows.select(*keys, F.col(key), F.coalesce(name, F.lit("")).alias("name_"))
    names = own.select(*keys, "name_").distinct()
    a, b, total = F.col("a_"), F.col("b_"), F.length("a_") + F.length("b_")
    bounded = lambda shared: F.when(total == 0, 1.0).otherwise(F.lit(2.0) * shared / total) >= least
    met = names.withColumnRenamed("name_", "a_").join(names.withColumnRenamed("name_", "b_"), keys)
    met = met.filter(bounded(F.least(F.length(a), F.length(b)))).select("a_", "b_").distinct().filter(bounded(shared_characters(a, b)))
    near = met.withColumn("ratio", sequence_ratio("a_", "b_")).filter(F.col("ratio") >= least)
    left = own.withColumnsRenamed({"name_": "a_", key: "k1"}).join(near, "a_")
    right = own.withColumnsRenamed({"name_": "b_", key: "k2"})
    return left.join(right, [*keys, "b_"]).filter("k1 < k2").select("k1", "k2", "ratio")


def inventory(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word files of the train and the label folders, from a listing (``path``)."""
    path = F.regexp_replace("path", r"\\", "/")
    docs = names.select(path.alias("path")).filter(F.lower("path").rlike(r"\.docx?$"))
    return docs.filter(matches_split(F.col("path"), "train")), docs.filter(matches_split(F.col("path"), "labels"))


def _keyed(files: DataFrame, name: str) -> DataFrame:
    p = F.col("path")
    return files.select(p.alias(name), year_of(p).alias("year"), normalized_stem(p).alias("stem"), report_code(p).alias("code"), bridge_key(p).alias("bridge"))


def unique_match(left: DataFrame, right: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` with ``n``: how many partners a left ``key`` has."""
    return left.join(right, keys).withColumn("n", F.count("*").over(Window.partitionBy(key)))


def pair_files(originals: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``pairs``, ``unmatched`` and ``unused`` labels. A name must fit one label only; only without any fit may code and
    a near-equal name decide; a label that several originals choose pairs with none."""
    a, b = _keyed(originals, "train_file"), _keyed(labels, "label_file")
    by_name = unique_match(a.drop("code", "bridge"), b.drop("code", "bridge"), "train_file", ["year", "stem"]).withColumns({"match_method": F.lit(BY_NAME), "name_similarity": F.lit(1.0)})
    rest = a.join(by_name.select("train_file").distinct(), "train_file", "left_anti").filter("code <> ''")
    by_code = unique_match(rest, b.drop("stem").withColumnRenamed("bridge", "bridge2"), "train_file", ["year", "code"]).filter("n = 1")
    fuzzy = by_code.withColumn("name_similarity", sequence_ratio("bridge", "bridge2")).filter(F.col("name_similarity") >= FUZZY).withColumn("match_method", F.lit(BY_CODE)).withColumn("name_similarity", F.round("name_similarity", 6))
    cols = ["train_file", "label_file", "year", "match_method", "name_similarity"]
    chosen = by_name.filter("n = 1").select(*cols).unionByName(fuzzy.select(*cols))
    marked = chosen.withColumn("m", F.count("*").over(Window.partitionBy("label_file")))
    pairs = marked.filter("m = 1").select(*cols)
    many = marked.filter("m > 1").select("train_file", F.lit("many_to_one_label").alias("reason"))
    none = a.select("train_file").join(chosen.select("train_file"), "train_file", "left_anti").withColumn("reason", F.lit("missing_or_ambiguous_label"))
    return pairs, many.unionByName(none), b.select("label_file").join(pairs.select("label_file"), "label_file", "left_anti")


def alias_components(nodes: DataFrame, node: str, aliases: str, most_rounds: int = 60) -> DataFrame:
    """``node`` -> ``component``: the least node among those that share an alias, directly or through others.

    Each alias ties its nodes to its least one: as many edges as names, also for an alias that all share. Then large-star
    and small-star in turn, rounds that grow with the logarithm of the longest chain; each round is checkpointed.
    """
    names = nodes.select(F.col(node).alias("v"), F.explode(aliases).alias("alias")).distinct()
    least = names.groupBy("alias").agg(F.min("v").alias("u")).select(F.col("alias").alias("a2"), "u")
    edges = names.join(least, F.col("alias") == F.col("a2")).filter("u <> v").select("u", "v").distinct()
    edges, mark = checkpointed(edges), None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = _to_least(both).filter("v > u").select(F.col("low").alias("u"), "v").filter("u <> v").distinct()
        down = up.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        star = _to_least(down)
        edges = checkpointed(star.select(F.col("low").alias("u"), "v").union(star.select(F.col("low").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            found = edges.select(F.col("v").alias("n2"), F.col("u").alias("component"))
            every = nodes.select(node).distinct().join(found, F.col(node) == F.col("n2"), "left")
            return every.select(node, F.coalesce("component", node).alias("component"))
        mark = seen
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _to_least(edges: DataFrame) -> DataFrame:
    """Edges with ``low``, the least of u and its neighbours: a pre-aggregated minimum joined back."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("low"))
    return edges.join(low, F.col("u") == F.col("w")).select("u", "v", "low")


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the folder that all executors share; it has to be set on a cluster, and has no local stand-in."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints")
    return df.checkpoint()


def holdout(groups: DataFrame, identity: Column, seed: str, fraction: float = FRACTION) -> DataFrame:
    """Groups with ``rank`` (sha256 of seed and identity) and ``split``: the first share by rank is validation, half to
    even. Groups are counted once; the cut is the last of a top-n by rank, so that no task holds or sorts all groups."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    ranked = groups.withColumn("identity", identity).withColumn("rank", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("identity")), 256))
    n = ranked.count()
    take = max(1, min(n - 1, round(n * fraction)))
    place = F.struct("rank", "identity")
    cut = _nth(ranked.select(place.alias("p")), take)
    return ranked.withColumn("split", F.when(place <= F.struct(F.lit(cut[0]).alias("rank"), F.lit(cut[1]).alias("identity")), "validation").otherwise("train"))


def _nth(places: DataFrame, n: int) -> tuple:
    """The n-th least place: narrowed down by the first digits of its hash, until few are left to sort."""
    prefix = ""
    while True:
        size = len(prefix) + 3
        inside = places.filter(F.startswith(F.col("p.rank"), F.lit(prefix)))
        if size > 60 or inside.limit(MOST_SORTED + 1).count() <= MOST_SORTED:
            return tuple(inside.orderBy("p").limit(n).agg(F.max("p").alias("p")).first()["p"]) if n else ("", "")
        for row in inside.groupBy(F.substring("p.rank", 1, size).alias("k")).count().orderBy("k").collect():
            if n <= row["count"]:
                prefix = row["k"]
                break
            n -= row["count"]


def group_split(pairs: DataFrame, seed: str, fraction: float = FRACTION, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs with their bridge group and split, and the groups: one bridge never stands on both sides.

    ``names`` (label_file, name): bridge names out of the labels, further aliases.
    """
    found = [bridge_aliases(F.col("train_file")), bridge_aliases(F.col("label_file"))]
    known = pairs
    if names is not None:
        told = names.filter("name <> ''").groupBy("label_file").agg(F.min("name").alias("told_")).withColumnRenamed("label_file", "l2_")
        known = pairs.join(told, F.col("label_file") == F.col("l2_"), "left").drop("l2_")
        found.append(bridge_aliases(F.coalesce("told_", F.lit(""))))
    named = known.withColumn("aliases_", F.array_distinct(F.concat(*found))).drop("told_")
    if named.filter(F.size("aliases_") == 0).limit(1).count():
        raise ValueError("a report has no bridge identity")
    comp = alias_components(named, "train_file", "aliases_").withColumnRenamed("train_file", "t2_")
    held = named.join(comp, F.col("train_file") == F.col("t2_")).drop("t2_")
    groups = held.groupBy("component").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases_")))).alias("aliases"), F.count("*").alias("reports"))
    if groups.limit(2).count() < 2:
        raise ValueError("a split needs two groups at least")
    identity = F.substring(F.sha2(F.array_join("aliases", "|"), 256), 1, 16)
    split = holdout(groups, identity, seed, fraction).withColumnRenamed("identity", "bridge_group")
    out = held.drop("aliases_").join(split.select("component", "bridge_group", "split"), "component").drop("component")
    return out, split.select("bridge_group", "aliases", "split", "reports", "rank")
