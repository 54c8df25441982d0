"""The training set made ready: files paired, labels parsed and audited, a split by bridge; nothing is predicted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.operators import evaluation, labels, pairing
from trestle.operators.pairing import checkpointed
from trestle.sources import docx


def label_texts(parsed: DataFrame) -> DataFrame:
    """Parsed labels (by label_file) as :func:`evaluation.consistency_issues` takes them."""
    return parsed.select("label_file", "summary", F.array_join("detailed_conclusion", "\n").alias("detail"), F.transform("recommendations", lambda x: x["category"]).alias("categories"))


def prepare_training(names: DataFrame, seed: str, label_files: DataFrame | None = None, fraction: float = pairing.FRACTION) -> dict[str, DataFrame]:
    """All artefacts by name, each in its order: ``pairs``, ``unmatched``, ``unused_labels``, ``labels``, ``failures``,
    ``split``, ``groups``, ``conflicts`` and the one-row ``summary``.

    ``names``: a listing (path); ``label_files``: path and content of the labels, where they are to be parsed. A label
    that warns is a failure, and its bridge name is not used.
    """
    originals, found = pairing.inventory(names)
    pairs, unmatched, unused = (checkpointed(x) for x in pairing.pair_files(originals, found))
    out = {"pairs": pairs.orderBy("train_file"), "unmatched": unmatched.orderBy("train_file"), "unused_labels": unused.orderBy("label_file")}
    told = None
    if label_files is not None:
        mine = label_files.join(pairs.select("label_file"), F.col("path") == F.col("label_file"), "left_semi")
        # blocks are named by content: two files of one content are one report, so the path stands in for the id
        blocks = docx.blocks(mine.select("path", "content")).withColumnRenamed("report_id", "content_id")
        ids = mine.select(F.col("path").alias("label_file"), F.substring(F.sha2("content", 256), 1, 16).alias("content_id"))
        full = checkpointed(blocks.drop("file_name").dropDuplicates(["content_id", "block_pos"]).join(ids, "content_id").withColumnRenamed("label_file", "report_id"))
        parsed = checkpointed(labels.parse_labels(full.filter("error is null"))).withColumnRenamed("report_id", "label_file")
        failures = parsed.filter(F.size("warnings") > 0).select("label_file", F.array_join("warnings", "; ").alias("error"))
        broken = full.filter("error is not null").select(F.col("report_id").alias("label_file"), "error")
        good = parsed.filter(F.size("warnings") == 0)
        out |= {"labels": good.orderBy("label_file"), "failures": failures.unionByName(broken).orderBy("label_file")}
        out["conflicts"] = checkpointed(evaluation.consistency_issues(label_texts(good))).orderBy("label_file", "field")
        told = good.select("label_file", F.try_element_at("summary", F.lit("桥梁名称")).alias("name"))
    split, groups = pairing.group_split(pairs, seed, fraction, told)
    out |= {"split": split.orderBy("train_file"), "groups": groups.orderBy("rank")}
    count = lambda df, name: df.agg(F.count("*").alias(name))
    summary = count(originals, "train_count").crossJoin(count(found, "label_count")).crossJoin(count(pairs, "paired_count"))
    summary = summary.crossJoin(count(unmatched, "unmatched_count")).crossJoin(count(unused, "unused_label_count"))
    by = split.agg(F.count_if(F.col("split") == "train").alias("training_reports"), F.count_if(F.col("split") == "validation").alias("validation_reports"))
    summary = summary.crossJoin(count(groups, "group_count")).crossJoin(by)
    if label_files is not None:
        summary = summary.crossJoin(count(out["labels"], "parsed_labels")).crossJoin(count(out["failures"], "label_parse_failures"))
        summary = summary.crossJoin(out["conflicts"].agg(F.countDistinct("label_file").alias("label_consistency_flags")))
    out["summary"] = summary.withColumn("labels_used_for_grouping", F.lit(label_files is not None))
    return out


def write_artefacts(artefacts: dict[str, DataFrame], path: str) -> None:
    """Each artefact as JSON lines in a folder of its name; replaced as a whole."""
    for name, rows in artefacts.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
