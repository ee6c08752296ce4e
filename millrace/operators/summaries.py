"""Summaries of collections, reviews, critics and self-tests: each one aggregation, as rows rather than documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

#: Scores of a review.
SCORES = ["same_image_context", "edit_faithfulness", "preservation", "artifact_severity", "instruction_clarity", "overall"]


def ordered_counts(df: DataFrame, column: str, order: str, label: str = "?") -> DataFrame:
    """(value, rows, place): counts by value, the most frequent first, of equals the one seen first; null is `label`."""
    from pyspark.sql import Window

    value = F.coalesce(F.col(column).cast("string"), F.lit(label))
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("_first"))
    # one row a value: as many as the column has values
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rows"), "_first", "value"))).drop("_first")


def conditional_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: the number of rows, and of those that fulfil each condition; null is no."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()))


def source_audit(pairs: DataFrame) -> DataFrame:
    """One row of edit pairs: rows, exact leaks, quality rejects (a missing verdict is no reject), distinct digests and instructions."""
    counts = conditional_counts(pairs, leaks=F.col("leakage_tags.benchmark_text_exact_match"), quality_rejects=~F.coalesce(F.col("quality_tags.ok"), F.lit(True)))
    some = lambda c: F.coalesce(c, F.lit(""))
    distinct = pairs.agg(F.count_distinct(some(F.col("source_image.sha256"))).alias("source_digests"), F.count_distinct(some(F.col("target_image.sha256"))).alias("target_digests"), F.count_distinct(some(F.col("instruction"))).alias("instructions"))
    return counts.crossJoin(F.broadcast(distinct))  # one row each


def collection(catalog: DataFrame, pairs: DataFrame, images: DataFrame, tasks: DataFrame, family: str = "task_family") -> DataFrame:
    """(section, name, rows) of a collection: sizes, usable sources, pair sources in order, task families."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("size").alias("section"), F.lit(name).alias("name"), "rows")
    by = lambda df, c, name: df.groupBy(F.coalesce(F.col(c), F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("section"), "name", "rows")
    out = one(catalog, "catalog_sources")
    for part in (one(catalog.filter(F.coalesce("status", F.lit("")).startswith("usable")), "usable_sources"), one(pairs, "pair_samples"), one(images, "source_images"), one(tasks, "seed_tasks"), by(pairs, "source_id", "pair_source"), by(tasks, family, "task_family")):
        out = out.unionByName(part)
    return out


def critic(df: DataFrame, modes: str = "evidence_modes", failed: str = "failure") -> DataFrame:
    """(section, name, rows, mean) of a critic's scores (label, score, an array of modes, a failure): mean by label, counts of modes and failures."""
    none = F.lit(None).cast("double")
    label = df.groupBy(F.coalesce("label", F.lit("None")).alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean")).select(F.lit("label").alias("section"), "name", "rows", "mean")
    mode = df.select(F.explode(modes).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("evidence_mode").alias("section"), "name", "rows", none.alias("mean"))
    fail = df.groupBy(F.coalesce(failed, F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("failure").alias("section"), "name", "rows", none.alias("mean"))
    return label.unionByName(mode).unionByName(fail)


def review(df: DataFrame, scores: list[str] = SCORES) -> DataFrame:
    """(section, name, other, rows, mean) of reviews: decisions, sources with decisions, failure types, and the mean of each score, rounded, without nulls.

    The decision is that of the gate, else the model's, else the status, else `unknown`; an empty one counts as missing.
    """
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    d = df.withColumn("_d", F.coalesce(empty("gate_decision"), empty("vlm_decision"), empty("status"), F.lit("unknown"))).withColumn("_s", F.coalesce(empty("source_id").cast("string"), F.lit("unknown")))
    no, none = F.lit(None).cast("string"), F.lit(None).cast("double")
    rows = F.count(F.lit(1)).alias("rows")
    out = d.groupBy("_d").agg(rows).select(F.lit("decision").alias("section"), F.col("_d").alias("name"), no.alias("other"), "rows", none.alias("mean"))
    out = out.unionByName(d.groupBy("_s", "_d").agg(rows).select(F.lit("source").alias("section"), F.col("_s").alias("name"), F.col("_d").alias("other"), "rows", none.alias("mean")))
    out = out.unionByName(d.select(F.explode("failure_types").alias("f")).groupBy("f").agg(rows).select(F.lit("failure").alias("section"), F.col("f").alias("name"), no.alias("other"), "rows", none.alias("mean")))
    one = d.agg(*(F.count(T.score(F.col(s))).alias(f"n{i}") for i, s in enumerate(scores)), *(F.round(F.avg(T.score(F.col(s))), 3).alias(f"m{i}") for i, s in enumerate(scores)))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(s).alias("name"), F.col(f"n{i}").alias("rows"), F.col(f"m{i}").alias("mean")) for i, s in enumerate(scores)))).alias("x"))
    return out.unionByName(long.select(F.lit("score").alias("section"), "x.name", no.alias("other"), "x.rows", "x.mean").filter("rows > 0"))


def self_test(df: DataFrame, **differences: str) -> DataFrame:
    """One row: tasks checked, renders checked (three a task), and the least of each difference in pixels."""
    return df.agg(F.count(F.lit(1)).alias("tasks"), (F.count(F.lit(1)) * 3).alias("renders"), *(F.min(c).alias(f"least_{k}") for k, c in differences.items()))


def rates(df: DataFrame, group: str | None = None, **conditions: Column) -> DataFrame:
    """The share of rows that fulfil each condition, rounded to four places, in all or by group; null is no, and no rows are a share of zero."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    share = [F.round(F.count_if(F.coalesce(c, F.lit(False))) / n, 4).alias(k) for k, c in conditions.items()]
    return (df.groupBy(group) if group else df).agg(F.count(F.lit(1)).alias("rows"), *share)


def truncated(errors: DataFrame, order: list[str], most: int = 100) -> DataFrame:
    """The first errors in order, which is what a report shows; their number is counted over all."""
    return errors.orderBy(*order).limit(most)
