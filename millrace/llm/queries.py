"""The queries pN_... of the training-data problems, and SQL where it can say the same."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import nearset as ns
from millrace.llm import p1_cross_split as p1
from millrace.llm import p2_incremental as p2
from millrace.llm import p3_grouped_splits as p3
from millrace.llm import p4_near_duplicates as p4
from millrace.llm import p5_encoding as p5
from millrace.llm import p6_leakage as p6
from millrace.llm import p7_quality as p7
from millrace.llm import sql
from millrace.session import cut, shared_dir, table

SEEDS, TASKS, PAIRS, POOL = "real_seed_prompts_v2_seed", "tasks_v1_refined_pilot3", "real_edit_pairs_rejected_v2_hf150", "wikimedia_source_pool_v2_seed"

#: Fixed values of these tables: the sentences that stand for a target yet to come.
STANDING = (
    "Target is still to be rendered by the editor and then checked against the list.",
    "No target text yet, the reviewer fills this in after the first render.",
    "Pending: see the checklist of the task for what the result has to show.",
)


def _instructions(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, TASKS).select("task_id", F.col("refined.instruction").alias("text"))
    return a.unionByName(table(spark, d, SEEDS).select("task_id", F.col("instruction").alias("text")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training and an evaluation record with nearly the same instruction or target."""
    return p1.found(table(spark, d, SEEDS), STANDING)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Cross-split pairs by evaluation split and source."""
    return p1.report(table(spark, d, SEEDS), STANDING)


def p1_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How much of each evaluation text lies in chunks that training texts have."""
    return p1.record_overlap(table(spark, d, SEEDS), STANDING)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of both tables that aren't accepted, all batches replayed in order."""
    pairs = p2.edit_rejected(table(spark, d, PAIRS), table(spark, d, "source_catalog"))
    return pairs.unionByName(p2.pool_rejected(table(spark, d, POOL))).distinct()


def p2_latest(spark: SparkSession, d: str) -> DataFrame:
    """Of both tables the records of the last batch that aren't accepted: a ledger of all batches before, and one batch taken against it."""
    pairs, pool, catalog = table(spark, d, PAIRS), table(spark, d, POOL), table(spark, d, "source_catalog")
    ledger = p2.Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    out = None
    for rows, load, accept in ((pairs, lambda x: ledger.load(x, catalog), lambda x: ledger.accept(x, catalog)), (pool, ledger.accept_pool, ledger.accept_pool)):
        last = rows.agg(F.max("batch_number")).first()[0]
        load(rows.filter(F.col("batch_number") < last))
        no = accept(rows.filter(F.col("batch_number") == last))
        out = no if out is None else out.unionByName(no)
    return out.distinct()


def p2_pool(spark: SparkSession, d: str) -> DataFrame:
    """Pool images that aren't accepted."""
    return p2.pool_rejected(table(spark, d, POOL))


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    """Records, and records not accepted, of each table and batch."""
    rows = table(spark, d, PAIRS).select(F.lit("pairs").alias("source_table"), F.col("sample_id").alias("record_id"), "batch_number")
    rows = rows.unionByName(table(spark, d, POOL).select(F.lit("pool").alias("source_table"), F.col("image_id").alias("record_id"), "batch_number"))
    no = p2_found(spark, d).withColumn("no", F.lit(1))
    return rows.distinct().join(no, "record_id", "left").groupBy("source_table", "batch_number").agg(F.count(F.lit(1)).alias("records"), F.sum(F.coalesce("no", F.lit(0))).alias("rejected"))


def _related(spark: SparkSession, d: str) -> DataFrame:
    return p3.groups(cut(p3.related(table(spark, d, SEEDS), table(spark, d, PAIRS), table(spark, d, "source_catalog"))))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that must share their split with another, with the smallest key of their group."""
    return _related(spark, d).filter("size > 1").select("record_id", "group_id")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of each record."""
    return p3.assign(cut(_related(spark, d)))


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    """Records and groups of each table and split."""
    return p3_splits(spark, d).groupBy("kind", "split").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("group_id").alias("groups"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records whose instructions are nearly the same, over both tables."""
    return p4.near_pairs(_instructions(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record: the smallest key of its group, and its number of links; records without five words are groups of their own."""
    rows = _instructions(spark, d)
    sets = ns.word_sets(rows, "text", "task_id")
    unique = ns.classes(sets).persist(StorageLevel.MEMORY_AND_DISK)
    links = cut(p4.near_links(unique).select("a", "b"))
    unique.unpersist()
    members = cut(sets.select("task_id", "sid").distinct())
    size = members.groupBy("sid").agg(F.count(F.lit(1)).alias("m"), F.min("task_id").alias("first"))
    roots = cut(p3.components(links))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(size.select(F.col("sid").alias("b"), "m"), "b").groupBy(F.col("a").alias("sid")).agg(F.sum("m").alias("others"))
    per = size.join(roots.withColumnRenamed("v", "sid"), "sid", "left").join(near, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    heads = per.groupBy("root").agg(F.min("first").alias("group_id"))
    found = members.join(per.join(heads, "root"), "sid").select("task_id", "group_id", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("links"))
    alone = rows.select("task_id").distinct().join(found, "task_id", "left_anti").select("task_id", F.col("task_id").alias("group_id"), F.lit(0).cast("long").alias("links"))
    # a record whose copies differ counts once
    return found.unionByName(alone).groupBy("task_id").agg(F.min("group_id").alias("group_id"), F.max("links").alias("links"))


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each document's text by byte_bpe_50k, without special tokens."""
    return p5.encode(table(spark, d, "documents"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return p6.leaks(table(spark, d, "documents"), table(spark, d, "benchmark_text_index"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of a held-out item, with the item."""
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Of each leaked item the number of documents it leaked into, and the longest passage."""
    return _leaks(spark, d).groupBy("item_id", "item_words").agg(F.countDistinct("doc_id").alias("documents"), F.max("span").alias("longest"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that aren't natural prose."""
    return p7.quality(table(spark, d, "documents")).filter("reason is not null").select("doc_id")


def p7_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The text statistics of each document, and why it isn't prose."""
    return p7.quality(table(spark, d, "documents"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of the statistics those that count words and lines."""
    q = p7.quality(table(spark, d, "documents"))
    return q.select("doc_id", "n_words", "n_lines", *(F.round(c, 6).alias(c) for c in ("mean_word", "ends", "bullet_lines")))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_report": p1_report, "p1_overlap": p1_overlap, "p2_found": p2_found, "p2_latest": p2_latest, "p2_pool": p2_pool, "p2_batches": p2_batches, "p3_found": p3_found, "p3_splits": p3_splits, "p3_totals": p3_totals, "p4_found": p4_found, "p4_groups": p4_groups, "p5_ids": p5_ids, "p6_found": p6_found, "p6_items": p6_items, "p7_found": p7_found, "p7_statistics": p7_statistics, "p7_counts": p7_counts}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql(STANDING)
