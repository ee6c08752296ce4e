"""Audits: distributions, repeated n-grams, phrase hits, ratios, summaries of reviews, judges, renders and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.decontam import grams
from millrace.session import spread

#: Phrases that glue instructions together, as patterns on normalized text, the template of a rationale, and checklist questions that fit anything.
GLUE = [
    r"^after inspecting the diagram",
    r"^study the image first",
    r"^look at the image carefully",
    r"keep unrelated regions unchanged",
    r"preserve object identity unless the instruction explicitly changes it",
    r"the target state must be knowledge plausible",
    r"do not alter any unrelated object",
    r"focus on reasoning correctness",
    r"preserve all unrelated visual context",
]
RATIONAL = "this requires [a-z_ ]+ reasoning"
GENERIC = [
    "is the result consistent with the required reasoning or discipline knowledge",
    "are unrelated objects background layout lighting and viewpoint preserved",
    "is the edited image visually clear and free of unrelated additions",
    "does the edit correctly perform this operation",
]


def distribution(df: DataFrame, columns: list[str], label: str = "?") -> DataFrame:
    """(dimension, value, rows): counts by each column, all in one pass by grouping sets; null is `label`."""
    named = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit(label)).alias(f"c{i}") for i, c in enumerate(columns)))
    keys = [F.col(f"c{i}") for i in range(len(columns))]
    sets = named.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id(*keys).alias("g"), F.count(F.lit(1)).alias("rows"))
    top = (1 << len(columns)) - 1
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        at = F.col("g") == top - (1 << (len(columns) - 1 - i))
        which, value = F.when(at, c).otherwise(which), F.when(at, keys[i]).otherwise(value)
    return sets.select(which.alias("dimension"), value.alias("value"), "rows")


def top_grams(df: DataFrame, key: str, text: str, n: int = 8, k: int = 25, least: int = 20) -> DataFrame:
    """(gram, documents): the k n-grams found in most documents, of those in at least max(least, rows // 100); ties by gram."""
    rows = df.count()
    norm = spread(df.select(key, text)).select(key, T.normalize(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    long = norm.filter(F.size(F.split("_t", " ")) >= n)  # shorter texts have no n-gram here
    counts = grams(long, key, F.col("_t"), n).groupBy("gram").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= max(least, rows // 100))
    return counts.orderBy(F.desc("documents"), "gram").limit(k)


def phrase_hits(df: DataFrame, text: str, patterns: list[str] = GLUE) -> DataFrame:
    """(pattern, rows): how many texts match each pattern, in one pass."""
    norm = T.normalize(F.coalesce(F.col(text), F.lit("")))
    one = df.select(norm.alias("_t")).agg(*(F.count_if(F.col("_t").rlike(p)).alias(f"p{i}") for i, p in enumerate(patterns)))
    return one.select(F.explode(F.create_map(*(x for i, p in enumerate(patterns) for x in (F.lit(p), F.col(f"p{i}"))))).alias("pattern", "rows"))


def uniqueness(df: DataFrame, group: str, text: str) -> DataFrame:
    """(group, rows, distinct_texts): distinct normalized texts of each group; a null counts as the empty text."""
    norm = T.normalize(F.coalesce(F.col(text), F.lit("")))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(norm).alias("distinct_texts"))


def checklist_audit(df: DataFrame, checklist: str) -> DataFrame:
    """One row: questions, distinct ones, and generic ones of grouped checklists."""
    q = df.select(F.explode(F.flatten(F.map_values(F.col(checklist)))).alias("q")).select(T.normalize(F.coalesce("q", F.lit(""))).alias("q"))
    generic = T.contains_any(F.col("q"), GENERIC)
    return q.agg(F.count(F.lit(1)).alias("questions"), F.count_distinct("q").alias("unique_questions"), F.count_if(generic).alias("generic_questions"))


def boilerplate(df: DataFrame, ops: str) -> DataFrame:
    """One row: operations, and those whose target, region and change are one and the same, all missing included."""
    o = df.select(F.explode(F.col(ops)).alias("o"))
    same = F.col("o.target").eqNullSafe(F.col("o.region_hint")) & F.col("o.region_hint").eqNullSafe(F.col("o.change"))
    return o.agg(F.count(F.lit(1)).alias("operations"), F.count_if(same).alias("boilerplate"))


def echoes(prompt: Column, instruction: Column) -> Column:
    """Whether one normalized text holds the other."""
    p, i = T.normalize(F.coalesce(prompt, F.lit(""))), T.normalize(F.coalesce(instruction, F.lit("")))
    return (p != "") & (i != "") & (F.contains(p, i) | F.contains(i, p))


def judged(df: DataFrame) -> DataFrame:
    """One row of a judge's verdicts (error, same, leaks, invented, quality): judged, errors, and sums of each."""
    ok = F.col("error").isNull()
    yes = lambda c: F.count_if(ok & F.coalesce(F.col(c), F.lit(False)))
    return df.agg(
        F.count_if(ok).alias("judged"), F.count_if(~ok).alias("errors"), yes("same").alias("same_edit"), yes("leaks").alias("leaks"), yes("invented").alias("invented"),
        F.coalesce(F.sum(F.when(ok, F.coalesce("quality", F.lit(0)))), F.lit(0)).cast("long").alias("quality_sum"),
    )


def judge_rejects(df: DataFrame) -> DataFrame:
    """(task_id): what a judge rejects; rows with an error say nothing."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return df.filter(F.col("error").isNull() & (no("same") | ~no("leaks") | ~no("invented"))).select("task_id").distinct()


def pairwise(df: DataFrame, task: str, label: str, score: str) -> DataFrame:
    """One row: tasks with a passing and a failing item, and those whose passing one scores strictly more."""
    p = df.groupBy(task).agg(F.max(F.when(F.col(label) == "pass", F.col(score))).alias("p"), F.max(F.when(F.col(label) == "fail", F.col(score))).alias("f"))
    both = p.filter("p is not null and f is not null")
    return both.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("p") > F.col("f")).alias("won"))


def render_rates(df: DataFrame, group: str, kind: str, score: str, least: float = 0.99) -> DataFrame:
    """(group, teacher_n, teacher_pass, negative_n, negative_reject) of each group and over all (null)."""
    t, n, s = F.col(kind) == "teacher", F.col(kind) == "negative", F.col(score)
    return df.rollup(group).agg(F.count_if(t).alias("teacher_n"), F.count_if(t & (s >= least)).alias("teacher_pass"), F.count_if(n).alias("negative_n"), F.count_if(n & (s < least)).alias("negative_reject"))


def score_report(df: DataFrame, columns: list[str], score: str) -> DataFrame:
    """(dimension, value, rows, total) of a score by each column and over all (`all`), in one pass by grouping sets; null is `unknown`."""
    named = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(f"c{i}") for i, c in enumerate(columns)), F.col(score).alias("_s"))
    keys = [F.col(f"c{i}") for i in range(len(columns))]
    sets = named.groupingSets([*([k] for k in keys), []], *keys).agg(F.grouping_id(*keys).alias("g"), F.count("_s").alias("rows"), F.sum("_s").alias("total"))
    top = (1 << len(columns)) - 1
    which, value = F.lit("all"), F.lit("all")
    for i, c in enumerate(columns):
        at = F.col("g") == top - (1 << (len(columns) - 1 - i))
        which, value = F.when(at, c).otherwise(which), F.when(at, keys[i]).otherwise(value)
    return sets.select(which.alias("dimension"), value.alias("value"), "rows", "total")


def dropped(tasks: DataFrame, refined: DataFrame, rejected: DataFrame, group: str) -> DataFrame:
    """(group, outcome, tasks): how many tasks of each group are usable, have no refined record, or are rejected by a judge."""
    has = refined.select("task_id").distinct().withColumn("_has", F.lit(True))
    no = rejected.select("task_id").distinct().withColumn("_no", F.lit(True))
    outcome = F.when(F.col("_has").isNull(), "no_refinement").when(F.col("_no"), "judge_rejected").otherwise("usable")
    return tasks.join(has, "task_id", "left").join(no, "task_id", "left").groupBy(group, outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("tasks"))


def latest_pivot(df: DataFrame, key: str, kind: str, kinds: list[str], value: str, order: list[Column]) -> DataFrame:
    """(key, one column for each kind): the last value of each kind."""
    return df.groupBy(key).pivot(kind, kinds).agg(F.max_by(F.col(value), F.struct(*order)))


def histogram(df: DataFrame, reasons: str) -> DataFrame:
    """(reason, rows), one count for each reason of a row."""
    return df.select(F.explode(F.col(reasons)).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def bootstrap(df: DataFrame, key: str, difference: str, rounds: int = 100, buckets: int = 1000) -> DataFrame:
    """One row (pairs, mean_difference, worse): a paired bootstrap; `worse` counts the rounds whose mean isn't above zero.

    Rows are summed into hash buckets first and the buckets are resampled by Poisson(1) weights from a hash of bucket
    and round, so `rounds * buckets` rows are all that is ever multiplied.
    """
    b = df.filter(F.col(difference).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(difference).alias("s"))
    u = F.pmod(F.xxhash64("b", "round"), F.lit(1 << 30)) / float(1 << 30)
    import math

    weight, edge = F.lit(0), 0.0
    for k in range(8):
        edge += math.exp(-1) / math.factorial(k)
        weight = weight + F.when(u >= edge, 1).otherwise(0)
    drawn = b.select("b", "n", "s", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", weight)
    means = drawn.groupBy("round").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    total = b.agg(F.sum("n").alias("pairs"), (F.sum("s") / F.sum("n")).alias("mean_difference"))
    return total.crossJoin(F.broadcast(means.agg(F.count_if(F.col("m") <= 0).alias("worse"))))  # one row each


def write_markdown(spark: SparkSession, title: str, tables: dict[str, DataFrame], path: str, rows: int = 200) -> None:
    """A report of small tables; `rows` is what a table shows."""
    lines = [f"# {title}", ""]
    for name, df in tables.items():
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in df.limit(rows).collect()] + [""]
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = fs.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs, True)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()
