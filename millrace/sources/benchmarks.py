"""Held-out benchmarks: loaders of their raw forms, and the union of several with a limit for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def document_rows(spark: SparkSession, path: str, *ids: str) -> DataFrame:
    """(sample_id, raw) of the rows of benchmark documents: an array, or an object whose `data` is one; the id is the first of the named
    fields that a row has, else its place from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    rows = F.when(F.startswith("v", F.lit("[")), F.col("v")).otherwise(F.get_json_object("v", "$.data"))
    each = whole.select(F.posexplode(F.from_json(rows, "array<string>")).alias("at", "raw"))
    return each.select(F.coalesce(*(F.get_json_object("raw", f"$.{i}") for i in ids), F.col("at").cast("string")).alias("sample_id"), "raw")


def instruction_items(docs: DataFrame) -> DataFrame:
    """(benchmark, sample_id, field, text) of rows {index, instruction, reference}: the texts that aren't blank."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("instruction", "reference")))
    return docs.select(F.lit("rise").alias("benchmark"), F.col("index").cast("string").alias("sample_id"), F.explode(fields).alias("x")).select("benchmark", "sample_id", "x.field", "x.text").filter("trim(text) <> ''")


def question_items(docs: DataFrame) -> DataFrame:
    """The same of rows {task_id, text, questions: array of {id, question}}: the text, and a row question:{id} for each question."""
    asked = F.transform(F.coalesce("questions", F.array().cast("array<struct<id:string,question:string>>")), lambda q: F.struct(F.concat(F.lit("question:"), F.coalesce(q["id"], F.lit(""))).alias("field"), q["question"].alias("text")))
    one = F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("text")))
    rows = docs.select(F.lit("grade").alias("benchmark"), F.col("task_id").cast("string").alias("sample_id"), F.explode(F.concat(one, asked)).alias("x")).select("benchmark", "sample_id", "x.field", "x.text")
    return rows.filter((F.col("field") != "text") | (F.trim("text") != "")).filter("text is not null")


def readme_items(lines: DataFrame) -> DataFrame:
    """The same of (line_no, value): lines that speak of KRIS, knowledge or reasoning."""
    line = F.trim("value")
    keep = F.contains(line, F.lit("KRIS")) | F.contains(F.lower(line), F.lit("knowledge")) | F.contains(F.lower(line), F.lit("reasoning"))
    return lines.filter(keep).select(F.lit("kris").alias("benchmark"), F.concat(F.lit("readme:"), F.col("line_no").cast("string")).alias("sample_id"), F.lit("readme_line").alias("field"), line.alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one text file, from 0."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def collect(parts: dict[str, DataFrame], names: list[str], order: str, limit: int | None = None) -> DataFrame:
    """The union of the benchmarks named, at most `limit` rows of each, in order."""
    out = None
    for n in names:
        part = parts[n] if limit is None else parts[n].orderBy(order).limit(limit)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
