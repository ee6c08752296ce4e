"""JSON lines and JSON documents: strict, optional, tolerant and validating scans, and sinks with sorted keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from millrace.session import cut


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern of paths, names anything."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_strict(spark: SparkSession, path: str | list[str], schema: str | S.StructType) -> DataFrame:
    """All rows; a line that isn't an object fails the job. Blank lines are skipped. The schema is given, so nothing is scanned twice."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_optional(spark: SparkSession, path: str, schema: str | S.StructType) -> DataFrame:
    """All rows, or none if there is no such file."""
    return read_strict(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_tolerant(spark: SparkSession, path: str | list[str], schema: str | S.StructType) -> DataFrame:
    """The rows that parse, as of a file that is being appended to."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_validated(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows that are objects, and (file, line_no, line) of the lines that aren't; blank lines are neither.

    Lines are numbered from 1 in their file, which may lie in many splits: the place of a line in its split, after the lines of
    the splits before it. Only the counts of splits are joined, and only to bad lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    good = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = splits.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n"))
    bad = lines.filter(~F.coalesce(good, F.lit(False)) & (F.trim("value") != ""))
    errors = bad.join(before, ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line_no"), F.col("value").alias("line"))
    return lines.filter(good).select(F.from_json("value", schema).alias("x")).select("x.*"), errors


def read_document(spark: SparkSession, path: str, schema: str, default: list | None = None) -> DataFrame:
    """One JSON document a file; an array gives a row for each item. If there is no such file: the rows of `default`, if it is given."""
    if default is not None and not exists(spark, path):
        return spark.createDataFrame(default, schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_shards(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All files of a pattern, with `shard`."""
    return read_tolerant(spark, pattern, schema).withColumn("shard", F.col("_metadata.file_path"))


def sorted_columns(df: DataFrame) -> DataFrame:
    """`df` with its columns, and the fields of its structs, in order of name."""
    def order(col: Column, kind: S.DataType) -> Column:
        if isinstance(kind, S.StructType):
            made = F.struct(*(order(col[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
            return F.when(col.isNotNull(), made)
        if isinstance(kind, S.ArrayType) and isinstance(kind.elementType, S.StructType):
            return F.transform(col, lambda x: order(x, kind.elementType))
        return col

    return df.select(*(order(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)))


def write(df: DataFrame, path: str, append: bool = False) -> int:
    """Rows as JSON lines with sorted keys; how many were written, counted as they pass."""
    from pyspark.sql import Observation

    seen = Observation()
    sorted_columns(df).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append" if append else "overwrite").json(path)
    return seen.get["rows"]


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file, in place of what is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_document(spark: SparkSession, value: object, path: str) -> None:
    """A small document as indented JSON."""
    write_text(spark, json.dumps(value, ensure_ascii=False, indent=2) + "\n", path)


def yaml(value: object, depth: int = 0) -> str:
    """Mappings, lists and scalars as YAML; scalars as JSON, which YAML reads."""
    pad = "  " * depth
    if isinstance(value, dict) and value:
        return "\n".join(f"{pad}{k}:" + (f"\n{yaml(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {yaml(v)}") for k, v in value.items())
    if isinstance(value, list) and value:
        return "\n".join(f"{pad}-" + (f"\n{yaml(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {yaml(v)}") for v in value)
    return json.dumps(value, ensure_ascii=False)


def store(spark: SparkSession, path: str, entries: DataFrame, key: str, schema: str) -> None:
    """Writes the registry at a path anew with `entries` put in by key; it is computed before what it is read from goes."""
    cut(upsert(spark, path, entries, key, schema)).coalesce(1).write.mode("overwrite").json(path)


def upsert(spark: SparkSession, path: str, entries: DataFrame, key: str, schema: str) -> DataFrame:
    """The registry at a path with `entries` put in by key; what isn't readable there counts as empty."""
    old = read_tolerant(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)
    return old.filter(F.col(key).isNotNull()).join(entries.select(key), key, "left_anti").unionByName(entries)
