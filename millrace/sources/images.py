"""Images as files: records of size, digest and existence without decoding, and pixel functions on decoded arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S


#: Modes of PNG images by the colour type of their header.
MODES = {"00": "L", "02": "RGB", "03": "P", "04": "LA", "06": "RGBA"}


def records(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256, kind, width, height, mode) of each file; sizes and modes of PNG files come from their header."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    head = F.hex(F.substring("content", 1, 26))
    png = F.startswith(head, F.lit("89504E470D0A1A0A"))
    number = lambda at: F.when(png, F.conv(F.substring(head, at, 8), 16, 10).cast("int"))
    kind = F.when(png, "png").when(F.startswith(head, F.lit("FFD8FF")), "jpeg").otherwise("other")
    mode = F.element_at(F.create_map(*(F.lit(x) for pair in MODES.items() for x in pair)), F.when(png, F.substring(head, 51, 2)))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"), number(33).alias("width"), number(41).alias("height"), mode.alias("mode"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of each file; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")


def missing(df: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """Rows whose file isn't there; a null path counts as missing."""
    return df.join(files.select(F.col("path").alias("_p")), F.col(path) == F.col("_p"), "left_anti")


def data_url(content: Column, kind: str = "png") -> Column:
    return F.concat(F.lit(f"data:image/{kind};base64,"), F.base64(content))


def _average_hashes(gray: pd.Series) -> pd.Series:
    whole = gray.map(lambda p: p is not None and len(p) == 64).to_numpy(bool)
    out = pd.Series([None] * len(gray), index=gray.index, dtype=object)
    if whole.any():
        pixels = np.stack(gray[whole].to_list()).astype(np.float64)
        bits = np.packbits(pixels >= pixels.mean(1, keepdims=True), axis=1)
        out[whole] = [b.tobytes().hex() for b in bits]
    return out


def average_hash(gray: Column) -> Column:
    """The 64-bit hash of 8 x 8 gray values: a bit for each that is at least their mean; null for any other number of values."""
    return F.pandas_udf(_average_hashes, S.StringType())(gray)


def pixel_diff(a: Column, b: Column) -> Column:
    """How many values of two equally long arrays differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def rendered(mode: str, source: Column, exists: Column) -> tuple[Column, Column]:
    """Image and status of a renderer that skips, or copies the source."""
    if mode == "skip":
        return F.lit(None).cast("string"), F.lit("skipped")
    return F.when(exists, source), F.when(exists, "copied_source").otherwise("missing_source")
