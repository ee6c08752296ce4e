"""Decontamination against held-out texts: frozen fingerprints, exact matches, n-gram similarity, containment, forbidden fields and paths.

The held-out side is broadcast only while it is counted to be small (`SMALL`
rows of fingerprints); beyond that the same joins shuffle. Grams are joined, then
counted by pair, so a pair costs one row for each gram it shares; the grams of a
text meet only held-out texts that have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.session import spread

THRESHOLD = 0.82
SMALL = 500_000
#: Fields and parts of paths that no training row may have, and fields whose strings are always texts.
FORBIDDEN_FIELDS = ["benchmark_id", "benchmark_source_path", "official_answer", "official_target", "official_score"]
FORBIDDEN_PATHS = ["data/benchmarks/", "outputs/eval/"]
TEXT_FIELDS = ["instruction", "text", "prompt", "target", "target_description", "expected_target", "rational_target_description", "editor_prompt", "question", "reference", "gt"]


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """`df`, marked for broadcast if it is counted to have few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fingerprints(items: DataFrame) -> DataFrame:
    """Held-out items with `norm` and `hash`: those stored, or made anew where they are null or empty."""
    norm = F.coalesce(F.nullif("normalized_text", F.lit("")), T.normalize(F.coalesce("text", F.lit(""))))
    return items.withColumn("norm", norm).withColumn("hash", F.coalesce(F.nullif("text_hash", F.lit("")), T.sha256(F.col("norm"))))


def freeze(rows: DataFrame) -> DataFrame:
    """Text items (benchmark, sample_id, field, text) with normalized_text and text_hash; blank texts are left out."""
    return rows.filter(F.trim("text") != "").withColumn("normalized_text", T.normalize(F.col("text"))).withColumn("text_hash", T.sha256(F.col("normalized_text")))


def exact_flags(df: DataFrame, text: str, items: DataFrame) -> DataFrame:
    """`df` with `exact`: whether its normalized text is that of an item. An empty text matches nothing."""
    norms = small(fingerprints(items).filter("norm <> ''").select(F.col("norm").alias("_norm")).distinct().withColumn("exact", F.lit(True)))
    return df.withColumn("_norm", T.normalize(F.coalesce(F.col(text), F.lit("")))).join(norms, "_norm", "left").withColumn("exact", F.coalesce("exact", F.lit(False))).drop("_norm")


def held_flags(df: DataFrame, texts: dict[str, Column], items: DataFrame) -> DataFrame:
    """`df` with a boolean column for each named text: whether it is, normalized, a held-out text. Null and empty texts are none."""
    norms = small(fingerprints(items).filter("norm <> ''").select("norm").distinct())
    for name, text in texts.items():
        df = df.withColumn("_norm", T.normalize(text)).join(norms.select(F.col("norm").alias("_norm"), F.lit(True).alias(name)), "_norm", "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_norm")
    return df


def grams(df: DataFrame, key: str, norm: Column, n: int = 5) -> DataFrame:
    """(key, size, gram): a row for each distinct n-gram of each text; a text of fewer words is one."""
    return df.select(key, norm.alias("_n")).filter("_n <> ''").mapInArrow(_gram_rows(n, False), f"{key} {dict(df.dtypes)[key]}, size int, gram string")


def hashed_grams(df: DataFrame, key: str, norm: Column, n: int = 5) -> DataFrame:
    """As `grams`, with 64-bit hashes of the n-grams, which is what joins and counts need: 8 bytes instead of a text.

    Making the 2.0 million 5-grams of sf0.1 took 1.6 to 1.8 s this way, 1.9 to 2.3 s as strings and 1.8 to 3.0 s by array functions
    in the JVM (the second and third of three runs each, on 8 cores beside another job): no great difference,
    so the gain is in what is shuffled.
    """
    return df.select(key, norm.alias("_n")).filter("_n <> ''").mapInArrow(_gram_rows(n, True), f"{key} {dict(df.dtypes)[key]}, size int, gram long")


def _gram_rows(n: int, hashed: bool):
    """Runs of n words of each text of an Arrow batch; texts stay whole. Hashes are of the words' own 64-bit hashes, mixed in order."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    def strings(texts):
        size, out = [], []
        for t in texts:
            w = t.split(" ")
            g = {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} or {t}
            out.extend(g)
            size.append(len(g))
        return np.array(size, np.int32), pa.array(out, pa.string())

    ids: dict[str, int] = {}

    def word_id(w: str) -> int:
        v = ids.get(w)
        if v is None:
            if len(ids) > 1_000_000:  # bounds a worker's memory, not the result
                ids.clear()
            v = ids[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        return v

    def hashes(texts):
        words = [t.split(" ") for t in texts]
        many = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter((word_id(w) for t in words for w in t), np.uint64, int(many.sum()))
        runs = np.minimum(many, n)
        place = np.maximum(many - n + 1, 1)
        begin = np.repeat(np.cumsum(many) - many, place) + np.arange(place.sum()) - np.repeat(np.cumsum(place) - place, place)
        row, long = np.repeat(np.arange(len(words)), place), np.repeat(runs, place)
        h = np.full(len(begin), np.uint64(0x9E3779B97F4A7C15)) ^ long.astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                more = k < long
                v = flat[np.minimum(begin + k, len(flat) - 1)]
                h = np.where(more, (h ^ v) * np.uint64(0xBF58476D1CE4E5B9), h)
                h ^= np.where(more, h >> np.uint64(29), np.uint64(0))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        return np.bincount(row[first], minlength=len(words)).astype(np.int32), pa.array(h[first].view(np.int64))

    def run(batches):
        for b in batches:
            if b.num_rows:
                size, out = (hashes if hashed else strings)(b.column(1).to_pylist())
                at = np.repeat(np.arange(b.num_rows), size)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(size[at]), out], names=[b.schema.names[0], "size", "gram"])

    return run


def overlaps(df: DataFrame, key: str, text: str, items: DataFrame, n: int = 5) -> DataFrame:
    """(key, item_id, both, size_text, size_item): all pairs that share an n-gram, without those of equal hash.

    Grams are joined as hashes. A gram that many items have is met by the texts that have it, as all pairs are asked for;
    the counts of pairs are combined before they are shuffled.
    """
    held = fingerprints(items)
    df = spread(df.select(key, text))
    left = hashed_grams(df.select(key, T.normalize(F.coalesce(F.col(text), F.lit(""))).alias("_t")), key, F.col("_t"), n).withColumnRenamed("size", "size_text")
    right = small(hashed_grams(held, "item_id", F.col("norm"), n).withColumnRenamed("size", "size_item"))
    shared = left.join(right, "gram").groupBy(key, "item_id", "size_text", "size_item").agg(F.count(F.lit(1)).alias("both"))
    same = df.select(key, T.sha256(T.normalize(F.coalesce(F.col(text), F.lit("")))).alias("hash")).join(small(held.select("item_id", "hash")), "hash").select(key, "item_id")
    return shared.join(same, [key, "item_id"], "left_anti").select(key, "item_id", "both", "size_text", "size_item")


def similarity() -> Column:
    """Jaccard similarity of a pair of `overlaps`."""
    return F.col("both") / (F.col("size_text") + F.col("size_item") - F.col("both"))


def severity(threshold: float = THRESHOLD) -> Column:
    """medium for a pair as similar as the threshold, else none."""
    return F.when(similarity() >= threshold, "medium").otherwise("none")


def report(df: DataFrame, key: str, text: str, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(severity, type, issues): exact matches, near matches of texts of five words or more, forbidden paths."""
    norm = T.normalize(F.coalesce(F.col(text), F.lit("")))
    held = fingerprints(items).filter("norm <> ''")
    exact = df.select(T.sha256(norm).alias("hash")).join(small(held.select("hash")), "hash").select(F.lit("high").alias("severity"), F.lit("exact_benchmark_text").alias("type"))
    long = df.filter(F.size(F.split(norm, " ")) >= 5)
    near = overlaps(long, key, text, items).filter(similarity() >= threshold).select(F.lit("medium").alias("severity"), F.lit("ngram_benchmark_text").alias("type"))
    paths = df.filter(T.contains_any(F.col(text), FORBIDDEN_PATHS)).select(F.lit("high").alias("severity"), F.lit("forbidden_path").alias("type"))
    return exact.unionByName(near).unionByName(paths).groupBy("severity", "type").agg(F.count(F.lit(1)).alias("issues"))


def forbidden_fields(raw_json: Column) -> Column:
    """The forbidden fields that a JSON row has at its top, even if null."""
    return F.array_sort(F.array_intersect(F.json_object_keys(raw_json), F.array(*map(F.lit, FORBIDDEN_FIELDS))))


ISSUE = "row_id string, field string, severity string, type string, benchmark string, sample_id string, overlap double"


def issues(values: DataFrame, items: DataFrame, fields: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, field, severity, type, benchmark, sample_id, overlap): everything wrong with the strings of training rows.

    values: (key, field, text) of `text_values`; items: held-out texts with benchmark and sample_id; fields: (key, raw JSON),
    for forbidden fields. Empty texts have no issue; near matches need five words; each forbidden part of a path counts.
    """
    key = values.columns[0]
    each = values.select(F.col(key).cast("string").alias("row_id"), "field", "text").withColumn("norm", T.normalize("text")).filter("norm <> ''")
    held = fingerprints(items).filter("norm <> ''").select("item_id", "benchmark", "sample_id", "norm", "hash")
    none = F.lit(None)
    paths = each.select("row_id", "field", F.explode(T.terms_in(F.col("text"), FORBIDDEN_PATHS)).alias("_part"))
    out = paths.select("row_id", "field", F.lit("high").alias("severity"), F.lit("forbidden_path").alias("type"), none.cast("string").alias("benchmark"), none.cast("string").alias("sample_id"), none.cast("double").alias("overlap"))
    exact = each.withColumn("hash", T.sha256(F.col("norm"))).join(small(held.select("hash", "benchmark", "sample_id")), "hash")
    out = out.unionByName(exact.select("row_id", "field", F.lit("high").alias("severity"), F.lit("exact_benchmark_text").alias("type"), "benchmark", "sample_id", none.cast("double").alias("overlap")))
    # texts are compared once, however many rows hold them
    long = each.filter(F.size(F.split("norm", " ")) >= 5).select("norm").distinct().withColumn("tid", F.xxhash64("norm"))
    pairs = overlaps(long.select("tid", "norm"), "tid", "norm", held.withColumnRenamed("norm", "normalized_text").withColumnRenamed("hash", "text_hash").withColumn("text", F.col("normalized_text")))
    near = pairs.filter(similarity() >= threshold).select("tid", "item_id", F.round(similarity(), 4).alias("overlap")).join(small(held.select("item_id", "benchmark", "sample_id")), "item_id")
    found = each.select("row_id", "field", F.xxhash64("norm").alias("tid")).join(near, "tid")
    out = out.unionByName(found.select("row_id", "field", F.lit("medium").alias("severity"), F.lit("ngram_benchmark_text").alias("type"), "benchmark", "sample_id", "overlap"))
    if fields is not None:
        k, raw = fields.columns
        bad = fields.select(F.col(k).cast("string").alias("row_id"), F.explode(forbidden_fields(F.col(raw))).alias("field"))
        out = out.unionByName(bad.select("row_id", "field", F.lit("high").alias("severity"), F.lit("forbidden_field").alias("type"), none.cast("string").alias("benchmark"), none.cast("string").alias("sample_id"), none.cast("double").alias("overlap")))
    return out


def verdict(found: DataFrame, rows_checked: DataFrame, items: DataFrame) -> DataFrame:
    """One row: rows checked, held-out texts, issues by severity and type, `ok` (no high one), and whether a gate on high or on medium fails."""
    n = lambda c: F.count_if(c)
    kinds = ["forbidden_field", "forbidden_path", "exact_benchmark_text", "ngram_benchmark_text"]
    counts = found.agg(n(F.col("severity") == "high").alias("high"), n(F.col("severity") == "medium").alias("medium"), *(n(F.col("type") == k).alias(k) for k in kinds))
    sizes = rows_checked.agg(F.count(F.lit(1)).alias("rows_checked")).crossJoin(F.broadcast(fingerprints(items).filter("norm <> ''").agg(F.count(F.lit(1)).alias("benchmark_text_items"))))
    all_ = sizes.crossJoin(F.broadcast(counts))  # one row each
    return all_.withColumns({"ok": F.col("high") == 0, "fails_on_high": F.col("high") > 0, "fails_on_medium": F.col("high") + F.col("medium") > 0})


def first_issues(found: DataFrame, most: int = 200) -> DataFrame:
    """The issues that a report shows, in order."""
    return found.orderBy("row_id", "field", "type", "benchmark", "sample_id").limit(most)


def text_values(df: DataFrame, key: str) -> DataFrame:
    """(key, field, text): every string of a row, however deep, under a text field or of five words or more; items of lists go by the list's field."""
    from pyspark.sql import types as S

    found: list[Column] = []

    def walk(col: Column, kind: S.DataType, name: str) -> Column | None:
        pair = lambda t: F.struct(F.lit(name).alias("field"), t.alias("text"))
        if isinstance(kind, S.StringType):
            return F.array(pair(col))
        if isinstance(kind, S.StructType):
            parts = [p for f in kind.fields if (p := walk(col[f.name], f.dataType, f.name)) is not None]
            return F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<struct<field:string,text:string>>")) for p in parts])) if parts else None
        if isinstance(kind, S.ArrayType):
            inner = walk(F.lit(None).cast(kind.elementType), kind.elementType, name)
            return None if inner is None else F.flatten(F.transform(col, lambda x: walk(x, kind.elementType, name)))
        if isinstance(kind, S.MapType):
            if isinstance(kind.valueType, S.StringType):
                return F.transform(F.map_entries(col), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("text")))
            if isinstance(kind.valueType, S.ArrayType) and isinstance(kind.valueType.elementType, S.StringType):
                return F.flatten(F.transform(F.map_entries(col), lambda e: F.transform(e["value"], lambda x: F.struct(e["key"].alias("field"), x.alias("text")))))
            # values of another shape go by their own fields, lists in them by the map's
            if walk(F.lit(None).cast(kind.valueType), kind.valueType, name) is not None:
                return F.flatten(F.transform(F.map_values(col), lambda v: walk(v, kind.valueType, name)))
        return None

    for f in df.schema.fields:
        if f.name != key and (w := walk(F.col(f.name), f.dataType, f.name)) is not None:
            found.append(F.coalesce(w, F.array().cast("array<struct<field:string,text:string>>")))
    rows = df.select(key, F.explode(F.flatten(F.array(*found))).alias("v")).select(key, "v.field", "v.text").filter("text is not null")
    return rows.filter(F.col("field").isin(TEXT_FIELDS) | (F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")) >= 5))


def similar_pairs(df: DataFrame, key: str, text: str, n: int = 5, tenths: int = 8) -> DataFrame:
    """(key_a, key_b, both, size_a, size_b): pairs of rows, key_a < key_b, whose n-gram sets have a Jaccard similarity of tenths / 10 or more.

    Copies of a text are one in the search. Each text is found by its rarest grams alone, as many as must hold one
    that both have (prefix filter), in an order that all share; so common phrases produce no pairs, and none is lost.
    """
    keyed = spread(df.select(key, text)).select(key, T.normalize(F.coalesce(F.col(text), F.lit(""))).alias("_t")).filter("_t <> ''")
    one = keyed.select("_t").distinct().withColumn("tid", F.xxhash64("_t"))
    each = hashed_grams(one.select("tid", "_t"), "tid", F.col("_t"), n)
    df_counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    lists = each.join(df_counts, "gram").groupBy("tid", "size").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    lists = lists.select("tid", "size", F.transform("g", lambda x: x["gram"]).alias("g")).persist()
    prefix = lists.select("tid", "size", F.explode(F.slice("g", F.lit(1), F.col("size") - F.ceil(F.col("size") * tenths / 10) + 1)).alias("h"))
    a, b = prefix.alias("a"), prefix.alias("b")
    fits = (F.col("a.size") * 10 >= F.col("b.size") * tenths) & (F.col("b.size") * 10 >= F.col("a.size") * tenths)
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.tid") < F.col("b.tid")) & fits).select(F.col("a.tid").alias("x"), F.col("b.tid").alias("y")).distinct()
    full = met.join(lists.select(F.col("tid").alias("x"), F.col("g").alias("gx"), F.col("size").alias("sx")), "x").join(lists.select(F.col("tid").alias("y"), F.col("g").alias("gy"), F.col("size").alias("sy")), "y")
    both = F.size(F.array_intersect("gx", "gy"))
    near = full.select("x", "y", both.cast("long").alias("both"), "sx", "sy").filter(F.col("both") * 10 >= (F.col("sx") + F.col("sy") - F.col("both")) * tenths)
    members = keyed.select(F.col(key).alias("k"), F.xxhash64("_t").alias("tid")).distinct()
    xs, ys = members.select(F.col("k").alias("kx"), F.col("tid").alias("x")), members.select(F.col("k").alias("ky"), F.col("tid").alias("y"))
    between = near.join(xs, "x").join(ys, "y").filter("kx <> ky")
    between = between.select(F.least("kx", "ky").alias(f"{key}_a"), F.greatest("kx", "ky").alias(f"{key}_b"), "both", F.when(F.col("kx") < F.col("ky"), F.col("sx")).otherwise(F.col("sy")).cast("long").alias("size_a"), F.when(F.col("kx") < F.col("ky"), F.col("sy")).otherwise(F.col("sx")).cast("long").alias("size_b"))
    sizes = lists.select(F.col("tid").alias("x"), F.col("size").cast("long").alias("s"))
    within = xs.join(ys, (F.col("x") == F.col("y")) & (F.col("kx") < F.col("ky"))).join(sizes, "x").select(F.col("kx").alias(f"{key}_a"), F.col("ky").alias(f"{key}_b"), F.col("s").alias("both"), F.col("s").alias("size_a"), F.col("s").alias("size_b"))
    return between.unionByName(within)
