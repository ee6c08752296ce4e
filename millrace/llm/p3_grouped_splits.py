"""Problem 3: splits that keep related records together.

Components by parallel hooking and shortcutting over parent arrays in joined
tables; split totals by subset-sum bitsets over size multiplicities.

- Nodes are the values records can share (a file, an author, a dataset), not the
  records: a value found in a third of all rows is one node, and edges are the
  distinct pairs of values. Hooking is a minimum with map-side combine.
- A null, empty or unknown value joins nothing; a record delivered twice counts
  once; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.asread import read_words
from millrace.session import cut

#: Authors, as read, who aren't known.
NOBODY = frozenset([
    "", "unknown", "unknown author", "unknown artist", "unknown photographer", "unknown creator", "author unknown", "artist unknown", "photographer unknown",
    "anonymous", "anon", "author not given", "artist not given", "not given", "name not given", "author not known", "not known", "no author", "no artist",
    "n a", "na", "none", "null", "nil", "nobody", "not available", "not stated", "not specified", "unspecified", "unnamed", "unidentified", "author not stated", "author not specified",
])

SPLITS = ("train", "validation", "test")


def file_key(path: Column) -> Column:
    """The file a path names: escapes undone, one kind of slash, no scheme, drive, root before data/, dots or doubled slashes, any case."""
    p = F.coalesce(F.try_url_decode(F.regexp_replace(F.trim(path), r"\+", "%2B")), F.trim(path))
    p = F.lower(F.regexp_replace(p, r"[\\/]+", "/"))
    p = F.regexp_replace(F.regexp_replace(p, r"^[a-z][a-z0-9+.-]*:/+", "/"), r"^[a-z]:", "")
    p = F.regexp_replace(p, r"(?<=/|^)\./", "")
    for _ in range(3):
        p = F.regexp_replace(p, r"(?<=/|^)(?!\.\./)[^/]+/\.\./", "")
    p = F.regexp_replace(p, r"^(?:.*?/)?(?=data/)", "")
    p = F.trim(F.regexp_replace(p, r"^/+|/+$", ""))
    return F.when(p != "", p)


def dataset_key(name: Column) -> Column:
    """The spelling of a dataset that counts: no address, escapes, revision, closing slash or case; - and _ stay apart."""
    p = F.trim(F.regexp_replace(name, r"[\s\u00A0\u200B\uFEFF]+", " "))
    p = F.lower(F.coalesce(F.try_url_decode(F.regexp_replace(p, r"\+", "%2B")), p))
    p = F.regexp_replace(p, r"^[a-z][a-z0-9+.-]*://(?:[^/]*\.[^/]*/)?", "")
    p = F.regexp_replace(F.regexp_replace(p, r"^/*(?:datasets/)?", ""), r"[@?#].*$", "")
    p = F.trim(F.regexp_replace(p, r"(?:\.git)?/*$", ""))
    return F.when(p != "", p)


def with_author(df: DataFrame, key: str, *keep: str) -> DataFrame:
    """`keep` columns and `author`: the words of column `key` as read, or null if it names nobody."""
    src = df.select(*keep, F.col(key).alias("_who"))
    kinds = dict(src.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(len(keep)).dictionary_encode()
            names = [" ".join(read_words(x)) for x in codes.dictionary.to_pylist()]
            who = pa.array([None if x in NOBODY else x for x in names], pa.string()).take(codes.indices)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], who], names=[*keep, "author"])

    return src.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "author string"]))


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(v, root) of every node of the edges (a, b), which are longs; root is the same within a component.

    Each round hooks every node to its smallest neighbour, shortcuts the parents
    `jumps` times by joins of the parent table with itself, and contracts the
    edges; the rest of the edges shrinks at least by half. Round tables are cut
    by checkpoints in the shared folder.
    """
    left = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), fresh=True)
    alone = edges.filter("a = b").select(F.col("a").alias("v")).distinct()
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p"))
        for _ in range(jumps):
            to = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            up = up.join(to, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
        up = cut(up, fresh=True)
        rounds.append(up)
        ends = left.join(up.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(up.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        left = cut(ends.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), fresh=True)
    out = None
    for up in rounds:
        step = up.select(F.col("v").alias("root"), F.col("p").alias("_up"))
        moved = up.select("v", F.col("p").alias("root")) if out is None else out.join(step, "root", "left").select("v", F.coalesce("_up", "root").alias("root"))
        out = moved
    alone = alone.select("v", F.col("v").alias("root"))
    return alone if out is None else out.unionByName(alone.join(out.select("v"), "v", "left_anti"))


def seed_values(seeds: DataFrame) -> DataFrame:
    """(record_id, f, w): of each seed prompt the ids of its file and of its author, null if it has none."""
    src = seeds.select(F.col("task_id").alias("record_id"), file_key(F.col("source_image")).alias("file"), F.col("source_image_provenance.artist").alias("artist"))
    who = with_author(src, "artist", "record_id", "file")
    return who.select("record_id", F.when(F.col("file").isNotNull(), F.xxhash64(F.lit("file"), "file")).alias("f"), F.when(F.col("author").isNotNull(), F.xxhash64(F.lit("author"), "author")).alias("w")).distinct()


def catalogue(catalog: DataFrame) -> DataFrame:
    """(dkey, d, up): the spelling of each entry that counts, its id, and that of the entry it mirrors."""
    d = lambda c: F.when(c.isNotNull(), F.xxhash64(F.lit("dataset"), c))
    own, up = dataset_key(F.col("dataset_id")), dataset_key(F.col("mirror_of"))
    return catalog.select(own.alias("dkey"), d(own).alias("d"), d(up).alias("up")).filter("dkey is not null")


def _left(df: DataFrame, other: DataFrame, key: str, **added: str) -> DataFrame:
    """The left join by `key`; rows whose key is null stay out of it, so that they don't gather in one task. added: columns of `other`, with types."""
    none = df.filter(F.col(key).isNull()).withColumns({c: F.lit(None).cast(t) for c, t in added.items()})
    return df.filter(F.col(key).isNotNull()).join(other.select(key, *added), key, "left").unionByName(none)


def related(seeds: DataFrame, pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(record_id, kind, root): every record of both tables and its component; root is null where nothing can join it."""
    values = cut(seed_values(seeds))
    entries = catalogue(catalog)
    known = entries.select("d").distinct()
    used = pairs.select(F.col("sample_id").alias("record_id"), dataset_key(F.col("dataset_id")).alias("dkey")).distinct()
    used = _left(used, entries.select("dkey", "d").distinct(), "dkey", d="long").select("record_id", "d")
    edges = (
        values.filter("f is not null or w is not null").select(F.coalesce("f", "w").alias("a"), F.coalesce("w", "f").alias("b")).distinct()
        .unionByName(entries.join(known.select(F.col("d").alias("up"), F.lit(True).alias("_in")), "up", "left").select(F.col("d").alias("a"), F.when(F.col("_in"), F.col("up")).otherwise(F.col("d")).alias("b")).distinct())
    )
    roots = cut(components(edges))
    one = values.select("record_id", F.lit("seed").alias("kind"), F.coalesce("f", "w").alias("v"))
    two = used.select("record_id", F.lit("pair").alias("kind"), F.col("d").alias("v"))
    return _left(one.unionByName(two), roots, "v", root="long").select("record_id", "kind", "root").distinct()


def groups(rel: DataFrame) -> DataFrame:
    """(record_id, kind, group_id, size): group_id is the smallest key of a record's group, size its number of records."""
    whole = rel.filter("root is not null").groupBy("kind", "root").agg(F.min("record_id").alias("group_id"), F.count(F.lit(1)).alias("size"))
    both = rel.filter("root is not null").join(whole, ["kind", "root"]).unionByName(rel.filter("root is null").withColumns({"group_id": F.lit(None).cast("string"), "size": F.lit(1).cast("long")}))
    return both.select("record_id", "kind", F.coalesce("group_id", "record_id").alias("group_id"), F.coalesce("size", F.lit(1)).alias("size"))


def subset_sum(sizes: dict[int, int], target: int) -> tuple[dict[int, int], int]:
    """How many groups of each size to take so that their total is as close to `target` as can be, and the gap that is left.

    Bit t of a set stands for a total of t. Multiplicities are split by powers of two; each item shifts the set onto itself, and for
    each total the item that first reached it is kept (2 bytes a total), which is all that the way back needs. It ends at the target.
    """
    if target <= 0 or not sizes:
        return {}, max(target, 0)
    items = []
    for s, m in sorted(sizes.items(), reverse=True):
        k = 1
        while m > 0:
            items.append((s, min(k, m)))
            m -= min(k, m)
            k *= 2
    items = sorted((x for x in items if x[0] * x[1] <= 2 * target), key=lambda x: x[0] * x[1], reverse=True)
    words = (2 * target + 64) // 64
    seen = np.zeros(words, np.uint64)
    seen[0] = 1
    by = np.zeros(words * 64, np.int16 if len(items) < 1 << 15 else np.int32)
    for i, (s, k) in enumerate(items):
        far, bit = divmod(s * k, 64)
        moved = np.zeros(words, np.uint64)
        moved[far:] = seen[: words - far] << np.uint64(bit)
        if bit:
            moved[far + 1 :] |= seen[: words - far - 1] >> np.uint64(64 - bit)
        moved &= ~seen
        some = np.flatnonzero(moved)
        for part in np.array_split(some, len(some) // 1_000_000 + 1):
            at, off = np.nonzero(np.unpackbits(moved[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            by[part[at] * 64 + off] = i
        seen |= moved
        if seen[target // 64] >> np.uint64(target % 64) & np.uint64(1):
            break
    bits = np.unpackbits(seen.view(np.uint8), bitorder="little")
    down, up = int(bits[target::-1].argmax()), int(bits[target:].argmax())
    total = target + up if bits[target + up] and up < down else target - down
    gap, taken = abs(total - target), {}
    while total:
        s, k = items[by[total]]
        taken[s] = taken.get(s, 0) + k
        total -= s * k
    return taken, gap


def take_closest(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size to take so that their total is as close to `target` as can be; sizes: multiplicity by size.

    Each size first gives its share, rounded down, so that no split is made of large groups alone; subset sums find the rest. If
    these leave a gap, which they do only where groups are few, the sums are made anew without the shares: the closest total in any case.
    """
    total = sum(s * m for s, m in sizes.items())
    if not total:
        return {}
    taken = {s: m * target // total for s, m in sizes.items()}
    more, gap = subset_sum({s: m - taken[s] for s, m in sizes.items()}, target - sum(s * k for s, k in taken.items()))
    if gap:
        return subset_sum(sizes, target)[0]
    return {s: k + more.get(s, 0) for s, k in taken.items()}


def assign(grouped: DataFrame, shares: tuple[float, float] = (0.1, 0.1), seed: str = "1", buckets: int = 256) -> DataFrame:
    """(record_id, kind, group_id, split). Of each size the groups first by hash go to test, then to validation.

    Only the multiplicities by kind and size come to the driver (at most the root of twice the number of
    records); ranks are found in buckets of the hash, so no size's groups meet in one task.
    """
    each = grouped.select("kind", "group_id", "size").distinct().withColumn("h", F.xxhash64(F.lit(seed), "group_id"))
    each = each.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    many: dict[str, dict[int, int]] = {}
    for r in each.groupBy("kind", "size").count().collect():
        many.setdefault(r["kind"], {})[r["size"]] = r["count"]
    quota = []
    for kind, sizes in many.items():
        n = sum(s * m for s, m in sizes.items())
        first = take_closest(sizes, round(n * shares[1]))
        second = take_closest({s: m - first.get(s, 0) for s, m in sizes.items()}, round(n * shares[0]))
        quota += [(kind, s, first.get(s, 0), second.get(s, 0)) for s in sizes]
    spark = grouped.sparkSession
    quotas = spark.createDataFrame(quota, "kind string, size long, t long, v long")
    starts = each.groupBy("kind", "size", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("kind", "size").orderBy("bucket")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("kind", "size", "bucket").orderBy("h", "group_id")) + F.col("before")
    ranked = each.join(starts, ["kind", "size", "bucket"]).withColumn("rank", rank).join(quotas, ["kind", "size"])
    split = F.when(F.col("rank") <= F.col("t"), SPLITS[2]).when(F.col("rank") <= F.col("t") + F.col("v"), SPLITS[1]).otherwise(SPLITS[0])
    return grouped.select("record_id", "kind", "group_id").join(ranked.select("kind", "group_id", split.alias("split")), ["kind", "group_id"]).select("record_id", "kind", "group_id", "split")
