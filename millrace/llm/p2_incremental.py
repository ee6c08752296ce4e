"""Problem 2: deduplicating new batches against all history.

Pivot-distance table. The metric is the weighted size of the symmetric difference
of two word sets, d(A, B) = sum of w(x) over x in exactly one of them, with a
fixed pseudo-random weight in [1, 2) for each word. Words fall into fixed classes;
d is the sum of its parts d_c over the classes, and the pivot of a class is its
empty part, so the stored distance s_c(A) is the weight of A's words in class c.
By the triangle inequality |s_c(A) - s_c(B)| <= d_c(A, B): a class in which two sets
don't differ has equal distances, to within less than the least weight.

A row of the table is a set under its distances to three pivots, and the range key
is these distances one after another, as they are, behind the number of the three
pivots; rows are range-partitioned and sorted by it. Nearly equal sets of n words
differ in at most 2n/9 words. Classes come in fours; while there are fewer
differences than twice the fours, three of some four have none, so the two sets meet
where the intervals of these three distances have no width. The number of classes
doubles at 9, 18, 36, 72 words and so on, so that this always holds: no pair is
missed at any size. Pairs that meet are pruned by the distances to the empty set
(sizes) and to 54 sets of words by their parity (odd sketch), then the true distance is verified.
A key held by more than nearset.HOT sets is not cut off: its sets go under their
rarest words (prefix filter), which loses no pair.

`edit_rejected` replays all batches of a table at once, which gives what batch by
batch acceptance gives; `Ledger` takes one batch against what is stored, for both tables.

The order of acceptance is (batch_number, key), null batches last. A null
instruction, or one of under five distinct words, has no near copies; an unknown
row index (null or negative), dataset or split matches none. A record delivered
twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import nearset as ns
from millrace.llm.p3_grouped_splits import catalogue, components, dataset_key
from millrace.session import cut

#: Four classes are enough for one difference, i.e. sets of under 9 words: 2n/9 < 2.
CLASSES, SPAN = 4, 9
#: Bits of a stored distance in the range key, and those of them behind the point.
BITS, FRACTION = 18, 12
#: Keys of a batch up to which they are pushed down into the scan of a stored table.
FEW = 4096
#: Fixed value: the SHA-256 digest of no bytes.
EMPTY_DIGEST = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def pivot_distances(words: np.ndarray, rows: np.ndarray, n: int, classes: int) -> np.ndarray:
    """The distance of each of `n` sets to each pivot, in units of 2**-32; words and rows: members and their sets."""
    h = ns.mix(words.astype(np.int64).view(np.uint64))
    weight = np.uint64(1 << 32) + (h >> np.uint64(32))
    out = np.zeros(n * classes, np.uint64)
    np.add.at(out, rows * classes + (h % np.uint64(classes)).astype(np.int64), weight)
    return out.reshape(n, classes)


def levels(n: np.ndarray) -> np.ndarray:
    """How often the classes are doubled for sets of n words: 2n/9 < 2 * 2**level."""
    return np.maximum(np.floor(np.log2(np.maximum(n, 1) / SPAN)).astype(int) + 1, 0)


def pivot_keys(sets: DataFrame) -> DataFrame:
    """(key, sid, bm): a row of the pivot-distance table for each set and each three of each four pivots; key: their number and the distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_numpy()
            words, rows = b.column(3).flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            level, upper = levels(n), levels(n * 10 // ns.TENTHS)
            for lv in range(int(level.min(initial=0)), int(upper.max(initial=-1)) + 1):
                own = np.flatnonzero((level <= lv) & (lv <= upper))
                if not len(own):
                    continue
                classes = CLASSES << lv
                four = np.minimum(pivot_distances(words, rows, len(n), classes)[own] >> np.uint64(32 - FRACTION), np.uint64((1 << BITS) - 1)).reshape(len(own), classes // 4, 4)
                keys = []
                for out in range(4):
                    k = (np.arange(classes // 4, dtype=np.uint64) * np.uint64(4) + np.uint64(out + classes)) & np.uint64(1023)
                    k = np.broadcast_to(k[None, :], four.shape[:2])
                    for c in range(4):
                        if c != out:
                            k = k << np.uint64(BITS) | four[:, :, c]
                    keys.append(k)
                key = np.stack(keys, 2).reshape(-1).view(np.int64)
                at = pa.array(np.repeat(own, classes))
                yield pa.RecordBatch.from_arrays([pa.array(key), *(b.column(k).take(at) for k in (0, 2))], names=["key", "sid", "bm"])

    return sets.select("sid", "n", "bm", "words").mapInArrow(run, "key long, sid long, bm long")


def near_links(sets: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of classes that are nearly equal. sets: classes(); keys: their pivot table, if it is stored."""
    shared = ns.shared_keys(pivot_keys(sets) if keys is None else keys).persist(StorageLevel.MEMORY_AND_DISK)
    met = ns.pairs_in_keys(shared.filter(F.col("cnt") <= ns.HOT))
    hot = cut(shared.filter(F.col("cnt") > ns.HOT).select("sid").distinct())
    if not hot.isEmpty():
        met = met.unionByName(ns.rare_pairs(ns.rare_rows(ns.semi(sets, hot, "sid"), ns.word_counts(sets)))).distinct()
    return ns.alike(ns.with_words(met, sets)).select("a", "b")


def digest(value: Column) -> Column:
    """A SHA-256 digest however written, or null if there is none or it is that of nothing."""
    d = F.regexp_extract(F.lower(value), r"(?:^|[^0-9a-f])([0-9a-f]{64})(?:[^0-9a-f]|$)", 1)
    return F.when((d != "") & (d != EMPTY_DIGEST), d)


def first_of(records: DataFrame, digest_col: str = "digest") -> DataFrame:
    """(record_id): the records that aren't the first of their digest; records: record_id, batch, digest (null: its own)."""
    order = F.struct(F.col("batch").isNull().alias("last"), "batch", "record_id")
    one = records.groupBy("record_id").agg(F.min(F.struct(F.col("batch").isNull().alias("last"), "batch", digest_col)).alias("r")).select("record_id", "r.batch", F.col(f"r.{digest_col}").alias("d"))
    lead = one.filter("d is not null").groupBy("d").agg(F.min(order).alias("lead"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    return one.join(lead.select("d", F.col("lead.record_id").alias("_first")), "d").filter("record_id <> _first").select("record_id")


def dataset_roots(catalog: DataFrame) -> DataFrame:
    """(dkey, root): each dataset of the catalogue and the id that it shares with those it mirrors."""
    entries = catalogue(catalog)
    known = entries.select(F.col("d").alias("up")).distinct()
    edges = entries.select(F.col("d").alias("a"), F.col("d").alias("b")).unionByName(entries.join(known, "up").select(F.col("d").alias("a"), F.col("up").alias("b")))
    return cut(entries.select("dkey", F.col("d").alias("v")).distinct().join(components(edges.distinct()), "v").select("dkey", "root"))


def edit_records(pairs: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_id, batch, r, sid), one row a record, with the id of its source row and of its class or null; and the classes."""
    split, idx = F.lower(F.trim(F.col("provenance.split"))), F.col("provenance.row_idx")
    src = pairs.select(F.col("sample_id").alias("record_id"), F.col("batch_number").cast("int").alias("batch"), dataset_key(F.col("dataset_id")).alias("dkey"), split.alias("sp"), F.when(idx >= 0, idx).alias("idx"), "instruction")
    sets = ns.word_sets(src, "instruction", "record_id", "batch", "dkey", "sp", "idx", every=True).persist(StorageLevel.MEMORY_AND_DISK)
    row = F.xxhash64("root", "sp", "idx")
    roots = dataset_roots(catalog)
    roots = F.broadcast(roots) if roots.limit(ns.SMALL + 1).count() <= ns.SMALL else roots
    # rows without a dataset stay out of the join, so that they don't gather in one task
    flat = sets.select("record_id", "batch", "dkey", "sp", "idx", "sid")
    flat = flat.filter("dkey is not null").join(roots, "dkey", "left").unionByName(flat.filter("dkey is null").withColumn("root", F.lit(None).cast("long")))
    known = F.col("root").isNotNull() & F.col("sp").isNotNull() & F.col("idx").isNotNull()
    one = flat.select("record_id", F.struct(F.col("batch").isNull().alias("last"), "batch", F.when(known, row).alias("r"), "sid").alias("x")).groupBy("record_id").agg(F.min("x").alias("x"))
    return one.select("record_id", "x.batch", "x.r", "x.sid"), ns.classes(sets.filter("sid is not null"))


def rejected(records: DataFrame, links: DataFrame) -> DataFrame:
    """(record_id): records that duplicate an accepted one before them.

    records: record_id, batch, r, sid as of `edit_records`; links: pairs (a, b) of near classes. In each round the
    undecided records that come before all undecided ones they duplicate are accepted, and all that duplicate these
    are rejected; the rounds are as many as the longest chain of decisions that hang on each other.
    """
    near = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), fresh=True)
    order = F.struct(F.col("batch").isNull().alias("last"), F.col("batch"), F.col("record_id"))
    base = records.select("record_id", order.alias("o"), "r", "sid")
    many = lambda c: base.filter(f"{c} is not null").groupBy(c).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(c)
    touched = many("sid").unionByName(near.select(F.col("a").alias("sid"))).distinct().withColumn("_s", F.lit(True))
    left = cut(base.join(many("r").withColumn("_r", F.lit(True)), "r", "left").join(touched, "sid", "left").filter("_r or _s").select("record_id", "o", "r", "sid"), fresh=True)
    out = None
    while not left.isEmpty():
        by_r = left.filter("r is not null").groupBy("r").agg(F.min("o").alias("mr"))
        by_s = left.filter("sid is not null").groupBy("sid").agg(F.min("o").alias("ms"))
        by_n = near.join(by_s.select(F.col("sid").alias("b"), F.col("ms").alias("mb")), "b").groupBy(F.col("a").alias("sid")).agg(F.min("mb").alias("mn"))
        led = left.join(by_r, "r", "left").join(by_s.join(by_n, "sid", "left"), "sid", "left")
        free = (F.col("r").isNull() | (F.col("o") == F.col("mr"))) & (F.col("sid").isNull() | (F.col("o") == F.col("ms"))) & (F.col("mn").isNull() | (F.col("o") < F.col("mn")))
        led = cut(led.select("record_id", "o", "r", "sid", free.alias("free")), fresh=True)
        won = led.filter("free")
        won_r = won.filter("r is not null").select("r", F.lit(True).alias("_r")).distinct()
        won_s = won.filter("sid is not null").select("sid").distinct()
        won_s = won_s.unionByName(near.join(won_s.withColumnRenamed("sid", "a"), "a").select(F.col("b").alias("sid"))).distinct().withColumn("_s", F.lit(True))
        state = cut(led.filter("not free").join(won_r, "r", "left").join(won_s, "sid", "left").select("record_id", "o", "r", "sid", F.coalesce("_r", "_s", F.lit(False)).alias("no")), fresh=True)
        gone = state.filter("no").select("record_id")
        out = gone if out is None else out.unionByName(gone)
        left = state.filter("not no").drop("no")
    return base.select("record_id").limit(0) if out is None else out


def edit_rejected(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Edit pairs that aren't accepted, all batches replayed in order."""
    records, sets = edit_records(pairs, catalog)
    sets = sets.persist(StorageLevel.MEMORY_AND_DISK)
    return rejected(cut(records), near_links(sets))


def pool_rejected(pool: DataFrame) -> DataFrame:
    """Pool images that aren't accepted: those whose digest an earlier image has; images without bytes or digest are neither."""
    return first_of(pool_records(pool))


def pool_records(pool: DataFrame) -> DataFrame:
    """(record_id, batch, digest) of pool images; digest is null where there is none or the image has no bytes."""
    d = F.when(F.col("image.bytes") > 0, digest(F.col("image.sha256")))
    return pool.select(F.col("image_id").alias("record_id"), F.col("batch_number").cast("int").alias("batch"), d.alias("digest"))


class Ledger:
    """Everything accepted so far, as tables in a folder; a new batch is joined with the stored rows of its own keys.

    keys: the pivot-distance table of accepted classes; sets: their words; rows: ids of accepted source rows; digests: those of
    accepted pool images. Each append is range-partitioned and sorted by key. A batch of up to FEW keys pushes them into the scan,
    so Parquet reads only pages whose range holds one; a larger batch touches nearly all ranges and scans the table once, without
    the words. `accept` appends; nothing stored is rewritten or processed again.
    """

    TABLES = {"keys": ("key", "key long, sid long, bm long"), "sets": ("sid", "sid long, n int, bm long, words array<int>"), "rows": ("r", "r long"), "digests": ("h", "h long, digest string")}

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(FEW))

    def stored(self, name: str, near: DataFrame) -> DataFrame:
        """The rows of a stored table that can join with `near` by the table's key."""
        key, schema = self.TABLES[name]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        own = near.select(key).filter(F.col(key).isNotNull()).distinct().limit(FEW + 1).collect()
        return rows.filter(F.col(key).isin([r[0] for r in own])) if len(own) <= FEW else rows

    def append(self, name: str, rows: DataFrame) -> None:
        key = self.TABLES[name][0]
        rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("append").parquet(f"{self.folder}/{name}")

    def _store(self, won: DataFrame, sets: DataFrame, keys: DataFrame) -> None:
        new = won.filter("sid is not null").select("sid").distinct()
        self.append("sets", sets.join(new, "sid", "left_semi").select("sid", "n", "bm", "words"))
        self.append("keys", keys.join(new, "sid", "left_semi").select("key", "sid", "bm"))
        self.append("rows", won.filter("r is not null").select("r").distinct())

    def load(self, pairs: DataFrame, catalog: DataFrame) -> None:
        """Stores what is accepted of a whole history, replayed at once, into an empty ledger."""
        records, sets = edit_records(pairs, catalog)
        records, sets = cut(records), cut(sets)
        keys = cut(pivot_keys(sets))
        self._store(cut(records.join(rejected(records, near_links(sets, keys)), "record_id", "left_anti")), sets, keys)

    def accept(self, batch: DataFrame, catalog: DataFrame) -> DataFrame:
        """(record_id) of the batch's edit pairs that aren't accepted; the others are stored."""
        records, sets = edit_records(batch, catalog)
        records, sets = cut(records), cut(sets)
        keys = cut(pivot_keys(sets))
        met = keys.alias("a").join(self.stored("keys", keys).alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.sid") != F.col("b.sid")) & ns.close())
        met = cut(met.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).distinct())
        old = self.stored("sets", met.select(F.col("b").alias("sid")))
        words = met.join(sets.select(F.col("sid").alias("a"), F.col("words").alias("wa")), "a").join(old.select(F.col("sid").alias("b"), F.col("words").alias("wb")), "b")
        same = self.stored("sets", sets).select("sid")
        near = ns.alike(words).select(F.col("a").alias("sid")).unionByName(sets.select("sid").join(same, "sid", "left_semi"))
        known = records.filter("r is not null")
        no = records.join(near.distinct(), "sid", "left_semi").select("record_id").unionByName(known.join(self.stored("rows", known), "r", "left_semi").select("record_id"))
        no = cut(no.distinct())
        rest = cut(records.join(no, "record_id", "left_anti"))
        no = cut(no.unionByName(rejected(rest, near_links(sets, keys))).distinct())
        self._store(cut(records.join(no, "record_id", "left_anti")), sets, keys)
        return no

    def accept_pool(self, batch: DataFrame) -> DataFrame:
        """(record_id) of the batch's pool images that aren't accepted; the digests of the others are stored."""
        records = cut(pool_records(batch).withColumn("h", F.xxhash64("digest")))
        some = records.filter("digest is not null")
        no = some.join(self.stored("digests", some).select("digest"), "digest", "left_semi").select("record_id").distinct()
        no = cut(no)
        rest = records.join(no, "record_id", "left_anti")
        no = cut(no.unionByName(first_of(rest)).distinct())
        self.append("digests", some.join(no, "record_id", "left_anti").select("h", "digest").distinct())
        return no
