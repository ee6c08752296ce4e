"""Problem 1: same or near-same records across splits.

Content-defined chunks: a rolling hash of the last WINDOW words of a record, as read,
decides where it is cut, so an edit changes only the chunks it touches. Chunks hold
2**level words on average: 1 in records of under 24 words, 2 in those of under 48, 4 in
longer ones, which are cut twice, by two hashes. Of simulated pairs with as many changed
words as nearly equal texts can have, none of 240,000 (9 to 400 words) were left without a shared
chunk. Longer chunks lose pairs: a mean of 8 words from 96 words on lost 6 of 20,000, and with
half as many chunks at all lengths 3 of the 4,576 linked pairs of texts of the larger check
tables were lost, none with these (against the exact prefix filter).
A record also gets the chunks of the level that its longest partner has.

Chunk digests are joined across splits, the lengths of shared chunks are summed for
each pair, and pairs whose sum is at least OVERLAP of the shorter record get the exact
test of nearly the same, with the overlap fraction of each record.

Boilerplate makes some digests hot. One of more than nearset.HOT classes isn't
dropped: its classes are joined by their rarest words instead (prefix filter with
places), which loses no pair of theirs.

Field by field: instructions meet instructions, targets meet targets. Null and
blank texts, and texts of under five distinct words, make no pair; neither do the
standing sentences, which the caller names. Records of other splits, or of none, are
on neither side. A record delivered twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.asread import read_words
from millrace.llm import nearset as ns
from millrace.session import cut

TRAIN, EVAL = ("sft_train",), ("sft_val", "bench_test", "hard_heldout")
WINDOW, OVERLAP = 3, 0.05
#: Words of the shortest record of level 1, half those of level 2, which is the last.
SPAN, LAST = 24, 2
#: The two hashes by which records are cut.
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def split_name(split: Column) -> Column:
    """A split's name however spelled."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(split, r"[\s\u00A0\u200B\uFEFF]+", " "))), r"[ -]+", "_")


def levels(n: np.ndarray) -> np.ndarray:
    """The level of records of n distinct words."""
    return np.clip(np.floor(np.log2(np.maximum(n, 1) / SPAN)).astype(int) + 1, 0, LAST)


def chunks(seq: np.ndarray, ends: np.ndarray, level: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the records seq[ends[i]:ends[i + 1]]: where each chunk begins, where each ends, and its record; level: of each record."""
    h = ns.mix(seq.astype(np.int64).view(np.uint64) ^ np.uint64(seed))
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    roll = h.copy()
    with np.errstate(over="ignore"):
        for j in range(1, WINDOW):
            roll[j:] += np.where(row[j:] == row[:-j], h[:-j], np.uint64(0)) * np.uint64(pow(1_000_003, j, 1 << 64))
    mask = (np.uint64(1) << level.astype(np.uint64)) - np.uint64(1)
    last = ns.mix(roll) & mask[row] == 0
    last[ends[1:][np.diff(ends) > 0] - 1] = True
    stop = np.flatnonzero(last) + 1
    return np.concatenate([[0], stop[:-1]]).astype(np.int64) if len(stop) else stop, stop, row[stop - 1]


def digests(seq: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The digest of each chunk: a polynomial of its words, from running sums."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(odd), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(seq), odd))])
        total = np.concatenate([[np.uint64(0)], np.cumsum(ns.mix(seq.astype(np.int64).view(np.uint64) + np.uint64(77)) * up[:-1])])
        down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(seq), back))])
        return ns.mix((total[stop] - total[begin]) * down[begin])


def _flat(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    seqs = b.column(column)
    sizes = np.diff(seqs.offsets.to_numpy())
    return seqs.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])


def sides(seeds: DataFrame, standing: tuple[str, ...]) -> DataFrame:
    """(task_id, train, field, sid, n, bm, seq) of both texts of the records on either side, without targets nearly the same as a standing sentence."""
    split = split_name(F.col("split"))
    src = seeds.select("task_id", F.when(split.isin(*TRAIN), True).when(split.isin(*EVAL), False).alias("train"), "instruction", "expected_target").filter("train is not null")
    src = src.select("task_id", "train", F.explode(F.map_from_arrays(F.array(F.lit(1), F.lit(2)), F.array("instruction", "expected_target"))).alias("field", "text"))
    sets = ns.word_sets(src, "text", "task_id", "train", "field", order=True)
    for s in standing:
        ids = ns.WordIds()
        known = sorted({((ids[w] & 0xFFFFFFFF) ^ 0x80000000) - 0x80000000 for w in read_words(s)})
        both = F.size(F.array_intersect("words", F.array(*map(F.lit, known))))
        sets = sets.filter((F.col("field") == 1) | (both * 10 < (F.col("n") + len(known) - both) * ns.TENTHS))
    return sets.select("task_id", "train", "field", F.xxhash64("field", "sid").alias("sid"), "n", "bm", "seq")


def side_classes(sets: DataFrame) -> DataFrame:
    """One row for each field and word set: sid, n, bm, seq, field, and side: 1 if training records have it, 2 if evaluation records do, 3 if both."""
    whole = sets.groupBy("sid").agg(*(F.first(c).alias(c) for c in ("n", "bm", "seq", "field")), F.max("train").alias("tr"), (~F.min("train")).alias("ev"))
    return whole.select("sid", "n", "bm", "seq", "field", (F.col("tr").cast("int") + F.col("ev").cast("int") * 2).alias("side"))


def chunk_keys(classes: DataFrame) -> DataFrame:
    """(key, sid, bm, side, size): the chunks of each class at its level, by both hashes, and at that of its longest partner; size: words in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n").to_numpy()
            own, most = levels(n), levels(n * 10 // ns.TENTHS)
            field = ns.mix(b.column("field").to_numpy().astype(np.uint64))
            for up, k in ((0, 0), (0, 1), (1, 0), (1, 1)):
                # records of under two spans have chunks so short that one hash will do
                some = np.flatnonzero((own + up <= most) & ((own + up > 1) | (k == 0)))
                if len(some):
                    level = own + up
                    part = b.column("seq").take(pa.array(some))
                    seq, ends = part.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(part.offsets.to_numpy()))])
                    begin, stop, row = chunks(seq, ends, level[some], SEEDS[k])
                    row = some[row]
                    key = ns.mix(digests(seq, begin, stop) ^ field[row] ^ ns.mix((level[row] * 2 + k).astype(np.uint64)))
                    order = np.lexsort((key, row))
                    key, row, size = key[order], row[order], (stop - begin)[order]
                    first = np.ones(len(key), bool)
                    first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                    at = pa.array(row[first])
                    if first.any():
                        yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), *(b.column(c).take(at) for c in ("sid", "bm", "side")), pa.array(size[first].astype(np.int32))], names=["key", "sid", "bm", "side", "size"])

    return classes.select("seq", "sid", "n", "bm", "side", "field").mapInArrow(run, "key long, sid long, bm long, side int, size int")


def overlaps(pairs: DataFrame) -> DataFrame:
    """(a, b, oa, ob) of the pairs of sequences wa and wb that are nearly the same; oa, ob: the share of each one's words in chunks that both have, by the better hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            seqs = [_flat(b, c) for c in ("wa", "wb")]
            words = []
            for seq, ends in seqs:
                row = np.repeat(np.arange(m, dtype=np.uint64), np.diff(ends))
                words.append(np.unique(row << np.uint64(32) | seq.view(np.uint32).astype(np.uint64)))
            n = [np.bincount((w >> np.uint64(32)).astype(np.int64), minlength=m) for w in words]
            both = np.bincount((words[0][np.isin(words[0], words[1], assume_unique=True)] >> np.uint64(32)).astype(np.int64), minlength=m)
            near = both * 10 >= (n[0] + n[1] - both) * ns.TENTHS
            level = levels(np.maximum(n[0], n[1]))
            best = np.zeros((2, m))
            for seed in SEEDS:
                cuts = [chunks(seq, ends, level, seed) for seq, ends in seqs]
                with np.errstate(over="ignore"):
                    own = [ns.mix(digests(seq, begin, stop) ^ ns.mix(row.astype(np.uint64))) for (seq, _), (begin, stop, row) in zip(seqs, cuts, strict=True)]
                for i, (begin, stop, row) in enumerate(cuts):
                    size = stop - begin
                    best[i] = np.maximum(best[i], np.bincount(row, size * np.isin(own[i], own[1 - i]), m) / np.maximum(1, np.bincount(row, size, m)))
            at = np.flatnonzero(near)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(at)) for c in ("a", "b")] + [pa.array(x[at]) for x in best], names=["a", "b", "oa", "ob"])

    return pairs.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long, oa double, ob double")


def cross_links(classes: DataFrame) -> DataFrame:
    """(a, b, oa, ob), computed: class a has training records, class b evaluation records, and they are nearly the same; a = b where one class has both."""
    keyed = chunk_keys(classes)
    known = ns.shared_keys(keyed).withColumn("sides", F.bit_or("side").over(Window.partitionBy("key")))
    shared = known.filter("sides = 3").persist(StorageLevel.MEMORY_AND_DISK)
    few = shared.filter(F.col("cnt") <= ns.HOT)
    a, b = few.filter("side <> 2").alias("a"), few.filter("side <> 1").alias("b")
    met = a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.sid") != F.col("b.sid")) & ns.close())
    # each pair was cut by both hashes, under one or two levels
    sums = met.groupBy(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).agg(F.sum("a.size").alias("words"), F.first(F.least(F.col("a.bm").bitwiseAND(1023), F.col("b.bm").bitwiseAND(1023))).alias("n"))
    pairs = sums.filter(F.col("words") >= F.col("n") * OVERLAP).select("a", "b")
    hot = cut(shared.filter(F.col("cnt") > ns.HOT).select("sid").distinct())
    if not hot.isEmpty():
        sets = classes.select("sid", "n", "bm", "side", "field", F.array_distinct("seq").alias("words"))
        rows = ns.rare_rows(ns.semi(sets, hot, "sid"), ns.word_counts(sets), "side", "field").withColumn("key", F.xxhash64("key", "field"))
        across = F.col("a.side").bitwiseOR(F.col("b.side")) == 3
        rare = ns.rare_pairs(rows, across, "side")
        # training class first; a pair of classes that have both counts either way
        ways = F.filter(F.array(F.struct("a", "b", F.expr("side_a <> 2 and side_b <> 1").alias("ok")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.expr("side_b <> 2 and side_a <> 1").alias("ok"))), lambda x: x["ok"])
        turned = rare.select(F.explode(ways).alias("x")).select("x.a", "x.b")
        pairs = pairs.unionByName(turned).distinct()
    near = overlaps(ns.with_words(pairs, classes, "seq"))
    out = cut(near.unionByName(classes.filter("side = 3").select(F.col("sid").alias("a"), F.col("sid").alias("b"), F.lit(1.0).alias("oa"), F.lit(1.0).alias("ob"))))
    shared.unpersist()
    return out


def cross_pairs(seeds: DataFrame, standing: tuple[str, ...]) -> DataFrame:
    """(train_id, eval_id, oa, ob): records of the training split and of evaluation splits with nearly the same text."""
    sets = sides(seeds, standing).persist(StorageLevel.MEMORY_AND_DISK)  # texts are read and normalized once
    members = cut(sets.select("task_id", "train", "sid").distinct())
    classes = side_classes(sets).persist(StorageLevel.MEMORY_AND_DISK)
    links = cross_links(classes)
    classes.unpersist()
    sets.unpersist()
    x = members.filter("train").select(F.col("task_id").alias("train_id"), F.col("sid").alias("a"))
    y = members.filter("not train").select(F.col("task_id").alias("eval_id"), F.col("sid").alias("b"))
    return links.join(x, "a").join(y, "b").filter("train_id <> eval_id").select("train_id", "eval_id", "oa", "ob")


def found(seeds: DataFrame, standing: tuple[str, ...] = ()) -> DataFrame:
    """(task_id_a, task_id_b), the smaller key first: all cross-split pairs."""
    p = cross_pairs(seeds, standing)
    return p.select(F.least("train_id", "eval_id").alias("task_id_a"), F.greatest("train_id", "eval_id").alias("task_id_b")).distinct()


def record_overlap(seeds: DataFrame, standing: tuple[str, ...] = ()) -> DataFrame:
    """(task_id, field, words, shared, fraction) of each evaluation record: how much of it lies in chunks that training records have."""
    sets = sides(seeds, standing).persist(StorageLevel.MEMORY_AND_DISK)  # texts are read and normalized once
    held = cut(sets.select("task_id", "train", "sid").distinct())
    classes = side_classes(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, ends = _flat(b, "seq")
            if len(seq):
                begin, stop, row = chunks(seq, ends, np.full(b.num_rows, LAST), SEEDS[0])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(digests(seq, begin, stop).view(np.int64)), pa.array((stop - begin).astype(np.int32)), *(b.column(c).take(at) for c in ("sid", "field", "side"))], names=["d", "size", "sid", "field", "side"])

    cut_up = cut(classes.select("seq", "sid", "field", "side").mapInArrow(run, "d long, size int, sid long, field int, side int"))
    sets.unpersist()
    trained = cut_up.filter("side <> 2").select("field", "d").distinct().withColumn("known", F.lit(True))
    # a chunk that a third of the records have is one row for each of them: the sums come together by record, and AQE splits such a partition
    sums = cut_up.filter("side <> 1").join(trained, ["field", "d"], "left").groupBy("sid", "field").agg(F.sum("size").alias("words"), F.sum(F.when(F.col("known"), F.col("size")).otherwise(0)).alias("shared"))
    return held.filter("not train").select("task_id", "sid").join(sums, "sid").select("task_id", "field", "words", "shared", (F.col("shared") / F.col("words")).alias("fraction"))


def report(seeds: DataFrame, standing: tuple[str, ...] = ()) -> DataFrame:
    """(eval_split, source, pairs, eval_records, train_records): the overlaps found, by evaluation split and source."""
    at = seeds.select(F.col("task_id").alias("eval_id"), split_name(F.col("split")).alias("eval_split"), "source").distinct()
    p = cross_pairs(seeds, standing).select("train_id", "eval_id").distinct().join(at, "eval_id")
    return p.groupBy("eval_split", "source").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("eval_id").alias("eval_records"), F.countDistinct("train_id").alias("train_records"))
