"""What the operators on nearly equal texts share: word sets, sketches, pair search within keys, and the exact check.

Two texts are nearly the same if each has at least `MIN_WORDS` distinct words as
read and the Jaccard similarity of their word sets is at least `SIMILARITY`.
Texts with one and the same word set form a class with the id `sid`; candidate
search works on classes, so copies never meet each other there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.asread import read_words
from millrace.session import cut, spread

MIN_WORDS = 5
#: Least similarity, in tenths, so that all comparisons are of whole numbers.
TENTHS = 8

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: an even, repeatable scattering of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + M1
        x = (x ^ (x >> np.uint64(30))) * M2
        x = (x ^ (x >> np.uint64(27))) * M3
        return x ^ (x >> np.uint64(31))


class WordIds(dict):
    """64-bit ids of words, computed once for each word."""

    def __missing__(self, word: str) -> int:
        v = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(self) > 2_000_000:  # bounds a worker's memory, not the result
            self.clear()
        return v


def ship(df: DataFrame, value: object):
    """Broadcasts a value together with the code of its classes, so that workers need no copy of this package; get it by `load`."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))


def load(shipped) -> object:
    """The value of `ship`, in a worker."""
    return cloudpickle.loads(shipped.value)


def flat_sets(sets: list[set[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All members one after another, and where each set begins; no set may be empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.fromiter((x for s in sets for x in s), np.uint64, int(sizes.sum()))
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def sketch(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set: its id, an odd sketch of its members (54 bits, above its size in 10 bits, 1,023 for more), and its members as sorted 32-bit numbers.

    A bit of the sketch says whether an odd number of members fall on it (Mitzenmacher, Pagh, Pham 2014).
    """
    with np.errstate(over="ignore"):
        sid = mix(np.add.reduceat(mix(flat), starts[:-1]))
    odd = np.bitwise_xor.reduceat(np.uint64(1) << ((flat >> np.uint64(40)) % np.uint64(54) + np.uint64(10)), starts[:-1]) | np.minimum(np.diff(starts), 1023).astype(np.uint64)
    row = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    short = (np.sort(row << np.uint64(32) | flat & np.uint64(0xFFFFFFFF)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return sid.view(np.int64), odd.view(np.int64), short


def word_sets(df: DataFrame, text: str, *keep: str, order: bool = False, every: bool = False) -> DataFrame:
    """`keep` columns, sid, n (distinct words), bm (odd sketch), words, and with `order` seq (all words in order).

    Rows whose text is null or has under MIN_WORDS distinct words are left out, or with `every` kept with nulls.
    """
    kinds = dict(df.dtypes)
    src = spread(df.select(*keep, F.col(text).alias("_text")))
    kept = len(keep)
    names = [*keep, "sid", "n", "bm", "words", *["seq"] * order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in batches:
            rows, place, sets, seqs = [], [], [], []
            for i, t in enumerate(b.column(kept).to_pylist()):
                w = read_words(t)
                each = set(w)
                if len(each) >= MIN_WORDS:
                    rows.append(i)
                    place.append(len(sets))
                    sets.append({ids[x] for x in each})
                    if order:
                        seqs.append([ids[x] for x in w])
                elif every:
                    rows.append(i)
                    place.append(None)
            if not rows:
                continue
            if sets:
                flat, starts = flat_sets(sets)
                sid, bm, short = sketch(flat, starts)
            else:
                starts, sid, bm, short = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
            made = [pa.array(sid), pa.array(np.diff(starts).astype(np.int32)), pa.array(bm), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(short))]
            if order:
                all_words, ends = flat_sets(seqs) if seqs else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
                made.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((all_words & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))))
            if every:
                made = [x.take(pa.array(place, pa.int64())) for x in made]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(rows)) for k in range(kept)), *made], names=names)

    ddl = ", ".join([*(f"{k} {kinds[k]}" for k in keep), "sid long, n int, bm long, words array<int>", *["seq array<int>"] * order])
    return src.mapInArrow(run, ddl)


def classes(sets: DataFrame, *also: str) -> DataFrame:
    """One row for each class (sid, n, bm, words, `also`): the word sets without their copies."""
    return sets.groupBy("sid").agg(*(F.first(c).alias(c) for c in ("n", "bm", "words", *also)))


def close(a: str = "a", b: str = "b"):
    """What every pair of nearly equal sets fulfils, by sizes and odd sketches (`bm`) alone: a bit differs only where an odd number of words does.

    A size that is cut at 1,023 refuses no pair: it is no larger than it is, and so many words may differ in more than 54 bits.
    """
    x, y = F.col(f"{a}.bm"), F.col(f"{b}.bm")
    na, nb = x.bitwiseAND(1023), y.bitwiseAND(1023)
    apart = F.bit_count(F.shiftrightunsigned(x.bitwiseXOR(y), 10))
    return (na * 10 >= nb * TENTHS) & (nb * 10 >= na * TENTHS) & (apart * (10 + TENTHS) <= (na + nb) * (10 - TENTHS))


def shared_keys(keyed: DataFrame, *also: str) -> DataFrame:
    """Rows whose key occurs more than once, with the count; one shuffle by key, and a hot key only fills a buffer that spills."""
    return keyed.withColumn("cnt", F.count(F.lit(1)).over(Window.partitionBy("key", *also))).filter("cnt > 1")


def pairs_in_keys(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes that share a key and pass the sketch test; rows: key, sid, bm.

    A merge join streams each key's rows, so no key's pairs are ever held; those that the test refuses leave the join at once.
    """
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.sid") < F.col("b.sid")) & close()
    return a.hint("merge").join(b, on).select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).distinct()


#: A key held by more classes than this is hot: its classes are joined by their rarest words instead.
HOT = 1000
#: Words are counted in so many buckets; the table of counts is 4 MB, whatever the corpus.
COUNT_BITS = 20


def word_counts(sets: DataFrame) -> np.ndarray:
    """In how many sets each bucket of words occurs, over all sets (words that share a bucket are counted together)."""
    out = np.zeros(1 << COUNT_BITS, np.int32)
    each = sets.select(F.explode("words").alias("w")).groupBy(F.col("w").bitwiseAND((1 << COUNT_BITS) - 1).alias("k")).count()
    got = each.toArrow()
    out[got["k"].to_numpy()] = np.minimum(got["count"].to_numpy(), 2**31 - 1)
    return out


def often(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each word's bucket."""
    return counts[words & ((1 << COUNT_BITS) - 1)]


def rare_rows(sets: DataFrame, counts: np.ndarray, *also: str) -> DataFrame:
    """(key, sid, n, bm, pos, held, `also`): sets under their rarest words, of which nearly equal sets share one (prefix filter).

    All words are in one order, by the count of their bucket, then by number. A set of n words goes under its first
    n - ceil(0.8 n) + 1; those up to n - ceil(8/9 n) + 1 are `held`, which is enough for partners that aren't smaller. pos: the word's place.
    """
    shipped = sets.sparkSession.sparkContext.broadcast(counts)
    kinds = dict(sets.dtypes)
    names = ["sid", "n", "bm", *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(len(names))
            words, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
            rows = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
            keep = place < (n + -n * TENTHS // 10 + 1)[rows]
            words = words[np.lexsort((words, often(words, shipped.value), rows))][keep]
            rows, place = rows[keep], place[keep]
            held = place < (n + -n * 2 * TENTHS // (10 + TENTHS) + 1)[rows]
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(mix(words.astype(np.int64).view(np.uint64)).view(np.int64)), *(b.column(k).take(at) for k in range(len(names))), pa.array(place.astype(np.int32)), pa.array(held)], names=["key", *names, "pos", "held"])

    return sets.select(*names, "words").mapInArrow(run, ", ".join(["key long", *(f"{c} {kinds[c]}" for c in names), "pos int, held boolean"]))


def rare_pairs(rows: DataFrame, also: Column | None = None, *keep: str) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows of `rare_rows` that can be nearly equal; also: a further condition on a.* and b.*.

    keep: columns that come out for both, with _a and _b behind their names.

    The larger set of a pair (of equals, that of the larger id) meets the smaller where the smaller one is held; from a word's
    places follows how much both can share from there on. A template word in a third of all rows is then met by the few sets
    that hold it, as the words that tell the sets apart come before it.
    """
    # kept, as both sides of the join are this one table, already partitioned and sorted by key; words of one set are gone
    own = Window.partitionBy("key")
    shared = rows.withColumns({"cnt": F.count(F.lit(1)).over(own), "some": F.max("held").over(own)}).filter("cnt > 1 and some").persist(StorageLevel.MEMORY_AND_DISK)
    a, b = shared.alias("a"), shared.filter("held").alias("b")
    larger = (F.col("a.n") > F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.sid") > F.col("b.sid"))
    room = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) * (10 + TENTHS) >= (F.col("a.n") + F.col("b.n")) * TENTHS
    on = (F.col("a.key") == F.col("b.key")) & larger & room & close()
    met = a.hint("merge").join(b, on if also is None else on & also)
    turned = F.col("a.sid") > F.col("b.sid")
    sides = [F.when(turned == (end == "a"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(f"{c}_{end}") for c in keep for end in "ab"]
    return met.select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b"), *sides).distinct()


#: Rows of two numbers that may be broadcast: some 10 MB.
SMALL = 300_000


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of `df` whose `on` is among `keys` (distinct, computed already): by broadcast if they are counted to be few, else by a shuffle."""
    return df.join(F.broadcast(keys) if keys.limit(SMALL + 1).count() <= SMALL else keys, on, "left_semi")


def with_words(pairs: DataFrame, sets: DataFrame, column: str = "words") -> DataFrame:
    """Pairs (a, b) with wa and wb, the words (or another list) of both; only the lists of these pairs are moved."""
    pairs = cut(pairs)
    ends = cut(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct())
    words = semi(sets.select("sid", column), ends, "sid")
    for end in ("a", "b"):
        pairs = pairs.join(words.select(F.col("sid").alias(end), F.col(column).alias(f"w{end}")), end)
    return pairs


def shared_words(b: pa.RecordBatch, left: str = "wa", right: str = "wb") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of pairs with two columns of sorted word sets: the words and rows of both sides, and which of the left words the right set has."""
    flat = []
    for c in (left, right):
        lists = b.column(c)
        flat += [lists.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))]
    key = [r.astype(np.uint64) << np.uint64(32) | w.view(np.uint32).astype(np.uint64) for w, r in (flat[:2], flat[2:])]
    at = np.searchsorted(key[1], key[0])
    both = np.zeros(len(key[0]), bool)
    if len(key[1]):
        both = key[1][np.minimum(at, len(key[1]) - 1)] == key[0]
    return *flat, both


def alike(pairs: DataFrame) -> DataFrame:
    """The exact check of pairs with words: those of Jaccard similarity 0.8 or more."""
    both = F.size(F.array_intersect("wa", "wb"))
    return pairs.withColumn("both", both).filter(F.col("both") * 10 >= (F.size("wa") + F.size("wb") - F.col("both")) * TENTHS)


def record_pairs(links: DataFrame, members: DataFrame, key: str = "task_id") -> DataFrame:
    """Pairs of records (key_a < key_b): of linked classes (a, b), and of one class; members: distinct key, sid."""
    m = members.select(F.col(key).alias("k"), "sid")
    x = m.select(F.col("k").alias("ka"), F.col("sid").alias("a"))
    y = m.select(F.col("k").alias("kb"), F.col("sid").alias("b"))
    between = links.select("a", "b").join(x, "a").join(y, "b").filter("ka <> kb")
    within = x.join(y, (F.col("a") == F.col("b")) & (F.col("ka") < F.col("kb")))
    return (
        between.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"))
        .unionByName(within.select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b")))
        .distinct()
    )
