"""Problem 4: near-duplicate records with small edits.

Improved consistent weighted sampling (Ioffe 2010) over TF-IDF shingles, banded,
verified by weighted Jaccard similarity and confirmed by the exact test.

- Shingle: one word as read, since order counts for nothing in what "nearly the
  same" means here (TESTDATA.md); term frequency is presence, for the same reason.
- Weight: 1 for a word of all texts, rising with idf to RATIO for words in SHARE of
  the texts or fewer. Sets of Jaccard similarity 0.8 then have a weighted one of at
  least 0.8 / (0.8 + 0.2 RATIO) = 0.762, the threshold of the weighted check; all
  documents count for idf. A full idf, ln(N / df), would draw that floor down to
  0.3 and with it the chance that bands find a pair whose common words are frequent.
- Sampling: BANDS * ROWS samples a set; r and c are Gamma(2, 1) and beta uniform,
  each a fixed function of word and sample. Equal samples of two sets occur with the
  probability of their weighted similarity w, so a pair is missed with the chance
  (1 - w ** ROWS) ** BANDS: 3e-3 at the floor, 1e-5 at 0.85.
- A band key held by more than nearset.HOT classes isn't split at random: its
  classes go under their rarest words (prefix filter with places), which loses none of their pairs.
- Classes of one word set are one node; records without five distinct words, and
  null or blank texts, are in no pair and form groups of their own. A record
  delivered twice counts once. Ties and repeated rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import nearset as ns
from millrace.session import cut

#: Words in a smaller share of the texts weigh as if in this share.
SHARE = 0.01
#: What the rarest words weigh, if words of all texts weigh 1.
RATIO = 1.25
ROWS, BANDS = 5, 20
#: Least weighted Jaccard similarity of a near-duplicate.
WEIGHTED = 0.8 / (0.8 + 0.2 * RATIO)


def weights(words: np.ndarray, n: int, counts: np.ndarray, share: float = SHARE) -> np.ndarray:
    """The idf weight of each word (a 32-bit number): 1 to RATIO. counts: of nearset.word_counts over n texts."""
    part = np.clip(ns.often(words, counts) / max(n, 1), share, 1.0)
    return 1 + (RATIO - 1) * np.log(part) / np.log(share)


def samples(words: np.ndarray, weight: np.ndarray, at: int) -> np.ndarray:
    """Sample `at` of each (word, weight), as one sortable number: the value to be minimised above, the (word, t) fingerprint below."""
    base = ns.mix(words.astype(np.int64).view(np.uint64) * np.uint64(8191) + np.uint64(at * 1_000_003))
    u = [(ns.mix(base + np.uint64(j)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54 for j in range(5)]
    r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
    t = np.floor(np.log(weight) / r + u[4])
    value = c / np.exp(r * (t - u[4] + 1))
    prints = ns.mix(base ^ ns.mix(t.astype(np.int64).view(np.uint64))) & np.uint64(0xFFFFFFFF)
    return value.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | prints


def band_keys(sets: DataFrame, n: int, counts: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(key, sid, bm): a row for each class and band."""
    shipped = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            words, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            each, at = np.unique(words, return_inverse=True)
            w = weights(each, n, shipped.value)
            keys = np.zeros((bands, b.num_rows), np.uint64)
            for band in range(bands):
                for row in range(rows):
                    least = np.minimum.reduceat(samples(each, w, band * rows + row)[at], starts)
                    keys[band] = ns.mix(keys[band] ^ (least & np.uint64(0xFFFFFFFF)))
                keys[band] ^= ns.mix(np.full(1, band, np.uint64))
            again = np.tile(np.arange(b.num_rows), bands)
            rest = [b.column(k).take(pa.array(again)) for k in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *rest], names=["key", "sid", "bm"])

    return sets.select("sid", "bm", "words").mapInArrow(run, "key long, sid long, bm long")


def verified(pairs: DataFrame, n: int, counts: np.ndarray) -> DataFrame:
    """(a, b, both, wsim): the pairs of sets wa and wb whose weighted Jaccard similarity `wsim` is WEIGHTED or more, confirmed by the exact test."""
    shipped = pairs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            left, lrow, right, rrow, common = ns.shared_words(b)
            lw, rw = weights(left, n, shipped.value), weights(right, n, shipped.value)
            same = np.bincount(lrow, lw * common, m)
            wsim = same / np.maximum(np.bincount(lrow, lw, m) + np.bincount(rrow, rw, m) - same, 1e-9)
            both = np.bincount(lrow, common, m).astype(np.int64)
            either = np.bincount(lrow, minlength=m) + np.bincount(rrow, minlength=m) - both
            at = np.flatnonzero((wsim >= WEIGHTED - 1e-9) & (both * 10 >= either * ns.TENTHS))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(both[at].astype(np.int32)), pa.array(wsim[at])], names=["a", "b", "both", "wsim"])

    return pairs.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long, both int, wsim double")


def near_links(sets: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Pairs (a, b) of classes whose word sets are nearly equal, with `both` and `wsim`; sets: classes(), kept."""
    n, counts = sets.count(), ns.word_counts(sets)
    # kept, as both sides of the join are this one table, already partitioned and sorted by key
    shared = ns.shared_keys(band_keys(sets, n, counts, rows, bands)).persist(StorageLevel.MEMORY_AND_DISK)
    found = ns.pairs_in_keys(shared.filter(F.col("cnt") <= ns.HOT))
    hot = cut(shared.filter(F.col("cnt") > ns.HOT).select("sid").distinct())
    if not hot.isEmpty():
        found = found.unionByName(ns.rare_pairs(ns.rare_rows(ns.semi(sets, hot, "sid"), counts))).distinct()
    return verified(ns.with_words(found, sets), n, counts)


def near_pairs(records: DataFrame, key: str = "task_id", text: str = "text") -> DataFrame:
    """All pairs of records (key_a < key_b) whose texts are nearly the same."""
    sets = ns.word_sets(records, text, key)
    members = sets.select(key, "sid").distinct()
    unique = ns.classes(sets).persist(StorageLevel.MEMORY_AND_DISK)
    return ns.record_pairs(near_links(unique), members, key)
