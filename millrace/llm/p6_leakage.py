"""Problem 6: evaluation texts leaking into training text.

Winnowing (Schleimer, Wilkerson, Aiken 2003): of each window of WINDOW successive
hashes of K words the rightmost minimum is kept, in the held-out texts and in the
documents, so every shared span of WINDOW + K - 1 = 4 words or more has a
fingerprint that both keep. Shared fingerprints are extended to maximal equal runs,
runs are chained along the item with the edit distance of the gaps between them, and
the ends of a chain go on over changes that are followed by equal words. A chain
counts if it spans half of the item's words or more, from its first equal word to its
last, with at most one word in eight changed, dropped or added.

The held-out texts are the small side by nature: an index of at most BLOCK items
is shipped to all tasks, and the documents are searched in one pass without any
shuffle. Larger indexes are joined by Spark on the fingerprints; pairs whose shared
fingerprints lie far enough apart get their texts and the same check. There, items
don't go under fingerprints that over COMMON items have, as long as each half of the
item keeps more others than allowed edits can take away, so a closing sentence of all items is no hot key.

Whole documents are searched. Marks of quotes and lists and escapes are taken off
before words are read. Null or blank texts and items of under MIN_ITEM words are in no
case; items with the same text are cases each; repeated documents come out each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.asread import read_words
from millrace.llm.nearset import WordIds, load, mix, ship
from millrace.session import cut, spread

K, WINDOW, MIN_ITEM = 3, 2, 8
#: Share of the item's words that a passage must hold, and words of it for each changed one.
SPAN, CHANGED = 0.5, 8
BLOCK, COMMON = 20_000, 50

_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_BREAK = re.compile(r"\\[nrtbf]")
_MARK = re.compile(r"(?m)^[ \t]*(?:(?:[>|#*+\-•‣▪●◦–—]+|\(?[0-9]{1,3}[.):\]]|\(?[a-zA-Z][.)]|\[[ xX]?\])[ \t]+)+")


def passage_words(text: str | None) -> list[str]:
    """The words of a text as read, without marks of quotes and lists, and with backslash escapes undone."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), _BREAK.sub("\n", text))
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return read_words(_MARK.sub("", text))


def winnow(ids: np.ndarray, row: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of texts one after another; row: the text of each word."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = mix(g ^ ids[j : j + n])
    inside = row[:n] == row[k - 1 : k - 1 + n]
    g[~inside] = np.uint64(2**64 - 1)
    keep = np.zeros(n, bool)
    if n >= window:
        least, at = g[: n - window + 1].copy(), np.arange(n - window + 1)
        for j in range(1, window):
            later = g[j : n - window + 1 + j]
            lower = later <= least
            least, at = np.where(lower, later, least), np.where(lower, np.arange(n - window + 1) + j, at)
        keep[at] = True
    alone = np.ones(n, bool)  # a text of so few words that no whole window lies in it keeps all it has
    for j in range(1, window):
        alone[:-j] &= ~(inside[j:] & (row[j:n] == row[: n - j]))
        alone[j:] &= ~(inside[:-j] & (row[: n - j] == row[j:n]))
    keep = (keep | alone) & inside
    at = np.flatnonzero(keep)
    return at, g[at]


class Index:
    """Words and sorted fingerprints of held-out items."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        ids = WordIds()
        texts = [(i, [ids[w] for w in passage_words(t)]) for i, t in items]
        texts = [(i, w) for i, w in texts if len(w) >= MIN_ITEM]
        self.item = [i for i, _ in texts]
        self.words = [w for _, w in texts]
        flat = np.array([x for w in self.words for x in w], np.uint64)
        self.size = size = np.array([len(w) for w in self.words], np.int64)
        row = np.repeat(np.arange(len(texts)), size)
        at, h = winnow(flat, row)
        order = np.argsort(h, kind="stable")
        self.hash, self.row, self.at = h[order], row[at][order], (at - (np.cumsum(size) - size)[row[at]])[order] if len(at) else at

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (into h, into the fingerprints) of equal hashes."""
        left, right = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
        many = right - left
        return np.repeat(np.arange(len(h)), many), np.repeat(left - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _edits(a: list[int], b: list[int]) -> int:
    """Edit distance of two short word lists."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def _runs(item: list[int], doc: list[int], seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Maximal equal runs (item start, document start, words) through the seeds."""
    out, seen = [], {}
    for i, d in sorted(seeds):
        if seen.get(d - i, -1) >= i:
            continue
        a, b = i, d
        while a and b and item[a - 1] == doc[b - 1]:
            a, b = a - 1, b - 1
        stop = i
        while stop < len(item) and stop + d - i < len(doc) and item[stop] == doc[stop + d - i]:
            stop += 1
        seen[d - i] = stop - 1
        if stop > a:
            out.append((a, b, stop - a))
    return out


def _ends(item: list[int], doc: list[int], i: int, d: int, step: int, most: int) -> list[tuple[int, int]]:
    """How far the item and the document go on from (i, d), one way, with 0, 1, ... `most` changes, to the last equal word (furthest diagonals)."""
    left_i, left_d = (len(item) - i, len(doc) - d) if step > 0 else (i + 1, d + 1)
    reach, out = {0: 0}, []
    for e in range(most + 1):
        if e:
            grown: dict[int, int] = {}
            for k, x in reach.items():  # k: words of the document more than of the item
                for to, y in ((k, x + 1), (k + 1, x), (k - 1, x + 1)):
                    if y <= left_i and y + to <= left_d and grown.get(to, -1) < y:
                        grown[to] = y
            reach = grown
        best = out[-1] if out else (0, 0)
        for k, x in reach.items():
            y = x
            while y < left_i and y + k < left_d and item[i + step * y] == doc[d + step * (y + k)]:
                y += 1
            reach[k] = y
            if y > x and y > best[0]:
                best = (y, y + k)
        out.append(best)
    return out


def fits(span: int, passage: int, edits: int) -> bool:
    """At most one word in eight is changed; a passage with dropped words is as long as the stretch of the item."""
    return edits * CHANGED <= max(span, passage)


def best_span(item: list[int], doc: list[int], seeds: list[tuple[int, int]], need: float = 0) -> tuple[int, int]:
    """The longest stretch of the item that one passage of the document follows, and the words changed in it; from `need` on any will do."""
    runs = sorted(_runs(item, doc, seeds))
    gap = gap_of(len(item))
    best = (0, 0)
    chain: list[tuple[int, int, int, int]] = []  # value, start in item, start in document, edits
    for k, (i, d, n) in enumerate(runs):
        top = (n, i, d, 0)
        for (pi, pd, pn), (value, si, sd, edits) in zip(runs[:k], chain, strict=False):
            over = max(0, pi + pn - i, pd + pn - d)
            gi, gd = i + over - (pi + pn), d + over - (pd + pn)
            if over >= n or gi < 0 or gd < 0 or max(gi, gd) > gap:
                continue
            cost = _edits(item[pi + pn : i + over], doc[pd + pn : d + over])
            # no passage has more changes than this, whatever it goes on with
            if (edits + cost) * (CHANGED - 1) <= len(item) and (v := value + n - over - 3 * cost) > top[0]:
                top = (v, si, sd, edits + cost)
        chain.append(top)
        _, si, sd, edits = top
        span, passage = i + n - si, d + n - sd
        if fits(span, passage, edits) and span > best[0]:
            best = (span, edits)
        # beyond its ends a chain wins at most K equal words and then K + 1 for each change, of which one in eight words is allowed
        most = (span + K - CHANGED * edits) // (CHANGED - K - 2)
        if span < need <= span + K + (K + 1) * most:
            left, right = _ends(item, doc, si - 1, sd - 1, -1, most), _ends(item, doc, i + n, d + n, 1, most)
            for le, (li, ld) in enumerate(left):
                for re_, (ri, rd) in enumerate(right):
                    if span + li + ri > best[0] and fits(span + li + ri, passage + ld + rd, edits + le + re_):
                        best = (span + li + ri, edits + le + re_)
    return best


def gap_of(n):
    """Words that a passage of an item of n words may go without an equal run: all its changes at one place, and short equal runs between."""
    return n // CHANGED + 1 + K


def gather(docs: np.ndarray, its: np.ndarray, dp: np.ndarray, ip: np.ndarray, size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of hits by document, item and diagonal, and begin and end of groups of diagonals next to each other that can be a passage.

    Between the hits of a passage and its ends lie only equal runs too short for a fingerprint, each with a change: with one word
    in eight changed no more than half of it, so groups whose hits are less than half of what is needed apart are left out.
    """
    order = np.lexsort((dp - ip, its, docs))
    docs, its, dp, ip, size = docs[order], its[order], dp[order], ip[order], size[order]
    if not len(docs):
        return order, np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (its[1:] != its[:-1]) | (np.diff(dp - ip) > gap_of(size[1:]))]))
    apart = np.maximum.reduceat(ip, edge) - np.minimum.reduceat(ip, edge) + 2 * K
    stop = np.append(edge[1:], len(docs))
    keep = apart >= least * size[edge] / 2
    return order, edge[keep], stop[keep]


def _taken(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts one after another, where each begins, its size, and positions and hashes of fingerprints."""
    ids = _IDS
    words = [passage_words(t) for t in texts.to_pylist()]
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((ids[w] for t in words for w in t), np.uint64, int(size.sum()))
    return flat, np.cumsum(size) - size, size, *winnow(flat, np.repeat(np.arange(len(words)), size))


_IDS = WordIds()
COLUMNS = "item_id long, span int, item_words int, changed int"


def _broadcast_leaks(documents: DataFrame, rows: list[tuple[int, str | None]], doc: str, text: str, least: float) -> DataFrame:
    """The documents searched in one pass, with all items in each task."""
    kind = dict(documents.dtypes)[doc]
    shipped = ship(documents, Index(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = load(shipped)
        for b in batches:
            flat, start, size, at, h = _taken(b.column(1))
            row = np.repeat(np.arange(b.num_rows), size)
            i, j = index.hits(h)
            docs, its, dp, ip = row[at[i]], index.row[j], at[i] - start[row[at[i]]], index.at[j]
            order, begin, stop = gather(docs, its, dp, ip, index.size[its], least)
            docs, its, dp, ip = docs[order], its[order], dp[order], ip[order]
            top: dict[tuple[int, int], tuple[int, int]] = {}
            for s, e in zip(begin.tolist(), stop.tolist(), strict=True):
                r, it = int(docs[s]), int(its[s])
                words = index.words[it]
                span, changed = best_span(words, flat[start[r] : start[r] + size[r]].tolist(), list(zip(ip[s:e].tolist(), dp[s:e].tolist(), strict=True)), least * len(words))
                if span >= least * len(words):
                    top[r, it] = max(top.get((r, it), (0, 0)), (span, changed))
            out = [(r, index.item[it], span, len(index.words[it]), changed) for (r, it), (span, changed) in top.items()]
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0])), pa.array(c[1], pa.int64()), *(pa.array(x, pa.int32()) for x in c[2:])], names=[doc, "item_id", "span", "item_words", "changed"])

    return spread(documents.select(doc, text)).mapInArrow(run, f"{doc} {kind}, {COLUMNS}")


def _prints(df: DataFrame, key: str, text: str, least_words: int = 0) -> DataFrame:
    """(h, key, p, n): the fingerprints of each text, their places and its words."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, start, size, at, h = _taken(b.column(1))
            row = np.repeat(np.arange(b.num_rows), size)[at]
            keep = size[row] >= least_words
            row, at, h = row[keep], at[keep], h[keep]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(pa.array(row)), pa.array((at - start[row]).astype(np.int32)), pa.array(size[row].astype(np.int32))], names=["h", key, "p", "n"])

    return spread(df.select(key, text)).mapInArrow(run, f"h long, {key} {kind}, p int, n int")


def _joined_leaks(documents: DataFrame, held: DataFrame, doc: str, text: str, least: float) -> DataFrame:
    """As _broadcast_leaks, by joins on fingerprints."""
    kind = dict(documents.dtypes)[doc]
    prints = cut(_prints(held, "item_id", "text", MIN_ITEM))
    often = prints.groupBy("h").agg(F.countDistinct("item_id").alias("m")).filter(F.col("m") > COMMON).select("h", F.lit(True).alias("often"))
    marked = prints.join(often, "h", "left").withColumn("often", F.coalesce("often", F.lit(False)))
    # of each item the places of its rare fingerprints: every half of it must keep more than its changes can take away
    rare = marked.groupBy("item_id", "n").agg(F.array_sort(F.collect_set(F.when(~F.col("often"), F.col("p")))).alias("at"))
    half, lost = F.floor(F.col("n") * least).cast("int"), (F.floor(F.col("n") / CHANGED) + 1) * K
    enough = F.forall(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - half)), lambda s: F.size(F.filter("at", lambda p: (p >= s) & (p <= s + half - K))) > lost)
    keyed = marked.join(rare.select("item_id", enough.alias("enough")), "item_id").filter("not (often and enough)").select("h", "item_id", F.col("p").alias("ip"), "n")
    hits = _prints(documents, doc, text).select("h", F.col(doc).alias("_doc"), F.col("p").alias("dp")).join(keyed, "h")
    # what is left out of the keys may lie at both ends of a passage, so any hit on an item with fewer keys will do
    near = cut(hits.groupBy("_doc", "item_id").agg(F.max("ip").alias("hi"), F.min("ip").alias("lo"), F.first("n").alias("n")).join(rare.select("item_id", enough.alias("some")), "item_id").filter(F.col("some") | (F.col("hi") - F.col("lo") + 2 * K >= F.col("n") * (least / 2))).select("_doc", "item_id"))
    texts = documents.select(F.col(doc).alias("_doc"), F.col(text).alias("_t")).join(near.select("_doc").distinct(), "_doc", "left_semi")
    both = texts.join(near, "_doc").join(held.select("item_id", F.col("text").alias("_it")), "item_id").select("_doc", "_t", "item_id", "_it")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, start, size, at, h = _taken(b.column(1))
            row = np.repeat(np.arange(b.num_rows), size)[at]
            out = []
            for r, (it, t) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                index = Index([(it, t)])
                own = row == r
                i, j = index.hits(h[own])
                dp, ip = at[own][i] - start[r], index.at[j]
                order, begin, stop = gather(np.zeros_like(ip), np.zeros_like(ip), dp, ip, np.full(len(ip), index.size[0]), least)
                dp, ip, words, best = dp[order], ip[order], index.words[0], (0, 0)
                for s, e in zip(begin.tolist(), stop.tolist(), strict=True):
                    best = max(best, best_span(words, flat[start[r] : start[r] + size[r]].tolist(), list(zip(ip[s:e].tolist(), dp[s:e].tolist(), strict=True)), least * len(words)))
                if best[0] >= least * len(words):
                    out.append((r, it, best[0], len(words), best[1]))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0])), pa.array(c[1], pa.int64()), *(pa.array(x, pa.int32()) for x in c[2:])], names=[doc, "item_id", "span", "item_words", "changed"])

    return both.mapInArrow(run, f"{doc} {kind}, {COLUMNS}")


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", least: float = SPAN, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, span, item_words, changed): the items that each document holds a passage of. items: item_id, text."""
    held = items.select("item_id", "text").distinct()
    few = held.orderBy("item_id").limit(block + 1).collect()  # at most block + 1 rows
    if len(few) <= block:
        return _broadcast_leaks(documents, [(r["item_id"], r["text"]) for r in few], doc, text, least)
    return _joined_leaks(documents, held, doc, text, least)
