"""Problem 5: encoding of the whole corpus with a public byte-level BPE tokenizer.

The JVM cuts each text into pieces by the tokenizer's pattern. Each Arrow batch
is then encoded by its distinct pieces: pieces that are tokens at once by lookup,
all others in padded numpy matrices, bucketed by length, where every row merges
its leftmost pair of minimum rank in each round; pairs are looked up in a hash
table, and rows are compacted after each merge and leave when no pair is left. As
compaction of one row costs its length each round, pieces of over LONG bytes (runs
without spaces, such as base64) go through linked arrays and a heap by rank and
place instead, which merges the same pairs in the same order in n log n steps.

A null and an empty text give an empty array; a blank text is encoded like any
other; the strings of special tokens are ordinary text. Ids are whatever row
they are in: repeated rows give repeated rows. The vocabulary (fixed size, some
12 MB as a table) is broadcast; its path is a parameter.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.nearset import load, mix, ship
from millrace.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of byte_bpe_50k, in which white space is that of Unicode.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
CELLS = 1 << 20
#: Bytes of a piece from which on it is merged in linked arrays.
LONG = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    """The ids of a .tiktoken file by token."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Table:
    """Ranks of pairs by hashed lookup, and the ids of single bytes and whole tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {(ranks[a], ranks[b]): r for t, r in ranks.items() for i in range(1, len(t)) if (a := t[:i]) in ranks and (b := t[i:]) in ranks}
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.pairs: dict[int, int] | None = None
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):  # linear probing, all keys at once: one per free slot goes in, the rest move on
            free = self.keys[slot] == np.uint64(2**64 - 1)
            first = np.zeros(len(keys), bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], slot[~put]
            slot = np.where(self.keys[slot] == keys, slot, (slot + 1) & ((1 << self.bits) - 1))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE if it doesn't merge."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        out = np.full(key.shape, NONE, np.int32)
        key = key.reshape(-1)
        flat, at, slot = out.reshape(-1), np.arange(key.size), self._slot(key)
        while len(at):
            held = self.keys[slot]
            hit = held == key
            flat[at[hit]] = self.values[slot[hit]]
            go = ~hit & (held != np.uint64(2**64 - 1))
            at, key, slot = at[go], key[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out


def merge_long(table: Table, ids: np.ndarray) -> np.ndarray:
    """Merges one long row of ids, its leftmost pair of minimum rank first: the ids that remain."""
    n, none = len(ids), int(NONE)
    if table.pairs is None:
        held = table.values != NONE
        table.pairs = dict(zip(table.keys[held].tolist(), table.values[held].tolist(), strict=True))
    get = table.pairs.get
    token, rank = ids.tolist(), [*table.rank(ids[:-1], ids[1:]).tolist(), none]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [r << 32 | i for i, r in enumerate(rank) if r != none]
    heapq.heapify(heap)
    while heap:
        r, i = divmod(heapq.heappop(heap), 1 << 32)
        if rank[i] != r:  # merged away, or a pair that is no more
            continue
        j = after[i]
        k = after[i] = after[j]
        token[i], rank[i], rank[j] = r, none, none
        if k < n:
            before[k] = i
            rank[i] = new = get(r << 32 | token[k], none)
            if new != none:
                heapq.heappush(heap, new << 32 | i)
        h = before[i]
        if h >= 0:
            rank[h] = new = get(token[h] << 32 | r, none)
            if new != none:
                heapq.heappush(heap, new << 32 | h)
    out, i = [], 0
    while i < n:
        out.append(token[i])
        i = after[i]
    return np.array(out, np.int32)


def merge_bucket(table: Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges the rows of a matrix of ids, padded by -1 on the right: the ids in row order, and how many each row has."""
    count = len(ids)
    done_rows, done_ids = [], []
    rows = np.arange(count)
    rank = table.rank(ids[:, :-1], ids[:, 1:])
    rank[ids[:, 1:] < 0] = NONE
    while len(rows):
        best = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), int)
        value = rank[np.arange(len(rows)), best] if rank.shape[1] else np.full(len(rows), NONE)
        over = value == NONE
        if over.any():
            done_rows.append(rows[over])
            done_ids.append(ids[over])
            go = ~over
            rows, ids, rank, best, value = rows[go], ids[go], rank[go], best[go], value[go]
            if not len(rows):
                break
        at = np.arange(len(rows))
        cols = np.arange(ids.shape[1] - 1)[None, :]
        ids[at, best] = value
        ids = np.where(cols <= best[:, None], ids[:, :-1], ids[:, 1:])
        rank = np.where(cols[:, :-1] < best[:, None], rank[:, :-1], rank[:, 1:])
        for side in (-1, 0):
            left = best + side
            inside = (left >= 0) & (left < ids.shape[1] - 1)
            i, left = at[inside], left[inside]
            a, b = ids[i, left], ids[i, left + 1]
            new = table.rank(a, b)
            new[b < 0] = NONE
            rank[i, left] = new
    width = max((m.shape[1] for m in done_ids), default=1)
    full = np.full((count, width), -1, np.int32)
    for r, m in zip(done_rows, done_ids, strict=True):
        full[r, : m.shape[1]] = m
    held = full >= 0
    return full[held], held.sum(1)


def encode_pieces(table: Table, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and where each piece's ids begin."""
    size = np.zeros(len(pieces), np.int64)
    whole = np.fromiter((table.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
    size[whole >= 0] = 1
    rest = np.flatnonzero(whole < 0)
    length = np.fromiter((len(pieces[i]) for i in rest), np.int64, len(rest))
    rest, length = rest[np.argsort(length, kind="stable")], np.sort(length)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    start = 0
    while start < len(rest):
        if length[start] > LONG:
            flat = merge_long(table, table.bytes[np.frombuffer(pieces[rest[start]], np.uint8)])
            size[rest[start]] = len(flat)
            parts.append((rest[start : start + 1], flat))
            start += 1
            continue
        stop = start + 1
        while stop < len(rest) and length[stop] <= min(LONG, max(8, length[start] * 1.25)) and length[stop] * (stop - start + 1) <= CELLS:
            stop += 1
        own, width = rest[start:stop], int(length[stop - 1])
        raw = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8)
        ids = np.full((len(own), max(2, width)), -1, np.int32)
        ids[np.arange(max(2, width))[None, :] < length[start:stop, None]] = table.bytes[raw]
        flat, many = merge_bucket(table, ids)
        size[own] = many
        parts.append((own, flat))
        start = stop
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(begin[-1], np.int32)
    out[begin[:-1][whole >= 0]] = whole[whole >= 0]
    for own, flat in parts:
        many = size[own]
        out[np.repeat(begin[own] - (np.cumsum(many) - many), many) + np.arange(len(flat))] = flat
    return out, begin


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): one row for each row of `df`."""
    shipped = ship(df, Table(read_ranks(vocabulary)))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(shipped)
        for b in batches:
            lists = b.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            codes = lists.flatten().dictionary_encode()
            ids, begin = encode_pieces(table, [p.encode() for p in codes.dictionary.to_pylist()])
            code = codes.indices.to_numpy()
            many = np.diff(begin)[code]
            stop = np.concatenate([[0], np.cumsum(many)])
            flat = ids[np.repeat(begin[:-1][code] - stop[:-1], many) + np.arange(stop[-1])]
            offsets = stop[ends - ends[0]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=[key, "ids"])

    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), F.lit(0))
    return spread(df.select(key, text)).select(key, pieces.alias("pieces")).mapInArrow(run, f"{key} {kind}, ids array<int>")
