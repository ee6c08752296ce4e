"""Neighbours by hash and by direction, without cross joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates compared at once: what a task holds besides its group.
COMPARED = 1 << 20


def _near_hashes(most: int):
    """Arrow batches of (part, h), sorted by part, to those of (h, g): each pair of hashes up to `most` bits apart once."""
    import numpy as np
    import pyarrow as pa

    def near(part: int, v):
        """Pairs of a group, whose hashes share the byte of `part`; their other byte of the band is looked up by it and all bytes one bit away."""
        band, low = part >> 9, part >> 8 & 1
        other = v >> np.uint64(48 - 16 * band + 8 * low) & np.uint64(255)
        order = np.argsort(other, kind="stable")
        v, other = v[order], other[order].astype(np.int64)
        starts = np.searchsorted(other, np.arange(257))
        for flip in ([] if low else [0]) + ([1 << i for i in range(8)] if band < most - 3 else []):
            rows = np.flatnonzero(other & flip == 0)
            to = other[rows] ^ flip
            first = starts[to] if flip else rows + 1
            count = starts[to + 1] - first
            ends = np.cumsum(count)
            at, done = 0, 0
            while at < len(rows):
                till = max(at + 1, int(np.searchsorted(ends, done + COMPARED, "right")))
                n = count[at:till]
                right = np.arange(done, ends[till - 1]) + np.repeat(first[at:till] - (ends[at:till] - n), n)
                apart = np.repeat(v[rows[at:till]], n) ^ v[right]
                hit = np.flatnonzero(np.bitwise_count(apart) <= most)
                apart, g = apart[hit], v[right[hit]]
                for b in range(band):  # found there already
                    new = np.bitwise_count(apart >> np.uint64(48 - 16 * b) & np.uint64(65535)) > (b < most - 3)
                    apart, g = apart[new], g[new]
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array((apart ^ g).view(np.int64)), pa.array(g.view(np.int64))], names=["h", "g"])
                at, done = till, int(ends[till - 1])

    def run(batches):
        part, held = None, []
        for b in batches:
            parts, v = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else []
            for x, y in zip(edges, edges[1:], strict=False):
                if parts[x] != part:
                    if held:
                        yield from near(part, np.concatenate(held))
                    part, held = int(parts[x]), []
                held.append(v[x:y].copy())
        if held:
            yield from near(part, np.concatenate(held))

    return run


def hamming_pairs(df: DataFrame, key: str, hash_col: str, most: int = 6) -> DataFrame:
    """(key_a, key_b, bits): all pairs of rows, key_a < key_b, whose 64-bit hashes differ in at most `most` <= 7 bits.

    Four bands of 16 bits: of two such hashes one of the first most - 3 bands differs in one bit at most, or one of the
    others in none, as else they were most + 1 bits apart. Bits that differ in one of two bytes leave the other as it
    is, so distinct hashes are grouped by each byte of a band and compared in Arrow batches. Exact; each hash is
    shuffled eight times at most, whatever the number of comparisons, which grows with its square. Joins are by
    sorting, as plans estimate neither exploded rows nor pairs, and a broadcast of them takes all of the driver's memory.
    """
    if not 0 <= most <= 7:
        raise ValueError("four bands with one bit of difference reach 7 bits")
    half = lambda at: F.conv(F.substring(F.col(hash_col), at, 8), 16, 10).cast("bigint")
    number = F.shiftleft(half(1), 32).bitwiseOR(half(9))
    valid = df.filter(F.col(hash_col).rlike(r"^[0-9a-fA-F]{16}\z")).select(F.col(key).alias("k"), number.alias("h")).distinct()
    byte = lambda band, low: F.lit(band * 512 + low * 256) + F.shiftrightunsigned("h", 56 - 16 * band - 8 * low).bitwiseAND(F.lit(255)).cast("int")
    parts = [byte(band, low) for band in range(min(most, 3) + 1) for low in range(1 + (band < most - 3))]
    grouped = valid.select("h").distinct().select(F.explode(F.array(*parts)).alias("part"), "h").repartition("part").sortWithinPartitions("part")
    met = grouped.mapInArrow(_near_hashes(most), "h long, g long")
    x, y = valid.select(F.col("k").alias("kx"), F.col("h")).hint("merge"), valid.select(F.col("k").alias("ky"), F.col("h").alias("g")).hint("merge")
    near = met.join(x, "h").join(y, "g").filter("kx <> ky").select("kx", "ky", F.bit_count(F.col("h").bitwiseXOR(F.col("g"))).cast("int").alias("bits"))
    same = x.join(y, (F.col("h") == F.col("g")) & (F.col("kx") < F.col("ky"))).select("kx", "ky", F.lit(0).cast("int").alias("bits"))
    return near.unionByName(same).select(F.least("kx", "ky").alias(f"{key}_a"), F.greatest("kx", "ky").alias(f"{key}_b"), "bits")


def cosine_neighbors(vectors: DataFrame, queries: DataFrame, key: str, vector: str, least: float, block: int = 5000) -> DataFrame:
    """(query_id, neighbor_id, cosine): for each query all vectors of cosine `least` or more, itself not counted.

    The stated query set is shipped in blocks of at most `block` vectors and multiplied with each Arrow batch of the
    table as a matrix, so the table is read once a block and never shuffled. Null or zero vectors have no neighbours.
    """
    import numpy as np
    import pyarrow as pa

    kind = dict(vectors.dtypes)[key]
    out, held = None, []

    def search(ids: list, rows: list) -> DataFrame:
        q = np.array(rows, np.float64)
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        shipped = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches):
            ids, q = shipped.value
            for b in batches:
                full = b.filter(b.column(1).is_valid())
                if not full.num_rows:
                    continue
                v = full.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(full.num_rows, -1)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                dots = q @ (v / np.where(size > 0, size, 1)).T
                at, to = np.nonzero(dots >= least)
                mine, theirs = pa.array([ids[i] for i in at]), full.column(0).take(pa.array(to))
                apart = pa.array([x != y for x, y in zip(mine.to_pylist(), theirs.to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([mine.cast(theirs.type).filter(apart), theirs.filter(apart), pa.array(dots[at, to]).filter(apart)], names=["query_id", "neighbor_id", "cosine"])

        return vectors.select(key, vector).mapInArrow(run, f"query_id {kind}, neighbor_id {kind}, cosine double")

    for r in queries.select(key, vector).filter(F.col(vector).isNotNull()).toLocalIterator():
        if any(r[vector]):
            held.append((r[key], list(r[vector])))
        if len(held) == block:
            part = search(*map(list, zip(*held, strict=True)))
            out, held = part if out is None else out.unionByName(part), []
    if held:
        part = search(*map(list, zip(*held, strict=True)))
        out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], f"query_id {kind}, neighbor_id {kind}, cosine double") if out is None else out
