"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming distance by pigeonring filtering.

The 64 bits lie in m segments on a ring, m = distance + 1. By the strong pigeonring principle two fingerprints within
the distance have a start from which each chain of l segments differs in at most l * distance / m bits. A chain of two
(an equal segment, then at most one bit) is looked up by equality of keys, in very large tables a chain of three; longer
chains are checked on each candidate before the full Hamming distance.

Equal fingerprints are one node. Keys that more than ``hot`` fingerprints share are compared in blocks by numpy, which
hands on only links that join something new within their block, so a large group costs no row per pair; nothing is
dropped. Null and empty texts have fingerprint zero and are linked like any other; rows with a null id keep their class
but cannot name it; repeated rows share a class.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import SLICE_BYTES, SPACE, counted, cut, map_texts, rows_of, runs
from pulsegrid.llm.components import components
from pulsegrid.llm.decontaminate import LOWER

SHINGLE = 4
SEED = 42

# The five primes of the XXH64 algorithm.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of raw[start:end] for each span; spans may overlap."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    halves = np.ndarray((len(raw) + 1,), "<u4", padded.data, strides=(1,))
    accs = [np.uint64((seed + x) % 2**64) for x in (int(P1) + int(P2), int(P2), 0, -int(P1))]
    seed = np.uint64(seed)
    sizes = ends - starts
    h = np.full(len(starts), seed + P5, np.uint64)
    at = starts.astype(np.int64).copy()
    big = np.flatnonzero(sizes >= 32)
    if len(big):
        acc = [np.full(len(big), x, np.uint64) for x in accs]
        live = np.arange(len(big))
        while len(live):
            where = at[big[live]]
            for k in range(4):
                acc[k][live] = _round(acc[k][live], words[where + 8 * k])
            at[big[live]] = where + 32
            live = live[at[big[live]] + 32 <= ends[big[live]]]
        total = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            total = (total ^ _round(np.zeros(1, np.uint64), a)) * P1 + P4
        h[big] = total
    h += sizes.astype(np.uint64)
    while len(live := np.flatnonzero(at + 8 <= ends)):
        h[live] = _rotl(h[live] ^ _round(np.zeros(1, np.uint64), words[at[live]]), 27) * P1 + P4
        at[live] += 8
    if len(live := np.flatnonzero(at + 4 <= ends)):
        h[live] = _rotl(h[live] ^ (halves[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
        at[live] += 4
    while len(live := np.flatnonzero(at < ends)):
        h[live] = _rotl(h[live] ^ (raw[at[live]].astype(np.uint64) * P5), 11) * P1
        at[live] += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned fingerprint of each row."""
    n = len(offsets) - 1
    raw = LOWER[raw]
    starts, ends = runs(~SPACE[raw], offsets)
    out = np.zeros(n, np.uint64)
    if not len(starts):
        return out
    row = rows_of(starts, offsets)
    sizes = ends - starts
    # the words once more, each followed by one space: a shingle is then one span
    to = np.cumsum(sizes + 1) - (sizes + 1)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined = np.full(int((sizes + 1).sum()), 32, np.uint8)
    joined[place + np.repeat(to, sizes)] = raw[place + np.repeat(starts, sizes)]
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    pieces = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    of_row = np.repeat(np.arange(n), pieces)
    begin = first[of_row] + np.arange(len(of_row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    last = np.minimum(begin + shingle, first[of_row] + counts[of_row]) - 1
    h = xxh64(joined, to[begin], to[last] + sizes[last], seed)
    filled = np.flatnonzero(pieces)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, (np.cumsum(pieces) - pieces)[filled], axis=0, dtype=np.int32)
    over = sums * 2 > pieces[filled, None]
    out[filled] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


# --------------------------------------------------------------------------- linking

DISTANCE = 4
#: Fingerprints that one key may have before they are compared in blocks of BLOCK.
HOT = 256
BLOCK = 4096
#: Segments of the chain that keys hold. From LONG fingerprints on it is one more: each of them has ten times the probes,
#: but meets thousands of times fewer others by chance, so that the work still grows with the rows and not their square.
CHAIN = 2
LONG = 500_000_000


def ring(distance: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    m = distance + 1
    edges = [round(64 * k / m) for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _piece(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep plus fp, the fingerprint as a signed long."""
    return map_texts(df, text, list(keep), "fp bigint", lambda raw, offsets: [pa.array(fingerprints_of(raw, offsets).view(np.int64))], SLICE_BYTES // 2)


def _flips(widths: list[int], distance: int) -> list[int]:
    """Differences of the segments behind the first, as bits of a key, within the budgets of each shorter chain; the highest
    bit of each stands in the upper half."""
    m, out = distance + 1, [(0, 0)]
    for n, width in enumerate(widths, 2):
        grown = []
        for flip, ones in out:
            for more in range(n * distance // m - ones + 1):
                grown += [(flip << width | sum(1 << b for b in chosen), ones + more) for chosen in combinations(range(width), more)]
        out = grown
    return [flip | (1 << flip.bit_length() - 1 if flip else 0) << 32 for flip, _ in out]


def _keyed(nodes: DataFrame, distance: int, probing: bool, chain: int = CHAIN) -> DataFrame:
    """Keys of the chain of ``chain`` segments at each start. A probe also has the key of each difference within the budgets
    whose highest bit it lacks; the fingerprint that has that bit holds the other end, so each pair meets once at a start."""
    fp, segments, starts = F.col("fp"), ring(distance), []
    for i in range(len(segments)):
        own = [segments[(i + k) % len(segments)] for k in range(chain)]
        base = F.lit(0).cast("bigint")
        for at, width in own:
            base = F.shiftleft(base, width).bitwiseOR(_piece(fp, at, width))
        flips = [F.lit(_flips([width for _, width in own[1:]], distance)).cast("array<bigint>").alias("flips")] if probing else []
        starts.append(F.struct(F.lit(i).cast("bigint").alias("i"), base.alias("base"), *flips))
    each = nodes.select("fp", F.explode(F.array(*starts)).alias("s"))
    if not probing:  # one key a start
        return each.select("fp", F.shiftleft("s.i", 58).bitwiseOR(F.col("s.base")).alias("key"))
    each = each.select("fp", "s.i", "s.base", F.explode("s.flips").alias("flip"))  # as many for every fingerprint
    low = F.col("flip").bitwiseAND(F.lit(2**32 - 1))
    return each.where(F.col("base").bitwiseAND(F.shiftright("flip", 32)) == 0).select("fp", F.shiftleft("i", 58).bitwiseOR(F.col("base").bitwiseXOR(low)).alias("key"))


def _chained(a: Column, b: Column, distance: int) -> Column:
    """Whether some start keeps every chain within its budget, the whole ring (the Hamming distance) included."""
    segments, m = ring(distance), distance + 1
    x = a.bitwiseXOR(b)
    d = [F.bit_count(_piece(x, at, width)) for at, width in segments]
    starts = []
    for i in range(m):
        total, fits = F.lit(0), F.lit(True)
        for n in range(m):
            total = total + d[(i + n) % m]
            fits = fits & (total <= (n + 1) * distance // m)
        starts.append(fits)
    out = starts[0]
    for more in starts[1:]:
        out = out | more
    return out


def _spanning(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks of fingerprints that join them as all links would."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = inverse[: len(a)], inverse[len(a) :]
    out = []
    for k in range(len(a)):
        near = right[np.bitwise_count(nodes[right] ^ nodes[left[k]]) <= distance]
        if len(near):
            near = near[parent[near] != parent[left[k]]]
        for j in np.unique(near):
            p, q = find(int(left[k])), find(int(j))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((nodes[left[k]], nodes[j]))
    pairs = np.array(out, np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _hot_links(probes: DataFrame, index: DataFrame, hot: DataFrame, distance: int, block: int) -> DataFrame:
    """Links under hot keys: both sides in blocks, each pair of blocks one group of bounded size."""
    sizes = hot.join(probes, "key").groupBy("key", "n").agg(F.count("*").alias("m")).select("key", F.ceil(F.col("m") / block).cast("int").alias("nl"), F.ceil(F.col("n") / block).cast("int").alias("nr"))
    place = F.xxhash64("fp", F.lit(5))
    left = probes.join(sizes, "key").withColumn("lb", F.pmod(place, "nl").cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))
    right = index.join(sizes, "key").withColumn("rb", F.pmod(place, "nr").cast("int")).withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)))
    left = left.select(F.col("key").alias("k1"), F.col("lb").alias("l1"), F.col("rb").alias("r1"), F.col("fp").alias("x"))
    right = right.select(F.col("key").alias("k2"), F.col("lb").alias("l2"), F.col("rb").alias("r2"), F.col("fp").alias("y"))

    def link(l: pa.Table, r: pa.Table) -> pa.Table:
        x, y = (np.ascontiguousarray(t.column(3).to_numpy()).view(np.uint64) for t in (l, r))
        a, b = _spanning(x, y, distance) if len(x) and len(y) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return left.groupBy("k1", "l1", "r1").cogroup(right.groupBy("k2", "l2", "r2")).applyInArrow(link, "a bigint, b bigint")


def links(nodes: DataFrame, distance: int = DISTANCE, hot: int = HOT, block: int = BLOCK, chain: int = CHAIN) -> DataFrame:
    """(a, b) such that distinct fingerprints (column fp) within the distance are connected exactly as all links would."""
    probes, index = _keyed(nodes, distance, True, chain), _keyed(nodes, distance, False, chain)
    busy, crowded = counted(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot))
    p, q = probes, index
    if crowded:
        q = index.join(busy, "key", "left_anti")
    pairs = p.select("key", F.col("fp").alias("a")).join(q.select("key", F.col("fp").alias("b")), "key").where((F.col("a") != F.col("b")) & _chained(F.col("a"), F.col("b"), distance)).select("a", "b")
    return pairs.unionByName(_hot_links(probes, index, busy, distance, block)) if crowded else pairs


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE, hot: int = HOT, long: int = LONG) -> DataFrame:
    """key, fingerprint (hex) and component_id, the smallest key that can be reached, for every row."""
    rows = cut(fingerprints(df.select(F.col(key).alias("id"), F.col(text).alias("text")), "text", ("id",)))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    chain = CHAIN + (distance > 1 and nodes.count() >= long)
    found = components(links(nodes.select("fp"), distance, hot, chain=chain))
    labelled = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = labelled.select(F.col("fp").alias("_fp"), "root").join(names, "root").select("_fp", "component_id")
    return rows.join(of_fp, F.col("fp") == F.col("_fp"), "left").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
