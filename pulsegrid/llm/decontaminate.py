"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the word windows of the benchmark items. Patterns of one length share a shift table over the hashes
of two-word blocks: the block at a window's end tells how far no pattern can end. Where the shift is zero, the bucket
of the window's last and first block selects the patterns, and a comparison of the words' bytes confirms. Texts are cut
into overlapping lanes that step in lockstep, so a very long text is no slower per word than a short one.

The benchmark goes to the workers in blocks of a bounded size; with more blocks than one, each is searched in turn and
the hits of the later ones, named by a digest of the text, meet those of the first. A window that many items share is
one pattern with a list of them. Null and empty texts have no words and are not contaminated; empty items have no window; an
item with a null id hits words but is not listed; repeated items count once; repeated rows each get their result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut, mixed, rows_of, runs, span_hashes, text_slices

WIDTH = 13
#: Words that one lane covers.
LANE = 512
#: Most bytes of benchmark text that are sent to the workers at once.
BLOCK_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.ones(256, bool)
for _first, _last in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    WORD[_first : _last + 1] = False


class Words:
    """Words of many texts: their rows, hashes and bytes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = LOWER[raw]
        self.starts, self.ends = runs(WORD[self.raw], offsets)
        self.row = rows_of(self.starts, offsets)
        self.hash = span_hashes(self.raw, self.starts, self.ends)
        self.counts = np.bincount(self.row, minlength=len(offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def bytes_of(self, places: np.ndarray) -> np.ndarray:
        sizes = self.ends[places] - self.starts[places]
        firsts = np.cumsum(sizes) - sizes
        return self.raw[np.arange(int(sizes.sum())) - np.repeat(firsts - self.starts[places], sizes)]


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0xA24BAED4963EE407) + b)


class Patterns:
    """Tables for the windows of one length: ``places`` are their first words in ``items``."""

    def __init__(self, items: Words, places: np.ndarray, width: int):
        self.items, self.places, self.width = items, places, width
        self.span = min(2, width)
        grid = items.hash[places[:, None] + np.arange(width)]
        blocks = grid if self.span == 1 else _block(grid[:, :-1], grid[:, 1:])
        self.bits = int(np.clip(np.ceil(np.log2(max(1, blocks.size) * 8)), 10, 24))
        self.shift = np.full(1 << self.bits, width - self.span + 1, np.uint8 if width < 255 else np.int32)
        for j in range(blocks.shape[1]):  # the nearest to the end comes last and is the least
            at = self.slot(blocks[:, j])
            self.shift[at] = np.minimum(self.shift[at], blocks.shape[1] - 1 - j)
        keys = mixed(blocks[:, -1] + blocks[:, 0] * np.uint64(3))
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word of each occurrence and its pattern."""
        h, m = text.hash, self.width
        windows = np.maximum(text.counts - m + 1, 0)
        lanes = -(-windows // LANE)
        row = np.repeat(np.arange(len(windows)), lanes)
        number = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = text.first[row] + number * LANE
        stop = np.minimum(at + LANE, text.first[row] + windows[row])
        found = []
        while len(at):
            last = h[at + (m - 1)] if self.span == 1 else _block(h[at + (m - 2)], h[at + (m - 1)])
            step = self.shift[self.slot(last)].astype(np.int64)
            if not step.all():
                found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        where = np.concatenate(found) if found else np.zeros(0, np.int64)
        if self.span == 1:
            keys = mixed(h[where + m - 1] + h[where] * np.uint64(3))
        else:
            keys = mixed(_block(h[where + m - 2], h[where + m - 1]) + _block(h[where], h[where + 1]) * np.uint64(3))
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        sizes = high - low
        where = np.repeat(where, sizes)
        which = self.order[np.arange(len(where)) - np.repeat(np.cumsum(sizes) - sizes - low, sizes)] if len(where) else np.zeros(0, np.int64)
        for k in range(m):  # word by word: hashes first, then the bytes of what is left
            same = h[where + k] == self.items.hash[self.places[which] + k]
            where, which = where[same], which[same]
        for k in range(m):
            a, b = where + k, self.places[which] + k
            size = text.ends[a] - text.starts[a]
            same = size == self.items.ends[b] - self.items.starts[b]
            where, which, a, b, size = where[same], which[same], a[same], b[same], size[same]
            if len(where):
                wrong = np.add.reduceat((text.bytes_of(a) != self.items.bytes_of(b)).astype(np.int64), np.cumsum(size) - size)
                where, which = where[wrong == 0], which[wrong == 0]
        return where, which


class Index:
    """The distinct windows of a block of items, each with the list of the items that hold it."""

    def __init__(self, items: list[tuple[str | None, str]], width: int = WIDTH):
        data = [text.encode() for _, text in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        words = Words(np.frombuffer(b"".join(data), np.uint8), offsets)
        names = sorted({i for i, _ in items if i is not None})
        number = {name: k for k, name in enumerate(names)}
        self.names, own = names, np.array([number.get(i, -1) for i, _ in items], np.int64)
        #: Patterns of one length, and the bounds and content of their posting lists.
        self.groups: list[tuple[Patterns, np.ndarray, np.ndarray]] = []
        for m in sorted({int(min(c, width)) for c in words.counts if c}):
            chosen = np.flatnonzero(words.counts == m) if m < width else np.flatnonzero(words.counts >= width)
            n = words.counts[chosen] - m + 1
            places = np.repeat(words.first[chosen], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            window = _same_windows(words, places, m)
            order = np.argsort(window, kind="stable")
            firsts = np.flatnonzero(np.diff(window[order], prepend=-1))
            posted = np.unique(np.stack([window, own[words.row[places]]]), axis=1)
            posted = posted[:, posted[1] >= 0]
            bounds = np.searchsorted(posted[0], np.arange(len(firsts) + 1))
            self.groups.append((Patterns(words, places[order[firsts]], m), bounds, posted[1]))

    def hits(self, text: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is hit; rows and items of the distinct finds."""
        edge = np.zeros(len(text.hash) + 1, np.int64)
        rows, items = [], []
        for patterns, bounds, posted in self.groups:
            where, which = patterns.search(text)
            np.add.at(edge, where, 1)
            np.add.at(edge, where + patterns.width, -1)
            row, window = np.unique(np.stack([text.row[where], which]), axis=1)
            sizes = bounds[window + 1] - bounds[window]
            rows.append(np.repeat(row, sizes))
            items.append(posted[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - bounds[window], sizes)])
        row, item = np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(items or [np.zeros(0, np.int64)])
        pairs = np.unique(np.stack([row, item]), axis=1)
        return np.cumsum(edge[:-1]) > 0, pairs[0], pairs[1]


def _same_windows(words: Words, places: np.ndarray, width: int) -> np.ndarray:
    """A number for each window, 0, 1, ... in ascending order of first use: equal for windows of equal words."""
    known: dict[bytes, int] = {}
    starts, ends, raw = words.starts, words.ends, words.raw
    out = np.empty(len(places), np.int64)
    for k, p in enumerate(places.tolist()):
        content = b" ".join([raw[a:b].tobytes() for a, b in zip(starts[p : p + width].tolist(), ends[p : p + width].tolist(), strict=True)])
        out[k] = known.setdefault(content, len(known))
    return out


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str]]]:
    """Distinct items in blocks of about ``limit`` bytes, names and a fixed cost of each item included; each block comes to the driver alone."""
    own = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null").distinct()
    total = own.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("i"), F.lit(0)) + 64)).first()[0] or 0
    n = int(total // limit) + 1
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("t", "i"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in part.collect()]


RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items")


def scan(df: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", width: int = WIDTH, limit: int = BLOCK_BYTES) -> DataFrame:
    """keep plus counts, the items found, and the verdict, for every row."""
    kept = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)])
    state = df.select(kept.alias("keep"), F.col(text).alias("text"))
    first, more = None, []
    for part in blocks(benchmark, limit=limit):
        index = df.sparkSession.sparkContext.broadcast(Index(part, width))
        if first is None:
            first = index
        else:  # later blocks hand on the hits of distinct texts, not the texts
            hits = _searched(state.select(F.struct(F.sha2("text", 256).alias("d")).alias("keep"), "text"), index).where("size(places) > 0")
            more.append(cut(hits.groupBy(F.col("keep.d").alias("d")).agg(F.first("places").alias("places"), F.first("items").alias("items"))))
    if not more:
        found = _searched(state, first)
    else:
        found = _searched(state.select(F.struct("keep", F.sha2("text", 256).alias("d")).alias("keep"), "text"), first)
        others = more[0]
        for hits in more[1:]:
            others = others.unionByName(hits)
        others = others.groupBy("d").agg(F.flatten(F.collect_list("places")).alias("p"), F.flatten(F.collect_list("items")).alias("i"))
        none = lambda kind: F.array().cast(f"array<{kind}>")
        found = cut(found).join(others, F.col("keep.d") == F.col("d"), "left").select(F.col("keep.keep").alias("keep"), "n_words", F.concat("places", F.coalesce("p", none("int"))).alias("places"), F.concat("items", F.coalesce("i", none("string"))).alias("items"))
    items = F.array_sort(F.array_distinct("items"))
    out = found.select("keep", "n_words", F.size(F.array_distinct("places")).cast("bigint").alias("n_hit"), items.alias("items"))
    out = out.select("*", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"))
    return out.select(*[F.col(f"keep.k{i}").alias(k) for i, k in enumerate(keep) if k not in RESULT], *RESULT)


def _searched(state: DataFrame, index) -> DataFrame:
    """keep, n_words, the places of the words that one block hits, and the items found, for every row of (keep, text)."""
    kept = state.schema["keep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            for part, raw, offsets in text_slices(batch, "text"):
                words = Words(raw, offsets)
                hit, rows, items = own.hits(words)
                found: list[list[str]] = [[] for _ in words.counts]
                for r, i in zip(rows.tolist(), items.tolist(), strict=True):
                    found[r].append(own.names[i])
                place = np.flatnonzero(hit)
                row = words.row[place]
                places = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(words.counts) + 1)), pa.int32()), pa.array(place - words.first[row], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts, pa.int64()), places, pa.array(found, pa.list_(pa.string()))], ["keep", "n_words", "places", "items"])

    return state.mapInArrow(run, f"keep {kept}, n_words bigint, places array<int>, items array<string>")
