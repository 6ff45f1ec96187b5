"""Ranked lexical search over a two-level quantised index.

The index is parted by documents. A segment (a row of a table in the shared folder) holds some documents with their
lengths, the terms in them in ascending order, and for each term its postings: the document, the occurrences, and one
byte, the impact. The impact of a posting, (1000000000 tf) div (1000 tf + 8 m), lies below a million whatever the term;
the byte is a ``STEP``-th of it, rounded up. So weight times step times byte bounds a term's share of a score from above,
and the same with one step less from below.

A search passes over the segments three times: documents that hold each term; the k highest lower bounds of each item,
of which the k-th is a threshold; and exact 64-bit integer scores of every document whose upper bound reaches its item's
threshold. Each task sends on k rows an item at most. No posting leaves its segment, so common terms make no hot keys.
Items are asked in blocks of ``TERMS`` terms.

Terms are told apart by 64-bit hashes. Null and empty texts have no terms; they count neither as documents nor as items.
Repeated rows are documents (or, under one id, terms of one item) of their own: repeated documents are ranked each, and
rows of one item id are one item. Documents with a null id come last among equal scores; items with a null id are one
item. Other columns are ignored. No documents give no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import byte_set, map_texts, row_sums, rows_of, runs, settle, shared_dir, span_hashes, text_slices

#: Impacts that one unit of a byte stands for: 255 of them reach a million.
STEP = 3922
#: Text bytes of a segment; a longer document has one of its own.
SEGMENT_BYTES = 1 << 21
#: Segments of a row group: Parquet's readers and writers hold a whole one, decoded, however many a task has.
GROUP_ROWS = 4
#: Distinct terms of the items that are asked together.
TERMS = 100_000
WORD = ~byte_set(bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ARRAYS = {"doc_id": pa.int64(), "known": pa.bool_(), "length": pa.int64(), "term": pa.int64(), "start": pa.int32(), "doc": pa.int32(), "tf": pa.int32()}
SEGMENT = "doc_id array<bigint>, known array<boolean>, length array<bigint>, term array<bigint>, start array<int>, doc array<int>, tf array<int>, impact binary"


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each term."""
    starts, ends = runs(WORD[raw], offsets)
    return span_hashes(LOWER[raw], starts, ends).view(np.int64), rows_of(starts, offsets)


def damping(length: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents with these many terms."""
    return 10 + (90 * length * n) // total


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and the terms of all documents."""

    def compute(raw: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        starts, _ = runs(WORD[raw], offsets)
        first = np.zeros(len(raw), bool)
        first[starts] = True
        return [pa.array(row_sums(first, offsets))]

    counted = map_texts(docs, text, [], "n bigint", compute)
    row = counted.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("total")).first()
    return row["n"], row["total"] or 0


def build(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> tuple[int, int]:
    """Writes the segments of all documents under folder; returns the counts that weights are made of."""
    n, total = totals(docs, text)
    own = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = docs_held = 0
        for batch in batches:
            for part, raw, offsets in text_slices(batch, "text", segment_bytes):
                if held and size + len(raw) > segment_bytes:
                    yield _segment(held, n, total)
                    held, size, docs_held = [], 0, 0
                hashes, rows = words(raw, offsets)
                ids = part.column(0)
                held.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), hashes, rows + docs_held))
                size, docs_held = size + len(raw), docs_held + part.num_rows
        if held:
            yield _segment(held, n, total)
        settle()

    own.mapInArrow(run, SEGMENT).write.mode("overwrite").option("parquet.block.row.count.limit", GROUP_ROWS).parquet(folder)
    return n, total


def _segment(held: list[tuple], n: int, total: int) -> pa.RecordBatch:
    ids, known, hashes, rows = (np.concatenate(x) for x in zip(*held, strict=True))
    length = np.bincount(rows, minlength=len(ids))
    order = np.lexsort((rows, hashes))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(first, append=len(rows))
    term, doc = hashes[first], rows[first]
    head = np.ones(len(term), bool)
    head[1:] = term[1:] != term[:-1]
    start = np.append(np.flatnonzero(head), len(term))
    impact = _impacts(tf, damping(length, n, max(total, 1))[doc])
    level = (-(-impact // STEP)).astype(np.uint8)
    columns = dict(zip(ARRAYS, (ids, known, length, term[head], start, doc, tf), strict=True))
    arrays = [pa.array([v.astype(ARRAYS[c].to_pandas_dtype())], pa.list_(ARRAYS[c])) for c, v in columns.items()]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([level.tobytes()], pa.binary())], [*ARRAYS, "impact"])


def _impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Block:
    """Items asked together: their distinct terms, and for each item the places of its terms among these."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.terms = np.unique(np.concatenate([t for _, t in items]))
        self.places = [np.searchsorted(self.terms, t) for _, t in items]
        self.weights = np.zeros(len(self.terms), np.int64)
        self.floors = np.zeros(len(items), np.int64)


class Postings:
    """Postings of a block's terms in one segment."""

    def __init__(self, batch: pa.RecordBatch, row: int, terms: np.ndarray, level: bool):
        flat = lambda c: batch.column(batch.schema.get_field_index(c))[row].values.to_numpy(zero_copy_only=False)
        own, self.start = flat("term"), flat("start")
        place = np.minimum(np.searchsorted(own, terms), max(len(own) - 1, 0))
        hit = own[place] == terms if len(own) else np.zeros(len(terms), bool)
        self.first = np.where(hit, self.start[place], 0)
        self.last = np.where(hit, self.start[np.minimum(place + 1, len(self.start) - 1)], 0)
        if level:
            self.doc = flat("doc")
            self.level = np.frombuffer(batch.column(batch.schema.get_field_index("impact"))[row].as_py(), np.uint8)
            self.flat = flat
            self.docs = len(batch.column(batch.schema.get_field_index("length"))[row])

    def bounds(self, places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents that hold a term of an item, and lower and upper bounds of their scores."""
        spans = [(a, b, w) for a, b, w in zip(self.first[places], self.last[places], weights[places], strict=True) if a < b]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = np.concatenate([self.doc[a:b] for a, b, _ in spans])
        each = np.concatenate([np.int64(w) * self.level[a:b] for a, b, w in spans])
        less = np.repeat([w for _, _, w in spans], [b - a for a, b, _ in spans])
        high = np.bincount(doc, each, self.docs)  # sums below 2 ** 53 are exact
        gap = np.bincount(doc, less, self.docs)
        found = np.flatnonzero(high)
        high, gap = high[found].astype(np.int64), gap[found].astype(np.int64)
        return found, (high - gap) * STEP, high * STEP

    def scores(self, places: np.ndarray, weights: np.ndarray, wanted: np.ndarray, m: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Exact scores of the wanted documents."""
        out = np.zeros(len(wanted), np.int64)
        slot = np.full(self.docs, -1)
        slot[wanted] = np.arange(len(wanted))
        for place in places:
            a, b = self.first[place], self.last[place]
            at = slot[self.doc[a:b]]
            here = at >= 0
            doc = self.doc[a:b][here]
            out[at[here]] += weights[place] * _impacts(tf[a:b][here], m[doc])
        return out


def _over(segments: DataFrame, columns: list[str], compute, schema: str, finish=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for row in range(batch.num_rows):
                compute(batch, row, state)
        yield finish(state)
        settle()

    return segments.select(*columns).mapInArrow(run, schema)


def _blocks(items: DataFrame, key: str, text: str, terms: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Items with their distinct terms, some at a time."""

    def compute(raw: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        hashes, rows = words(raw, offsets)
        cuts = np.searchsorted(rows, np.arange(1, len(offsets) - 1))
        return [pa.array([np.unique(x) for x in np.split(hashes, cuts)] if len(offsets) > 1 else [], pa.list_(pa.int64()))]

    asked = map_texts(items.select(F.col(f"`{key}`").cast("bigint").alias("item"), F.col(f"`{text}`").alias("text")), "text", ["item"], "terms array<bigint>", compute)
    asked = asked.select("item", F.explode("terms").alias("term")).groupBy("item").agg(F.collect_set("term").alias("terms"))
    held, size = [], 0
    for r in asked.orderBy("item").toLocalIterator():
        held.append((r["item"], np.array(sorted(r["terms"]), np.int64)))
        size += len(r["terms"])
        if size >= terms:
            yield held
            held, size = [], 0
    if held:
        yield held


def _top(score: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then known and smallest ids."""
    return np.lexsort((ids, ~known, -score))[:k]


def search(segments: DataFrame, n: int, total: int, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", terms: int = TERMS) -> DataFrame:
    """The k documents with the highest positive scores of each item: item_id, rank, doc_id, score."""
    spark = segments.sparkSession
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    out = None
    for held in _blocks(items, key, text, terms):
        found = _asked(segments, n, total, Block(held), k).select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _asked(segments: DataFrame, n: int, total: int, block: Block, k: int) -> DataFrame:
    def count(batch: pa.RecordBatch, row: int, state: dict) -> None:
        own = Postings(batch, row, block.terms, False)
        state["df"] = state.get("df", 0) + (own.last - own.first)

    def counts(state: dict) -> pa.RecordBatch:
        df = np.atleast_1d(np.asarray(state.get("df", np.zeros(len(block.terms), np.int64)), np.int64))
        used = np.flatnonzero(df)
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(df[used])], ["place", "df"])

    for r in _over(segments, ["term", "start"], count, "place int, df bigint", counts).groupBy("place").agg(F.sum("df").alias("df")).collect():  # the block's terms
        block.weights[r["place"]] = weight(n, r["df"])

    def bound(batch: pa.RecordBatch, row: int, state: dict) -> None:
        own = Postings(batch, row, block.terms, True)
        for item, places in enumerate(block.places):
            _, low, _ = own.bounds(places, block.weights)
            low = low[low > 0]
            if len(low):
                best = np.concatenate([state.get(item, low[:0]), low])
                state[item] = np.partition(best, len(best) - k)[-k:] if len(best) > k else best

    def bounded(state: dict) -> pa.RecordBatch:
        item = np.repeat(np.array(list(state), np.int32), [len(v) for v in state.values()])
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate([*state.values(), np.zeros(0, np.int64)]).astype(np.int64))], ["item", "low"])

    lows = _over(segments, ["length", "term", "start", "doc", "impact"], bound, "item int, low bigint", bounded)
    kth = lows.withColumn("k", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).where(F.col("k") <= k)
    for r in kth.where(F.col("k") == k).collect():  # one row an item of the block
        block.floors[r["item"]] = r["low"]

    def rescore(batch: pa.RecordBatch, row: int, state: dict) -> None:
        own = Postings(batch, row, block.terms, True)
        ids, known, length, tf = (own.flat(c) for c in ("doc_id", "known", "length", "tf"))
        m = damping(length, n, total)
        for item, places in enumerate(block.places):
            found, _, high = own.bounds(places, block.weights)
            found = found[high >= block.floors[item]]
            if len(found):
                score = own.scores(places, block.weights, found, m, tf)
                found, score = found[score > 0], score[score > 0]
                s, i, o = (np.concatenate(x) for x in zip(state.get(item, (score[:0], ids[:0], known[:0])), (score, ids[found], known[found]), strict=True))
                best = _top(s, i, o, k)
                state[item] = s[best], i[best], o[best]

    def rescored(state: dict) -> pa.RecordBatch:
        columns = [np.concatenate([v[c] for v in state.values()]) if state else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, bool))]
        item = np.repeat(np.array(list(state), np.int32), [len(v[0]) for v in state.values()])
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(columns[0]), pa.array(columns[1], mask=~columns[2])], ["item", "score", "doc_id"])

    exact = _over(segments, ["doc_id", "known", "length", "term", "start", "doc", "tf", "impact"], rescore, "item int, score bigint, doc_id bigint", rescored)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).cast("int")
    ids = F.array(*[F.lit(i).cast("bigint") for i in block.ids]) if len(block.ids) <= 1000 else None
    best = exact.withColumn("rank", rank).where(F.col("rank") <= k)
    if ids is not None:
        return best.withColumn("item_id", F.element_at(ids, F.col("item") + 1))
    names = segments.sparkSession.createDataFrame(list(enumerate(block.ids)), "item int, item_id bigint")
    return best.join(F.broadcast(names), "item")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Builds the index of docs in the shared folder and searches it for every item."""
    folder = f"{shared_dir(docs.sparkSession)}/lexical-{uuid.uuid4().hex}"
    n, total = build(docs, folder)
    return search(docs.sparkSession.read.schema(SEGMENT).parquet(folder), n, total, items, k)


SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
    n AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
    p AS (SELECT rid, doc_id, len(w) AS size, t, count(*) AS tf FROM d, unnest(w) AS u(t) GROUP BY rid, doc_id, size, t),
    f AS (SELECT t, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, n GROUP BY t, n),
    s AS (SELECT item_id, rid, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * size * n) // total))))::BIGINT AS score
        FROM p JOIN q USING (t) JOIN f USING (t), n GROUP BY item_id, rid, doc_id)
    SELECT item_id, k::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS k FROM s WHERE score > 0) AS o WHERE k <= 10
"""
