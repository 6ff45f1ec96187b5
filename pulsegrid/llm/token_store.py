"""Token ids in wavelet-matrix files: one compressed file for each shard of documents, in ascending order of their ids.

A file holds the token sequence of its documents as a wavelet matrix of Huffman shape. Level k keeps bit k of the code of
every token whose code is longer than k, zeros of the level above first, with the number of ones before every 512th bit.
Codes are given out so that tokens whose code ends at a level lie behind all others there; so a rank alone leads from one
level to the next. Frequent tokens have short codes: the planes take about the entropy of the tokens. Access to a token,
the count of a token in a range, and its k-th occurrence each take one or two steps a level, without unpacking the file.

Tables are dealt by ranges of document id; rows of one id are dealt further by a hash of their text, so a hot id (or null,
which comes first) fills no single task. A task cuts its range into files of about ``most`` tokens; a longer document has
a file of its own. Rows that are equal in id and text come one after the other. Null texts are empty texts; each document
ends with the end id. An empty table makes no file. Files of failed attempts are not named by the manifest and never read.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import settle, text_slices

MAGIC = b"PGWM0001"
#: Tokens of one file, and thereby the memory of a task: about 60 bytes for each of them.
MOST = 1 << 21
#: Bits between two counts of the rank directory.
STEP = 512
#: Distinct pieces whose ids a Python worker keeps.
MEMO = 600_000
#: Longest piece that is kept.
KEPT_CHARS = 64
#: Pieces that the library encodes at once.
ENCODED = 2048
#: A space between two other characters always begins a token of the byte-level vocabulary.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: A piece of a word and signs behind it, between which another token begins.
WORD_SIGNS = re.compile(r"([A-Za-z]+)([!-&(-/:-@\[-`{-~]+)")
#: A piece that is one word, and the sign that stands for its space in the vocabulary.
WORD = re.compile(r" ?[A-Za-z]+")
SPACE_SIGN = "\u0120"
#: Texts in which each space is such a cut.
UNEVEN = re.compile(r"\s\s|^\s|\s$")


class Encoder:
    """Ids of texts by the tokenizers library, piece by piece: texts are cut where a space always begins a token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # the same merges without the step that parts texts into words, for words that are parted already
        bare = json.loads(self.library.to_str())
        plain = bare["normalizer"] is None and bare["pre_tokenizer"]["type"] == "ByteLevel" and not bare["pre_tokenizer"]["add_prefix_space"]
        if not plain:
            raise ValueError("not a byte-level vocabulary")
        self.words = Tokenizer.from_str(json.dumps(bare | {"pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}))
        self.memo: dict[str, bytes] = {}  # pieces behind a space, without it
        self.halves: dict[str, bytes] = {}  # words and signs of pieces that were parted

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit words."""
        out, waiting, fresh = [], [], set()
        get = self.memo.get
        for text in texts:
            first, rest = self._pieces(text)
            row = list(map(get, rest))
            row.insert(0, self._whole(first))
            missed = [i for i, ids in enumerate(row) if ids is None]
            if missed:
                fresh.update([rest[i - 1] for i in missed])
                waiting.append((len(out), rest, missed))
                out.append(row)
            else:
                out.append(b"".join(row))
        known = self._learned(fresh)
        for place, rest, missed in waiting:
            row = out[place]
            for i in missed:
                row[i] = known[rest[i - 1]]
            out[place] = b"".join(row)
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""

    def _learned(self, fresh: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the memo does not hold; those that are not long go into it."""
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
        parts = {p: m.groups() for p in fresh if (m := WORD_SIGNS.fullmatch(p))}
        pairs = {x for both in parts.values() for x in ((" " + both[0]), both[1])}
        words = [p for p in fresh if WORD.fullmatch(p)]
        others = [" " + p for p in fresh.difference(parts).difference(words)]
        asked = list({" " + p for p in words}.union(pairs).difference(self.halves))
        got = self._asked(self.words, [p for p in asked if WORD.fullmatch(p)]) | self._asked(self.library, others + [p for p in asked if not WORD.fullmatch(p)])
        if len(self.halves) + len(pairs) > MEMO:
            self.halves.clear()
        find = lambda p: got[p] if p in got else self.halves[p]
        out = {p: find(" " + p) for p in fresh.difference(parts)}
        out |= {p: find(" " + word) + find(signs) for p, (word, signs) in parts.items()}
        self.halves |= {p: find(p) for p in pairs if len(p) <= KEPT_CHARS}
        self.memo |= {p: ids for p, ids in out.items() if len(p) <= KEPT_CHARS}
        return out

    def _asked(self, library, pieces: list[str]) -> dict[str, bytes]:
        out = {}
        for a in range(0, len(pieces), ENCODED):
            some = pieces[a : a + ENCODED]
            sent = some if library is self.library else [p.replace(" ", SPACE_SIGN) for p in some]
            for piece, got in zip(some, library.encode_batch_fast(sent, add_special_tokens=False), strict=True):
                ids = got.ids
                out[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _pieces(self, text: str) -> tuple[str, list[str]]:
        """The first piece, and the others without the space that each of them begins with."""
        if " " in text and UNEVEN.search(text) is None:
            first, *rest = text.split(" ")
        else:
            first, *rest = CUT.split(text)
        return first, rest


_KEPT: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder of a vocabulary, which lives on from task to task with the pieces it knows (MEMO of them at most)."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code length of each symbol; at least 1."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    parent = [0] * (2 * n - 1)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    for node in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = node
        heapq.heappush(heap, (a + b, node))
    depth = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    return np.array(depth[:n], np.int64)


def codes(ordered: np.ndarray) -> np.ndarray:
    """Codes for symbols in ascending order of code length; of the nodes of a level the last ones end there."""
    out, nodes, at = np.zeros(len(ordered), np.int64), np.zeros(1, np.int64), 0
    for length in range(1, int(ordered[-1]) + 1 if len(ordered) else 0):
        nodes = np.concatenate([nodes << 1, nodes << 1 | 1])
        ending = int(np.searchsorted(ordered, length, "right")) - at
        if ending:
            out[at : at + ending] = nodes[len(nodes) - ending :]
            nodes = nodes[: len(nodes) - ending]
            at += ending
    return out


def packed(tokens: np.ndarray, ends: np.ndarray, ids: np.ndarray, known: np.ndarray) -> bytes:
    """A file: tokens, the end of each document in them, and the ids of the documents (known: not null)."""
    counts = np.bincount(tokens)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    length = lengths(counts) if len(symbols) else np.zeros(0, np.int64)
    order = np.argsort(length, kind="stable")
    symbols, counts, length = symbols[order], counts[order], length[order]
    code = codes(length)
    rank = np.zeros(int(symbols.max(initial=-1)) + 1, np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
    rank[symbols] = np.arange(len(symbols))
    row = rank[tokens]  # the sequence, as numbers of symbols in file order
    levels, planes = [], []
    depth = int(length[-1]) if len(length) else 0
    for k in range(depth):
        bit = (code >> np.maximum(length - 1 - k, 0) & 1).astype(bool)[row]
        ones = np.packbits(bit, bitorder="little")
        ones = np.concatenate([ones, np.zeros(-len(ones) % (STEP // 8), np.uint8)])
        marks = np.zeros(len(ones) // (STEP // 8) + 1, "<u4")
        np.cumsum(np.bitwise_count(ones.view("<u8")).reshape(-1, STEP // 64).sum(1), out=marks[1:])
        levels.append((len(row), len(row) - int(marks[-1])))
        planes += [marks.tobytes(), ones.tobytes()]
        row = np.concatenate([row[~bit], row[bit]])
        row = row[: len(row) - int(counts[length == k + 1].sum())]
    head = struct.pack("<8sQQQQ", MAGIC, len(tokens), len(ends), len(symbols), depth)
    parts = [ends.astype("<u8"), ids.astype("<i8"), np.packbits(known, bitorder="little"), symbols.astype("<u4"), counts.astype("<u4"), length.astype("u1"), np.array(levels, "<u8").reshape(-1)]
    return b"".join([head, *(p.tobytes() for p in parts), *planes])


class Shard:
    """Reader of one file; its arrays are views of the bytes."""

    def __init__(self, raw: bytes):
        magic, self.n, docs, kinds, depth = struct.unpack_from("<8sQQQQ", raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.ends, self.ids = take("<u8", docs).astype(np.int64), take("<i8", docs)
        self.known = np.unpackbits(take("u1", (docs + 7) // 8), count=docs, bitorder="little").astype(bool)
        self.symbols, self.counts, self.length = take("<u4", kinds), take("<u4", kinds).astype(np.int64), take("u1", kinds).astype(np.int64)
        self.levels = take("<u8", 2 * depth).astype(np.int64).reshape(-1, 2)
        self.code = codes(self.length)
        self.planes = []
        for n, _ in self.levels:
            blocks = -(-int(n) // STEP)
            self.planes.append((take("<u4", blocks + 1), take("u1", blocks * (STEP // 8))))
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.number = {int(s): k for k, s in enumerate(self.symbols)}
        self.leaf = {(int(a), int(c)): k for k, (a, c) in enumerate(zip(self.length, self.code, strict=True))}

    def ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        marks, bits = self.planes[level]
        block = i // STEP
        part = bits[block * (STEP // 8) : (i + 7) // 8]
        total = int(marks[block])
        if len(part):
            total += int(np.bitwise_count(part).sum())
            if i & 7:
                total -= (int(part[-1]) >> (i & 7)).bit_count()
        return total

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value in a level."""
        marks, bits = self.planes[level]
        found = marks.astype(np.int64) if bit else np.minimum(np.arange(len(marks)) * STEP, self.levels[level][0]) - marks
        block = int(np.searchsorted(found, k, "right")) - 1
        own = np.unpackbits(bits[block * (STEP // 8) : (block + 1) * (STEP // 8)], bitorder="little")
        return block * STEP + int(np.flatnonzero(own == bit)[k - int(found[block])])

    def access(self, i: int) -> int:
        """Token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level, (_, zeros) in enumerate(self.levels):
            before = self.ones(level, i)
            bit = self.ones(level, i + 1) - before
            code = code << 1 | bit
            i = int(zeros) + before if bit else i - before
            if level + 1 == len(self.levels) or i >= self.levels[level + 1][0]:
                return int(self.symbols[self.leaf[level + 1, code]])
        raise IndexError(i)

    def _down(self, token: int, a: int, b: int) -> tuple[int, int]:
        """The range that positions a to b of the token's path take behind its last level."""
        k = self.number[token]
        for level in range(int(self.length[k])):
            x, y = self.ones(level, a), self.ones(level, b)
            if int(self.code[k]) >> (int(self.length[k]) - 1 - level) & 1:
                a, b = int(self.levels[level][1]) + x, int(self.levels[level][1]) + y
            else:
                a, b = a - x, b - y
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of a token in positions a to b."""
        if token not in self.number:
            return 0
        a, b = self._down(token, a, self.n if b is None else b)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        symbol = self.number[token]
        i = self._down(token, 0, 0)[0] + k
        for level in range(int(self.length[symbol]) - 1, -1, -1):
            bit = int(self.code[symbol]) >> (int(self.length[symbol]) - 1 - level) & 1
            i = self.select(level, bit, i - (int(self.levels[level][1]) if bit else 0))
        return i

    def positions(self, token: int) -> np.ndarray:
        """All positions of a token, its occurrences followed up the levels together."""
        if token not in self.number:
            return np.zeros(0, np.int64)
        symbol = self.number[token]
        at = self._down(token, 0, 0)[0] + np.arange(int(self.counts[symbol]))
        for level in range(int(self.length[symbol]) - 1, -1, -1):
            bit = int(self.code[symbol]) >> (int(self.length[symbol]) - 1 - level) & 1
            own = np.unpackbits(self.planes[level][1], count=int(self.levels[level][0]), bitorder="little")
            at = np.flatnonzero(own == bit)[at - (int(self.levels[level][1]) if bit else 0)]
        return at

    def tokens(self) -> np.ndarray:
        """The whole sequence, unpacked from the last level to the first."""
        row, last = np.zeros(0, np.uint32), len(self.symbols)
        for level in range(len(self.levels) - 1, -1, -1):
            first = int(np.searchsorted(self.length, level + 1, "left"))
            below = np.concatenate([row, np.repeat(self.symbols[first:last], self.counts[first:last])])
            last = first
            n, zeros = map(int, self.levels[level])
            bit = np.unpackbits(self.planes[level][1], count=n, bitorder="little").astype(bool)
            row = np.empty(n, np.uint32)
            row[~bit], row[bit] = below[:zeros], below[zeros:]
        return row


# --------------------------------------------------------------------------- files

MANIFEST = "name string, first_id bigint, first_hash bigint, docs bigint, tokens bigint, bytes bigint"


def _store(folder: str):
    """File system and path of a folder that a task writes to and reads from."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", folder)
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9]+:/", uri) else (fs.LocalFileSystem(), uri)


def write(docs: DataFrame, folder: str, path: str, end: int = 0, most: int = MOST, key: str = "doc_id", text: str = "text") -> None:
    """Files of the token ids of all documents under folder, in ascending order of key, and their manifest."""
    own = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    own = own.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text")
    tail = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _store(folder)
        store.create_dir(f"{place}/shards", recursive=True)
        encoder, held, ids, hashes, n = encoder_of(path), [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, ids, hashes, n
            ends = np.cumsum([len(x) // 4 for x in held])
            known = np.array([i is not None for i in ids], bool)
            raw = packed(np.frombuffer(b"".join(held), "<u4"), ends, np.array([i or 0 for i in ids], np.int64), known)
            name = f"{uuid.uuid4().hex}.wm"
            with store.open_output_stream(f"{place}/shards/{name}") as out:
                out.write(raw)
            row = [[name], [ids[0]], [hashes[0]], [len(ids)], [n], [len(raw)]]
            held, ids, hashes, n = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.string()), *(pa.array(c, pa.int64()) for c in row[1:])], [x.split(" ")[0] for x in MANIFEST.split(", ")])

        for batch in batches:
            for part, _, _ in text_slices(batch, "text"):
                rows = encoder.encode([x or "" for x in part.column(1).to_pylist()])
                for i, h, row in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), rows, strict=True):
                    if ids and n + len(row) // 4 + 1 > most:
                        yield flush()
                    held.append(row + tail)
                    ids.append(i)
                    hashes.append(h)
                    n += len(row) // 4 + 1
        if ids:
            yield flush()
        settle()

    own.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files in their order, with the number of tokens before each."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash", "name")  # one row a file
    return files.withColumn("base", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _scanned(spark: SparkSession, folder: str, compute, schema: str) -> DataFrame:
    """Rows of compute(shard, base) over all files, one file in a task's memory at a time."""
    files = manifest(spark, folder).select("name", "base")
    n = files.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _store(folder)
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(f"{place}/shards/{name}") as src:
                    shard = Shard(src.read())
                yield compute(shard, base)
        settle()

    return files.repartition(max(1, min(n, 10_000))).mapInArrow(run, schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of all files: doc_id, start (tokens of all documents before it), n_tokens and the CRC-32 of the ids."""

    def compute(shard: Shard, base: int) -> pa.RecordBatch:
        raw = memoryview(shard.tokens().astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(shard.starts.tolist(), shard.ends.tolist(), strict=True)]
        columns = [pa.array(shard.ids, mask=~shard.known), pa.array(shard.starts + base), pa.array(shard.ends - shard.starts), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _scanned(spark, folder, compute, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """Occurrences of each of the tokens in each document that holds it, by ranks alone."""

    def compute(shard: Shard, base: int) -> pa.RecordBatch:
        rows = []
        for token in tokens:
            if token in shard.number:
                per = np.bincount(np.searchsorted(shard.ends, shard.positions(token), "right"), minlength=len(shard.ends))
                rows += [(token, int(shard.ids[d]) if shard.known[d] else None, int(per[d])) for d in np.flatnonzero(per)]
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["token", "doc_id", "n"])

    return _scanned(spark, folder, compute, "token bigint, doc_id bigint, n bigint")


def occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """Every occurrence of the tokens: the document and the place in it, from 0."""

    def compute(shard: Shard, base: int) -> pa.RecordBatch:
        found = [shard.positions(t) for t in tokens]
        at = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
        doc = np.searchsorted(shard.ends, at, "right")
        which = np.repeat(np.array(tokens, np.int64), [len(f) for f in found])
        columns = [pa.array(which), pa.array(shard.ids[doc], mask=~shard.known[doc]), pa.array(at - shard.starts[doc])]
        return pa.RecordBatch.from_arrays(columns, ["token", "doc_id", "place"])

    return _scanned(spark, folder, compute, "token bigint, doc_id bigint, place bigint")


def default_path() -> str:
    """The byte-level vocabulary file of the public tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
