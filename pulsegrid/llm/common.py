"""Pieces that the corpus operators share: table access, lineage cuts, byte-level tokenising."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import graph

#: Text bytes that one numpy pass handles; its temporaries take up to a hundred times this.
SLICE_BYTES = 1 << 20
#: Rows of one Arrow batch, unless the session says otherwise.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches and sends this package to the Python workers once, for sessions started without it on their path."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(context, "_pulsegrid_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="pulsegrid-")) / "pulsegrid.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._pulsegrid_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which a cluster has to name; a temporary one only on a local master, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext.getCheckpointDir()
        if held is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = held.rsplit("/", 1)[0] if held else tempfile.mkdtemp(prefix="pulsegrid-")
    return named.rstrip("/")


def ready(spark: SparkSession) -> None:
    """Names the checkpoint folder where the session has none yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Writes df to the shared folder and goes on from there, so that lost executors cost no recomputation."""
    ready(df.sparkSession)
    return df.checkpoint(eager)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """As ``cut``, with the number of rows; a small table goes on in few partitions."""
    ready(df.sparkSession)
    return graph.counted(df)


def held_out(doc_id: str = "doc_id"):
    """True for rows that must not be learned from: crc32 of the id as text is a multiple of 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hash_sample(df: DataFrame, key, rows: int) -> DataFrame:
    """At most ``rows`` rows, the first in the order of a hash of key: the same at any partitioning."""
    return df.orderBy(F.xxhash64(key, F.lit(17)), key).limit(rows)


# --------------------------------------------------------------------------- bytes of many texts at once


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` text bytes, each with its bytes and its row offsets; null texts are empty. A longer text comes alone, whole."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
        part = texts.slice(first, last - first)
        width = np.int64 if pa.types.is_large_string(part.type) else np.int32
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, width)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        yield batch.slice(first, last - first), raw, offsets - offsets[0]
        first = last


_generator = np.random.Generator(np.random.PCG64(20240229))
BYTE_MIX = _generator.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def powers(n: int, base: np.uint64 = STEP) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true bytes; runs stop at row ends."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(member)
    before[0] = False
    before[1:] = member[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(member)]
    before[inner] = False
    starts = np.flatnonzero(member & ~before)
    after = np.empty_like(member)
    after[-1] = False
    after[:-1] = member[1:]
    inner = inner[inner > 0]
    after[inner - 1] = False
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of raw[start:end] for disjoint ascending spans, none of them empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    firsts = np.zeros(len(sizes), np.int64)
    np.cumsum(sizes[:-1], out=firsts[1:])
    place = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    values = BYTE_MIX[raw[place + np.repeat(starts, sizes)]] * powers(int(sizes.max()))[place]
    return mixed(np.add.reduceat(values, firsts) + sizes.astype(np.uint64))


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row number of each byte position."""
    return np.searchsorted(offsets, starts, "right") - 1


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive word hashes; shorter by width - 1 than words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, p in enumerate(powers(width, np.uint64(0xD1342543DE82EF95))):
        total += words[k : k + n] * p
    return mixed(total)


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags over the bytes of each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


#: The ASCII white space that parts words: space and U+0009 to U+000D.
SPACE = byte_set(b" \t\n\x0b\x0c\r")


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts keys, and for each sorted place whether the same key stands before it."""
    order = np.argsort(keys)
    held = keys[order]
    same = np.zeros(len(held), bool)
    same[1:] = held[1:] == held[:-1]
    return order, same


def settle() -> None:
    """Gives free memory back at the end of a task: Python workers live on beside the next operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def map_texts(df: DataFrame, text: str, keep: list[str], schema: str, compute, limit: int = SLICE_BYTES, done=None) -> DataFrame:
    """keep plus the columns of ``schema``: compute(bytes, offsets) gives an arrow array for each of them; done() ends a task.

    The kept columns travel as one struct, so that their names cannot clash with those of the results; a kept column
    that has the name of a result is dropped in its favour.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    packed = df.select(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)]).alias("keep"), F.col(text).alias("text"))
    kept_type = packed.schema["keep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part, raw, offsets in text_slices(batch, "text", limit):
                    yield pa.RecordBatch.from_arrays([part.column(0), *compute(raw, offsets)], ["keep", *names])
        finally:
            if done is not None:
                done()
            settle()

    out = packed.mapInArrow(run, f"keep {kept_type}, {schema}")
    return out.select(*[F.col(f"keep.k{i}").alias(k) for i, k in enumerate(keep) if k not in names], *names)
