"""Byte-pair encoding and decoding by tree concatenation.

White space always parts two words of this tokenizer, so a text is cut there and the ids of each distinct chunk are
kept in a bounded memo. A chunk that stays unsplit over more than ``leaf`` characters is cut in half again and again;
all leaves are encoded together, and the halves are concatenated bottom-up: a window around each join is encoded anew
and grows until it gives the same tokens as the left half at its start and as the right half at its end.

Nulls are empty texts; empty texts have no tokens and decode to the empty string; repeated rows and ties each give
their own row; other columns of the input are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import settle, text_slices

LEAF = 32
#: Distinct chunks whose ids a Python worker keeps; they go when a task ends, as workers live on for other operators.
MEMO = 100_000
#: Chunks that the library encodes at once.
ENCODED = 2048
#: Tokens that both sides must share with the window.
AGREE = 2
#: Texts without these characters are lower-cased and cut by str methods, which then do the same as the tokenizer's normaliser.
UNPLAIN = re.compile("[^\t\n\r -~¡-¬®-įı-ňŊ-ž–—‘-”]")


class Codec:
    """Encoder and decoder over a tokenizer file of the tokenizers library."""

    def __init__(self, path: str, leaf: int = LEAF):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory of their own
        from tokenizers import Tokenizer, normalizers

        full = Tokenizer.from_file(path)
        self.normalizer = full.normalizer
        self.bare = Tokenizer.from_file(path)
        self.bare.no_truncation()
        self.bare.no_padding()
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.encode_special_tokens = True
        added = {t.content: i for i, t in full.get_added_tokens_decoder().items()}
        self.added = added
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.leaf = max(2, leaf)
        self.memo: dict[str, tuple[int, ...]] = {}
        size = full.get_vocab_size(with_added_tokens=True)
        self.tokens = [full.id_to_token(i) or "" for i in range(size)]
        self.full = full if full.decoder is not None else None  # else its second copy of the vocabulary goes

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut at white space."""
        if UNPLAIN.search(text) is None:
            return text.lower().split()
        return (self.normalizer.normalize_str(text) if self.normalizer else text).split(" ")

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, as the library gives them without added special tokens."""
        plans = []
        for text in texts:
            if self.specials and "<|" in text:
                plan = []
                for part in self.specials.split(text):
                    plan.extend([part] if part in self.added else self.chunks(part))
                plans.append(plan)
            else:
                plans.append(self.chunks(text))
        rows, waiting = [], []
        find = self.memo.__getitem__
        for plan in plans:
            try:
                rows.append(list(chain.from_iterable(map(find, plan))))
            except KeyError:
                waiting.append(len(rows))
                rows.append(plan)
        if waiting:
            self.learn([rows[k] for k in waiting])
            for k in waiting:
                rows[k] = list(chain.from_iterable(map(find, rows[k])))
        return rows

    def learn(self, plans: list[list[str]]) -> None:
        """Puts the ids of all chunks of plans into the memo, which is emptied first if it is full."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        fresh = [c for c in set(chain.from_iterable(plans)) if c not in memo]
        marks = {s: (i,) for s, i in self.added.items()}
        memo.update((c, marks[c]) for c in fresh if c in marks)
        short = [c for c in fresh if len(c) <= self.leaf and c not in marks]
        for a in range(0, len(short), ENCODED):  # few at a time, as each encoding holds a kilobyte
            part = short[a : a + ENCODED]
            memo.update(zip(part, (tuple(got.ids) for got in self.bare.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        long = [c for c in fresh if len(c) > self.leaf and c not in marks]
        memo.update(zip(long, map(tuple, self.by_tree(long)), strict=True))

    # ------------------------------------------------------------------ tree concatenation

    def by_tree(self, chunks: list[str]) -> list[list[int]]:
        """Ids of long unsplit chunks: leaves together, then one level of joins after another, each level together."""
        levels = []
        for number, chunk in enumerate(chunks):
            n, width = len(chunk), len(chunk)
            while width > self.leaf:
                width = (width + 1) // 2
            levels.append((number, [(a, min(a + width, n)) for a in range(0, n, width)]))
        leaves = [chunks[number][a:b] for number, spans in levels for a, b in spans]
        encoded = iter(self.bare.encode_batch(leaves, add_special_tokens=False)) if leaves else iter(())
        pieces = []
        for _, spans in levels:
            row = []
            for a, b in spans:
                got = next(encoded)
                row.append((a, b, list(got.ids), [a + s for s, _ in got.offsets], [a + e for _, e in got.offsets]))
            pieces.append(row)
        while any(len(row) > 1 for row in pieces):
            pieces = [[self.joined(chunks[k], *row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)] for k, row in enumerate(pieces)]
        return [row[0][2] if row else [] for row in pieces]

    def joined(self, text: str, left: tuple, right: tuple) -> tuple:
        """One piece of two neighbours. The window starts and ends at token edges of the halves and doubles until it agrees with both."""
        a, _, ids_l, starts_l, ends_l = left
        _, b, ids_r, starts_r, ends_r = right
        reach = 4
        while True:
            i, j = max(0, len(ids_l) - reach), min(len(ids_r), reach)
            from_, to = (a if i == 0 else starts_l[i]), (b if j == len(ids_r) else ends_r[j - 1])
            whole_l, whole_r = i == 0, j == len(ids_r)
            got = self.bare.encode(text[from_:to], add_special_tokens=False)
            ids = list(got.ids)
            starts, ends = [from_ + s for s, _ in got.offsets], [from_ + e for _, e in got.offsets]
            head = whole_l or ids[:AGREE] == ids_l[i : i + AGREE] and ends[:AGREE] == ends_l[i : i + AGREE] and len(ids_l) - i > AGREE
            cut = None
            if head and whole_r:
                cut = (len(ids), len(ids_r))
            elif head:
                edges = {(s, e, t): k for k, (s, e, t) in enumerate(zip(starts_r, ends_r, ids_r, strict=True)) if k < j}
                for k in range(0 if whole_l else AGREE, len(ids) - AGREE - 1):  # the window's last token bears a false word end
                    where = [edges.get((starts[k + n], ends[k + n], ids[k + n])) for n in range(AGREE)]
                    if where[0] is not None and where == list(range(where[0], where[0] + AGREE)):
                        cut = (k, where[0])
                        break
            if cut is not None:
                k, r = cut
                return a, b, ids_l[:i] + ids[:k] + ids_r[r:], starts_l[:i] + starts[:k] + starts_r[r:], ends_l[:i] + ends[:k] + ends_r[r:]
            reach *= 2

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; the file names no decoder, so tokens are joined by spaces."""
        if self.full is not None:
            return self.full.decode(ids, skip_special_tokens=False)
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """Returns keep, ids (array<int>) and decoded (string) of every row of df."""
    kind = df.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path, leaf)
        for batch in batches:
            for part in slices(batch):
                ids = own.encode_many([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    return df.select(F.col(keep).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", keep)


def digests(df: DataFrame, path: str, text: str = "text", keep: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """Returns keep, n_tokens and the SHA-256 of the ids and of the decoded text; ids stay in the worker."""
    kind = df.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path, leaf)
        try:
            for batch in batches:
                for part in slices(batch):
                    rows = own.encode_many([x or "" for x in part.column(1).to_pylist()])
                    of_ids = [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in rows]
                    of_text = [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in rows]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            own.memo.clear()
            del own
            settle()

    return df.select(F.col(keep).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", keep)


def slices(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    for part, _, _ in text_slices(batch, "text", limit):
        yield part


def default_path() -> str:
    """The word-level vocabulary file of the public tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


if sys.byteorder != "little":
    raise ImportError("ids are hashed as little-endian words")
