"""Language identification by cross-parsing entropy over suffix automata.

``train`` builds one suffix automaton for each language from labelled text. A text is then parsed against each of them:
from each place the longest match (or one letter that never occurs) is a phrase, and the next phrase starts behind it. The language
that needs the fewest phrases per letter wins; equal counts go to the language that comes first by name.

The transitions of an automaton lie in a dense or a hash table, so that any alphabet will do, and numpy steps through
many stretches of text at once. A long text is cut into stretches of ``STRETCH`` letters whose parses run side by side, each
as if a phrase began there; then the parse that comes out of a stretch is carried into the next one until it begins a
phrase where that one did too. From there on the two agree, so the counts are those of the text parsed in one go.

Texts that are null, empty or without a letter are ``und`` with score 0. With nothing to learn from every text is
``und``. Languages with no letters in their sample are not learned. Repeated rows each get their own row, and count once
in learning; rows with a null or shared id are told apart by their text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import map_texts

#: Most labelled texts of a language that are learned from, each of them whole.
TEXTS = 24
STRETCH = 256
#: Entries of all dense tables of a worker, four bytes each; automata beyond their share of them are hash tables.
DENSE_ENTRIES = 1 << 25
SHARDS = 64
NONE = np.int64(-1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    """Lower-cased code points."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[:] = [chr(c).isalpha() for c in range(len(_LETTER))]
    return _LETTER


def symbols_of(points: np.ndarray) -> np.ndarray:
    """Letters as their code points; each run of other characters is one 0."""
    out = np.where(_letters()[points], points, 0).astype(np.int32)
    if not len(out):
        return out
    keep = out != 0
    keep[1:] |= out[:-1] != 0
    return out[keep]


def automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton."""
    most = 2 * len(symbols) + 2
    link, size = [-1] + [0] * (most - 1), [0] * most
    rows: list[dict[int, int]] = [{}]
    last = 0
    for c in symbols.tolist():
        cur = len(rows)
        rows.append({})
        size[cur] = size[last] + 1
        p = last
        while p != -1 and c not in rows[p]:
            rows[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = rows[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(rows)
                rows.append(dict(rows[q]))
                size[clone] = size[p] + 1
                link[clone] = link[q]
                while p != -1 and rows[p].get(c) == q:
                    rows[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return rows


class Automaton:
    """The transitions of one language, packed; state 0 is the root, to which no text leads back, so there the next letter
    begins a phrase. A letter that the language lacks is a phrase alone and leads to the root.

    ``step`` looks up in a dense table where states times letters are few enough, else in a hash table; both give the same.
    """

    def __init__(self, rows: list[dict[int, int]]):
        sizes = [len(r) for r in rows]
        self.state = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        self.symbol = np.fromiter((c for r in rows for c in r), np.int32, sum(sizes))
        self.to = np.fromiter((t for r in rows for t in r.values()), np.int32, sum(sizes))
        self.states = len(rows)
        self.alphabet = np.unique(self.symbol)

    def ready(self, entries: int) -> None:
        """Builds the tables, in the worker that uses them."""
        self.width = len(self.alphabet) + 1
        self.numbers = np.zeros(0x110000, np.uint32)
        self.numbers[self.alphabet] = np.arange(1, self.width)
        self.dense = None
        restart = np.zeros(self.width, np.int64)  # where a letter leads from the root; 0 for one that the language lacks
        first = self.state == 0
        restart[self.numbers[self.symbol[first]]] = self.to[first]
        self.restart = restart
        if self.states * self.width <= entries:
            table = np.repeat(~restart[None, :].astype(np.int32), self.states, axis=0)  # below zero where a phrase begins
            inner = ~first
            table[self.state[inner], self.numbers[self.symbol[inner]]] = self.to[inner]
            self.dense = table.ravel()
        else:
            self._hash()

    def _hash(self) -> None:
        keys = self.state.astype(np.int64) * self.width + self.numbers[self.symbol]
        keys, to = keys[self.state > 0], self.to[self.state > 0]
        self.shift = np.uint64(64 - int(max(4, np.ceil(np.log2(max(1, len(keys)) * 2.5)))))
        slots = 1 << (64 - int(self.shift))
        self.keys, self.found = np.full(slots, NONE), np.zeros(slots, np.int32)
        at, waiting = self._home(keys), np.arange(len(keys))
        while len(waiting):
            free = waiting[self.keys[at[waiting]] == NONE]
            _, one = np.unique(at[free], return_index=True)
            placed = free[one]
            self.keys[at[placed]], self.found[at[placed]] = keys[placed], to[placed]
            waiting = waiting[self.keys[at[waiting]] != keys[waiting]]
            at[waiting] = (at[waiting] + 1) & (slots - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and whether the letter (by its number) begins a phrase."""
        keys = state * np.int64(self.width) + number
        if self.dense is not None:
            got = self.dense[keys]
            begins = got < 0
            return np.where(begins, ~got, got), begins
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.found[at], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held != NONE))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.found[at[open_[same]]]
            open_ = open_[~same & (held != NONE)]
        begins = out < 0
        return np.where(begins, self.restart[number], out).astype(np.int32), begins


class Model:
    """The automata of all languages."""

    def __init__(self, samples: dict[str, list[str]], entries: int = DENSE_ENTRIES):
        self.langs: list[str] = []
        self.parts: list[Automaton] = []
        self.entries, self.built = entries, False
        for lang in sorted(samples):
            parts = [symbols_of(codes(t)) for t in samples[lang]]
            parts = [p for p in parts if p.any()]
            if parts:
                gap = np.zeros(1, np.int32)
                self.langs.append(lang)
                self.parts.append(Automaton(automaton(np.concatenate([x for p in parts for x in (p, gap)]))))

    def release(self) -> None:
        """Drops the tables, which the next task builds again."""
        for part in self.parts:
            part.dense = part.numbers = part.keys = part.found = None
        self.built = False

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrase counts, rows by languages, of the symbol runs that offsets delimit."""
        n, sizes = len(offsets) - 1, np.diff(offsets)
        pieces = -(-sizes // STRETCH)
        row = np.repeat(np.arange(n), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[row] + number * STRETCH
        length = np.minimum(start + STRETCH, offsets[row + 1]) - start
        order = np.argsort(-length, kind="stable")
        shrinking = np.searchsorted(-length[order], -np.arange(1, STRETCH + 1), "right")  # pieces that are at least so long
        at = start[order]
        out = np.zeros((n, len(self.langs)), np.int64)
        if not self.built:
            for part in self.parts:
                part.ready(self.entries // len(self.parts))
            self.built = True
        for k, part in enumerate(self.parts):
            numbers = part.numbers[symbols]
            begins = np.zeros(len(symbols), bool)
            state = np.zeros(len(row), np.int32)
            for step in range(STRETCH):
                live = shrinking[step]
                if not live:
                    break
                place = at[:live] + step
                state[:live], begins[place] = part.step(state[:live], numbers[place])
            left = np.empty(len(row), np.int32)
            left[order] = state
            _carry(part, numbers, begins, left, start, length, number)
            total = np.concatenate([[0], np.cumsum(begins)])
            out[:, k] = total[offsets[1:]] - total[offsets[:-1]]
        return out

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        data = raw.tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        runs = [symbols_of(codes(t)) for t in texts]
        lettered = np.array([bool(r.any()) for r in runs], bool)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
        counts = self.phrases(np.concatenate(runs) if runs else np.zeros(0, np.int32), ends).astype(np.float64)
        rate = counts / np.maximum(np.diff(ends), 1)[:, None]
        best = np.argmin(rate, axis=1)
        # the winner's share where each language weighs the less the more phrases it needs
        weight = np.exp(-40 * (rate - rate.min(axis=1, keepdims=True)))
        score = np.where(lettered, 1 / weight.sum(axis=1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], score


def _carry(part: Automaton, numbers: np.ndarray, begins: np.ndarray, left: np.ndarray, start: np.ndarray, length: np.ndarray, number: np.ndarray) -> None:
    """Corrects ``begins`` where a phrase runs from one stretch into the next; left are the states behind each stretch."""
    pending = np.flatnonzero(number > 0)
    while len(pending):
        live, state, step = pending, left[pending - 1], 0
        unmet = []
        while len(live):
            place = start[live] + step
            state, fresh = part.step(state, numbers[place])
            met = fresh & begins[place]
            begins[place] = fresh
            ended = ~met & (step + 1 == length[live])
            if ended.any():  # never in step within the stretch: what comes out of it changes
                gone = live[ended]
                changed = left[gone] != state[ended]
                left[gone] = state[ended]
                unmet.append(gone[changed])
            go = ~met & ~ended
            live, state, step = live[go], state[go], step + 1
        after = np.concatenate(unmet) + 1 if unmet else np.zeros(0, np.int64)
        after = after[after < len(number)]
        pending = after[number[after] > 0]


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", texts: int = TEXTS) -> Model:
    """Model from at most ``texts`` labelled texts of each language, the first by a hash of id and text, each of them whole."""
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(F.lit(17), F.col(key), F.col(text)).alias("h"), F.col(text).alias("text"))
    # first the least of each shard, then the least of those, so that no language meets in one task
    shard = Window.partitionBy("lang", F.pmod("h", F.lit(SHARDS))).orderBy("h")
    some = known.select("lang", "h").withColumn("r", F.rank().over(shard)).where(F.col("r") <= texts).select("lang", "h").distinct()
    chosen = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= texts)
    taken = known.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("t"))
    held: dict[str, list[str]] = {}
    for r in taken.orderBy("lang", "h").collect():
        held.setdefault(r["lang"], []).append(r["t"])
    return Model(held)


def predicted(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, lang_pred and score of every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(raw: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        langs, score = sent.value.predict(raw, offsets)
        return [pa.array(langs, pa.string()), pa.array(score, pa.float64())]

    return map_texts(df, text, list(keep), "lang_pred string, score double", run, done=lambda: sent.value.release())
