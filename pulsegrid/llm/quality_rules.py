"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark expressions.

``text_statistics`` counts words, symbols and repetitions of every whole text. ``learn`` grows one conjunction of
thresholds after another over labelled statistics: it adds the condition of the greatest information gain on two thirds
of the rows, prunes conditions from the end while that helps on the other third, keeps the rule if it is precise enough,
and goes on with the rows that no rule covers. Texts that fail the base rules are not learned from. ``DecisionList.verdict`` is a CASE expression in that order.

Null and empty texts have zero counts (and fail the base rules for want of words); a null id or label is not learned
from; repeated rows each get their row but count once in learning; of equally good conditions the first by feature and
threshold wins; with no labelled rows the list is empty and every text that passes the base rules is kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import SPACE, byte_set, cut, hash_sample, map_texts, mixed, repeated, row_sums, rows_of, runs, span_hashes, window_hashes

WINDOW = 8
SYMBOLS = byte_set(b"#*$%&|<>")
UPPER = byte_set(bytes(range(65, 91)))
DIGIT = byte_set(bytes(range(48, 58)))
PUNCT = byte_set(b".,;:!?")
STATISTICS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_distinct bigint, n_upper bigint, n_digits bigint, n_punct bigint"

#: Most labelled rows that are learned from.
LABELLED_ROWS = 20_000

#: Name to SQL over the statistics; denominators are at least one.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "distinct_power": "ln(n_distinct + 1) / ln(greatest(n_words, 1) + 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "punct_rate": "n_punct / greatest(n_words, 1)",
    "line_length": "n_words / greatest(n_lines, 1)",
}


def statistics_of(raw: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    n = len(offsets) - 1
    member = ~SPACE[raw]
    starts, ends = runs(member, offsets)
    row = rows_of(starts, offsets)
    words = span_hashes(raw, starts, ends)
    row_key = mixed(row.astype(np.uint64) + np.uint64(1))
    n_words = np.bincount(row, minlength=n)
    word_chars = row_sums(member & ((raw & 0xC0) != 0x80), offsets)

    line_starts, line_ends = runs(raw != 10, offsets)
    seen = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(member, out=seen[1:])
    worded = seen[line_ends] > seen[line_starts]
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_row = rows_of(line_starts, offsets)
    order, same = repeated(span_hashes(raw, line_starts, line_ends) + mixed(line_row.astype(np.uint64) + np.uint64(1)))
    n_dup_lines = np.bincount(line_row[order[same]], minlength=n)

    windows = window_hashes(words, WINDOW)
    places = np.flatnonzero(row[: len(windows)] == row[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    order, same = repeated(windows[places] + row_key[places])
    twice = same.copy()
    twice[:-1] |= same[1:]
    covered = np.zeros(len(words) + 1, np.int64)
    found = places[order[twice]]
    np.add.at(covered, found, 1)
    np.add.at(covered, found + WINDOW, -1)
    n_repeat = np.bincount(row[np.cumsum(covered[:-1]) > 0], minlength=n)

    order, same = repeated(words + row_key)
    n_distinct = n_words - np.bincount(row[order[same]], minlength=n)
    counts = (n_words, word_chars, row_sums(SYMBOLS[raw], offsets), n_dup_lines, n_repeat, np.bincount(line_row, minlength=n), n_distinct, row_sums(UPPER[raw], offsets), row_sums(DIGIT[raw], offsets), row_sums(PUNCT[raw], offsets))
    return [pa.array(x, pa.int64()) for x in counts]


def text_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return map_texts(df, text, list(keep), STATISTICS, statistics_of)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<='} {self.threshold!r}D"


@dataclass
class DecisionList:
    """Rules in order; a text that one of them covers is rejected, any other is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        found = np.zeros(len(next(iter(x.values()))), bool)
        for rule in self.rules:
            found |= np.logical_and.reduce([c.holds(x) for c in rule])
        return found

    def verdict(self) -> Column:
        """True where a text is kept."""
        if not self.rules:
            return F.lit(True)
        cases = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN false" for rule in self.rules)
        return F.expr(f"CASE {cases} ELSE true END")


def _thresholds(values: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Midpoints at quantiles of all values and of those of the bad class."""
    grid = np.linspace(0, 1, 65)
    points = np.unique(np.concatenate([np.quantile(values, grid), np.quantile(values[bad], grid)]))
    return np.concatenate([points, (points[1:] + points[:-1]) / 2])


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray, most: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = live.copy()
    while len(rule) < most:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not p or not n:
            break
        base, best, chosen = np.log2(p / (p + n)), 1e-9, None
        for name, values in x.items():
            held = values[inside]
            marked = bad[inside]
            for t in _thresholds(held, marked):
                for above in (True, False):
                    got = held >= t if above else held <= t
                    q, m = (got & marked).sum(), (got & ~marked).sum()
                    if q and (gain := q * (np.log2(q / (q + m)) - base)) > best:
                        best, chosen = gain, Condition(name, above, float(t))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= chosen.holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, least: int = 5, seed: int = 7) -> DecisionList:
    """Sequential covering of the bad rows."""
    out = DecisionList()
    live = np.ones(len(bad), bool)
    random = np.random.default_rng(seed)
    while len(out.rules) < most_rules and (live & bad).sum() >= least:
        growing = random.random(len(bad)) < 2 / 3
        rule = _grow(x, bad, live & growing, most_conditions)
        pruning = live & ~growing

        def worth(part: list[Condition], pruning=pruning) -> float:
            got = np.logical_and.reduce([c.holds(x) for c in part]) & pruning
            p, n = (got & bad).sum(), (got & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule:
            break
        got = np.logical_and.reduce([c.holds(x) for c in rule]) & live
        if (got & bad).sum() < least or (got & bad).sum() < precision * got.sum():
            break
        out.rules.append(rule)
        live &= ~got
    return out


def judged(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, text: str = "text", key: str = "doc_id", label: str = "quality") -> tuple[DataFrame, DecisionList]:
    """Statistics of every document with base_failed and kept, and the list that was learned from at most ``rows`` labels.

    The sample is the first labels by a hash of the id; of labels that disagree on an id the smallest counts, of documents
    that share an id the one of the smallest statistics. The rows are sorted before they are learned from, so the list is
    the same at any partitioning.
    """
    stats = cut(text_statistics(documents, text, (key,)))
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    known = hash_sample(own, F.col("_key"), rows)
    names = list(FEATURES)
    base = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    counts = [part.strip().split(" ")[0] for part in STATISTICS.split(",")]
    taught = stats.where(~base).join(known, stats[key] == known["_key"]).groupBy("_key").agg(F.min(F.struct(*counts)).alias("s"), F.min("_label").alias("_label"))
    found = _learned(taught.select("_key", "_label", "s.*").select("_key", *[F.expr(FEATURES[f]).alias(f) for f in names], "_label").toPandas())
    return stats.withColumn("base_failed", base).withColumn("kept", F.when(base, F.lit(False)).otherwise(found.verdict())), found


def _learned(taught) -> DecisionList:
    """The list of labelled features, in the order of their keys."""
    if not len(taught):
        return DecisionList()
    taught = taught.sort_values("_key", kind="stable")
    return learn({f: taught[f].to_numpy(np.float64) for f in FEATURES}, taught["_label"].to_numpy() == 0)
