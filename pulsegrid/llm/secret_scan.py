"""Secret scan: candidates by pattern, false positives removed by a random forest.

``candidates`` finds assigned values, tokens of known shapes and long mixed runs in every whole text. Each candidate is
taken to its end, however long, and described by its length and classes of characters, by how usual its character transitions are, by how much of it a
dictionary covers, by its path, and by the words next to it: the last four before and the first two after, of those within
``NEAR`` characters on either side. ``Forest`` is a random forest in numpy that learns from
labelled findings; ``labelled_findings`` makes such findings by rule where a user has none.

Of candidates that overlap the kind that comes first in the list is taken, then the one that starts first. Null and empty texts have no findings; a null path is an empty one; findings of one text do not overlap; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import text_slices

#: Characters before and after a candidate in which its neighbouring words are looked for; what lies further off is no neighbour.
NEAR = 48
THRESHOLD = 0.5
#: Most words that the corpus adds to the dictionary, a bound on the model that goes to every task.
CORPUS_WORDS = 20_000
SHARDS = 16

# Words that name a secret, words that name something else, and words of the dictionary.
SECRET_WORDS = frozenset("token secret password passwd pwd passphrase key apikey api_key access_key secret_key private_key auth authorization bearer credential credentials client_secret aws github slack stripe login".split())
OTHER_WORDS = frozenset("commit sha sha1 sha256 md5 hash checksum digest uuid guid id revision version build ref tree blob etag integrity phone tel call card order invoice isbn doi url path file example sample placeholder dummy test fake your changeme".split())
DICTIONARY = (
    "able access account action admin after alpha apple application array auth back base beta black blue body book build button call change char check city class click client close code color comment common config connect content count create current data date debug default delete demo digit document domain dummy "
    "edit email enable error event example false fetch file filter first float folder form format function game general get global group hand handle hash header hello help home host house http image import index info input insert integer internal issue item join just language last letter level light line link list load local "
    "login long main manager master member message method mode model module month name network never node none null number object open option order output page param parent parse party pass password path person place placeholder point post print private process project public query quick random read record release remove replace report request "
    "reset response result return route sample save schema screen script search secret section select send server service session shell should simple single size sort source space start state static status storage store stream string style system table target task test text thing this time title token total trade tree true type under "
    "unit update upload user value version view water web week white window word work world write year your zone"
).split()
SHAPES = (
    ("private_key", re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s\\]*(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?")),
    ("aws_key", re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")),
    ("github_token", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}\b")),
    ("slack_token", re.compile(r"\bxox[baprs]-[A-Za-z0-9-]{10,}")),
    ("stripe_key", re.compile(r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}")),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}")),
)
STARTS = re.compile(r"-----BEGIN |A[KS]IA[0-9A-Z]|gh[pousr]_|xox[baprs]-|[sr]k_(?:live|test)_|eyJ[A-Za-z0-9_-]{8}")
#: Where an assigned value begins; the value itself is taken only after a name, so that no other value hides a named one.
ASSIGN = re.compile(r"[:=](?=>?\s{0,3}[\"'`]?([^\s\"'`<>,;(){}\[\]]{8}))")
VALUE = re.compile(r"[^\s\"'`<>,;(){}\[\]]{8,}")
NAMED = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth\w*|bearer|credentials?)[\"'`\]]{0,2}\s{0,3}$", re.I)
RUN = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
WORD = re.compile(r"[A-Za-z][A-Za-z0-9_]*")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each candidate, in order, without overlaps."""
    found: list[tuple[int, int, str]] = []
    slack = 0  # end of the run of the last slack token: tokens that begin inside it end with it
    for m in STARTS.finditer(text):
        if m.start() < slack and m[0].startswith("xox"):
            if slack - m.end() >= 10:
                found.append((m.start(), slack, "slack_token"))
            continue
        for kind, shape in SHAPES:
            if got := shape.match(text, m.start()):
                found.append((got.start(), got.end(), kind))
                slack = got.end() if kind == "slack_token" else slack
                break
    end = 0
    for m in ASSIGN.finditer(text):
        if m.start() >= end and NAMED.search(text, max(0, m.start() - 24), m.start()):
            end = VALUE.match(text, m.start(1)).end()
            found.append((m.start(1), end, "assigned"))
    for m in RUN.finditer(text):
        run = m[0]
        if any(c in DIGITS for c in run) and not run.isdigit() and any(c in LETTERS for c in run):
            found.append((m.start(), m.end(), "run"))
    rank = {kind: k for k, kind in enumerate([k for k, _ in SHAPES] + ["assigned", "run"])}
    return sorted(_apart(sorted(found, key=lambda f: (rank[f[2]], f[0]))))


def _apart(items: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The items that overlap none before them."""
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for item in items:
        k = bisect.bisect_right(starts, item[0])
        if (k and ends[k - 1] > item[0]) or (k < len(starts) and starts[k] < item[1]):
            continue
        starts.insert(k, item[0])
        ends.insert(k, item[1])
        kept.append(item)
    return kept


DIGITS = frozenset(string.digits)
LETTERS = frozenset(string.ascii_letters)
CLASSES = {**dict.fromkeys(string.ascii_lowercase, 0), **dict.fromkeys(string.ascii_uppercase, 1), **dict.fromkeys(string.digits, 2)}


class Lexicon:
    """Words that values are covered with, and how usual a letter is after another in them."""

    def __init__(self, words: Iterable[str] = DICTIONARY):
        self.list = sorted({w for w in words if len(w) >= 4})
        self.words = frozenset(self.list)
        self.sizes = sorted({len(w) for w in self.list}, reverse=True)
        counts = np.ones((26, 26))
        for word in self.list:
            for a, b in zip(word, word[1:], strict=False):
                if "a" <= a <= "z" and "a" <= b <= "z":
                    counts[ord(a) - 97, ord(b) - 97] += 1
        self.transitions = np.log(counts / counts.sum(axis=1, keepdims=True))


BASIC = Lexicon()


def corpus_lexicon(df: DataFrame, text: str = "text", words: int = CORPUS_WORDS, least: int = 5) -> Lexicon:
    """The dictionary and the commonest words of the whole corpus, at most ``words`` of 4 to 12 letters that occur ``least`` times; ties by name."""
    each = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\b([a-z]{4,12})\b"), F.lit(1))).alias("w"))
    counts = each.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # the first of each shard, so that the driver meets a bounded number of them whatever the number of partitions
    shard = Window.partitionBy(F.pmod(F.xxhash64("w"), F.lit(SHARDS))).orderBy(F.desc("n"), "w")
    some = counts.withColumn("r", F.row_number().over(shard)).where(F.col("r") <= words).coalesce(SHARDS)
    return Lexicon([*DICTIONARY, *(r["w"] for r in some.orderBy(F.desc("n"), "w").limit(words).collect())])


FEATURES = (
    "length", "lower", "upper", "digit", "other", "distinct", "entropy", "class_changes", "transition", "letter_pairs", "longest_run", "covered", "hex", "period",
    "secret_words", "other_words", "named", "quoted", "assigned", "shape", "path_test", "path_code", "path_depth",
)


def covered(value: str, lexicon: Lexicon = BASIC) -> float:
    """Share of the characters that dictionary words of four letters and more cover, longest first."""
    low, at, hit = value.lower(), 0, 0
    while at < len(low):
        for size in lexicon.sizes:
            if low[at : at + size] in lexicon.words and at + size <= len(low):
                hit += size
                at += size
                break
        else:
            at += 1
    return hit / max(1, len(low))


def _period(value: str) -> int:
    """Smallest shift at which a value repeats itself to its end; its length if there is none."""
    border = [0] * len(value)
    for i in range(1, len(value)):
        k = border[i - 1]
        while k and value[i] != value[k]:
            k = border[k - 1]
        border[i] = k + (value[i] == value[k])
    return len(value) - border[-1] if value else 0


def features(text: str, start: int, end: int, kind: str, path: str = "", lexicon: Lexicon = BASIC) -> list[float]:
    value = text[start:end]
    n = len(value)
    kinds = [CLASSES.get(c, 3) for c in value]
    counts = np.bincount(kinds, minlength=4)
    freq = np.array([value.count(c) for c in set(value)], float) / n
    low = value.lower()
    pairs = [lexicon.transitions[ord(a) - 97, ord(b) - 97] for a, b in zip(low, low[1:], strict=False) if "a" <= a <= "z" and "a" <= b <= "z"]
    longest, run = 1, 1
    for a, b in zip(value, value[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    words = [w.lower() for w in WORD.findall(before)[-4:]]
    parts = {p for w in words for p in (w, *w.split("_"))}
    later = {w.lower() for w in WORD.findall(after)[:2]}
    tail = before.rstrip("\"'` ")
    where = path.lower()
    period = _period(value)
    return [
        n, *(counts / n), len(freq) / n, float(-(freq * np.log2(freq)).sum()), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, float(np.mean(pairs)) if pairs else -4.0, len(pairs) / n, longest / n, covered(value, lexicon),
        float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None), float(2 * period <= n), len(parts & SECRET_WORDS), len((parts | later) & OTHER_WORDS) + len(set(WORD.findall(low)) & OTHER_WORDS), float(NAMED.search(before.rstrip("\"'`:=> ") or "") is not None),
        float(before[-1:] in "\"'`" and before != ""), float(tail[-1:] in ":=" and tail != ""), float(kind not in ("assigned", "run")), float(any(x in where for x in ("test", "example", "sample", "doc", "fixture", "mock"))), float(where.endswith((".py", ".js", ".env", ".yml", ".yaml", ".json", ".cfg", ".ini", ".sh", ".java", ".go", ".toml"))), float(where.count("/")),
    ]


# --------------------------------------------------------------------------- forest


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (live := self.feature[at] >= 0).any():
            rows = np.flatnonzero(live)
            node = at[rows]
            at[rows] = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.below[node], self.above[node])
        return self.value[at]


def _split(x: np.ndarray, y: np.ndarray, tried: np.ndarray, leaf: int) -> tuple[float, int, float]:
    """Least Gini impurity over the tried features: (impurity, feature, threshold)."""
    best = (math.inf, -1, 0.0)
    n = len(y)
    for f in tried:
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= leaf) & (n - cut >= leaf)]
        if not len(cut):
            continue
        left = t[cut - 1]
        right = t[-1] - left
        impurity = (left - left**2 / cut + right - right**2 / (n - cut)) / n
        k = int(np.argmin(impurity))
        if impurity[k] < best[0]:
            best = (float(impurity[k]), int(f), float((v[cut[k]] + v[cut[k] - 1]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, random: np.random.Generator, depth: int = 12, leaf: int = 2) -> Tree:
    """One tree; a square root of the features is tried at each node."""
    nodes: list[list[float]] = []
    waiting = [(np.arange(len(y)), 0, -1, 0)]
    tries = max(1, round(x.shape[1] ** 0.5))
    while waiting:
        rows, level, parent, side = waiting.pop()
        own = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
        if parent >= 0:
            nodes[parent][2 + side] = own
        if level >= depth or len(rows) < 2 * leaf or y[rows].min() == y[rows].max():
            continue
        _, f, t = _split(x[rows], y[rows], random.choice(x.shape[1], tries, replace=False), leaf)
        if f < 0:
            continue
        nodes[own][0], nodes[own][1] = f, t
        go = x[rows, f] <= t
        waiting += [(rows[go], level + 1, own, 0), (rows[~go], level + 1, own, 1)]
    a = np.array(nodes)
    return Tree(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4])


@dataclass
class Forest:
    trees: list[Tree]
    lexicon: Lexicon = field(default_factory=lambda: BASIC)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 60, seed: int = 3) -> Forest:
        random = np.random.default_rng(seed)
        out = []
        for _ in range(trees):
            rows = random.integers(0, len(y), len(y))
            out.append(grow(x[rows], y[rows].astype(np.float64), random))
        return cls(out)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)


# --------------------------------------------------------------------------- labelled findings


@dataclass(frozen=True)
class Finding:
    text: str
    start: int
    end: int
    kind: str
    path: str
    secret: bool


def _some(random: np.random.Generator, alphabet: str, n: int) -> str:
    return "".join(alphabet[i] for i in random.integers(0, len(alphabet), n))


# Origins of the made findings, of secrets more often the first, of others more often the last.
SECRET_PATHS = ("src/config.py", "app/.env", "deploy/values.yaml", "lib/main.go", "ops/terraform.tfvars", "a/b/c/settings.json")
OTHER_PATHS = ("docs/readme.md", "tests/test_api.py", "examples/sample.env", "test/fixtures/mock.json", "CHANGELOG.md", "package-lock.json")


def labelled_findings(n: int = 2400, seed: int = 1, words: list[str] = DICTIONARY) -> list[Finding]:
    """Findings made by rule, half of them secrets, in prose and in code. A third have no origin; of the others a secret
    comes from configuration and code in three cases of four, anything else from tests and papers."""
    random = np.random.default_rng(seed)
    hexa, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    pick = lambda *x: x[int(random.integers(len(x)))]
    word = lambda: words[int(random.integers(len(words)))] if random.random() < 0.5 else _some(random, "etaoinshrdlu", int(random.integers(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    out: list[Finding] = []
    while len(out) < n:
        secret = len(out) % 2 == 0
        name = pick("token", "secret", "password", "api_key", "API_KEY", "access_token", "client_secret", "auth_token", "AWS_SECRET_ACCESS_KEY", "apikey", "passwd", "private_key")
        equals, quote = pick(" = ", "=", ": ", ":", " := "), pick('"', "'", "")
        path = "" if random.random() < 1 / 3 else pick(*(SECRET_PATHS if secret == (random.random() < 0.75) else OTHER_PATHS))
        if secret:
            how = int(random.integers(8))
            value = (
                _some(random, hexa, pick(32, 40, 64)), _some(random, alnum, int(random.integers(20, 48))), base64.b64encode(random.bytes(int(random.integers(18, 48)))).decode(), "AKIA" + _some(random, string.ascii_uppercase + string.digits, 16),
                "ghp_" + _some(random, alnum, 36), "sk_live_" + _some(random, alnum, 24), "eyJ" + _some(random, alnum, 30) + "." + _some(random, alnum, 60) + "." + _some(random, alnum, 43), _some(random, alnum + "!@#$%^&*", int(random.integers(10, 24))),
            )[how]
            lead = f"{name}{equals}{quote}" if how not in (3, 4, 5, 6) or random.random() < 0.7 else pick("", "uses ", "Authorization: Bearer ")
        else:
            how = int(random.integers(12))
            value = (
                _some(random, hexa, pick(40, 64)), "-".join(_some(random, hexa, k) for k in (8, 4, 4, 4, 12)), _some(random, hexa, 32), pick("xxxxxxxxxxxxxxxx", "changeme123", "your_api_key_here", "YOUR-TOKEN-HERE-1234", "example_secret_key_123", "placeholder0000000", "************", "<password>", "000000000000000000000000000000a1"),
                "/".join(word() for _ in range(6)) + "/v2", "-".join(word() for _ in range(5)) + "-2024", "".join(word().title() for _ in range(5)) + "2", _some(random, string.digits, int(random.integers(12, 19))), "os.environ_get_" + "_".join(word() for _ in range(2)) + "1",
                "sha256-" + base64.b64encode(random.bytes(32)).decode(), "_".join(word() for _ in range(4)) + "_id0", "_".join(word() for _ in range(2)) + "_token_v1",
            )[how]
            lead = (
                pick("commit ", "sha1 ", "tree ", "revision ", "at commit "), pick("uuid ", "id=", "request id: ", "guid: "), pick("md5 ", "checksum: ", "etag "), f"{name}{equals}{quote}", pick("see ", "path ", "file: "), pick("url ", "see ", "posted as "), pick("class ", "calls ", ""), pick("phone ", "order ", "card ", f"{name}{equals}"),
                f"{name}{equals}", pick('integrity="', "digest "), pick("column ", "field ", ""), pick(f"{name}{equals}{quote}", "from "),
            )[how]
        before = prose(int(random.integers(0, 12))) + pick(" ", "\n", ". ")
        text = before + lead + value + (quote if lead.endswith(quote) and quote else "") + pick(" ", "\n", ". ") + prose(int(random.integers(0, 8)))
        got = [c for c in candidates(text) if c[0] < len(before + lead + value) and c[1] > len(before + lead)]
        if got:
            start, end, kind = got[0]
            out.append(Finding(text, start, end, kind, path, secret))
        elif secret or random.random() < 0.5:
            start = len(before + lead)
            out.append(Finding(text, start, start + len(value), "assigned" if lead.endswith(("=", '"', "'", ": ", ":", "= ")) else "run", path, secret))
    return out


def train(findings: list[Finding] | None = None, lexicon: Lexicon = BASIC, **how) -> Forest:
    """A forest from labelled findings; without any, from made ones that use the words of the lexicon."""
    found = labelled_findings(words=lexicon.list) if findings is None else findings
    x = np.array([features(f.text, f.start, f.end, f.kind, f.path, lexicon) for f in found])
    forest = Forest.fit(x, np.array([f.secret for f in found]), **how)
    forest.lexicon = lexicon
    return forest


SCANNED = "start bigint, length bigint, kind string, score double, is_secret boolean, value_sha256 string"


def scan(df: DataFrame, forest: Forest, text: str = "text", path: str | None = None, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each candidate: key, place (in code points), kind, score, verdict, and a hash in place of the value."""
    sent = df.sparkSession.sparkContext.broadcast(forest)
    own = df.select(F.col(key).alias("id"), F.col(text).alias("text"), (F.col(path).cast("string") if path else F.lit("")).alias("path"))
    kind = own.schema["id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_slices(batch, "text"):
                rows, described = [], []
                for i, t, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    for start, end, what in candidates(t or ""):
                        rows.append((i, start, end - start, what, hashlib.sha256(t[start:end].encode("utf-8", "surrogatepass")).hexdigest()))
                        described.append(features(t, start, end, what, p or "", sent.value.lexicon))
                score = sent.value.score(np.array(described).reshape(len(rows), len(FEATURES)))
                c = list(zip(*rows, strict=True)) if rows else [[] for _ in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c[0]), id_type), pa.array(list(c[1]), pa.int64()), pa.array(list(c[2]), pa.int64()), pa.array(list(c[3]), pa.string()), pa.array(score, pa.float64()), pa.array(score >= threshold, pa.bool_()), pa.array(list(c[4]), pa.string())], ["id", "start", "length", "kind", "score", "is_secret", "value_sha256"])

    return own.mapInArrow(run, f"id {kind}, {SCANNED}").withColumnRenamed("id", key)
