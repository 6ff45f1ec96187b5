"""Line deduplication and the pipeline against plain versions."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import components, line_dedup
from pulsegrid.llm.common import prepare


def components_of(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(4)
    pairs = {"path": [(k * 7919 % 211, (k + 1) * 7919 % 211) for k in range(200)], "star": [(500, k) for k in range(300)], "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(None, 3), (5, 5)], "empty": []}[shape]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == components_of(pairs)


def expected(texts, size=12, similarity=0.8):
    """Kept (document, line) pairs by comparing all lines that share a shingle."""
    lines = {(i, k): line for i, t in texts for k, line in enumerate((t or "").split("\n")) if t is not None}
    distinct = sorted({x for x in lines.values() if x.strip()})
    sets = [{x[k : k + size] for k in range(max(1, len(x) - size + 1))} for x in distinct]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    pairs = [(k, k) for k in range(len(distinct))]
    for k, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g] if j > k).items():
            if n >= similarity * (len(s) + len(sets[j]) - n):
                pairs.append((k, j))
    label = components_of(pairs)
    place = {x: label.get(k, k) for k, x in enumerate(distinct)}
    first = {}
    for key in sorted(lines):
        if lines[key].strip():
            first.setdefault(place[lines[key]], key)
    return {key: not x.strip() or first[place[x]] == key for key, x in lines.items()}


@pytest.mark.parametrize("block", [line_dedup.BLOCK, 3])
def test_lines(spark, block, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    prepare(spark)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    base = [" ".join(word() for _ in range(60)) for _ in range(12)]
    texts = []
    for i in range(60):
        chosen = []
        for _ in range(3):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = word()
            chosen.append(" ".join(w))
        texts.append((i, "\n".join([*chosen, "", "short", "é" * 40])))
    texts += [(100, None), (101, ""), (102, "x\r"), (103, "y" * 20000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id bigint, text string, gone string")
    got = {(r["id"], r["line_no"]): r["kept"] for r in line_dedup.classes(df).collect()}
    want = expected(texts)
    assert got.keys() == want.keys()
    assert got == want
    kept = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(df).collect()}
    assert kept == {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if got[i, k]) for i, t in texts}
    assert line_dedup.classes(df.limit(0)).count() == 0


def test_pairs_just_similar_enough_are_found(spark):
    prepare(spark)
    rng = random.Random(9)
    for n in (4, 8, 60):  # sets of n shingles in sets of 5/4 n: similarity 0.8
        pairs = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n * 5 // 4 + 11)) for _ in range(500)]
        df = spark.createDataFrame([(i, x[: n + 11] + "\n" + x) for i, x in enumerate(pairs)], "doc_id bigint, text string")
        assert line_dedup.classes(df).where("NOT kept").count() >= 0.985 * len(pairs)


def near_lines(rng, n):
    """Lines in small groups of copies with a few words changed, of all degrees of similarity."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8)))
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.randint(6, 60))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out[:n]


def test_recall_on_ten_thousand_lines(spark):
    prepare(spark)
    texts = [(i, x) for i, x in enumerate(near_lines(random.Random(12), 10_000))]
    want = expected(texts)
    got = {(r["id"], r["line_no"]): r["kept"] for r in line_dedup.classes(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    gone = sum(not x for x in want.values())
    assert gone > 2000
    assert not [k for k in want if want[k] and not got[k]]  # precise: no pair below the similarity joins anything
    assert sum(not got[k] for k in want if not want[k]) >= 0.99 * gone


def test_every_pair_of_a_bucket_is_verified(spark):
    prepare(spark)
    line = "the quick brown fox jumps over the lazy dog and then sleeps all day long in the warm sun"
    df = spark.createDataFrame([(1, line + "\n" + line + "s")], "doc_id bigint, text string")
    assert sum(line_dedup.classes(df, bands=((k, k + 1, k + 2),)).where("NOT kept").count() for k in range(3)) > 0


def test_sketches_never_reject_a_similar_pair(spark):
    prepare(spark)
    rows = [(k, x) for k, x in enumerate(near_lines(random.Random(5), 300))] + [(1000, "z" * 5000), (1001, "z" * 5001), (1002, "q")]
    nodes = spark.createDataFrame(rows, "node bigint, line string")
    pairs = spark.createDataFrame([(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(len(a[1]) - len(b[1])) < 200], "a bigint, b bigint")
    near = {tuple(r) for r in line_dedup.verified(pairs, nodes).collect()}
    sketch = line_dedup.sketches(nodes)
    left = pairs.join(line_dedup._side(sketch, "a"), "a").join(line_dedup._side(sketch, "b"), "b").where(line_dedup._possible(0.8))
    assert len(near) > 100 and near <= {(r["a"], r["b"]) for r in left.collect()}


def test_rows_without_their_own_id_lose_no_line(spark):
    prepare(spark)
    line = "a line that several rows hold word for word, long enough to be shingled"
    alone = "unrelated closing sentence that nothing else repeats"
    rows = [(None, "opening of the first\n" + line), (None, "opening of the second\n" + line), (None, "opening of the third\n" + alone), (7, line + "\nseven"), (7, "seven again\n" + alone + "\n" + line)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [r["text"] for r in line_dedup.deduplicated(df).collect()]
    together = "\n".join(out)
    assert len(out) == 5 and together.count(line) == 1 and together.count(alone) == 1
    assert all(x in together for x in ("opening of the first", "opening of the second", "opening of the third", "seven", "seven again"))


def test_letters_outside_the_basic_plane_count_once(spark):
    prepare(spark)
    base = "".join(chr(0x10400 + k) for k in range(60))
    other = base[:57] + "abc"  # 46 of 52 shingles in common
    far = base[:52] + "abcdefgh"  # 41 of 57
    df = spark.createDataFrame([(1, base), (2, other), (3, far)], "doc_id bigint, text string")
    kept = {r["id"]: r["kept"] for r in line_dedup.classes(df).collect()}
    assert kept == {k: v for (k, _), v in expected([(1, base), (2, other), (3, far)]).items()}


DATA = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_pipeline(docs, benchmark):
    """Rows of the pipeline by plain comparison of everything with everything; docs are (id, text) pairs with distinct ids."""
    import hashlib
    import re

    import numpy as np
    import xxhash
    from tokenizers import Tokenizer

    from pulsegrid.llm import bpe_codec

    docs = [(i, t) for i, t in docs if t is not None and any(c.isalpha() for c in t.lower())]
    keep = expected(docs)
    docs = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if keep[i, k])) for i, t in docs]

    def fingerprint(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), seed=42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))

    prints = [fingerprint(t) for _, t in docs]
    label = components_of((a, b) for a in range(len(docs)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4)
    least = {}
    for k, (i, _) in enumerate(docs):
        root = label.get(k, k)
        least[root] = min(least.get(root, i), i)
    docs = [(i, t) for k, (i, t) in enumerate(docs) if least[label.get(k, k)] == i]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for text in benchmark:
        w = word.findall((text or "").translate(LOW))
        m = min(13, len(w))
        windows |= {tuple(w[k : k + m]) for k in range(len(w) - m + 1 if m else 0)}
    coder = Tokenizer.from_file(bpe_codec.default_path())
    out = []
    for i, t in docs:
        w, hit = word.findall(t.translate(LOW)), set()
        for m in {len(p) for p in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
        if not hit or 20 * len(hit) < len(w):
            ids = coder.encode(t, add_special_tokens=False).ids
            out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
def test_pipeline_equals_plain_comparison(spark):
    import corpus_pipeline

    out = sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert out == plain_pipeline(docs, [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    assert len(out) > 0.6 * len(docs)


def test_pipeline_with_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    story = [" ".join(word() for _ in range(60)) for _ in range(8)]
    rows = [(k, x, "xy"[k % 2]) for k, x in enumerate(story)] + [(20, None, "x"), (21, "", None), (22, "12 34", "y"), (23, story[0], "x"), (24, story[1] + "\nown words of this one " + word(), "y"), (25, "z" * 50_000, None), (26, "Of a Test\n" + " ".join(word() for _ in range(40)), "x")]
    schema = "doc_id bigint, text string, lang string"
    extra = spark.createDataFrame(rows, schema).selectExpr("*", "'s' AS source", "cast(length(text) as bigint) AS n_chars", "1 AS node", "2 AS component", "3 AS n_hit", "cast(null as string) AS keep", "4 AS fp")
    extra.write.parquet(str(tmp_path / "documents.parquet"))
    items = ["of a test", None, ""]
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert out == plain_pipeline([(i, t) for i, t, _ in rows], items)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    twice = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("bigint")))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, twice, str(tmp_path)).count() > 0
