"""Ranked search against a plain version: every document scored for every item."""

import math
import random
import re
from collections import Counter

import pytest

from pulsegrid.llm import lexical_search
from pulsegrid.llm.common import prepare

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c in own:
            m = 10 + 90 * sum(c.values()) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(seed):
    random_ = random.Random(seed)
    known = [f"w{k}" for k in range(60)] + ["Über", "naïve", "X9", "日本"]
    docs = [(i, " ".join(random_.choices(known, [1 / (j + 1) for j in range(len(known))], k=random_.choice([1, 5, 30, 200])))) for i in range(80)]
    docs += [(i + 100, docs[3][1]) for i in range(15)] + [docs[5], docs[5], (None, docs[5][1]), (200, None), (201, ""), (202, "-- ,"), (203, "w1 " * 5000)]
    items = [(i, " ".join(random_.choices(known, k=random_.choice([1, 3, 12])))) for i in range(12)] + [(0, "w2 w3"), (50, None), (51, "unknown"), (None, "w1 W1 über"), (52, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("segment_bytes, block, k, parts", [(1 << 21, 100_000, 10, 3), (300, 4, 10, 2), (300, 4, 1, 1), (1, 1, 200, 2)])
def test_against_plain(spark, tmp_path, segment_bytes, block, k, parts):
    prepare(spark)
    rows, asked = corpus(k)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, score string, term int").repartition(parts)
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    n, total = lexical_search.build(docs, f"{tmp_path}/index", segment_bytes=segment_bytes)
    found = lexical_search.search(spark.read.parquet(f"{tmp_path}/index"), n, total, items, k, terms=block)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain(rows, asked, k), key=key)


def test_nothing_to_search(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert lexical_search.ranked(docs, items).count() == 0
    assert lexical_search.ranked(docs.limit(0), items).count() == 0
    assert lexical_search.ranked(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_few_documents_are_rescored(spark, tmp_path):
    """Bounds are tight enough that most documents that hold a term are never scored exactly, and never too tight."""
    import numpy as np

    random_ = np.random.default_rng(4)
    tf, m = random_.integers(1, 40, 5000), random_.integers(10, 900, 5000)
    exact = lexical_search._impacts(tf, m)
    level = -(-exact // lexical_search.STEP)
    assert level.max() <= 255 and (level * lexical_search.STEP >= exact).all() and ((level - 1) * lexical_search.STEP < exact).all()


def test_row_groups_hold_few_segments(spark, tmp_path):
    import pyarrow.parquet as pq

    prepare(spark)
    docs = spark.createDataFrame([(i, f"word{i} again") for i in range(50)], "doc_id bigint, text string").coalesce(1)
    lexical_search.build(docs, str(tmp_path / "index"), segment_bytes=10)
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "index").glob("*.parquet")]
    rows = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(rows) == 50 and max(rows) <= lexical_search.GROUP_ROWS
