"""Token files against plain arrays and the tokenizers library."""

import uuid
import zlib

import numpy as np
import pytest

from pulsegrid.llm import token_store
from pulsegrid.llm.common import prepare

ODD = ["", " ", "  a  b ", "a <|endoftext|> b<|endoftext|>", "x y z  w", "don't  we're\n\n a\tb ", "é ü\r\n ß" * 50, "a" * 5000, " \n " * 40, "\x1c a\x1cb c", "foo!!(x) bar,, baz's' a`b", "word," * 3 + " q! ", "long " * 20_000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_store.default_path())


@pytest.mark.parametrize("n, kinds", [(0, 1), (1, 1), (5, 1), (1000, 3), (5000, 300), (60_000, 40_000)])
def test_wavelet_matrix(n, kinds):
    random_ = np.random.default_rng(n)
    tokens = (random_.zipf(1.3, n) % kinds).astype(np.uint32)
    shard = token_store.Shard(token_store.packed(tokens, np.array([n]), np.array([7]), np.array([True])))
    assert (shard.tokens() == tokens).all() and shard.n == n
    for i in random_.integers(0, n, 40) if n else []:
        assert shard.access(int(i)) == tokens[i]
    for token in {int(t) for t in tokens[:30]}:
        places = np.flatnonzero(tokens == token)
        a, b = sorted(int(x) for x in random_.integers(0, n + 1, 2))
        assert (shard.positions(token) == places).all() and shard.count(token, a, b) == ((places >= a) & (places < b)).sum()
        k = int(random_.integers(len(places)))
        assert shard.locate(token, k) == places[k]
    assert shard.count(1 << 20) == 0 and len(shard.positions(1 << 20)) == 0
    with pytest.raises(IndexError):
        shard.access(n)


def test_pieces_give_the_ids_of_whole_texts(library):
    got = [np.frombuffer(x, "<u4").tolist() for x in token_store.Encoder(token_store.default_path()).encode(ODD)]
    assert got == [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]


@pytest.mark.parametrize("most", [1, 100, 1 << 21])
def test_files(spark, library, tmp_path, most):
    prepare(spark)
    rows = [(i % 7 * 3, t, "n") for i, t in enumerate(ODD)] + [(None, "no id", None), (None, None, None), (5, None, "x"), (5, "same", None), (5, "same", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    token_store.write(docs, folder, token_store.default_path(), most=most)
    got = token_store.read(spark, folder).orderBy("start").collect()
    want = sorted((i is not None, i or 0, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for i, ids in ((i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _ in rows))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32, r.n_tokens) for r in got) == want
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    token = library.encode("long", add_special_tokens=False).ids[0]
    space = library.encode(" long", add_special_tokens=False).ids[0]
    found = token_store.occurrences(spark, folder, [token, space, 0]).groupBy("token").count().collect()
    zeros = sum(library.encode(t or "", add_special_tokens=False).ids.count(0) for _, t, _ in rows)  # the end id is also that of a sign
    assert {r["token"]: r["count"] for r in found} == {token: 1, space: 19_999, 0: len(rows) + zeros}
    counts = {r["token"]: r["n"] for r in token_store.token_counts(spark, folder, [space]).collect()}
    assert counts == {space: 19_999}


def test_no_documents(spark, tmp_path):
    prepare(spark)
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    token_store.write(docs, f"{tmp_path}/none", token_store.default_path())
    assert token_store.read(spark, f"{tmp_path}/none").count() == 0
