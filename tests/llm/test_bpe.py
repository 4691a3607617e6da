import hashlib
import itertools
import random

import pytest
from tokenizers import Tokenizer

from pledgelens.llm import bpe

WORDS = ["ab", "a", "aAb1", "thein", "é ñü", "=-_", "a'st !", "\t\n \xa0ab", "日本語", "́a b", "🎉é", "0123", "\x1c \x1fa!"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    return lambda s: t.encode(s, add_special_tokens=False).ids


def tree_encoded(b, text, most):
    ids = []
    for run, part in itertools.groupby(bpe.cut(b, text, most), key=lambda r: r[0]):
        part = [b.leaf(d) if run else b.encode(d.decode()) for _, d in part]
        ids += b.tree(part) if run else list(itertools.chain.from_iterable(part))
    return ids


def test_tree_equals_whole(library):
    b, rnd = bpe.loaded(bpe.default_vocabulary()), random.Random(1)
    for _ in range(1500):
        letters = list(rnd.choice(WORDS)) + rnd.choice([[], ["the", "<|endoftext|>", " "]])
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 120)))
        want = library(text)
        assert b.encode(text) == want
        assert [tree_encoded(b, text, m) for m in (3, 7, 20)] == [want] * 3
        assert bpe.decoded(b, want) == text


def test_rows(spark, library):
    texts = [None, "", "a", "Hello <|endoftext|> world  \n", "x" * 900, "ab" * 700, "é" * 333, "one two " * 100, "one two " * 100]
    rows = [(i if i else None, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string").repartition(3)
    for most in (64, 65536):
        out = bpe.encode(docs, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep_text=True, piece_chars=most)
        got = out.collect()
        assert len(got) == len(texts)
        for r in got:
            ids = library(r.text or "")
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        back = bpe.decode(out.select("doc_id", "ids")).collect()
        assert sorted(x.text for x in back) == sorted(t or "" for t in texts)
    assert bpe.digests(docs.limit(0)).count() == 0


def test_decode_broken_bytes():
    b = bpe.loaded(bpe.default_vocabulary())
    ids = b.leaf("é".encode()[:1])
    assert bpe.decoded(b, ids) == "�"
