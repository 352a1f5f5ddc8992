import base64

import pytest
import tiktoken

from skarn.llm import bpe

TEXTS = ["", " ", "a", "aaaaaaa", "Hello world, it's  2024\n\n\tok ", "can't won't we'll they've I'd it's", "<|endoftext|> is text", "日本語のテキスト。", "👩‍💻🔐", "﻿​", "é" * 300, "x" * 20_000, " \t \n" * 50, "ﬀ ǅ ß İ", "0xDEADBEEF" * 30]


@pytest.fixture(scope="module")
def reference():
    path = bpe.tokenizer_file("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_a_public_encoder(reference):
    enc = bpe.CorpusEncoder(bpe.tokenizer_file())
    for texts in (TEXTS, TEXTS[::-1]):
        ids, off = enc.encode(texts)
        assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == [reference.encode_ordinary(t) for t in texts]
        assert enc.count(texts).tolist() == [len(reference.encode_ordinary(t)) for t in texts]


def test_random_texts(reference):
    import random

    r = random.Random(0)
    alphabet = "abcdeé 日\n'.0123-ABĆ"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(300)]
    ids, off = bpe.CorpusEncoder(bpe.tokenizer_file()).encode(texts)
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == [reference.encode_ordinary(t) for t in texts]


def test_forgotten_words_are_encoded_again(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    enc = bpe.CorpusEncoder(bpe.tokenizer_file())
    for t in TEXTS:
        ids, _ = enc.encode([t])
        assert ids.tolist() == reference.encode_ordinary(t)


def test_table(spark, reference, monkeypatch):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(100, None, "x"), (101, "dup", "x"), (101, "dup", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.encode_corpus(df, "doc_id", "text").collect()
    want = [(i, None if t is None else reference.encode_ordinary(t)) for i, t, _ in rows]
    assert sorted((r["doc_id"], r["ids"]) for r in got if r["ids"] is not None) == sorted(w for w in want if w[1] is not None)
    assert [r["doc_id"] for r in got if r["ids"] is None] == [100]
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(df, "doc_id", "text").collect()}
    assert n[0] == 0 and n[100] is None
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
