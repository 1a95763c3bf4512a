import base64
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")

from factmill.llm.tokenizer import PATTERN, VOCABULARY, RankArrays, encode, token_counts  # noqa: E402

LINES = open(VOCABULARY, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, LINES.splitlines())}
PUBLIC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return RankArrays(LINES)


def _texts():
    r = random.Random(7)
    alphabet = "abcdefghijABC 0123456789\n\t'.,-_=+/<>éßñ日本語\U0001f600\u200d\x00\x1c\x85\u00a0"
    some = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 400))) for _ in range(120)]
    return some + [
        "", "a", " ", "   ", "\n\n ", "don't DON'T we'll 's", "<|endoftext|> and <|endoftext|>", "１２３ ½ ² Ⅷ", "x" * 5000, "ab" * 3000, "=" * 777, "é" * 300,
        "\ufeffbom", "a\u0301e\u0301", "tab\there", "\r\n\r\n" * 50, "aGVsbG8gd29ybGQhIQ==" * 40,
    ]


def test_same_ids_as_the_public_library(own):
    texts = _texts()
    ids, counts = own.encode(texts)
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == PUBLIC.encode_ordinary(t), t[:40]
        at += n
    assert at == len(ids)
    assert own.counts(texts).tolist() == counts.tolist()


def test_long_words_by_heap_and_by_rows_agree(own):
    for w in (b"abcabcabd" * 7, b"the quick", "überraschend".encode()):
        import numpy as np

        ids, n = own.encode_equal(np.frombuffer(w, np.uint8)[None, :])
        assert ids[0, : n[0]].tolist() == own.encode_long(w)


def test_very_long_text(own):
    text = "lorem ipsum, 123 dolor\n" * 60_000 + "z" * 100_000
    ids, counts = own.encode(["before", text, None, "after"])
    assert counts.tolist() == [len(PUBLIC.encode_ordinary(t)) for t in ("before", text, "", "after")]
    assert ids.tolist() == [i for t in ("before", text, "after") for i in PUBLIC.encode_ordinary(t)]


def test_forgetting_words_changes_nothing(own, monkeypatch):
    monkeypatch.setattr("factmill.llm.tokenizer._POOL_WORDS", 50)
    texts = _texts()[:40]
    assert own.encode(texts)[0].tolist() == [i for t in texts for i in PUBLIC.encode_ordinary(t)]


def test_round_trip(own):
    by_id = {v: k for k, v in RANKS.items()}
    for t in _texts():
        ids, _ = own.encode([t])
        assert b"".join(by_id[i] for i in ids.tolist()).decode() == t


def test_frames(spark, rows):
    data = [(1, "hello world", "ids"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (1, "hello world", "ids")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    got = {(r.doc_id, tuple(r.ids)) for r in encode(df).collect()}
    assert got == {(1, tuple(PUBLIC.encode_ordinary("hello world"))), (2, ()), (3, ()), (None, tuple(PUBLIC.encode_ordinary("a")))}
    assert encode(df).count() == 5
    assert rows(token_counts(df)) == sorted([(1, 2), (2, 0), (3, 0), (None, 1), (1, 2)], key=str)
    assert encode(df.limit(0)).collect() == []
