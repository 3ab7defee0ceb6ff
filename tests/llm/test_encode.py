import random

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import encode

PATH = f"{encode.TOKENIZERS}/{encode.BYTE_BPE}"
ODD = [
    "a", "b", "es", "t", "'", "'s", "'ll", "\n", "\n\n", " ", "  ", "\t", "\r\n", "1", "23", ".", ",", "(", ")", "é", "中", "😀", "\u00a0", "\u2007", "\x1c", "\x85", "<|endoftext|>", "re",
    "--", "==", "A", "\x00", "ß", "İ", "'S", " ' ", "\u0301", "у", "же", "日本", "語。", "\u3000", "\u2028", "\u00c5", "한", "ا",
]


@pytest.fixture(scope="module")
def tokenizer():
    return encode.load_tokenizer(PATH)


def ids(texts, tokenizer):
    flat, offsets = encode.encode_column(pa.array(texts, pa.string()), *tokenizer, {})
    return [flat[offsets[i] : offsets[i + 1]].tolist() for i in range(len(texts))]


@pytest.mark.parametrize("fragment", [1, 7, 256])
def test_cuts_never_change_ids(tokenizer, monkeypatch, fragment):
    plain = encode.cuts
    monkeypatch.setattr(encode, "cuts", lambda d, b, n: plain(d, b, n, fragment))
    rnd = random.Random(fragment)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 80))) for _ in range(4000)]
    assert ids(texts, tokenizer) == [tokenizer[0].encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["修复 空指针。用例、" * 40, "исправлен щелчок" * 40, "commit 修复\u3000bug, ещё 日本" * 40])
def test_other_scripts_are_cut_too(tokenizer, text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    at = encode.cuts(data, np.array([0, len(data)]), tokenizer[1])
    assert len(at) >= len(data) // 256 - 1 and ids([text], tokenizer) == [tokenizer[0].encode_ordinary(text)]


def test_most_texts_are_cut(spark, tables, tokenizer):
    """Every text with a certain cut behind its first 256 bytes is cut, however short."""
    texts = [r.text.encode() for r in spark.read.parquet(f"{tables}/documents.parquet").select("text").collect() if r.text]
    long_ = [t for t in texts if len(t) > 512]
    cut = sum(len(encode.cuts(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]), tokenizer[1])) > 0 for t in long_)
    assert cut >= 0.99 * len(long_)


def test_cuts_do_cut(tokenizer):

    data = np.frombuffer(b"x = (y)\nfoo bar\n" * 1000, dtype=np.uint8)
    assert len(encode.cuts(data, np.array([0, len(data)]), tokenizer[1], 64)) > 200


@pytest.mark.parametrize("text", ["x" + " " * 4000 + "y", " " * 5000, "\n" * 3000 + "'s", "a" + "\n \u2007" * 900 + "b", " " * 1500 + "\x1c" + " " * 1500 + "é"])
def test_long_blanks(tokenizer, text):
    assert ids([text], tokenizer) == [tokenizer[0].encode_ordinary(text)]


def test_very_long_texts_end_and_decode(tokenizer):
    for text in ("a" * 400_000, " " * 1_000_000, "\n" * 500_000 + "x", "-=" * 200_000, "é" * 200_000):
        [got] = ids([text], tokenizer)
        assert tokenizer[0].decode(got) == text


def test_agrees_with_the_other_library(tokenizer):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ODD) for _ in range(30)) for _ in range(500)]
    assert ids(texts, tokenizer) == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def test_frame(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "<|endoftext|>", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, len(r.ids)) for r in encode.encode(docs, ["doc_id"]).collect())
    assert got == [(1, 2), (2, 0), (3, 0), (3, 7)]
    assert sorted(r.n_tokens for r in encode.token_counts(docs, ["doc_id", "ids"]).collect()) == [0, 0, 2, 7]
    assert encode.encode(docs.limit(0), ["doc_id"]).count() == 0


def test_whole_table(spark, tables, tokenizer):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    want = {r.doc_id: tokenizer[0].encode_ordinary(r.text or "") for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: list(r.ids) for r in encode.encode(docs, ["doc_id"]).collect()} == want


def test_slices_keep_every_row():
    texts = ["a" * n for n in (5, 0, 12, 1, 1, 1, 30, 2)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(encode.slices(batch, 10))
    assert len(parts) > 2 and [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert list(encode.slices(batch.slice(0, 0))) == []


def test_slices_of_slices_encode_alike(tokenizer):
    texts = ["foo bar", None, "baz" * 50, "", "x\ny"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]).slice(1, 4)
    got = []
    for part in encode.slices(batch, 4):
        flat, offsets = encode.encode_column(part.column(0), *tokenizer, {})
        got += [flat[offsets[i] : offsets[i + 1]].tolist() for i in range(part.num_rows)]
    assert got == [tokenizer[0].encode_ordinary(t or "") for t in texts[1:]]
