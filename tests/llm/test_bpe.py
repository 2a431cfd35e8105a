"""Encoding against the tokenizers library, decoding, and hostile texts."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe
from gridloom.llm.registry import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")
HOSTILE = ["", " ", "don'T I'LL 've", "ΣΑΣ İx ẞ", "<|endoftext|>a<|startoftext|> b", "\x1c a\x85b\xa0c", "é é", "²٣ 漢字🎉", "a" * 3000, "eauou" * 900, "%%%###$$$ 1234"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_as_the_library(library):
    rng = random.Random(3)
    alphabet = "abcE 'sS1é٣²ΣσİÀ́\n\t\x1c\x85$#_-漢🎉."
    texts = HOSTILE + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(500)]
    codec = bpe.TextCodec(PATH)
    ids, back = codec.encode_all(texts)
    for text, own, decoded in zip(texts, ids, back, strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert own == " ".join(map(str, expected)), text
        assert decoded == library.decode(expected, skip_special_tokens=False), text


def test_caches_may_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 5)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 5)
    codec = bpe.TextCodec(PATH)
    for text in ["one two three four five six seven", "seven eight nine ten one two", "one"]:
        assert codec.encode_all([text])[0][0] == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_rows_of_a_table(spark, library):
    docs = spark.createDataFrame([(1, "Hello", "x"), (1, "Hello", "x"), (2, None, None), (None, "", "y")], "doc_id long, text string, n_tokens string")
    rows = bpe.encode_decode(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in rows) == [(0, 0, ""), (1, 1, "hello</w>"), (1, 1, "hello</w>"), (2, 0, "")]
    digests = bpe.encode_decode(docs, PATH, digests_only=True).filter("doc_id = 2").first()
    assert digests.ids_sha256 == digests.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0
