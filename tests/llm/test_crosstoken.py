"""Alignment of two tokenizers against both libraries on whole texts and plain counting."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridloom.llm import crosstoken
from gridloom.llm.bpe import byte_symbols
from gridloom.llm.registry import tokenizer_file

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
HOSTILE = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a\n b", "\n", "x\ny z", "▁", "a▁ b", "é É 漢字🎉 ﬁ", "<|endoftext|> a <s> </s> <unk> <0x41>", "\x00a \x00", "\x1c a\x85b\xa0c", "don't I'LL 12345", "　x y", "word " * 400, "a" * 3000]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(libraries, text):
    """Tokens, groups and links by the libraries' whole way."""
    a, b = libraries
    if not text:
        return 0, 0, "", []
    symbol = {c: k for k, c in enumerate(byte_symbols())}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(symbol[c] for c in a.id_to_token(k)) for k in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return 0, 0, "", []
    ends_a, ends_b = ([sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (bytes_a, bytes_b))
    shared = sorted(set(ends_a) & set(ends_b))
    groups, links, last = [], [], 0
    for end in shared:
        groups.append(",".join(str(k) for k, e in zip(ids_a, ends_a, strict=True) if last < e <= end) + "|" + ",".join(str(k) for k, e in zip(ids_b, ends_b, strict=True) if last < e <= end))
        links += [(x, y) for x, e in zip(ids_a, ends_a, strict=True) if e == end for y, f in zip(ids_b, ends_b, strict=True) if f == end]
        last = end
    return len(ids_a), len(ids_b), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def texts():
    rng = random.Random(12)
    alphabet = "abcé.,'  \n\t1²漢▁<"
    words = ["the", "and", "thing", "inwh.\nWas", "a,", "Ünder", "x"]
    return HOSTILE + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(150)] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(80)]


def test_chunks_align_as_whole_texts(libraries, monkeypatch):
    monkeypatch.setattr(crosstoken, "CACHED", 40)
    aligner = crosstoken.Aligner(A, B)
    for text in texts():
        n_a, n_b, digest, links = plain(libraries, text)
        codes = Counter(x * aligner.n_b + y for x, y in links)
        for size in (crosstoken.STRETCH, 9):
            own = crosstoken.document(aligner, text, size)
            assert own[:4] == (n_a, n_b, len(links), digest), repr(text)
            assert dict(zip(own[4].tolist(), own[5].tolist(), strict=True)) == codes


@pytest.mark.parametrize("options", [{}, {"block_docs": 7, "stripes": 3}])
def test_counts_over_all_documents(spark, libraries, options):
    rows = list(enumerate(texts())) + [(None, "the thing"), (5, "the thing")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, code string").repartition(3)
    said = [(doc_id, plain(libraries, text)) for doc_id, text in rows]
    count = Counter(link for _, s in said for link in s[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    want = [(d, n_a, n_b, len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest) for d, (n_a, n_b, digest, links) in said]
    out = crosstoken.alignment(docs, A, B, **options)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_nothing_to_align(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert crosstoken.alignment(empty, A, B).collect() == []
    assert [tuple(r)[1:] for r in crosstoken.alignment(spark.createDataFrame([(1, None)], "doc_id int, text string"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]
