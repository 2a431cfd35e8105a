"""Token shards: the library's ids, order, random access, and round trips."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from gridloom.llm import tokenstore
from gridloom.llm.common import shared_dir
from gridloom.llm.registry import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")


def test_chunks_encode_as_whole_texts():
    library = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    alphabet = "abc.,é  'sS1٣²\n\t\x1c\x85$#_-漢🎉"
    texts = ["", None, " ", "<|endoftext|> a  <|endoftext|>", "x ", " x", "word.\nNext, é.\nÀ"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    own = tokenstore.ChunkEncoder(PATH).arrays(texts)
    for text, ids in zip(texts, own, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_round_trip_in_order(spark, monkeypatch):
    monkeypatch.setattr(tokenstore, "SHARD_DOCS", 7)
    library = Tokenizer.from_file(PATH)
    rows = [(k * 3 % 101, f"text number {k} " * (k % 5), "x") for k in range(101)] + [(5, None, "x"), (5, "again", "x")] + [(None, f"nameless {k}", "x") for k in range(20)] + [(None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    out = tokenstore.round_trip(docs, PATH).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda i: (i is None, i or 0))
    at = 0
    expected = {}
    for doc_id, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        expected.setdefault(doc_id, set()).add((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in out:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in expected[r.doc_id]
        at += r.n_tokens


def test_one_document_without_its_neighbours(spark):
    docs = spark.createDataFrame([(k, f"document {k} says {k * k}") for k in range(50)], "doc_id long, text string")
    path = shared_dir(spark) + "/tokens"
    tokenstore.write(docs, PATH, path)
    dictionary = bytes(spark.read.parquet(path + "/dictionary").first()[0])
    shard = tokenstore.Shard(bytes(spark.read.parquet(path + "/shards").orderBy("part", "seq").first().blob), dictionary)
    assert Tokenizer.from_file(PATH).decode(shard.ids(3)[:-1].tolist()) == f"document {shard.doc_ids[3]} says {int(shard.doc_ids[3]) ** 2}"
    ids = {r.doc_id: r.ids for r in tokenstore.read(spark, path).collect()}
    assert len(ids) == 50 and all(i[-1] == 0 for i in ids.values())


def test_empty_table(spark):
    assert tokenstore.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
