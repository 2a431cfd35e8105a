"""Segmentation sums by enumeration, held-out accuracy, and texts without language."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import langid
from gridloom.llm.common import remainder
from gridloom.llm.registry import op2_language, tokenizer_file

VOCABULARY = tokenizer_file("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    model = langid.fit({"a": {"there": 3, "then": 2}, "b": {"eau": 2, "beau": 5}}, VOCABULARY)
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=VOCABULARY)
    order = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    row = {sp.id_to_piece(i): k for k, i in enumerate(order) if not sp.is_byte(i)}
    for word in ("then", "beau", "aéz", "q漢"):
        whole = "▁" + word
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(whole) - 1):
            parts, now = [], whole[0]
            for c, cut in zip(whole[1:], cuts, strict=True):
                if cut:
                    parts.append(now)
                    now = c
                else:
                    now += c
            parts.append(now)
            p = np.ones(2)
            for part in parts:
                if part in row:
                    p *= model.p[row[part]]
                elif len(part) == 1:
                    for b in part.encode():
                        p *= model.p[model.pieces.byte_row[b]]
                else:
                    p *= 0
            total += p
        assert np.allclose(model.word_scores([word])[0], np.log(total)), word


def test_long_words_agree_with_short_ones(monkeypatch):
    model = langid.fit({"a": {"there": 3}, "b": {"beau": 5}}, VOCABULARY)
    word = "therebeau" * 5
    assert np.allclose(model.word_scores([word])[0], model._long("▁" + word))


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = op2_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the there then", "en"), (2, "beau eau", "fr"), (3, None, "en"), (4, "12 %% 3", None), (5, "", "fr"), (1, "the there then", "en")], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(docs, VOCABULARY)
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert rows[1].lang_pred == "en" and rows[2].lang_pred == "fr"
    assert {(rows[k].lang_pred, rows[k].score) for k in (3, 4, 5)} == {("und", 0.0)}
    assert langid.predict(docs, model).count() == 6 and langid.predict(docs.limit(0), model).count() == 0
    none = langid.train(docs.filter("lang is null"), VOCABULARY)
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_more_languages_than_allowed(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 1)
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, lang string"), VOCABULARY, remainder("doc_id", 3) >= 0)
