"""The pipeline's decisions, stage by stage and as a whole."""

import corpus_pipeline
from tokenizers import Tokenizer

from gridloom.llm import mixing
from gridloom.llm.registry import tokenizer_file

SF = "/root/testdata/sf0.001"


def words(text):
    return text.lower().encode().split()


def test_stages_and_result(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "near_duplicates":
            rows = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
            sets = {i: {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)} or {tuple(words(t))} for i, t in rows.items()}
            gone = kept["language"] - kept[name]
            linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            assert gone and all(any(linked(a, b) for b in sets if b < a) for a in gone)
            assert not any(linked(a, b) for a in kept[name] for b in kept[name] if a < b)
        if name == "personal_data":
            texts = {r.doc_id: r.text for r in docs.collect()}
            given = {r.doc_id: r for r in before.collect()}
            changed = [r for r in docs.collect() if r.text != given[r.doc_id].text]
            assert changed and all(len(r.text) == r.n_chars for r in changed)
            assert all(r == given[r.doc_id] for r in docs.collect() if r not in changed)
    assert len(kept["language"]) == 200 and kept["near_duplicates"] == kept["personal_data"] == kept["mixture"] == kept["token_ids"]
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    result = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(result) == kept["token_ids"]
    for i, text in texts.items():
        assert result[i].ids == library.encode(text, add_special_tokens=False).ids


def test_hostile_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "123 %%", "en", None, 6), (4, "the there then that and this is the text", "en", "a", 40), (4, "the there then that and this is the text", "en", "a", 40), (5, "la maison et le jardin de la ville avec des fleurs", "fr", "b", 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert {r.doc_id for r in docs.collect()} == {4, 5}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_ids_that_are_null_or_repeat(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (None, "another text of its own with some words in it"), (7, text), (8, text), (8, "words that no other row has at all here"), (9, text), (9, text), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([r for r in rows if r[0] != 9], key=str)


def test_mixture_outlives_part_files(spark, tmp_path):
    rows = [(k, "word " * (1 + 997 * k % 300), "en", f"s{k % 3 if k % 5 else 0}", 5) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    expected = [r.doc_id for r in mixing.mix(docs).orderBy("position").collect()]
    mixed = f"{tmp_path}/mixed"
    corpus_pipeline.mixture(spark, docs, SF).write.option("maxRecordsPerFile", 300).parquet(mixed)
    again = spark.read.parquet(mixed)
    assert len(again.inputFiles()) > 4
    out = corpus_pipeline.token_ids(spark, again.orderBy("text").repartition(7), SF)
    out.write.option("maxRecordsPerFile", 300).parquet(f"{tmp_path}/ids")
    assert [r.doc_id for r in out.collect()] == expected
    assert [r.doc_id for r in spark.read.parquet(f"{tmp_path}/ids").orderBy("position").collect()] == expected
