"""The queries of the operators, over the tables of a folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, crosstoken, exactdedup, langid, mixing, ngramlm, periodic, pii, secrets, setjoin, tokenstore, vectors
from gridloom.llm.common import remainder, texts_of


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files lie: the installed package says so, else the usual folder."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return str(Path("/opt/tokenizers") / name)
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for the key that a deployment keeps secret.
KEY = b"gridloom pseudonyms"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mixture of all sources, weighed by the square root of their sizes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of the documents is kept from the training."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, tokenizer_file("piece_bpe_32k.model"), remainder("doc_id", 3) != 1)
    found = langid.predict(texts_of(docs), model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document holds a secret; secrets themselves only as a hash."""
    known = secrets.dictionary(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    forest = secrets.train(spark, secrets.labelled_findings(known), known)
    found = secrets.scan(table(spark, sf_dir, "documents"), forest)
    return found.select("doc_id", "nth", "start", "n_chars", F.sha2("secret", 256).alias("secret_sha256"), "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth one."""
    return vectors.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the word-level vocabulary; digests of both."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), digests_only=True)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's byte-level ids, written to shards in id order and read back."""
    return tokenstore.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors that have a label."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms for personal values, and their number."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a trigram model of four fifths of the documents."""
    docs = table(spark, sf_dir, "documents")
    scored = ngramlm.score(docs, ngramlm.train(docs, remainder("doc_id", 5) != 1))
    return scored.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of four-word runs reach a Jaccard similarity of 0.85."""
    return setjoin.join(table(spark, sf_dir, "documents"), n=4, part=85, whole=100)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays of those with the same text, white space aside."""
    return exactdedup.dedup(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two vocabularies, aligned, and how often its linked ids are linked in all documents."""
    return crosstoken.alignment(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words that repeat with a period, in every document; a tenth of them repeats itself on purpose."""
    return periodic.collapsed(table(spark, sf_dir, "documents"), periodic.planted)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_language, op3_secrets, op4_top_k, op5_bpe_codec, op6_token_files, op7_vector_dedup, op8_pii, op9_lm_score, op10_set_join, op11_exact_dedup, op12_token_alignment, op13_periodic_runs)}


OP4_SQL = """
WITH able AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
    FROM able q JOIN able d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP7_SQL = """
WITH RECURSIVE able AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_inner_product(a.v, b.v) >= 0.98 * sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))
      AND list_inner_product(a.v, a.v) > 0 AND list_inner_product(b.v, b.v) > 0
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.a
"""


OP11_SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS said FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY said ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY said) AS group_size,
    row_number() OVER (PARTITION BY said ORDER BY points DESC, doc_id) = 1 AS kept, sha256(said) AS text_sha256
FROM n
"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL does in reasonable time over whole tables; the rest is tested against brute force."""
    return {"op4_top_k": OP4_SQL, "op7_vector_dedup": OP7_SQL, "op11_exact_dedup": OP11_SQL}
