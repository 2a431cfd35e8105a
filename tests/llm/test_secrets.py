"""Secrets found, look-alikes left, places right."""

from pyspark.sql import functions as F

from gridloom.llm import secrets
from gridloom.llm.registry import tokenizer_file

KNOWN = secrets.dictionary(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def forest(spark):
    return secrets.train(spark, secrets.labelled_findings(KNOWN, 3000), KNOWN)


def test_dictionary_is_words():
    assert 300 <= len(KNOWN) <= 600 and {"which", "there"} <= {*KNOWN} and all(w.isalpha() and len(w) >= 4 for w in KNOWN)


def walked(node, x):
    while node.below is not None:
        node = node.below if x[node.feature] <= node.at else node.above
    return node.share


def test_score_is_the_mean_of_the_trees(spark):
    grown = forest(spark)
    rows = spark.createDataFrame([(f["c"], f["b"], f["a"]) for f in secrets.labelled_findings(KNOWN, 200, seed=3)], "c string, b string, a string")
    found = secrets.scored(rows, grown).select("score", *[x.alias(n) for n, x in secrets.features(KNOWN).items()]).collect()
    for r in found:
        assert abs(r.score - sum(walked(t, r[1:]) for t in grown.trees) / len(grown.trees)) < 1e-9
    empty = secrets.Forest([secrets.Node(0.25)], KNOWN)
    assert {r.score for r in secrets.scored(rows, empty).select("score").collect()} == {0.25}


def test_held_out_findings(spark):
    own = secrets.labelled_findings(KNOWN, 1500, seed=99)
    import json

    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(own)), "array<struct<c string, b string, a string, secret boolean>>")).alias("x")).select("x.*")
    scored = secrets.scored(rows, forest(spark))
    right = scored.agg(F.avg(((F.col("score") >= 0.5) == F.col("secret")).cast("int"))).first()[0]
    assert right > 0.9


def test_rows(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    docs = spark.createDataFrame(
        [
            (1, f'prose é here. token = "{key}" and api_key: "{key}"'),
            (2, "thblebleinginghation erationshionthe in src/components/application/settings"),
            (3, f"commit {key} fixes it"),
            (4, None),
            (5, ""),
            (6, f'token = "{key}" ' + "x " * 40_000),
            (1, f'prose é here. token = "{key}" and api_key: "{key}"'),
        ],
        "doc_id long, text string",
    ).withColumn("score", F.lit("clash"))
    found = secrets.scan(docs, forest(spark)).collect()
    assert sorted((r.doc_id, r.nth) for r in found) == [(1, 0), (1, 0), (1, 1), (1, 1), (6, 0)]
    text = docs.filter("doc_id = 1").first().text
    assert all(text[r.start : r.start + r.n_chars] == r.secret == key for r in found if r.doc_id == 1)
    assert secrets.scan(docs.limit(0), forest(spark)).count() == 0


def test_candidates_against_plain_scanning(spark):
    """Same pattern, by Python's own engine, over whole rows: ties, neighbours that touch, short values, dotted tokens."""
    import random
    import re

    rng = random.Random(2)
    bits = ["password = hunter2!xY", "pwd:'abc'", 'api_key="Zx9-Zx9_Zx9!Zx9"', "eyJhbGciOi.eyJzdWIiOi.SflKxwRJSM", "A" * 16, "A" * 15, "token=" + "q1" * 12, "é", "secret", "=" * 20, "plain words here", "/" * 17, "auth: Bearer", "\n"]
    texts = [rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    pattern, told = re.compile(secrets.CANDIDATE, re.ASCII), re.compile(secrets.ASSIGNED, re.ASCII)
    expected = []
    for k, text in enumerate(texts):
        for nth, m in enumerate(pattern.finditer(text)):
            lead = told.match(m[0])
            at = m.start() + (lead.end() if lead else 0)
            expected.append((k, nth, at, text[at : m.end()]))
    found = secrets.candidates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.nth, r.start, r.c) for r in found) == expected and len(expected) > 300


def test_short_and_dotted_secrets(spark):
    texts = ["password = 'hX7!kq2z'", "pwd: Tr0ub4dor&3", "see eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c", "the password: required for all", "token = value of the word", "no secret here"]
    found = secrets.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), forest(spark)).collect()
    assert sorted((r.doc_id, r.secret) for r in found) == [(0, "hX7!kq2z"), (1, "Tr0ub4dor&3"), (2, texts[2][4:])]
