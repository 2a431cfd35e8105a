"""Every query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, duck, tmp_path, name):
    path = f"{tmp_path}/out"
    catalogue.queries()[name](spark, SF).write.parquet(path)
    own = f"SELECT * FROM '{path}/*.parquet'"
    sql = f"SELECT * FROM ({catalogue.oracle_sql()[name]})" if not catalogue.oracle_sql()[name].startswith("WITH RECURSIVE") else catalogue.oracle_sql()[name]
    duck.sql(f"CREATE OR REPLACE TABLE expected AS {sql}")
    duck.sql(f"CREATE OR REPLACE TABLE found AS {own}")
    columns = sorted(r[0] for r in duck.sql("DESCRIBE expected").fetchall())
    assert columns == sorted(r[0] for r in duck.sql("DESCRIBE found").fetchall())
    q = ", ".join(columns)
    assert duck.sql(f"(SELECT {q} FROM expected EXCEPT ALL SELECT {q} FROM found) UNION ALL (SELECT {q} FROM found EXCEPT ALL SELECT {q} FROM expected)").fetchall() == []


def test_stratified_split_keeps_shares(spark):
    rows = catalogue.stratified_split(spark, SF).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == spark.read.parquet(f"{SF}/documents.parquet").count()
    share = sum(r.split == "train" for r in rows) / len(rows)
    assert abs(share - 0.7) < 0.05
    again = {r.doc_id: r.split for r in catalogue.stratified_split(spark, SF).repartition(7).collect()}
    assert again == {r.doc_id: r.split for r in rows}
