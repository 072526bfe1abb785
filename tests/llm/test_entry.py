import __spark_entry__ as entry
from tessera.llm.queries import ORACLES, QUERIES


def test_one_query_for_each_operator():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(QUERIES) <= set(names) and set(ORACLES) <= set(entry.oracle_sql())


def test_mixing_sql(spark, tmp_path):
    import duckdb

    from tests.llm.fixtures import frame

    docs = frame(spark).filter("doc_id is not null and source is not null").select("doc_id", "text", "lang", "source", "n_chars")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    relation = con.sql(ORACLES["op7_poisson_mixing"])
    out = QUERIES["op7_poisson_mixing"](spark, str(tmp_path))
    assert sorted(map(tuple, out.select(*relation.columns).collect()), key=str) == sorted(relation.fetchall(), key=str)
