"""Queries that SQL can express, against it; and all of them on odd and on empty tables."""

import pytest
from pyspark.sql import functions as F

from pointloom.llm import queries
from tests import oracle
from tests.llm import cases


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    oracle.same(queries.QUERIES[name](spark, oracle.DATA), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n not in ("op2_url_filters", "op12_source_divergence", "op13_hard_negatives")))
@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_odd_tables(spark, name, kind, tmp_path):
    docs = cases.table(spark) if kind == "odd" else cases.empty(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "quick brown fox jumps over"), (None, None), (3, "...")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0), (7, 0, 1), (7, 0, 1), (None, 1, 0), (8, None, None), (9, 5, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(out) == docs.count()
    ids = out["doc_id"].astype("Int64")
    assert ids.isna().sum() == docs.where("doc_id IS NULL").count()
    for c in out.columns:
        if c not in ("doc_id", "class_id", "first_word", "last_word"):
            assert out[c].notna().all(), c
    if kind == "odd" and name == "op5_decontaminate":
        assert out.set_index(ids).loc[3, "n_items"] == 1
    if kind == "odd" and name == "op4_suffix_array":
        assert (out[ids == 7]["n_removed"] > 0).all() and (out[ids == 3]["n_removed"] == 0).all()
    if kind == "odd" and name == "op1_jaccard_join":
        assert out[ids == 3]["class_id"].tolist() == [1] and out[ids == 3]["n_links"].tolist() == [2]


def test_urls(spark):
    from pointloom.llm import urls

    t = lambda s: F.to_timestamp(F.lit(s))
    entries = spark.createDataFrame(
        [("host", "A.example.com", "add", "2024-01-10", "x"), ("host", "a.example.com", "remove", "2024-02-10", "x"), ("host", "a.example.com", "add", "2024-03-10", "y"), ("host", "a.example.com", "add", "2024-03-10", "y"), ("domain", "example.org", "add", "2024-01-01", "d"), ("prefix", "b.example.net/p/q", "add", "2024-01-01", "p"), ("domain", None, "add", "2024-01-01", "d"), ("host", "z.example.com", "add", None, "d")],
        "kind string, value string, action string, at string, category string",
    )
    pages = spark.createDataFrame(
        [(1, "http://a.example.com/", "2024-01-09"), (2, "http://A.example.com./x", "2024-01-10"), (3, "https://u@a.example.com:80", "2024-02-10"), (4, "http://a.example.com?q", "2024-03-11"), (5, "http://www.sub.example.org/", "2024-05-01"), (6, "http://notexample.org/", "2024-05-01"), (7, "http://b.example.net/p/q/r", "2024-05-01"), (8, "http://b.example.net/p", "2024-05-01"), (None, None, "2024-05-01"), (10, "no url", None)],
        "page_id long, url string, at string",
    ).withColumn("fetched_at", F.to_timestamp("at"))
    for most in (urls.MOST_VALUES, 0):
        got = {r["page_id"]: (r["blocked"], r["rule"], r["category"]) for r in urls.evaluate(pages, entries, most=most).collect()}
        assert got[1] == (False, None, None) and got[2] == (True, "host:a.example.com", "x") and got[3][0] is False
        assert got[4] == (True, "host:a.example.com", "y") and got[5] == (True, "domain:example.org", "d") and got[6][0] is False
        assert got[7] == (True, "prefix:b.example.net/p/q", "p") and got[8][0] is False and got[None][0] is False and got[10][0] is False
    assert urls.evaluate(pages, entries.limit(0)).where("blocked").count() == 0
    assert urls.evaluate(pages.limit(0), entries).count() == 0
