import re

from pyspark.sql import functions as F

from pointloom.llm import decontaminate as D
from tests.llm import cases


def test_both_ways_and_removal(spark):
    items = spark.createDataFrame([(1, "the lazy dog near the old river bank at noon now"), (2, "Quick; brown"), (3, None), (4, "!!")], "item_id long, text string")
    docs = cases.table(spark)
    plain = {(r["k"], tuple(r["hits"]), tuple(r["items"])) for r in D.scan(docs.withColumn("k", F.xxhash64("doc_id", "text")), items, pass_on=("k",)).collect()}
    other = {(r["k"], tuple(r["hits"]), tuple(r["items"])) for r in D.scan(docs.withColumn("k", F.xxhash64("doc_id", "text")), items, pass_on=("k",), most=0).collect()}
    assert plain == other
    assert {h for _, h, _ in plain} == {(), (1, 2, *range(6, 16))}
    for most in (D.MOST_WINDOWS, 0):
        out = D.remove(docs, items, whole=0.9, most=most)
        assert out.dtypes == docs.dtypes
        texts = {r["doc_id"]: r["text"] for r in out.where("doc_id IS NOT NULL").collect()}
        assert texts[3] == "The fox jumps over." and texts[4] is None and texts[7] == cases.LONG and texts[6] == cases.TEXTS[7][1]
        assert D.remove(docs, items, whole=0.5, most=most).where("doc_id = 3").count() == 0


def test_removed_text_has_no_window_left(spark):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    before = D.scan(docs, items).where(F.size("hits") > 0).count()
    out = D.remove(docs, items)
    assert before > 0 and D.scan(out, items).where(F.size("hits") > 0).count() == 0
    clean = docs.join(D.scan(docs, items).where(F.size("hits") == 0).select("doc_id"), "doc_id", "left_semi")
    assert clean.select("doc_id", "text").exceptAll(out.select("doc_id", "text")).count() == 0
    words = re.findall(D.WORD, "A b-c é1", re.ASCII)
    assert words == ["A", "b", "c", "é1"]
