"""Each stage on its own input: what it keeps, drops and changes."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from pointloom.llm import common as C
from pointloom.llm import decontaminate, queries
from tests.llm import cases
from tests.llm.test_jaccard import brute as brute_links
from tests.llm.test_suffix import brute as brute_strings

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, docs, DATA).write.parquet(f"{root}/{k}")
        out.append((docs, spark.read.parquet(f"{root}/{k}")))
        docs = out[-1][1]
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_quality(spark, stages):
    before, after = stages[0]
    bad = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0")
    good = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").join(before, "doc_id")
    assert after.join(bad, "doc_id").count() <= 1
    assert after.join(good.select("doc_id"), "doc_id").count() >= 0.97 * good.count()


def test_near_duplicates(stages):
    before, after = stages[1]
    docs = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for c, _ in brute_links(docs).values()})


def test_repeats(stages):
    before, after = stages[2]
    docs = sorted((r["doc_id"], r["text"].encode()) for r in before.collect())
    kept = {r["doc_id"]: r for r in after.collect()}
    for (i, t), gone in zip(docs, brute_strings(docs, 100), strict=True):
        want = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
        if i in kept:
            assert kept[i]["text"] == want and kept[i]["n_chars"] == len(want)
        else:
            assert not want.strip()


def test_items(spark, stages):
    before, after = stages[3]
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.scan(after, items).where(F.size("hits") > 0).count() == 0
    clean = decontaminate.scan(before, items).where(F.size("hits") == 0).count()
    assert clean <= after.count() <= before.count()


def test_tokens(stages):
    import tiktoken

    from pointloom.llm import bpe

    before, after = stages[4]
    path, pattern = queries.tokenizer_file()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    got = {r["doc_id"]: r for r in after.collect()}
    for r in before.collect():
        assert got[r["doc_id"]]["n_tokens"] == len(enc.encode_ordinary(r["text"]))
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_run(spark, stages):
    assert P.run(spark, DATA).exceptAll(stages[-1][1]).count() == 0


@pytest.mark.parametrize("make", [cases.table, cases.empty])
def test_stages_take_odd_and_empty_tables(spark, tmp_path, make):
    docs = make(spark)
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(P.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        assert out.count() <= docs.count()
        docs = out


def test_a_stage_folder_goes_when_the_next_is_whole(spark):
    root = C.shared_dir(spark).removeprefix("file:")
    stages = lambda: {p.name for p in Path(root).iterdir() if p.name.startswith("stage-")}
    before = stages()
    assert P.run(spark, DATA).count() > 0
    assert len(stages() - before) == 1
