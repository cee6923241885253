"""A pipeline over documents: quality, near duplicates, repeated strings, test items, tokens. Part of subpackage llm."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import bpe, decontaminate, jaccard, quality, suffix
from pointloom.llm import common as C
from pointloom.llm.queries import tokenizer_file
from pointloom.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    """f, with the package sent to executors that lack it."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, docs, sf_dir)

    return run


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of names that no operator gives, and which name each has."""
    own = docs.toDF(*(f"own{k}" for k in range(len(docs.columns))))
    return own, dict(zip(docs.columns, own.columns, strict=True))


def _back(docs: DataFrame, out: DataFrame, names: dict[str, str]) -> DataFrame:
    return out.select(*(F.col(names[c]).alias(c) for c in docs.columns))


def _whole(docs: DataFrame, text: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return text.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    own, names = _renamed(docs)
    scored = quality.classify(own, C.table(spark, sf_dir, "labels"), names["doc_id"], names["text"], pass_on=tuple(c for c in own.columns if c != names["doc_id"]))
    return _back(docs, scored.where("predicted = 1"), names)


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id."""
    return jaccard.keep_one(docs)


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 100 bytes that also start earlier; those of which nothing is left go."""
    own, names = _renamed(docs)
    others = tuple(c for c in own.columns if c not in (names["doc_id"], names["text"]))
    kept = suffix.deduplicate(own, names["doc_id"], names["text"], pass_on=others)
    return _whole(docs, _back(docs, kept.where((F.col("n_removed") == 0) | (F.trim(names["text"]) != "")), names))


@_stage
def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of test items; those that are mostly such words go."""
    return _whole(docs, decontaminate.remove(docs, C.table(spark, sf_dir, "benchmark")))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's tokens, and the digest of the bytes that they decode to."""
    return bpe.encode_decode(docs, *tokenizer_file())


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_test_items),
    ("byte-level BPE", tokens),
]

#: Learnt scores and tokens are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's documents. A stage's
    folder goes once the next one's is whole; the last one's stays, since the result reads it."""
    docs, last = C.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{C.shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last is not None:
                _remove(spark, last)
            last = path
    return docs
