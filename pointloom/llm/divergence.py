"""Audit of how the sources of a language differ in their use of words.

Terms are runs of letters (A-Z lower-cased) and of characters beyond ASCII. Each language keeps its terms that enough
documents hold. Every (language, source) group, and each language as a whole, gives each kept term a smoothed
probability as an integer, p = 1 + floor(SCALE * (count + ALPHA) / (N + ALPHA * V)), N being the sum of the counts over
the kept terms and V their number. The distance of two sources is the sum of |p - q| over all kept terms.

Count columns are deduplicated: terms of the same sparse vector of (source, count) are one vector with a multiplicity.
Let z be a source's p at count 0. Over the kept terms

    sum |p_a - p_b| = V |z_a - z_b|
                    + sum over a's counts (|p_a - z_b| - |z_a - z_b|)  +  the same for b
                    + sum over vectors that hold both (|p_a - p_b| - |p_a - z_b| - |z_a - p_b| + |z_a - z_b|)

so a pair of sources meets each distinct vector once at most, times its multiplicity, and absent counts cost nothing.

Odd rows: a null text, language or source is an empty one; an empty text has no terms, and its group still occurs;
repeated rows are documents of their own; other columns of the documents, of whatever name, are not read. An empty
table gives no rows. A language that keeps no term has pairs of value 0 and no terms in its result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

ALPHA, SCALE = 5, 1_000_000_000
#: Bytes of text that a task counts at once, and that a longer text is split into; sources of a task's pair sums.
CHUNK, HELD_SOURCES = 24 << 20, 1024

#: Every byte as terms hold it: letters in lower case, bytes beyond ASCII as they are, all others a space.
_AS_TERM = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_TABLE = np.frombuffer(_AS_TERM, np.uint8)
COUNTS = "lang string, source string, term string, n long, docs long"


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of sorted keys, and how often each occurs."""
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys)))


def _count(off: np.ndarray, data: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, count and number of texts of each (group, term) of some texts."""
    data = _TABLE[data]
    inside = data != 32
    first = inside.copy()  # a term begins where no term is before it, or where a text does
    first[1:] &= ~inside[:-1]
    starts = off[:-1][off[:-1] < len(data)]
    first[starts] = inside[starts]
    begins = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = off[1:][(off[1:] > 0)] - 1
    last[ends] = inside[ends]
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - begins)])
    tokens = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    terms = tokens.dictionary_encode()
    codes, n = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(terms.dictionary))
    text = np.repeat(np.arange(len(group)), np.diff(np.searchsorted(begins, off)))
    found, counts = _runs(np.sort(group[text] * n + codes))
    in_text, _ = _runs(np.sort(text * n + codes))
    text, code = np.divmod(in_text, n)
    _, with_term = _runs(np.sort(group[text] * n + code))
    return found // n, terms.dictionary.take(pa.array(found % n)), counts, with_term


def _count_long(data: np.ndarray) -> tuple[pa.Array, list[int], list[int]]:
    """Term, count and 1 of each term of one text, taken in parts that end between terms."""
    text, counter, lo = _TABLE[data].tobytes(), Counter(), 0
    while lo < len(text):
        hi = text.find(b" ", lo + CHUNK) if lo + CHUNK < len(text) else -1
        hi = len(text) if hi < 0 else hi
        counter.update(text[lo:hi].split())
        lo = hi
    return pa.array([t.decode("utf-8", "replace") for t in counter], pa.string()), list(counter.values()), [1] * len(counter)


def term_counts(docs: DataFrame, text: Column, lang: Column, source: Column) -> DataFrame:
    """COUNTS: how often each term occurs in each group, and in how many of its documents. A group also has one row
    whose term is null, so that groups without terms are there."""

    def rows(names: list[tuple[str, str]], group, terms, n, with_term):
        lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(group)) for k in range(2))
        return pa.RecordBatch.from_arrays([lang, source, terms.cast(pa.string()), pa.array(n, pa.int64()), pa.array(with_term, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        seen: dict[tuple[str, str], int] = {}
        for b in batches:
            group = np.array([seen.setdefault(x, len(seen)) for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], np.int64)
            names, (off, data) = list(seen), C.buffers(b.column(0))
            lo = 0
            while lo < len(group):
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, side="right")) - 1)
                part = data[off[lo] : off[hi]]
                if len(part) > CHUNK:
                    terms, n, with_term = _count_long(part)
                    yield rows(names, np.full(len(n), group[lo]), terms, n, with_term)
                else:
                    yield rows(names, *_count(off[lo : hi + 1] - off[lo], part, group[lo:hi]))
                lo = hi
        none = np.zeros(len(seen), np.int64)
        yield rows(list(seen), np.arange(len(seen)), pa.nulls(len(seen), pa.string()), none, none)

    read = C.spread(docs.select(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang"), F.coalesce(source.cast("string"), F.lit("")).alias("source")))
    # Tasks have added up their own rows, so these are dealt out as they are.
    return read.mapInArrow(run, COUNTS).repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + ALPHA) / (total + ALPHA * terms)) of three columns of integers, exactly; null without terms."""
    share = f"CAST(CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + {ALPHA} AS DECIMAL(20,0)) AS DECIMAL(38,0)) div CAST({total} + {ALPHA} * {terms} AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + {share} END")


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of sources that vectors hold together, the sum of the last term of the module's formula over them,
    times their multiplicities. Sums of many vectors are kept until more than HELD_SOURCES sources are met."""
    names = ["lang", "a", "b", "f"]

    def cells(lang, sources, f, rows, columns):
        i, j = np.nonzero(f)
        order = [[sources[k] for k in rows[i]], [sources[k] for k in columns[j]]]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(order[0], pa.string()), pa.array(order[1], pa.string()), pa.array(f[i, j], pa.int64())], names=names)

    held: dict[str, tuple[dict, np.ndarray]] = {}
    for b in batches:
        for lang, m, sources, p, z in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            p, z, t = np.array(p, np.int64), np.array(z, np.int64), len(sources)

            def term(i, j, p=p, z=z, m=m):
                pi, zi, pj, zj = p[i, None], z[i, None], p[None, j], z[None, j]
                return m * (np.abs(pi - pj) - np.abs(pi - zj) - np.abs(zi - pj) + np.abs(zi - zj))

            if t > HELD_SOURCES:  # by tiles, each handed on at once
                for lo in range(0, t, HELD_SOURCES):
                    for lo2 in range(lo, t, HELD_SOURCES):
                        i, j = np.arange(lo, min(t, lo + HELD_SOURCES)), np.arange(lo2, min(t, lo2 + HELD_SOURCES))
                        f = term(i, j)
                        yield cells(lang, sources, np.triu(f, 1) if lo == lo2 else f, i, j)
                continue
            ids, sums = held.get(lang) or ({}, np.zeros((0, 0), np.int64))
            new = [s for s in sources if s not in ids]
            if len(ids) + len(new) > HELD_SOURCES:
                yield cells(lang, list(ids), sums, np.arange(len(ids)), np.arange(len(ids)))
                ids, sums, new = {}, np.zeros((0, 0), np.int64), sources
            if new:
                ids |= {s: len(ids) + k for k, s in enumerate(new)}
                sums = np.pad(sums, (0, len(ids) - len(sums)))
            at = np.array([ids[s] for s in sources])
            f = np.triu(term(np.arange(t), np.arange(t)), 1)
            sums[np.ix_(at, at)] += f
            held[lang] = (ids, sums)
            if len(held) > 64:  # many languages: hand on the first
                first = next(iter(held))
                ids, sums = held.pop(first)
                yield cells(first, list(ids), sums, np.arange(len(ids)), np.arange(len(ids)))
    for lang, (ids, sums) in held.items():
        yield cells(lang, list(ids), sums, np.arange(len(ids)), np.arange(len(ids)))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part pair: every other source of the language by its distance. Part term: the most_terms kept terms that the group
    uses most above the language, by the difference of the two p. Ranks start at 1 for each group and part, values
    descending, equal ones by the item's UTF-8 bytes.
    """
    counts = C.checkpoint(term_counts(docs, docs[text], docs[lang], docs[source]))
    entry = F.struct("source", "n")
    used = counts.where("term IS NOT NULL")
    kept = used.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    terms = used.join(kept.select("lang", "term"), ["lang", "term"], "left_semi")
    terms = C.checkpoint(terms.groupBy("lang", "term").agg(F.sort_array(F.collect_list(entry)).alias("v")))
    # A vector's number stays as it is, since it is written before it is used.
    vectors = C.checkpoint(terms.groupBy("lang", "v").agg(F.count("*").alias("m")).withColumn("vid", F.monotonically_increasing_id()))

    entries = vectors.select("vid", "lang", "m", F.explode("v").alias("e")).select("vid", "lang", "m", "e.source", "e.n")
    totals = entries.groupBy("lang", "source").agg(F.sum(F.expr("m * n")).alias("total"))
    sizes = vectors.groupBy("lang").agg(F.sum("m").alias("n_terms"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "n_terms"])
    groups = C.checkpoint(groups.withColumn("zero", F.lit(0)).withColumn("z", probability("zero", "total", "n_terms")).drop("zero"))

    known = entries.join(groups, ["lang", "source"]).withColumn("p", probability("n", "total", "n_terms"))
    known = C.checkpoint(known.select("vid", "lang", "source", "m", "n", "p", "z"))
    ranked = _pairs(groups, known).unionByName(_terms(groups, known, vectors, terms, most_terms))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def _rank(by: str) -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc(by), F.asc("item"))).cast("int")


def _pairs(groups: DataFrame, known: DataFrame) -> DataFrame:
    """Every other source of a group's language, with the sum over all kept terms."""
    here, there = groups.select("lang", F.col("source").alias("a"), "n_terms", F.col("z").alias("za")), groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"))
    pairs = C.checkpoint(here.join(there, "lang").where("a <> b"))
    base = pairs.where("a < b").select("lang", "a", "b", F.coalesce(F.expr("n_terms * abs(za - zb)"), F.lit(0)).cast("long").alias("f"))
    one = known.groupBy("lang", F.col("source").alias("a"), "p").agg(F.sum("m").alias("m"))
    alone = pairs.join(one, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.expr("m * (abs(p - zb) - abs(za - zb))")).alias("f"))
    alone = alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "f")
    x = F.sort_array(F.collect_list(F.struct("source", "p", "z")))
    together = known.groupBy("vid", "lang", "m").agg(x.alias("x")).where(F.size("x") > 1)
    together = together.select("lang", "m", F.col("x.source").alias("s"), F.col("x.p").alias("p"), F.col("x.z").alias("z"))
    together = together.mapInArrow(_both, "lang string, a string, b string, f long")
    together = together.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "f")
    total = base.union(alone).union(together).groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    out = total.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value", F.lit("pair").alias("part"))
    return out.withColumn("rank", _rank("value"))


def _terms(groups: DataFrame, known: DataFrame, vectors: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """The terms that a group uses most above its language. All terms of a vector have its value, so a vector's
    first `most` terms are all that can have a rank up to `most`."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("n_terms").alias("n_terms"))
    q = vectors.select("vid", "lang", F.expr("aggregate(v, 0L, (s, e) -> s + e.n)").alias("n")).join(whole, "lang")
    q = q.select("vid", probability("n", "total", "n_terms").alias("q"))
    nth = F.row_number().over(Window.partitionBy("lang", "v").orderBy("term"))
    first = terms.withColumn("nth", nth).where(F.col("nth") <= most).join(vectors, ["lang", "v"]).select("vid", F.col("term").alias("item"))
    above = known.join(q, "vid").where("p > q").select("vid", "lang", "source", F.expr("p - q").alias("value")).join(first, "vid")
    return above.drop("vid").withColumn("part", F.lit("term")).withColumn("rank", _rank("value")).where(F.col("rank") <= most)
