"""A quality classifier by Bradley-Terry ranking: scores learnt from pairs of which one text is preferred.

For each pair of a good and a bad text the model has P(good preferred) = sigmoid(w . (x_good - x_bad)), fitted by
logistic loss on feature differences. A text's score is sigmoid((w . x - t) / s), where t is the quantile of the
labelled texts' raw scores below which the share of bad labels lies, and s their spread.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that are learnt from at most; beyond it those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: Pairs for each of the fit's passes.
PAIRS = 60_000
SYMBOLS = b"!#$%&*|<>{}[]/\\=_~^"
CLASSES = 32


def _class_table() -> np.ndarray:
    """The class of each byte: 0 others, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 not ASCII, 7 plain marks, 8 on symbols."""
    t = np.zeros(256, np.uint8)
    t[97:123], t[65:91], t[48:58], t[32], t[10], t[128:] = 1, 2, 3, 4, 5, 6
    t[list(b".,;:?'\"-()")] = 7
    for k, s in enumerate(SYMBOLS):
        t[s] = 8 + k
    return t


TABLE = _class_table()


def features(texts: list[bytes]) -> np.ndarray:
    """A row for each whole text: shares of byte classes, lengths, and how much words and strings repeat."""
    out = np.zeros((len(texts), CLASSES + 8))
    for i, t in enumerate(texts):
        n = len(t)
        if not n:
            continue
        counts = np.bincount(TABLE[np.frombuffer(t, np.uint8)], minlength=CLASSES)[:CLASSES]
        words = t.split()
        lines = t.split(b"\n")
        out[i, :CLASSES] = np.sqrt(counts / n)
        w = max(1, len(words))
        out[i, CLASSES:] = (np.log1p(n), np.log1p(len(words)), n / w / 10, len(set(words)) / w, len(set(lines)) / len(lines), len(zlib.compress(t, 1)) / (n + 20), np.log1p(counts[8:].sum()), np.sqrt(counts[7] / w))
    return out


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, passes: int = 300, seed: int = 5) -> dict:
    """Weights, scaling, threshold and spread, from features and labels (1 preferred to 0)."""
    mean, std = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.clip((x - mean) / std, -6, 6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    model = {"mean": mean, "std": std, "w": np.zeros(x.shape[1]), "t": 0.0, "s": 1.0}
    if not len(good) or not len(bad):  # no pair: every score is 0.5 or follows the only label
        model["t"] = -1.0 if len(good) else (1.0 if len(bad) else 0.0)
        return model
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, m, v = model["w"], np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(1, passes + 1):
        g = -(d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))) / pairs + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    raw = z @ w
    share = len(bad) / len(y)
    order = np.sort(raw)
    k = min(max(round(share * len(y)), 1), len(y) - 1)
    model |= {"w": w, "t": float((order[k - 1] + order[k]) / 2), "s": float(raw.std() / 4 + 1e-9)}
    return model


def apply(model: dict, x: np.ndarray) -> np.ndarray:
    raw = np.clip((x - model["mean"]) / model["std"], -6, 6) @ model["w"]
    return 1 / (1 + np.exp(-np.clip((raw - model["t"]) / model["s"], -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str, text_col: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled texts that keep (a condition on the id) admits, `rows` of them at most."""
    own = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("quality")).where(F.col("l_id").isNotNull() & F.col("quality").isin(0, 1))
    own = own.groupBy("l_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("least")).where("quality = least").drop("least")
    own = own.withColumnRenamed("l_id", id_col).where(keep).withColumnRenamed(id_col, "l_id")
    sample = own.orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), F.col("id") == F.col("l_id")).select("quality", "text")  # `rows` at most

    def run(batches):
        for b in batches:
            off, data = C.buffers(b.column(1))
            x = features([data[off[i] : off[i + 1]].tobytes() for i in range(b.num_rows)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["quality", "x"])

    got = joined.mapInArrow(run, "quality int, x array<float>").orderBy(F.xxhash64("x"), "quality").limit(rows).toArrow()  # an id may repeat in docs
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, CLASSES + 8)
    y = np.array(got.column("quality").to_pylist(), dtype=np.int64)
    order = np.lexsort((*x.T, y))  # the same fit in whatever order rows arrive
    return x[order], y[order]


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", pass_on: tuple[str, ...] = ()) -> DataFrame:
    """score (0 to 1) and predicted (1 if score is 0.5 or more) of each whole text, with id_col and the columns pass_on.

    A null text counts as empty and gets a score too. Nothing but the text is read for a score. Rows with null or
    repeated ids keep rows of their own; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [id_col, *(c for c in pass_on if c not in (id_col, text_col))]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                off, data = C.buffers(b.column(b.num_columns - 1))
                s = apply(shared.value, features([data[off[i] : off[i + 1]].tobytes() for i in range(b.num_rows)]))
                rest = b.columns if text_col in pass_on else b.columns[:-1]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*(f"c{k}" for k in range(len(rest))), "score", "predicted"])

    docs = C.spread(docs)
    picked = docs.select(*(docs[c] for c in columns), docs[text_col].cast("string").alias(text_col))
    kept = picked if text_col in pass_on else picked.drop(text_col)
    kinds = ", ".join(f"c{k} {t}" for k, (_, t) in enumerate(kept.dtypes))
    out = picked.mapInArrow(run, f"{kinds}, score double, predicted int")
    return out.toDF(*kept.columns, "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_on: tuple[str, ...] = (), rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learns from the labelled texts whose crc32 of the id, modulo 3, is not 1, and scores every text: id_col, pass_on,
    held_out, score, predicted. Labels with a null, with a value other than 0 and 1, or that contradict each other for
    one id, are not learnt from; without a label of each kind every text gets the only kind's score, or 0.5."""
    x, y = labelled(docs, labels, C.remainder(F.col(id_col), 3) != 1, id_col, text_col, rows)
    out = score(docs, fit(x, y), id_col, text_col, pass_on)
    return out.withColumn("held_out", C.remainder(F.col(id_col), 3) == 1)
