"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read in segments of SEGMENT bytes, all of them; A-Z count as a-z. At each byte a forward and a backward GRU
have a state each, and a softmax over both labels that position with a language. A text's probabilities are the mean
over its positions. The network is trained in numpy by backpropagation through time, with Adam.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SEGMENT = 64
HIDDEN = 8
#: Labelled texts that are learnt from at most, and their bytes, the same share of each language: those with the smallest
#: hashes, each text whole; one that alone exceeds its language's share of the bytes is not learnt from.
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 10 << 20
#: Ranges of the hash that texts are counted by, to find where a language's sample ends.
RANGES = 4096
#: Batches at least; more if it takes more until every segment of the sample was read.
STEPS = 700
BATCH = 256
UND = "und"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def segments(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text's bytes in rows of SEGMENT, 0 beyond the end; each row's text, and its number of bytes."""
    n = np.diff(off)
    rows = -(-n // SEGMENT)
    of = np.repeat(np.arange(len(n)), rows)
    k = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
    begin, size = off[of] + k * SEGMENT, np.minimum(SEGMENT, n[of] - k * SEGMENT)
    padded = np.concatenate([LOWER[data], np.zeros(SEGMENT, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(padded, SEGMENT)[begin] if len(of) else np.zeros((0, SEGMENT), np.uint8)
    short = np.flatnonzero(size < SEGMENT)
    x[short] *= np.arange(SEGMENT)[None, :] < size[short, None]
    return x, of, size


class Network:
    """Two GRUs, of which one reads backward, and a softmax at each position.

    Of each direction: e (256, 3, H) the input's share in update gate, reset gate and candidate; u (3, H, H) the
    state's. Gates are written as (1 + tanh(a / 2)) / 2.
    """

    def __init__(self, languages: int, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p[f"e{d}"] = rng.normal(0, 0.3, (3, 256, hidden)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, 0.4 / np.sqrt(hidden), (3, hidden, hidden)).astype(np.float32)
        self.p["w"] = rng.normal(0, 0.3, (2 * hidden, languages)).astype(np.float32)
        self.p["c"] = np.zeros(languages, np.float32)

    def _states(self, x: np.ndarray, d: str, keep: bool):
        """States (T, N, H) of one direction; x: (T, N). keep: also what the gradient needs."""
        e, u = self.p[f"e{d}"], self.p[f"u{d}"]
        steps, n = x.shape
        out = np.empty((steps, n, self.h), np.float32)
        h, memo = np.zeros((n, self.h), np.float32), []
        half = np.float32(0.5)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = e[0][x[t]]
            z += h @ u[0]
            z *= half
            np.tanh(z, out=z)
            z += 1
            z *= half
            r = e[1][x[t]]
            r += h @ u[1]
            r *= half
            np.tanh(r, out=r)
            r += 1
            r *= half
            q = r * h
            c = e[2][x[t]]
            c += q @ u[2]
            np.tanh(c, out=c)
            if keep:
                memo.append((t, h, z, r, c, q))
            new = c - h
            new *= z
            new += h
            h = new
            out[t] = h
        return out, memo

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(N, T) bytes to (N, T, languages)."""
        xt = np.ascontiguousarray(x.T)
        s = np.concatenate([self._states(xt, d, False)[0] for d in "fb"], axis=2)
        a = s.reshape(-1, 2 * self.h) @ self.p["w"]
        a += self.p["c"]
        a -= a.max(1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(1, keepdims=True)
        return a.reshape(*xt.shape, -1).transpose(1, 0, 2)

    def gradient(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[float, dict]:
        """The mean loss over the positions of the segments, and its gradient."""
        xt = np.ascontiguousarray(x.T)
        (f, mf), (b, mb) = self._states(xt, "f", True), self._states(xt, "b", True)
        s = np.concatenate([f, b], axis=2)
        a = s @ self.p["w"] + self.p["c"]
        a -= a.max(2, keepdims=True)
        prob = np.exp(a)
        prob /= prob.sum(2, keepdims=True)
        mask = (np.arange(xt.shape[0])[:, None] < size[None, :]).astype(np.float32)
        total = mask.sum()
        loss = float(-(np.log(prob[:, np.arange(len(y)), y] + 1e-12) * mask).sum() / total)
        da = prob
        da[:, np.arange(len(y)), y] -= 1
        da *= (mask / total)[:, :, None]
        g = {"w": s.reshape(-1, 2 * self.h).T @ da.reshape(-1, da.shape[2]), "c": da.sum((0, 1))}
        ds = da @ self.p["w"].T
        for d, memo, own in (("f", mf, ds[:, :, : self.h]), ("b", mb, ds[:, :, self.h :])):
            u = self.p[f"u{d}"]
            ge, gu = np.zeros_like(self.p[f"e{d}"]), np.zeros_like(u)
            dh = np.zeros((xt.shape[1], self.h), np.float32)
            pre = np.empty((3, *own.shape), np.float32)
            for t, h, z, r, c, q in reversed(memo):
                dh = dh + own[t]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                dq = dc @ u[2].T
                dr = dq * h * r * (1 - r)
                pre[0, t], pre[1, t], pre[2, t] = dz, dr, dc
                gu[0] += h.T @ dz
                gu[1] += h.T @ dr
                gu[2] += q.T @ dc
                dh = dh * (1 - z) + dq * r + dz @ u[0].T + dr @ u[1].T
            flat = xt.ravel()
            for k in range(3):
                for j in range(self.h):
                    ge[k, :, j] = np.bincount(flat, pre[k, :, :, j].ravel(), minlength=256)
            g[f"e{d}"], g[f"u{d}"] = ge, gu
        return loss, g


def train(x: np.ndarray, y: np.ndarray, size: np.ndarray, languages: int, steps: int = STEPS, seed: int = 3) -> Network:
    """Adam on batches of segments in which each language has the same share. A language's segments come in one
    random order, over and over, and batches go on until all were read."""
    net, rng = Network(languages, seed=seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    of = [own for k in range(languages) if len(own := rng.permutation(np.flatnonzero(y == k)))]
    share = BATCH // languages + 1
    steps = max(steps, *(-(-len(own) // share) for own in of)) if of else 0
    for step in range(1, steps + 1):
        pick = np.concatenate([np.take(own, np.arange((step - 1) * share, step * share), mode="wrap") for own in of])
        _, g = net.gradient(x[pick], y[pick], size[pick])
        norm = np.sqrt(sum(float((w.astype(np.float64) ** 2).sum()) for w in g.values()))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, w in g.items():
            w = w * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * w
            v[k] = 0.99 * v[k] + 0.01 * w * w
            net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, steps: int = STEPS, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], Network | None]:
    """Languages and a network, from texts with a language whose crc32 of the id, modulo 3, is not 1: of each language
    its share of `rows` and of `sample_bytes` at most, with all their segments. The sampled texts are held by the driver.
    A language whose every text exceeds its share of the bytes is not learnt; without any, no language and no network."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    fit = own.where((C.remainder(F.col("id"), 3) != 1) & F.col("text").isNotNull() & (F.col("text") != "") & F.col("lang").isNotNull())
    fit = fit.withColumn("hash", F.xxhash64("id", "text")).withColumn("range", F.pmod("hash", F.lit(RANGES)))
    counts = fit.groupBy("lang", "range").agg(F.count("*").alias("n"))
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not names:
        return [], None
    most, share = max(1, rows // len(names)), sample_bytes // len(names)
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("range")) - F.col("n")
    ends = counts.withColumn("before", before).where(F.col("before") < most).groupBy("lang").agg(F.max("range").alias("end"))
    near = fit.join(F.broadcast(ends), "lang").where("range <= end")  # a language has one row in ends
    near = near.where(F.octet_length("text") <= share)
    order = Window.partitionBy("lang").orderBy("range", "hash", "id", "text")
    first = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("rank"))
    got = first.withColumn("so_far", so_far).where(F.col("so_far") <= share).select("lang", "text").toArrow()
    got = got.sort_by([("lang", "ascending"), ("text", "ascending")])  # the same network in whatever order rows arrive
    names = sorted(set(got.column("lang").to_pylist()))
    if not names:
        return [], None
    x, of, size = segments(*C.buffers(got.column("text")))
    y = np.array([names.index(k) for k in got.column("lang").to_pylist()])[of]
    return names, train(x, y, size, len(names), steps)


def label(net: Network, off: np.ndarray, data: np.ndarray, block: int = 2048) -> np.ndarray:
    """Mean over its positions of the probabilities of each text; an empty text's are even."""
    x, of, size = segments(off, data)
    total = np.zeros((len(off) - 1, len(net.p["c"])))
    for lo in range(0, len(of), block):
        p = net.probabilities(x[lo : lo + block])
        p = p * (np.arange(SEGMENT)[None, :] < size[lo : lo + block, None])[:, :, None]
        np.add.at(total, of[lo : lo + block], p.sum(1))
    n = total.sum(1, keepdims=True)
    return np.where(n > 0, total / np.maximum(n, 1e-30), 1 / total.shape[1])


def has_letter(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    plain = np.diff(np.concatenate([[0], np.cumsum(LETTER[data])])[off]) > 0
    for i in np.flatnonzero(~plain):
        plain[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "ignore"))
    return plain


def identify(docs: DataFrame, languages: list[str], net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score (its probability) of each whole text, read from the text alone.

    A text that is null or has no letter is `und`, with score 0, as is every text without a network. Rows keep their
    number, whether ids repeat or are null; an empty table gives an empty one; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast((languages, net))

    def run(batches):
        names, own = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                off, data = C.buffers(b.column(1))
                known = has_letter(off, data) if own else np.zeros(b.num_rows, bool)
                p = label(own, off, data) if own else np.zeros((b.num_rows, 1))
                pred = [names[k] if ok else UND for k, ok in zip(p.argmax(1), known, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, p.max(1), 0.0))], names=["id", "lang_pred", "score"])

    rows = C.spread(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
