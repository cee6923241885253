"""Learnt operators against plain Python: the network position by position, the ranking pair by pair, features value by value."""

import math
import zlib

import numpy as np
import pytest

from pointloom.llm import langid, media, quality


def sigmoid(a):
    return 1 / (1 + math.exp(-a))


def plain_states(net, segment, d):
    e, u = net.p[f"e{d}"].astype(float), net.p[f"u{d}"].astype(float)
    h, out = [0.0] * net.h, {}
    for t in range(len(segment)) if d == "f" else range(len(segment) - 1, -1, -1):
        c = segment[t]
        gate = lambda k, s: [e[k][c][j] + sum(s[i] * u[k][i][j] for i in range(net.h)) for j in range(net.h)]  # noqa: B023, E731
        z, r = [sigmoid(a) for a in gate(0, h)], [sigmoid(a) for a in gate(1, h)]
        new = [math.tanh(a) for a in gate(2, [r[j] * h[j] for j in range(net.h)])]
        h = [h[j] + z[j] * (new[j] - h[j]) for j in range(net.h)]
        out[t] = h
    return out


def plain_label(net, text):
    """The mean of the labels' probabilities over a text's positions, in segments that end in zeros."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
    total, n = [0.0] * len(net.p["c"]), 0
    for at in range(0, len(low), langid.SEGMENT):
        segment = low[at : at + langid.SEGMENT].ljust(langid.SEGMENT, b"\0")
        f, b = plain_states(net, segment, "f"), plain_states(net, segment, "b")
        for t in range(min(langid.SEGMENT, len(low) - at)):
            s = f[t] + b[t]
            a = [float(net.p["c"][k]) + sum(x * float(net.p["w"][i][k]) for i, x in enumerate(s)) for k in range(len(total))]
            e = [math.exp(x - max(a)) for x in a]
            total = [x + y / sum(e) for x, y in zip(total, e, strict=True)]
            n += 1
    return [x / n for x in total] if n else [1 / len(total)] * len(total)


def test_labels_equal_a_plain_network(spark):
    net = langid.Network(3, 4, seed=1)
    texts = ["Some words, and then MORE of them; over one segment's end and a little farther on.", "", "x", "été là-bas", "?!", None]
    raw = [(t or "").encode() for t in texts]
    got = langid.label(net, np.concatenate([[0], np.cumsum([len(t) for t in raw])]), np.frombuffer(b"".join(raw), np.uint8))
    for k, t in enumerate(raw):
        assert got[k].tolist() == pytest.approx(plain_label(net, t), abs=1e-5)
    rows = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["a", "b", "c"], net).collect()
    for r in rows:
        p = plain_label(net, raw[r["doc_id"]])
        letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert r["lang_pred"] == ("abc"[p.index(max(p))] if letters else "und")
        assert r["score"] == pytest.approx(max(p) if letters else 0.0, abs=1e-5)


def test_ties_of_languages_are_the_first():
    net = langid.Network(2, 2)
    net.p["w"][:], net.p["c"][:] = 0, 0
    assert langid.label(net, np.array([0, 3]), np.frombuffer(b"abc", np.uint8)).argmax(1).tolist() == [0]


def plain_features(t):
    n = len(t)
    if not n:
        return [0.0] * (quality.CLASSES + 8)

    def kind(c):
        if chr(c) in ".,;:?'\"-()":
            return 7
        if c in quality.SYMBOLS:
            return 8 + quality.SYMBOLS.index(c)
        return 6 if c >= 128 else 1 if chr(c).islower() else 2 if chr(c).isupper() else 3 if chr(c).isdigit() else 4 if c == 32 else 5 if c == 10 else 0

    count = [0] * quality.CLASSES
    for c in t:
        count[kind(c)] += 1
    words, lines = t.split(), t.split(b"\n")
    w = max(1, len(words))
    return [math.sqrt(c / n) for c in count] + [math.log1p(n), math.log1p(len(words)), n / w / 10, len(set(words)) / w, len(set(lines)) / len(lines), len(zlib.compress(t, 1)) / (n + 20), math.log1p(sum(count[8:])), math.sqrt(count[7] / w)]


def plain_fit(x, y, pairs, passes, seed):
    """Bradley-Terry by pairs, one after another: logistic loss on the difference of features, with Adam."""
    columns = list(zip(*x, strict=True))
    mean = [sum(c) / len(c) for c in columns]
    std = [math.sqrt(sum((v - m) ** 2 for v in c) / len(c)) + 1e-6 for c, m in zip(columns, mean, strict=True)]
    z = [[min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip(r, mean, std, strict=True)] for r in x]
    rng = np.random.default_rng(seed)
    good, bad = ([k for k, v in enumerate(y) if v == want] for want in (1, 0))
    chosen = list(zip(rng.choice(good, pairs).tolist(), rng.choice(bad, pairs).tolist(), strict=True))
    w, m, v = ([0.0] * len(mean) for _ in range(3))
    for k in range(1, passes + 1):
        g = [1e-3 * a for a in w]
        for a, b in chosen:
            d = [p - q for p, q in zip(z[a], z[b], strict=True)]
            weight = 1 - sigmoid(sum(p * q for p, q in zip(d, w, strict=True)))
            g = [p - weight * q / pairs for p, q in zip(g, d, strict=True)]
        m = [0.9 * p + 0.1 * q for p, q in zip(m, g, strict=True)]
        v = [0.999 * p + 0.001 * q * q for p, q in zip(v, g, strict=True)]
        w = [p - 0.05 * (a / (1 - 0.9**k)) / (math.sqrt(b / (1 - 0.999**k)) + 1e-8) for p, a, b in zip(w, m, v, strict=True)]
    raw = sorted(sum(p * q for p, q in zip(r, w, strict=True)) for r in z)
    k = min(max(round(len(bad)), 1), len(y) - 1)
    mid = sum(raw) / len(raw)
    spread = math.sqrt(sum((r - mid) ** 2 for r in raw) / len(raw)) / 4 + 1e-9
    return lambda r: sigmoid((sum(min(6.0, max(-6.0, (p - a) / s)) * q for p, a, s, q in zip(r, mean, std, w, strict=True)) - (raw[k - 1] + raw[k]) / 2) / spread)


def test_quality_equals_a_plain_ranking(spark):
    rng = np.random.default_rng(3)
    words = ["river", "stone", "light", "of", "the", "and", "walks"]
    good = [f"The {' '.join(rng.choice(words, 20))}. It {' '.join(rng.choice(words, 9))}." for _ in range(20)]
    bad = ["".join(chr(c) for c in rng.choice(list(b"#$%& x1\n"), 80)) for _ in range(20)]
    texts = [*good, *bad, "", "Été, là-bas!"]
    x = quality.features([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert x[k].tolist() == pytest.approx(plain_features(t.encode()), abs=1e-9)
    y = [1] * 20 + [0] * 20
    score = plain_fit(x[:40].tolist(), y, 50, 12, 5)
    model = quality.fit(x[:40], np.array(y), pairs=50, passes=12)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k in range(len(texts)):
        assert got[k][0] == pytest.approx(score(x[k].tolist()), abs=1e-6) and got[k][1] == (got[k][0] >= 0.5)


def test_labelled_rows_are_bounded_where_ids_repeat(spark):
    from pyspark.sql import functions as F

    docs = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    x, y = quality.labelled(docs, labels, F.lit(True), "doc_id", "text", 50)
    assert len(x) == len(y) == 50


def test_media_feature_equals_plain_sums():
    for p in (b" " * 192, bytes(range(192)), b"some text".ljust(384)):
        mean = sum(p) / len(p)
        share = [p.count(v) / len(p) for v in set(p)]
        std = math.sqrt(sum((v - mean) ** 2 for v in p) / len(p))
        step = sum(abs(a - b) for a, b in zip(p, p[1:])) / len(p)  # noqa: B905
        entropy = -sum(s * math.log2(s) for s in share)
        got = dict(x.split("=") for x in media.feature(p).split(";"))
        assert {k: float(v) for k, v in got.items()} == pytest.approx({"mean": mean, "std": std, "entropy": entropy, "step": step}, abs=1e-4)
