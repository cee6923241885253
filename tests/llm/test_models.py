"""Learnt models: gradients, held-out accuracy, and scores against plain versions."""

import collections
import math
import zlib

import duckdb
import numpy as np
import pytest

from pointloom.llm import common as C
from pointloom.llm import langid, pst, quality, queries
from tests.llm import cases

DATA = "/root/testdata/sf0.01"


def shard(docs):
    t = [x.encode() for _, x in docs]
    return C.Shard(np.array([i for i, _ in docs]), np.zeros(len(t), bool), np.concatenate([[0], np.cumsum([len(x) for x in t])]), np.frombuffer(b"".join(t), np.uint8))


def held_out(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


def test_quality_on_held_out_labels(spark):
    out = queries.op10_quality(spark, DATA).toPandas().set_index("doc_id")
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").df().set_index("doc_id").join(out)
    assert all(h == held_out(i, 3, 1) for i, h in out["held_out"].items())
    assert ((out["score"] >= 0.5).astype(int) == out["predicted"]).all() and out["score"].between(0, 1).all()
    own = labels[labels["held_out"]]
    assert (own["quality"] == own["predicted"]).mean() > 0.97


def test_quality_without_pairs():
    x = quality.features([b"a", b"", b"b c"])
    assert (quality.apply(quality.fit(x[:0], np.zeros(0)), x) == 0.5).all()
    assert (quality.apply(quality.fit(x, np.ones(3)), x) > 0.5).all()
    assert (quality.apply(quality.fit(x, np.zeros(3)), x) < 0.5).all()


def test_network_gradient():
    net = langid.Network(3, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y, size = rng.integers(97, 100, (5, 6)).astype(np.uint8), rng.integers(0, 3, 5), np.array([6, 3, 6, 1, 5])
    _, g = net.gradient(x, y, size)
    for k, p in net.p.items():
        i = (1, 98, 2) if k[0] == "e" else tuple(rng.integers(0, s) for s in p.shape)
        at = p[i]
        p[i] = at + 1e-3
        up = net.gradient(x, y, size)[0]
        p[i] = at - 1e-3
        down = net.gradient(x, y, size)[0]
        p[i] = at
        assert abs((up - down) / 2e-3 - g[k][i]) < 1e-3 * max(1, abs(g[k][i])), k


def test_language_on_held_out_texts(spark):
    out = queries.op8_language(spark, DATA).toPandas().set_index("doc_id")
    lang = duckdb.sql(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet'").df().set_index("doc_id").join(out)
    own = lang[lang["held_out"]]
    assert len(own) > 200 and (own["lang"] == own["lang_pred"]).mean() > 0.97


def test_language_of_odd_texts(spark):
    names, net = langid.learn(spark.read.parquet(f"{DATA}/documents.parquet"), rows=200, steps=20)
    got = {(r["doc_id"], r["lang_pred"] == "und", r["score"]) for r in langid.identify(cases.table(spark), names, net).collect()}
    assert {(4, True, 0.0), (5, True, 0.0), (10, True, 0.0)} <= got and all(not u for i, u, _ in got if i in (3, 6, 7, 9))
    assert langid.learn(cases.empty(spark)) == ([], None)


def test_languages_are_learnt_from_whole_texts_of_each(spark, monkeypatch):
    docs = [(k, f"a text of number {k} " * 20, "en") for k in range(3000)]
    docs += [(k, f"ein seltener Text {k} " * 30, "de") for k in range(5000, 5008)] + [(None, "x", None), (6000, "", "fr")]
    held = {}
    monkeypatch.setattr(langid, "train", lambda x, y, size, languages, steps: held.update(x=x, y=y, size=size))
    names, _ = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5), rows=40)
    assert names == ["de", "en"]
    whole = {t.lower().encode(): lang for i, t, lang in docs if lang and t and not held_out(i, 3, 1)}
    ends = np.flatnonzero(held["size"] < langid.SEGMENT)  # no text fills its last segment
    assert all(len(t) % langid.SEGMENT for t in whole)
    texts = [held["x"][a + 1 : z + 1].tobytes()[: (z - a - 1) * langid.SEGMENT + held["size"][z]] for a, z in zip([-1, *ends[:-1]], ends, strict=True)]
    got = collections.Counter(whole[t] for t in texts)
    assert got == {"en": 20, "de": sum(lang == "de" for lang in whole.values())} and got["de"] > 0


def test_every_segment_is_learnt_from(monkeypatch):
    rng = np.random.default_rng(1)
    x, size = rng.integers(97, 123, (5000, langid.SEGMENT)).astype(np.uint8), np.full(5000, langid.SEGMENT)
    x[:, :4] = np.arange(5000, dtype=np.uint32).view(np.uint8).reshape(-1, 4)
    seen = []

    def gradient(self, x, y, size):
        seen.append(np.ascontiguousarray(x[:, :4]).view(np.uint32)[:, 0])
        return 0.0, {k: np.zeros_like(v) for k, v in self.p.items()}

    monkeypatch.setattr(langid.Network, "gradient", gradient)
    langid.train(x, (np.arange(5000) < 300).astype(int), size, 2, steps=3)
    assert len(np.unique(np.concatenate(seen))) == 5000 and len(seen) == -(-4700 // (langid.BATCH // 2 + 1))


def test_the_sample_of_languages_is_bounded_in_bytes(spark, monkeypatch):
    docs = [(k, "abcdefg " * (10 + k % 7), "en") for k in range(300)] + [(k, "x " * 50_000, "long") for k in range(300, 340)] + [(k, "ein Text ", "de") for k in range(400, 440)]
    held = {}
    monkeypatch.setattr(langid, "train", lambda x, y, size, languages, steps: held.update(y=y, size=size))
    names, _ = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"), sample_bytes=6000)
    assert names == ["de", "en"] and 1500 < held["size"][held["y"] == 1].sum() <= 2000 and held["size"][held["y"] == 0].sum() <= 2000


def test_segments_cover_all_bytes():
    s = shard([(1, "abc"), (2, ""), (3, "X" * 200), (4, "y" * 64)])
    x, of, size = langid.segments(s.off, s.data)
    assert of.tolist() == [0, 2, 2, 2, 2, 3] and size.tolist() == [3, 64, 64, 64, 8, 64]
    assert bytes(x[of == 2].ravel()[:200]) == b"x" * 200 and not x[4][8:].any()


def plain_tree(docs, depth, least, gain, pull, evidence):
    """The tree as dictionaries: of each retained context its distribution, and a function that scores a text."""
    n = collections.defaultdict(collections.Counter)
    total = 0
    for t in docs:
        s = [pst.PAD] * depth + list(t.lower()) + [pst.END]
        for i in range(depth, len(s)):
            total += 1
            for d in range(depth + 1):
                n[tuple(s[i - d : i])][s[i]] += 1
    seen = sorted(n[()])
    others = 257 - len(seen)
    col = {c: k for k, c in enumerate(seen)}
    width = len(seen) + 1
    base = np.array([0.5] * len(seen) + [0.5 * max(others, 1)])
    for c, k in n[()].items():
        base[col[c]] += k
    tree = {(): base / base.sum()}
    for d in range(1, depth + 1):
        new = {}
        for c in [c for c in n if len(c) == d and sum(n[c].values()) >= least * total]:
            parent = next(tree[c[k:]] for k in range(1, d + 1) if c[k:] in tree)
            own = np.zeros(width)
            for x, k in n[c].items():
                own[col[x]] += k
            p = (own + pull * parent) / (own.sum() + pull)
            apart = float((p * np.log(p / parent)).sum())
            if apart >= gain and apart * own.sum() >= evidence:
                new[c] = p
        tree |= new

    def score(t):
        s, out = [pst.PAD] * depth + list(t.lower()) + [pst.END], 0.0
        for i in range(depth, len(s)):
            c = tuple(s[i - depth : i])
            p = next(tree[c[k:]] for k in range(depth + 1) if c[k:] in tree)
            out += math.log10(p[col.get(s[i], width - 1)] / (max(others, 1) if s[i] not in col else 1))
        return out

    return tree, score


def test_automaton_equals_the_plain_tree():
    docs = [t.encode() for (t,) in duckdb.sql(f"SELECT substr(text, 1, 400) FROM '{DATA}/documents.parquet' LIMIT 60").fetchall()]
    depth = 3
    s = shard([(k, t.decode("utf-8", "ignore")) for k, t in enumerate(docs)])
    code, n = pst.gram_counts(s, np.arange(len(s)), depth)
    counts, total = [], n.sum()
    for d in range(depth + 1):
        c, inverse = np.unique(code & np.uint64((1 << (9 * (d + 1))) - 1), return_inverse=True)
        m = np.bincount(inverse, n).astype(np.int64)
        if d:
            _, of = np.unique(c >> np.uint64(9), return_inverse=True)
            keep = np.bincount(of, m)[of] >= 0.001 * total
            c, m = c[keep], m[keep]
        counts.append((c, m))
    model = pst.build(counts, 0.01, 5.0, 3.0)
    tree, score = plain_tree([s.text(k) for k in range(len(s))], depth, 0.001, 0.01, 5.0, 3.0)
    assert len(tree) > 50
    test = shard([(1, "A new text, with qqqq ~ and \u0000 漢字"), (2, ""), (3, docs[0].decode("utf-8", "ignore") * 3)])
    got = pst.score(model, test)
    for k in range(3):
        assert got[k] == pytest.approx(score(test.text(k)), rel=1e-4), k


def test_rare_contexts_count_in_large_corpora(spark, monkeypatch):
    monkeypatch.setattr(pst, "COUNT_BYTES", 300_000)
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 12, rng.integers(2, 7))) for _ in range(300)]
    docs = [(k, " ".join(words[w] for w in rng.integers(0, 300, 15_000))) for k in range(60)]
    docs += [(k, "zqxvyw") for k in range(100, 140)]  # less than 1/100,000 of all positions, and yet evident
    s = shard(docs)
    train = ~pst.held_out(s.ids)
    code, n = pst.gram_counts(s, np.flatnonzero(train), pst.DEPTH)
    assert 20 < train[60:].sum() < 1e-5 * n.sum()
    counts = []
    for d in range(pst.DEPTH + 1):
        c, inverse = np.unique(code & np.uint64((1 << (9 * (d + 1))) - 1), return_inverse=True)
        counts.append((c, np.bincount(inverse, n).astype(np.int64)))
    want = pst.score(pst.build(counts), s)
    got = {r["doc_id"]: r["score"] for r in pst.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in docs] == pytest.approx(want.tolist(), rel=1e-4)
    assert got[100] > -12


def test_scores_equal_the_plain_tree(spark):
    docs = duckdb.sql(f"SELECT doc_id, substr(text, 1, 400) FROM '{DATA}/documents.parquet' LIMIT 120").fetchall()
    docs += [(900_001, ""), (900_002, None), (900_003, "qqqq ~ and \u0000 漢字 Z")]
    raw = {i: (t or "").encode() for i, t in docs}
    tree, score = plain_tree([t for i, t in raw.items() if not held_out(i, 7, 2)], 4, 0, pst.GAIN, pst.PULL, pst.EVIDENCE)
    assert len(tree) > 100
    for r in pst.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), depth=4).collect():
        assert r["score"] == pytest.approx(score(raw[r["doc_id"]]), rel=1e-5), r["doc_id"]


@pytest.mark.parametrize("hot", [1, 8, 5000])
def test_scores_do_not_depend_on_which_contexts_are_hot(spark, monkeypatch, hot):
    monkeypatch.setattr(pst, "HINT", 500)
    docs = duckdb.sql(f"SELECT doc_id, substr(text, 1, 300) FROM '{DATA}/documents.parquet' LIMIT 150").fetchall()
    raw = {i: (t or "").encode() for i, t in docs}
    _, score = plain_tree([t for i, t in raw.items() if not held_out(i, 7, 2)], 5, 0, pst.GAIN, pst.PULL, pst.EVIDENCE)
    for r in pst.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), depth=5, hot=hot).collect():
        assert r["score"] == pytest.approx(score(raw[r["doc_id"]]), rel=1e-5), r["doc_id"]


def test_no_group_depends_on_one_pair_of_symbols():
    rng = np.random.default_rng(2)
    s = shard([(k, "e " * 3 + "".join(chr(97 + c) for c in rng.integers(0, 20, 12)) + " the theme ") for k in range(3000)])
    code = np.unique(pst._codes(pst.symbols(s, np.arange(len(s)), pst.DEPTH)[0], pst.DEPTH))
    context = code >> np.uint64(pst.BITS)
    pair = np.unique(context & np.uint64((1 << 18) - 1), return_counts=True)
    hot = [np.unique(x)[np.unique(x, return_counts=True)[1] * 200 >= len(x)] for x in (context & np.uint64((1 << 9 * d) - 1) for d in range(2, pst.DEPTH))]
    ends = pst.Ends([pst.Known(x) for x in hot])
    by = ends.lengths(code)
    end = context & np.array([(1 << 9 * int(d)) - 1 for d in by], np.uint64)
    largest = np.unique(np.stack([end, by.astype(np.uint64)]), axis=1, return_counts=True)[1].max()
    assert pair[1].max() > 0.02 * len(code) and largest <= 0.005 * len(code) + 1
    order, cut, _ = ends.dealt(code, 50)
    assert sorted(order.tolist()) == list(range(len(code))) and cut[-1] == len(code)


def test_base_scores(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    words = {i: [*t.encode().lower().split(), None] for i, t in docs}
    count = collections.Counter(w for i, ws in words.items() if not held_out(i, 7, 2) for w in ws)
    n, v = sum(count.values()), len(count)
    for r in queries.op7_suffix_tree(spark, DATA).collect():
        ws = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out(r["doc_id"], 7, 2), len(ws), sum(count[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
        assert r["score"] < 0
