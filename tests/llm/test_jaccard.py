import random

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import jaccard as J
from pointloom.llm.components import connected
from tests.llm import cases


def sets_of(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, threshold=0.8):
    s = {i: sets_of(t) for i, t in docs}
    links = {i: [j for j in s if j != i and s[i] and s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j]) - 1e-9] for i in s}
    root = {}
    for i in sorted(s):
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += links[k]
    return {i: (root[i], len(links[i])) for i in s}


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = []
    for _ in range(6):
        base = rng.choices(vocabulary, k=rng.choice([4, 30, 120, 300]))
        for _ in range(rng.randint(1, 30)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            docs.append((len(docs), ", ".join(t).title() if rng.random() < 0.1 else " ".join(t)))
    return docs


def test_equals_brute_force_with_any_tiles(spark):
    docs = near_copies(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs)
    for limits in ({}, {"node_rows": 2, "tile_rows": 4, "tile_shingles": 300}):
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.join(df, **limits).collect()}
        assert got == want
    kept = sorted(r["doc_id"] for r in J.keep_one(df).collect())
    assert kept == sorted({c for c, _ in want.values()})


def test_keep_one_keeps_what_links_to_nothing(spark):
    docs = cases.table(spark)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in kept.collect())
    want = sorted((i if i is not None else -1, t or "") for i, t in cases.TEXTS if (i, t) not in (cases.TEXTS[0], cases.TEXTS[2]))
    assert got == want
    assert J.keep_one(cases.empty(spark)).count() == 0


def test_prefix_is_shortened_until_the_recall():
    assert J.prefix_for(0.8, 20, 5, 0.999999) == 3
    assert J.prefix_for(0.8, 20, 5, 0.5) == 5
    assert J.prefix_for(0.1, 2, 5, 0.999999) == 1


def test_words_do_not_run_over_a_text_end():
    a = [b"ab cd", b"ef", b"", b"gh ij"]
    off = np.concatenate([[0], np.cumsum([len(x) for x in a])])
    h, at = J.word_hashes(np.frombuffer(b"".join(a), np.uint8), off)
    assert at.tolist() == [0, 2, 3, 3, 5]
    alone = [J.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] for w in (b"ab", b"cd", b"ef", b"gh", b"IJ")]
    assert h.tolist() == alone


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5400)] + [(7, 7), (7, None)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            group[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in group}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_edges(path, sig, least):
    """Of each depth, the candidate pairs: those of a node that are NEAR alike."""
    n = len(path)
    out = {}
    for d in range(path.shape[1], least - 1, -1):
        out[d] = {(i, j) for i in range(n) for j in range(i + 1, n) if (path[i, :d] == path[j, :d]).all() and (sig[i] == sig[j]).mean() >= J.NEAR}
    return out


def components(pairs, n):
    label = list(range(n))
    for i, j in pairs:
        a, b = label[i], label[j]
        label = [b if x == a else x for x in label]
    return {frozenset(k for k in range(n) if label[k] == x) for x in label}


def test_a_node_connects_the_candidates_of_each_depth():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        sig = np.repeat(rng.integers(0, 9, (12, 100)), 8, axis=0)
        sig = np.where(rng.random(sig.shape) < 0.3, rng.integers(0, 9, sig.shape), sig).astype(np.uint16)
        sig[:, 0] = 1
        order = np.lexsort(sig[:, J.DEPTH - 1 :: -1].T)
        sig = sig[order]
        path = sig[:, : J.DEPTH]
        want = plain_edges(path, sig, 1)
        edges = J._node(path, sig, 1)
        assert len(edges) < len(sig)
        for d in want:
            assert components([e[:2] for e in edges if e[2] >= d], len(sig)) == components(want[d], len(sig))


def worn_copies(n, seed=0):
    """Near copies of one text: 60 words, of which one to three are others."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        docs.append((i, " ".join(t)))
    return docs


def test_many_near_copies_in_bounded_memory():
    import tracemalloc

    docs = worn_copies(2000)
    texts = [t.encode() for _, t in docs]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sets = list(J.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), off))
    sig = np.stack([J._mixed(J.signature(s)) >> np.uint64(48) for s in sets]).astype(np.uint16)
    tracemalloc.start()
    for tree in range(3):
        path = sig[:, tree * J.DEPTH : (tree + 1) * J.DEPTH]
        order = np.lexsort(path[:, ::-1].T)
        edges = J._node(path[order], sig[order], 1)
        assert len(edges) < len(docs)
    assert tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()


def test_hot_nodes_and_tiles_lose_no_link(spark):
    docs = worn_copies(400) + [(1000 + i, t) for i, t in near_copies(3)]
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for limits in ({}, {"node_rows": 50, "tile_rows": 60}):
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.join(df, **limits).collect()}
        assert got == want


def test_the_prefix_is_shortened_by_what_is_found(spark):
    """Close copies alone are found by the longest prefix; where worn ones are about, it is shortened."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(5000)]

    def searched(edits):
        docs = []
        for k in range(40):
            base = rng.choices(words, k=300)
            for c in range(2):
                t = list(base)
                for e in range(edits * c):
                    t[e * 30] = f"y{k}"
                docs.append((len(docs), " ".join(t)))
        shards = J.C.pack(spark.createDataFrame(docs, "doc_id long, text string"))
        sketches = J._sketches(shards, J.SHINGLE)
        parts = J.C.checkpoint(sketches.selectExpr("rid AS node", "shard", "index", "n_set", "sig", "1L AS mult"))
        return J.search(shards, parts, J.THRESHOLD, J.SHINGLE, J.RECALL, J.NODE_ROWS, J.TILE_ROWS, J.TILE_SHINGLES)

    close, worn = searched(1), searched(6)
    assert close.depth == J.DEPTH and close.recall[J.DEPTH] >= J.RECALL
    assert worn.depth < J.DEPTH and worn.recall[J.DEPTH] < J.RECALL


def test_estimated_recall_is_what_brute_force_measures():
    """found() against pairs of sets of a known similarity."""
    rng = np.random.default_rng(1)
    share = 0.8
    hit, n = 0, 400
    for _ in range(n):
        common = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 10, dtype=np.uint64)]) for _ in range(2))
        x, y = (J._mixed(J.signature(s)).reshape(J.TREES, J.DEPTH)[:2, :2] for s in (a, b))
        hit += bool((x == y).all(1).any())
    assert abs(hit / n - J.found(share, 2, 2)) < 0.08
