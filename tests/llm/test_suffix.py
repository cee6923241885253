"""Repeated strings against brute force, at small lengths, with any number of shards and buckets."""

import random

import numpy as np

from pointloom.llm import common as C
from pointloom.llm import suffix as S
from tests.llm import cases


def brute(docs, length):
    first = {}
    for i, t in docs:
        for s in range(len(t) - length + 1):
            k = t[s : s + length]
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < (i, s):
                gone[s : s + length] = b"\1" * length
        out.append(bytes(gone))
    return out


def by_parts(docs, length, gram, shards, most):
    per, own = -(-len(docs) // shards), []
    for k in range(0, len(docs), per):
        part = docs[k : k + per]
        own.append(C.Shard(np.array([i for i, _ in part], np.int64), np.zeros(len(part), bool), np.concatenate([[0], np.cumsum([len(t) for _, t in part])]).astype(np.int64), np.frombuffer(b"".join(t for _, t in part), np.uint8)))
    count = {}
    for s in own:
        for h in S.anchors(s.data, s.off, length, gram)[1].tolist():
            count[h] = count.get(h, 0) + 1
    buckets, hits = {}, {k: [] for k in range(len(own))}
    for k, s in enumerate(own):
        at, h = S.anchors(s.data, s.off, length, gram)
        n = np.array([count[x] for x in h.tolist()])
        cool, hot = (n > 1) & (n <= most), (n > 1) & (n > most)
        parts = [(at[cool], S.contexts(s, at[cool], length, gram), h[cool])]
        if hot.any():
            parts.append(S.single_strings(s, at[hot], S.contexts(s, at[hot], length, gram), length, gram))
        for a, rows, hh in parts:
            runs, found = S._sorted_runs(s, a, rows, hh, 3, length, gram)
            hits[k].append(S.pack_hits(found))
            for b, r in runs:
                buckets.setdefault(b, []).append((k, S.Run.unpack(r)))
    for runs in buckets.values():
        for k, found in S.repeated(runs, length, gram).items():
            hits[k].append(S.pack_hits(found))
    out = []
    for k, s in enumerate(own):
        gone = S.removed_bytes(s, hits[k], length)
        out += [gone[a:z].astype(np.uint8).tobytes() for a, z in zip(s.off[:-1], s.off[1:], strict=True)]
    return out


def test_equals_brute_force():
    rng = random.Random(3)
    for trial in range(200):
        length = rng.choice([8, 10, 12])
        gram = length // 2 + rng.choice([-1, 0, 1])
        alphabet = rng.choice([b"ab", b"abcdefgh", b"a", bytes(range(256)), b"\0a"])
        pieces = [bytes(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(4)]
        docs = []
        for i in range(rng.randint(1, 25)):
            t = b"".join(rng.choice(pieces) if rng.random() < 0.4 else bytes(rng.choices(alphabet, k=rng.randint(0, 15))) for _ in range(rng.randint(0, 5)))
            docs.append((rng.choice([i, rng.randint(0, 10)]), t))
        rng.shuffle(docs)
        assert by_parts(docs, length, gram, rng.randint(1, 4), rng.choice([10**9, 2, 1])) == brute(docs, length), trial


def test_merge_is_sorted_and_knows_common_prefixes():
    rng = random.Random(5)
    for _ in range(100):
        runs = []
        for _ in range(rng.randint(1, 6)):
            s = sorted(bytes(rng.choices(b"ab", k=6)) for _ in range(rng.randint(0, 12)))
            runs.append((s, [0] + [next((k for k in range(6) if a[k] != b[k]), 6) for a, b in zip(s, s[1:])] if s else []))
        source, shared = S.merge(runs, 6)
        heads = [iter(s) for s, _ in runs]
        out = [next(heads[r]) for r in source]
        assert out == sorted(x for s, _ in runs for x in s)
        assert shared[1:] == [next((k for k in range(6) if a[k] != b[k]), 6) for a, b in zip(out, out[1:])]


def test_tables(spark):
    a = "Passage that repeats, with é and enough words to be longer than a hundred bytes in all of its texts, for certain. "
    docs = spark.createDataFrame([(1, "Begin. " + a + "End", "q"), (2, "Other " + a, "r"), (3, a[:50], "s"), (None, a, "t"), (4, None, "u"), (5, "x" * 250, "v")], "doc_id long, text string, n_bytes string")
    for most in (S.MOST_CONTEXTS, 1):
        got = {r["doc_id"]: r for r in S.deduplicate(docs.repartition(3), pass_on=("n_bytes",), most=most).collect()}
        rows = [(-1 if i is None else i, (t or "").encode()) for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()]]
        want = dict(zip((i for i, _ in rows), brute(rows, 100), strict=True))
        for i, r in got.items():
            gone = want[-1 if i is None else i]
            assert r["n_removed"] == sum(gone), i
            assert r["n_spans"] == len([k for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1])])
        assert got[2]["text"].startswith("Other") and got[4]["text"] is None and got[5]["n_removed"] == 249
    assert S.deduplicate(cases.empty(spark)).count() == 0
