"""Tokens, licences, media, against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from pointloom.llm import bpe, licenses, media, queries
from tests import oracle
from tests.llm import cases


@pytest.fixture(scope="module")
def codec():
    path, pattern = queries.tokenizer_file()
    return bpe.Codec(bpe.serialise(bpe.read_ranks(path)), pattern)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    path, pattern = queries.tokenizer_file()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(bpe.read_ranks(path))}, special_tokens={})


def check(codec, reference, text):
    ids = codec.encode(text)
    assert list(memoryview(ids).cast("I")) == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_equals_the_tokenizer(codec, reference):
    rng = random.Random(1)
    alphabet = [" ", "  ", "\n", "\t", "a", "e", "é", "ß", "漢", "\x1c", "\x85", "'s", "'ll", "1", "12345", "!", "<unk>", "🙂", "the", "ing", "\x00", "▁", "A", "İ", "Ā"]
    for _ in range(3000):
        check(codec, reference, "".join(rng.choices(alphabet, k=rng.randint(0, 40))))
    for (t,) in duckdb.sql(f"SELECT text FROM '{oracle.DATA}/documents.parquet'").fetchall():
        check(codec, reference, t)
    check(codec, reference, cases.LONG + "a" * 3000)


def test_bpe_forgets_and_goes_on(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    for k in range(50):
        check(codec, reference, f"word{k} more{k} and the same again")


def test_bpe_rows(spark):
    out = {(r["doc_id"], r["n_tokens"]): r for r in bpe.encode_decode(cases.table(spark), *queries.tokenizer_file(), keep_ids=True).collect()}
    assert all(hashlib.sha256(bytes(r["ids"])).hexdigest() == r["ids_sha256"] and hashlib.sha256(bytes(r["decoded"])).hexdigest() == r["decoded_sha256"] for r in out.values())
    assert out[4, 0]["decoded"] == b""


def brute_licence(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    joined = " ".join(w)
    found = [(m.start(), m.end(), level, k, label) for k, label, level, keyword, pattern in licenses.rules() if keyword in w for m in re.finditer(pattern, joined, re.ASCII)]
    found.sort(key=lambda x: (x[0], -x[1], x[2], x[3]))
    kept = [x for i, x in enumerate(found) if not any(y[1] >= x[1] and y[2] <= x[2] for y in found[:i])]
    score = max([licenses.WEIGHT[x[2]] for x in kept] + [licenses.WEIGHT[licenses.HINT]] * bool(at), default=0.0)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[4] for x in kept})), score


def test_licences_equal_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{oracle.DATA}/documents.parquet'").fetchall()
    docs += [
        (9001, "SPDX-License-Identifier: GPL-3.0-or-later\nThis work is licensed under the GNU General Public License, version 3."),
        (9002, "Licensed under CC BY-NC 4.0. All Rights Reserved; cc by cc by! Copyright (c) 2020 X all rights reserved"),
        (9003, "mit der MIT License. Licensed under the Apache License, Version 2.0. http://www.apache.org/licenses/LICENSE-2.0 mit license"),
        (9004, "GNU Lesser General Public License version 2.1, bsd 3-clause, public domain, ISC license, cc cc by all rights reserved rights reserved"),
        (9005, None),
    ]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == brute_licence(texts[r["doc_id"]]), r["doc_id"]
    assert len(licenses.rules()) >= 300


def test_licence_keywords_are_in_every_match():
    for _, label, _, keyword, pattern in licenses.rules():
        assert re.search(rf"\b{keyword}\b", pattern.replace("\\b", " ").replace("(?:", " (").replace(")", " ")), (label, keyword, pattern)


def alternatives(tree):
    """Texts of every branch of a parsed pattern; a repeat stands with its least number and one more."""
    out = [""]
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            own = [chr(arg)]
        elif kind == "ANY":
            own = ["x"]
        elif kind == "IN":
            own = [chr(a[0] if str(o) == "RANGE" else a) for o, a in arg]
        elif kind == "BRANCH":
            own = [t for branch in arg[1] for t in alternatives(branch)]
        elif kind == "SUBPATTERN":
            own = alternatives(arg[-1])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            once = alternatives(arg[2])
            own = [t * n for n in range(arg[0], min(arg[0] + 1, arg[1]) + 1) for t in once]
        else:
            assert kind in ("AT", "ASSERT_NOT"), kind
            own = [""]
        out = [a + b for a in out for b in dict.fromkeys(own)]
    return out


def test_licence_keywords_are_words_of_every_alternative():
    for _, label, _, keyword, pattern in licenses.rules():
        for text in alternatives(re._parser.parse(pattern)):
            assert keyword in text.split(), (label, keyword, text)


def test_licence_for_noncommercial_use_in_one_word(spark):
    docs = [(k, f"Released for {w} use only.") for k, w in enumerate(("noncommercial", "non-commercial", "Non Commercial"))]
    for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert r["labels"] == "non-commercial" == brute_licence(docs[r["doc_id"]][1])[5], r["doc_id"]


def test_media_round_trip(spark, tmp_path):
    docs = cases.table(spark)
    store = media.write_tar_shards(docs, f"file://{tmp_path}").cache()
    back = media.with_payload(media.with_header(store), keep_payload=True).collect()
    want = sorted(media.pad((t or "").encode()) for _, t in cases.TEXTS)
    assert sorted(bytes(r["payload"]) for r in back) == want
    for r in back:
        p = bytes(r["payload"])
        assert r["payload_bytes"] == len(p) == r["width"] * r["height"] and len(p) % 192 == 0 and p
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-16:]) and r["bits"] == 8
        assert r["media_sha256"] == r["digest"] and r["media_bytes"] == r["length"] and r["feature"] == media.feature(p)
    import tarfile

    with tarfile.open(back[0]["shard"].removeprefix("file://")) as tar:
        m = tar.getmember(f"{back[0]['digest']}.png")
        assert (m.offset_data, m.size) == (back[0]["offset"], back[0]["length"])
    shard = max(tmp_path.glob("*.tar"), key=lambda p: p.stat().st_size)
    raw = bytearray(shard.read_bytes())
    raw[520] ^= 255
    shard.write_bytes(raw)
    with pytest.raises(Exception, match="(?s)head of a PNG|differ"):
        media.with_payload(media.with_header(store)).count()


@pytest.mark.parametrize("first", [True, False])
def test_a_shard_that_another_attempt_wrote_meanwhile(tmp_path, first):
    """On a store that does not move onto a file; without the other attempt's shard a failed move is an error."""
    from pyarrow import fs

    class Store:
        def __init__(self):
            self.local = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.local, name)

        def move(self, part, target):
            if first:
                self.local.copy_file(part, target)
            raise OSError("not moved")

    if first:
        media._put(Store(), str(tmp_path), "a.tar", b"shard")
    else:
        with pytest.raises(OSError, match="not moved"):
            media._put(Store(), str(tmp_path), "a.tar", b"shard")
    assert [(p.name, p.read_bytes()) for p in tmp_path.iterdir()] == [("a.tar", b"shard")] * first
