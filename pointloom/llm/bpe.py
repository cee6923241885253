"""Byte-level BPE encoding and decoding through a sentencepiece model that is serialised from a rank file.

The rank file's tokens become pieces: each byte b is the character chr(256 + b), a piece's score is minus its rank,
and the normaliser is the identity. Sentencepiece then merges the pair of highest score first, which is the pair of
lowest rank, the leftmost among equals: the merges of the rank file's own tokeniser. Texts are cut into pre-tokens by
the given pattern, and each pre-token is encoded alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Pre-tokens whose ids a task remembers; it starts anew beyond that, so that memory stays bounded.
REMEMBER = 400_000
MAPPED = {b: chr(256 + b) for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank. Ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _piece(text: str, score: float, kind: int) -> bytes:
    return _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces (1), trainer spec (2) with model type BPE, normalizer spec (3)."""
    pieces = [_piece(t.decode("latin-1").translate(MAPPED), -float(r), 1) for r, t in enumerate(tokens)]
    pieces.append(_piece("<unk>", 0.0, 2))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(24, 0) + _number(40, len(tokens))
    trainer += b"".join(_varint(k << 3) + _varint((1 << 64) - 1) for k in (41, 42, 43))  # no bos, eos or pad
    normal = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normal)


class Codec:
    """Encodes to and decodes from ids, which are ranks."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        n = self.sp.get_piece_size() - 1
        self.bytes_of = [bytes(ord(c) - 256 for c in self.sp.id_to_piece(i)) for i in range(n)]
        self.whole = {t: i for i, t in enumerate(self.bytes_of)}
        self.known: dict[str, bytes] = {}

    def _learn(self, tokens: Iterable[str]) -> None:
        if len(self.known) > REMEMBER:
            self.known.clear()
        rest = []
        for t in tokens:
            raw = t.encode()
            if (k := self.whole.get(raw)) is not None:  # a whole token needs no merges
                self.known[t] = struct.pack("<I", k)
            else:
                rest.append((t, raw.decode("latin-1").translate(MAPPED)))
        for (t, _), ids in zip(rest, self.sp.encode([m for _, m in rest], num_threads=1) if rest else [], strict=True):
            self.known[t] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        tokens = self.find(text)
        try:
            return b"".join(map(self.known.__getitem__, tokens))
        except KeyError:
            known, new = self.known, set(tokens).difference(self.known)
            if len(known) > REMEMBER:
                new = set(tokens)
            self._learn(new)
            return b"".join(map(self.known.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes each whole text and decodes the ids again.

    Returns, for each row: id_col, n_tokens, ids_sha256 and decoded_sha256 in lowercase hex, and with keep_ids also
    ids (little-endian unsigned 32-bit integers) and decoded (bytes). A null text counts as empty: no tokens. Repeated
    rows and null ids stay rows of their own; an empty table gives an empty one; other columns of docs are left out.
    The rank file is read once, on the driver; the model (its size is the file's) is broadcast.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(serialise(read_ranks(rank_file)))
    more = ", ids binary, decoded binary" if keep_ids else ""
    fields = [(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + ([("ids", pa.binary()), ("decoded", pa.binary())] if keep_ids else []))

    def run(batches):
        codec = Codec(model.value, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                out = []
                for text in part.column(1).to_pylist():
                    ids = codec.encode(text or "")
                    back = codec.decode(ids)
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), *((ids, back) if keep_ids else ())))
                yield C.batch(schema, part.column(0), *(list(zip(*out, strict=True)) or [[]] * (len(schema) - 1)))

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
