"""Media columns: payloads in tar shards by their digest, rows of digest, offset and length, and metadata from headers.

A text's bytes, padded with spaces to a multiple of WIDTH, are the 8-bit grey samples of a PNG image of that width.
Images lie in tar shards in the shared folder, each under its SHA-256, once in a shard however often a text repeats
there. A row of the catalogue has the shard, the offset and the length; header columns come from reads of the
image's first HEAD bytes alone, and payloads from reads of its own range.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH = 192
#: Signature, length and IHDR chunk of a PNG file.
HEAD = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of images in a tar shard.
SHARD_BYTES = 32 << 20
#: What the catalogue says of each payload.
CATALOGUE = "digest string, n_bytes long, shard string, offset long, length long"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(text: bytes) -> bytes:
    """Spaces up to a positive multiple of WIDTH."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b" ")


def to_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with its filter: 0, none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_head(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits of a sample and colour type, from the first HEAD bytes."""
    if len(head) < HEAD or head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not the head of a PNG image")
    return struct.unpack(">IIBB", head[16:26])


def from_png(image: bytes) -> bytes:
    width, height, bits, colour = read_head(image[:HEAD])
    if (bits, colour) != (8, 0):
        raise ValueError("not 8-bit grey")
    at, packed = 8, []
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        if zlib.crc32(image[at + 4 : at + 8 + n]) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's check sum is wrong")
        if kind == b"IDAT":
            packed.append(image[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation, entropy and step between neighbours of the samples, in text."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256).astype(np.float64)
    p, v = n[n > 0] / len(x), np.arange(256.0)
    mean = float(n @ v / len(x))
    step = float(np.abs(np.diff(x.astype(np.int16))).sum() / len(x))
    return f"mean={mean:.4f};std={max(0.0, float(n @ (v - mean) ** 2 / len(x))) ** 0.5:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={step:.4f}"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"file://{uri}" if uri.startswith("/") else uri)


def _put(store, path: str, name: str, data) -> None:
    """Writes data as path/name, whole or not at all. Attempts that run side by side write the same, so where one was
    there first the other's part goes, also on stores that do not move onto a file."""
    from pyarrow import fs

    there = lambda: store.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound
    if there():
        return
    part = f"{path}/.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(part) as f:
            f.write(data)
        store.move(part, f"{path}/{name}")
    except OSError:
        if store.get_file_info(part).type != fs.FileType.NotFound:
            store.delete_file(part)
        if not there():
            raise


def write_tar_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the texts' images to tar shards below folder, a URI that executors reach; the catalogue: id_col and CATALOGUE.

    A shard's name is the digest of its contents and it appears under that name when it is whole, so a repeated task
    writes the same shard again and readers never see half of one. A null text counts as empty.
    """
    schema = pa.schema([(id_col, pa.int64()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def close(tar: io.BytesIO, rows: list[tuple]) -> pa.RecordBatch:
        tar.write(b"\0" * 1024)
        store, path = _store(folder)
        name = f"{hashlib.sha256(tar.getbuffer()).hexdigest()}.tar"
        store.create_dir(path, recursive=True)
        _put(store, path, name, tar.getbuffer())
        return C.batch(schema, *zip(*((i, d, n, f"{folder}/{name}", o, k) for i, d, n, o, k in rows), strict=True))

    def run(batches: Iterator[pa.RecordBatch]):
        tar, rows, at = io.BytesIO(), [], {}
        for s in C.shards_in(batches):
            for k, i in enumerate(s.ids):
                text = s.text(k)
                image = to_png(pad(text))
                digest = hashlib.sha256(image).hexdigest()
                if digest not in at:
                    head = tarfile.TarInfo(f"{digest}.png")
                    head.size = len(image)
                    tar.write(head.tobuf(tarfile.USTAR_FORMAT))
                    at[digest] = (tar.tell(), len(image))
                    tar.write(image.ljust(-(-len(image) // 512) * 512, b"\0"))
                rows.append((None if i == C.NULL_ID else int(i), digest, len(text), *at[digest]))
                if tar.tell() >= SHARD_BYTES:
                    yield close(tar, rows)
                    tar, rows, at = io.BytesIO(), [], {}
        if rows:
            yield close(tar, rows)

    picked = C.spread(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` long, {CATALOGUE}")


def _ranges(rows: pa.RecordBatch, most: int | None) -> Iterator[bytes]:
    """The stored bytes of each row's range, its first `most` at most."""
    name = file = None
    try:
        for shard, offset, length in zip(*(rows.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
            if shard != name:
                if file is not None:
                    file.close()
                store, path = _store(shard)
                name, file = shard, store.open_input_file(path)
            yield file.read_at(length if most is None else min(most, length), offset)
    finally:
        if file is not None:
            file.close()


def with_header(catalogue: DataFrame) -> DataFrame:
    """The catalogue with width, height, bits and colour of each image, from a read of HEAD bytes for each row."""
    kinds = [("width", pa.int64()), ("height", pa.int64()), ("bits", pa.int32()), ("colour", pa.int32())]

    def run(batches):
        for b in batches:
            got = [read_head(h) for h in _ranges(b, HEAD)]
            cols = [pa.array([g[k] for g in got], t) for k, (_, t) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *(n for n, _ in kinds)])

    return catalogue.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in catalogue.dtypes) + ", width long, height long, bits int, colour int")


def with_payload(catalogue: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The catalogue with what the stored images hold: payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, and with keep_payload the payload itself. An image that does not have its digest is an error."""
    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())] + [("payload", pa.binary())] * keep_payload

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b, out = whole.slice(lo, 1000), []
                for digest, image in zip(b.column("digest").to_pylist(), _ranges(b, None), strict=True):
                    if (sha := hashlib.sha256(image).hexdigest()) != digest:
                        raise ValueError(f"{digest}: its stored bytes differ")
                    p = from_png(image)
                    out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(image), sha, feature(p), p))
                cols = [pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *(n for n, _ in kinds)])

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return catalogue.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in catalogue.dtypes] + [f"{n} {names[t]}" for n, t in kinds]))


def media_columns(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as an image and returns the catalogue with header and payload columns.

    One row for each row of docs. A null or empty text is an image of one row of spaces. Equal texts get equal values
    (but for shard and offset, which say where). Null and repeated ids stay as they are; an empty table gives an empty
    one and no shard; other columns of docs are left out.
    """
    return with_payload(with_header(write_tar_shards(docs, folder, id_col, text_col)))
