"""E57 files: scans with Cartesian or spherical points, read by ranges of records, and a writer of one file.

A file is cut into pages with a check sum each; offsets in its XML count those, lengths do not. A scan's records are
columns of bits, spread over packets. One pass over the packets' heads finds where each column goes on at the first record
of every range; a task then reads its own packets only. Images are blobs with a pose and a projection; they are read and written whole.
"""

from __future__ import annotations

import functools
import math
import os
import struct
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pointloom.errors import CoordinateSystemMismatch, TargetExists, UnsupportedFormat
from pointloom.functions.geometry import Pose, scaled
from pointloom.operators.statistics import percentile_rows
from pointloom.plans.state import Scan, new_id
from pointloom.sources.las import GREY, TASK_RECORDS, _open
from pointloom.sources.parts import append_rows

PAGE, SUM = 1024, 4
DATA = PAGE - SUM
NS = "http://www.astm.org/COMMIT/E57/2010-e57-v1.0"
ROWS = 65_536
#: Records of a packet that is written, and of which number all streams are whole bytes.
PACKET, EVEN = 1024, 8
GREY_RECORDS = 500_000
KINDS = ("visualReferenceRepresentation", "pinholeRepresentation", "sphericalRepresentation", "cylindricalRepresentation")
SCHEMA = "chunk int, idx int, valid boolean, x double, y double, z double, r short, g short, b short, a short, intensity double, row long, col long"


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)  # the Castagnoli polynomial, reversed
    return t


def page_sums(pages: np.ndarray) -> np.ndarray:
    """The check sum of each page (n, DATA)."""
    t, crc = _table(), np.full(len(pages), 0xFFFFFFFF, np.uint32)
    for k in range(pages.shape[1]):
        crc = t[(crc ^ pages[:, k]) & 0xFF] ^ (crc >> 8)
    return ~crc


def _physical(at: int) -> int:
    return at // DATA * PAGE + at % DATA


def _logical(at: int) -> int:
    return at // PAGE * DATA + at % PAGE


def _read(f, at: int, n: int, check: bool = False) -> bytes:
    """n bytes from a logical place."""
    first, last = at // DATA, (at + n - 1) // DATA if n else at // DATA
    raw = f.read_at((last - first + 1) * PAGE, first * PAGE)
    if len(raw) < (last - first + 1) * PAGE:
        raise UnsupportedFormat("the file is cut off")
    pages = np.frombuffer(raw, np.uint8).reshape(-1, PAGE)
    if check and not (page_sums(pages[:, :DATA]) == np.frombuffer(np.ascontiguousarray(pages[:, DATA:]).tobytes(), ">u4")).all():
        raise UnsupportedFormat("a page's check sum is wrong")
    lo = at - first * DATA
    return np.ascontiguousarray(pages[:, :DATA]).tobytes()[lo : lo + n]


@dataclass(frozen=True)
class Field:
    """A column of a scan's records. kind: float, double, int; bits and least of an int; a scaled int's scale and shift."""

    name: str
    kind: str
    bits: int = 0
    least: int = 0
    most: int = 0
    scale: float = 1.0
    shift: float = 0.0


@dataclass(frozen=True)
class Data:
    """A scan in a file."""

    name: str
    guid: str
    pose: Pose | None
    at: int
    records: int
    fields: tuple[Field, ...]
    limits: dict


@dataclass(frozen=True)
class Image:
    """A picture in a file. kind: the element of its projection; format: jpegImage or pngImage; numbers: what else that
    element says, such as sizes of pixels; scan: the guid of the scan it belongs to; mask: another blob, or empty."""

    name: str
    guid: str
    kind: str
    format: str
    data: bytes
    pose: Pose | None = None
    scan: str = ""
    numbers: dict | None = None
    mask: bytes = b""


def panorama_image(name: str, guid: str, data: bytes, pose: Pose, width: int, height: int) -> Image:
    """A photograph of all directions, as a spherical picture."""
    kind = "pngImage" if data[:4] == b"\x89PNG" else "jpegImage"
    return Image(name, guid, "sphericalRepresentation", kind, data, pose, numbers={"imageWidth": width, "imageHeight": height, "pixelWidth": 2 * math.pi / width, "pixelHeight": math.pi / height})


def _pose(e) -> Pose | None:
    if e is None:
        return None
    find = lambda x, name: x.find(f"{{{NS}}}{name}") if x is not None else None
    num = lambda x, name, default: float(find(x, name).text or default) if find(x, name) is not None else default
    r, t = find(e, "rotation"), find(e, "translation")
    turn = tuple(num(r, c, 0.0) for c in "wxyz") if r is not None else (1.0, 0.0, 0.0, 0.0)
    return Pose.from_e57(tuple(num(t, c, 0.0) for c in "xyz") if t is not None else (0.0, 0.0, 0.0), turn)


def read_images(path: str) -> list[Image]:
    """The pictures of a file; those of an unknown projection are left out."""
    out = []
    with _open(path) as f:
        xml_at, xml_n = struct.unpack_from("<QQ", f.read_at(48, 0), 24)
        root = ET.fromstring(_read(f, _logical(xml_at), xml_n, True))

        def blob(e) -> bytes:
            return _read(f, _logical(int(e.get("fileOffset"))) + 16, int(e.get("length")), True)

        for e in root.iterfind(f"{{{NS}}}images2D/{{{NS}}}vectorChild"):
            text = lambda name, e=e: (e.findtext(f"{{{NS}}}{name}") or "")
            for kind in KINDS:
                if (r := e.find(f"{{{NS}}}{kind}")) is None:
                    continue
                picture = next((c for c in r if c.tag.split("}")[-1] in ("jpegImage", "pngImage")), None)
                if picture is None:
                    continue
                mask = r.find(f"{{{NS}}}imageMask")
                numbers = {c.tag.split("}")[-1]: (int if c.get("type") == "Integer" else float)(c.text or 0) for c in r if c.get("type") in ("Integer", "Float")}
                out.append(Image(text("name"), text("guid"), kind, picture.tag.split("}")[-1], blob(picture), _pose(e.find(f"{{{NS}}}pose")), text("associatedData3DGuid"), numbers, blob(mask) if mask is not None else b""))
                break
    return out


def _fields(prototype) -> tuple[Field, ...]:
    out = []
    for e in prototype:
        name, kind = e.tag.split("}")[-1], e.get("type")
        if kind == "Float":
            out.append(Field(name, "float" if e.get("precision") == "single" else "double"))
        elif kind in ("Integer", "ScaledInteger"):
            lo, hi = int(e.get("minimum", -(1 << 63))), int(e.get("maximum", (1 << 63) - 1))
            out.append(Field(name, "int", (hi - lo).bit_length(), lo, hi, float(e.get("scale", 1)) if kind == "ScaledInteger" else 1.0, float(e.get("offset", 0)) if kind == "ScaledInteger" else 0.0))
        else:
            raise UnsupportedFormat(f"{name} is a {kind}")
    return tuple(out)


def read_header(path: str) -> tuple[list[Data], str | None]:
    """The scans of a file, and its coordinate metadata."""
    with _open(path) as f:
        h = f.read_at(48, 0)
        if h[:8] != b"ASTM-E57":
            raise UnsupportedFormat("not an E57 file")
        xml_at, xml_n, page = struct.unpack_from("<QQQ", h, 24)
        if page != PAGE:
            raise UnsupportedFormat(f"pages of {page} bytes")
        root = ET.fromstring(_read(f, _logical(xml_at), xml_n, True))
    tag = lambda e, *path: e.find("/".join(f"{{{NS}}}{p}" for p in path))
    text = lambda e, name: (tag(e, name).text if tag(e, name) is not None else None) or ""
    out = []
    for k, e in enumerate(tag(root, "data3D") if tag(root, "data3D") is not None else ()):
        points = tag(e, "points")
        limits = {c.tag.split("}")[-1]: float(c.text or 0) for name in ("colorLimits", "intensityLimits") if (q := tag(e, name)) is not None for c in q}
        out.append(Data(text(e, "name") or f"Scan {k + 1}", text(e, "guid"), _pose(tag(e, "pose")), _logical(int(points.get("fileOffset"))), int(points.get("recordCount")), _fields(tag(points, "prototype")), limits))
    return out, text(root, "coordinateMetadata") or None


#: Bytes that are read at once where packets' heads are looked at one after another.
AHEAD = 1 << 16


def _widths(d: Data) -> list[int]:
    """Bits of a record in each column."""
    return [{"float": 32, "double": 64}.get(x.kind, x.bits) for x in d.fields]


def _data_at(f, d: Data) -> int:
    head = _read(f, d.at, 32)
    if head[0] != 1:
        raise UnsupportedFormat("no compressed vector")
    return _logical(struct.unpack_from("<Q", head, 16)[0])


@dataclass(frozen=True)
class Range(InputPartition):
    """Records of a scan: the first one and their number, the packet in which the first of them begins in some column,
    and the bytes of each column, from that packet on, that belong to earlier records."""

    first: int
    records: int
    at: int
    skip: tuple[int, ...]


def ranges(f, d: Data, records: int) -> list[Range]:
    """The ranges of about `records` records, by one pass over the heads of a scan's packets. A range begins at a
    multiple of EVEN records, so that every column begins at a whole byte."""
    at, step, width = _data_at(f, d), max(EVEN, records // EVEN * EVEN), _widths(d)
    cum, out, held, held_at = [0] * len(width), [], b"", 0
    firsts = list(range(0, d.records, step)) if any(width) else [0] if d.records else []
    while len(out) < len(firsts):
        if not held_at <= at <= held_at + len(held) - 6 - 2 * len(width):  # the head is not among what was read ahead
            held, held_at = _ahead(f, at), at
        kind, n = struct.unpack_from("<BxH", held, at - held_at)
        sizes = [0] * len(width)
        if kind == 1:
            count = struct.unpack_from("<H", held, at - held_at + 4)[0]
            if count != len(width):
                raise UnsupportedFormat("a packet lacks columns")
            sizes = struct.unpack_from(f"<{count}H", held, at - held_at + 6)
        while len(out) < len(firsts):
            starts = [firsts[len(out)] * w // 8 for w in width]
            if any(width) and not any(c + size > b for c, size, b, w in zip(cum, sizes, starts, width, strict=True) if w):
                break
            first = firsts[len(out)]
            out.append(Range(first, min(step, d.records - first) if any(width) else d.records, at, tuple(b - c for b, c in zip(starts, cum, strict=True))))
        cum = [c + size for c, size in zip(cum, sizes, strict=True)]
        at += n + 1
    return out


def _ahead(f, at: int) -> bytes:
    """As many bytes from a logical place as there are, up to AHEAD; an error if there is none."""
    first = at // DATA
    raw = f.read_at((AHEAD // DATA + 1) * PAGE, first * PAGE)
    pages = np.frombuffer(raw[: len(raw) // PAGE * PAGE], np.uint8).reshape(-1, PAGE)
    out = np.ascontiguousarray(pages[:, :DATA]).tobytes()[at - first * DATA :]
    if len(out) < 6:
        raise UnsupportedFormat("the file is cut off")
    return out


def _columns(f, d: Data, part: Range | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Blocks of a range's records, or of all, each a raw array by field."""
    if part is None:
        part = Range(0, d.records, _data_at(f, d), (0,) * len(d.fields))
    at, drop = part.at, list(part.skip)  # drop: bytes of earlier records that are still to come
    held = [bytearray() for _ in d.fields]
    skip = [0] * len(d.fields)  # bits of the first byte that are used already
    width = _widths(d)
    left = part.records
    while left:
        ready = min([left] + [(len(b) * 8 - s) // w for b, s, w in zip(held, skip, width, strict=True) if w])
        if ready < min(left, ROWS):
            kind, n = struct.unpack("<BxH", _read(f, at, 4))
            packet = _read(f, at, n + 1)
            at += n + 1
            if kind == 1:
                count = struct.unpack_from("<H", packet, 4)[0]
                sizes = struct.unpack_from(f"<{count}H", packet, 6)
                lo = 6 + 2 * count
                for k, size in enumerate(sizes):
                    early = min(drop[k], size)
                    held[k] += packet[lo + early : lo + size]
                    drop[k] -= early
                    lo += size
            continue
        n, out = min(ready, ROWS), {}
        for k, x in enumerate(d.fields):
            total = skip[k] + n * width[k]
            raw, used = bytes(held[k][: -(-total // 8)]), total // 8
            if x.kind != "int":
                out[x.name] = np.frombuffer(raw, "<f4" if x.kind == "float" else "<f8", n)
            elif not x.bits:
                out[x.name] = np.full(n, x.least, np.int64)
            else:
                bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[skip[k] : total].reshape(n, x.bits)
                wide = np.zeros((n, 64), np.uint8)
                wide[:, : x.bits] = bits
                value = np.packbits(wide, axis=1, bitorder="little").view("<u8")[:, 0]
                out[x.name] = (value + np.uint64(x.least & (1 << 64) - 1)).view(np.int64)  # wraps as 64-bit numbers do
            del held[k][:used]
            skip[k] = total % 8
        left -= n
        yield out


def _value(d: Data, c: dict, name: str) -> np.ndarray | None:
    x = next((x for x in d.fields if x.name == name), None)
    if x is None:
        return None
    return c[name].astype(float) * x.scale + x.shift if x.kind == "int" else c[name].astype(float)


def _colour(d: Data, c: dict, name: str, n: int, default: int) -> np.ndarray:
    """A colour in 8 bits, between its limits, else its type's, else 0 to 65535."""
    v = _value(d, c, f"color{name}")
    if v is None:
        return np.full(n, default, np.int16)
    x = next(x for x in d.fields if x.name == f"color{name}")
    lo, hi = d.limits.get(f"color{name}Minimum"), d.limits.get(f"color{name}Maximum")
    if lo is None or hi is None or hi <= lo:
        lo, hi = (x.least, x.most) if x.kind == "int" and x.most > x.least else (0, 65535)
    return np.floor(np.clip((v - lo) / (hi - lo) * 255, 0, 255) + 0.5).astype(np.int16)


def decode(d: Data, c: dict, first: int) -> pa.RecordBatch:
    n = len(next(iter(c.values())))
    at = np.arange(first, first + n)
    xyz = [_value(d, c, f"cartesian{a}") for a in "XYZ"]
    if all(v is not None for v in xyz):
        state = c.get("cartesianInvalidState")
    else:
        r, az, el = (_value(d, c, f"spherical{a}") for a in ("Range", "Azimuth", "Elevation"))
        if r is None or az is None or el is None:
            raise UnsupportedFormat("neither Cartesian nor spherical points")
        xyz = [r * np.cos(el) * np.cos(az), r * np.cos(el) * np.sin(az), r * np.sin(el)]
        state = c.get("sphericalInvalidState")
    valid = np.logical_and.reduce([np.isfinite(v) for v in xyz]) & ((state == 0) if state is not None else True)
    xyz = [np.where(valid, v, 0.0) for v in xyz]
    colours = [_colour(d, c, name, n, g) for name, g in zip(("Red", "Green", "Blue"), GREY, strict=False)]
    i = _value(d, c, "intensity")
    index = lambda name: pa.array(c[name].astype(np.int64)) if name in c else pa.nulls(n, pa.int64())
    cols = [pa.array((at >> 16).astype(np.int32)), pa.array((at & 0xFFFF).astype(np.int32)), pa.array(valid), *map(pa.array, xyz), *map(pa.array, colours), pa.array(np.full(n, 255, np.int16)), pa.array(i) if i is not None else pa.nulls(n, pa.float64()), index("rowIndex"), index("columnIndex")]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])


class _Reader(DataSourceReader):
    def __init__(self, path: str, scan: int, records: int):
        self.path, self.scan, self.records = path, scan, records

    def partitions(self):
        d = read_header(self.path)[0][self.scan]
        with _open(self.path) as f:
            return ranges(f, d, self.records) or [Range(0, 0, d.at, ())]

    def read(self, part):
        d, first = read_header(self.path)[0][self.scan], part.first
        with _open(self.path) as f:
            for c in _columns(f, d, part) if part.records else ():
                out = decode(d, c, first)
                first += out.num_rows
                yield out


class E57Source(DataSource):
    """spark.read.format("e57").load(path); options scan: its number in the file, from 0; records: how many a task reads."""

    @classmethod
    def name(cls):
        return "e57"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("scan", 0)), int(self.options.get("records", TASK_RECORDS)))


def read(spark: SparkSession, path: str, number: int, records: int = TASK_RECORDS) -> DataFrame:
    """The points of a file's scan."""
    spark.dataSource.register(E57Source)
    return spark.read.format("e57").option("scan", number).option("records", records).load(path)


def coloured(d: Data, points: DataFrame) -> DataFrame:
    """points of a scan without colours but with intensities, in grey between the 1st and 99th percentile of its first
    GREY_RECORDS; as they are where there are colours, no intensities, or too few of them."""
    names = {x.name for x in d.fields}
    if "intensity" not in names or names & {"colorRed", "colorGreen", "colorBlue"}:
        return points
    first = points.where((F.col("chunk") * ROWS + F.col("idx") < GREY_RECORDS) & F.col("intensity").isNotNull() & ~F.isnan("intensity"))
    one = first.withColumn("_k", F.lit(0))
    w = percentile_rows(one, "intensity", {"lo": (0.01, False), "hi": (0.99, False)}, "_k").first()
    if w is None or first.limit(100).count() < 100 or not w["hi"] > w["lo"]:
        return points
    grey = scaled(F.col("intensity"), w["lo"], w["hi"], 255).cast("short")
    return points.withColumns({c: F.coalesce(grey, F.col(c)) for c in "rgb"})


def scans_of(spark: SparkSession, path: str) -> list[tuple[Scan, DataFrame]]:
    found, crs = read_header(path)
    return [(Scan(new_id(), d.name, d.pose, crs=crs, guid=d.guid), coloured(d, read(spark, path, k))) for k, d in enumerate(found)]


def _packed(v: np.ndarray, bits: int) -> np.ndarray:
    return np.unpackbits(v.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].ravel()


def _packet(columns: list[np.ndarray], extra) -> bytes:
    """A data packet of records: valid, x, y, z, r, g, b and the extra columns."""
    valid, *points = columns
    streams = [c.astype("<f8").tobytes() for c in points[:3]] + [c.astype(np.uint8).tobytes() for c in points[3:6]]
    streams.append(np.packbits(_packed(np.where(valid, 0, 2), 2), bitorder="little").tobytes())
    for c, v in zip(extra, points[6:], strict=True):
        streams.append(v.astype("<f8").tobytes() if c == "intensity" else (v.astype(np.int64).view(np.uint64) + np.uint64(1 << 63)).astype("<u8").tobytes())
    packet = struct.pack(f"<H{len(streams)}H", len(streams), *map(len, streams)) + b"".join(streams)
    packet += bytes(-(len(packet) + 4) % 4)
    return struct.pack("<BBH", 1, 0, len(packet) + 3) + packet


def _packets(batches, write, extra) -> tuple[int, list[np.ndarray]]:
    """Writes a task's records in packets; how many, and the records left, fewer than EVEN: streams go on from packet to
    packet, so that only the last one of a scan may end within a byte."""
    names, n, held = ("valid", "x", "y", "z", "r", "g", "b", *extra), 0, None
    for b in batches:
        own = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
        held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
        full = len(held[0]) // PACKET * PACKET
        for lo in range(0, full, PACKET):
            write(_packet([c[lo : lo + PACKET] for c in held], extra))
        n, held = n + full, [c[full:] for c in held]
    if held is not None and (full := len(held[0]) // EVEN * EVEN):
        write(_packet([c[:full] for c in held], extra))
        n, held = n + full, [c[full:] for c in held]
    return n, held if held is not None else [np.zeros(0, bool), *(np.zeros(0) for _ in names[1:])]


def export(target: str, scans: list[tuple[Scan, str, Pose, DataFrame]], images: tuple[Image, ...] = ()) -> int:
    """Writes scans (name, pose, records in scan coordinates, valid or not) and images, and returns the number of records. The file
    appears when it is whole and replaces none; scans of different coordinate systems are an error."""
    if os.path.exists(target):
        raise TargetExists(target)
    if len({s.crs for s, *_ in scans}) > 1:
        raise CoordinateSystemMismatch("the scans' coordinate systems differ")
    flat, part, total = f"{target}.{uuid.uuid4().hex}.flat", f"{target}.{uuid.uuid4().hex}.part", 0
    head = ET.Element("e57Root", {"type": "Structure", "xmlns": NS})

    def put(parent, name: str, kind: str, text=None, **more):
        e = ET.SubElement(parent, name, {"type": kind, **{k: str(v) for k, v in more.items()}})
        e.text = None if text is None else str(text) if not isinstance(text, float) else repr(text)
        return e

    def placed(parent, pose: Pose) -> None:
        t, q = pose.to_e57()
        p = put(parent, "pose", "Structure")
        turn, move = put(p, "rotation", "Structure"), put(p, "translation", "Structure")
        for c, v in zip("wxyz", q, strict=True):
            put(turn, c, "Float", float(v))
        for c, v in zip("xyz", t, strict=True):
            put(move, c, "Float", float(v))

    put(head, "formatName", "String", "ASTM E57 3D Imaging Data File")
    put(head, "guid", "String", new_id())
    put(head, "versionMajor", "Integer", 1)
    put(head, "versionMinor", "Integer", 0)
    if scans and scans[0][0].crs:
        put(head, "coordinateMetadata", "String", scans[0][0].crs)
    data = put(head, "data3D", "Vector", allowHeterogeneousChildren=1)
    try:
        with open(flat, "wb") as f:
            f.write(bytes(48))
            for scan, name, pose, points in scans:
                have = set(points.columns)
                start = f.tell()
                f.write(bytes(32))
                body, n = f.tell(), 0
                extra = [c for c in ("intensity", "row", "col") if c in have]
                rows = points.select("valid", "x", "y", "z", "r", "g", "b", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in extra))
                left = []
                for own, rest in append_rows(rows, functools.partial(_packets, extra=tuple(extra)), f"{part}s", f):
                    n += own + len(rest[0])
                    left.append(rest)
                whole = [np.concatenate([r[k] for r in left]) for k in range(7 + len(extra))] if left else []
                for lo in range(0, len(whole[0]) if whole else 0, PACKET):
                    f.write(_packet([c[lo : lo + PACKET] for c in whole], extra))
                end = f.tell()
                f.seek(start)
                f.write(struct.pack("<B7xQQQ", 1, end - start, _physical(body), 0))
                f.seek(end)
                total += n
                e = put(data, "vectorChild", "Structure")
                put(e, "guid", "String", scan.id)
                put(e, "name", "String", name)
                placed(e, pose)
                vector = put(e, "points", "CompressedVector", fileOffset=_physical(start), recordCount=n)
                proto = put(vector, "prototype", "Structure")
                for c in "XYZ":
                    put(proto, f"cartesian{c}", "Float", precision="double")
                for c in ("Red", "Green", "Blue"):
                    put(proto, f"color{c}", "Integer", minimum=0, maximum=255)
                put(proto, "cartesianInvalidState", "Integer", minimum=0, maximum=2)
                for c in extra:
                    if c == "intensity":
                        put(proto, "intensity", "Float", precision="double")
                    else:
                        put(proto, {"row": "rowIndex", "col": "columnIndex"}[c], "Integer", minimum=-(1 << 63), maximum=(1 << 63) - 1)
                put(vector, "codecs", "Vector", allowHeterogeneousChildren=1)
            pictures = put(head, "images2D", "Vector", allowHeterogeneousChildren=1)

            def blob(parent, name: str, content: bytes) -> None:
                start = f.tell()
                f.write(struct.pack("<B7xQ", 0, 16 + len(content)) + content)
                f.write(bytes(-f.tell() % 4))
                put(parent, name, "Blob", fileOffset=_physical(start), length=len(content))

            for image in images:
                e = put(pictures, "vectorChild", "Structure")
                put(e, "guid", "String", image.guid)
                put(e, "name", "String", image.name)
                if image.scan:
                    put(e, "associatedData3DGuid", "String", image.scan)
                if image.pose is not None:
                    placed(e, image.pose)
                r = put(e, image.kind, "Structure")
                blob(r, image.format, image.data)
                if image.mask:
                    blob(r, "imageMask", image.mask)
                for name, v in (image.numbers or {}).items():
                    put(r, name, "Integer" if isinstance(v, int) else "Float", v)
            at = f.tell()
            xml = b'<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(head)
            f.write(xml)
            length = f.tell()
            f.write(bytes(-length % DATA))
            pages = f.tell() // DATA
            f.seek(0)
            f.write(struct.pack("<8sIIQQQQ", b"ASTM-E57", 1, 0, pages * PAGE, _physical(at), len(xml), PAGE))
        with open(flat, "rb") as f, open(part, "wb") as out:
            while raw := f.read(DATA * 4096):
                own = np.frombuffer(raw, np.uint8).reshape(-1, DATA)
                out.write(np.concatenate([own, page_sums(own).astype(">u4").view(np.uint8).reshape(-1, SUM)], axis=1).tobytes())
        os.rename(part, target)
    finally:
        for p in (flat, part):
            if os.path.exists(p):
                os.unlink(p)
    return total
