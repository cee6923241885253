"""LAS files: a reader whose tasks take ranges of records, and a writer of one file. Compressed (LAZ) files are not read."""

from __future__ import annotations

import os
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pointloom.errors import CoordinateSystemMismatch, IncompatibleMetadata, TargetExists, UnsupportedFormat
from pointloom.plans.state import Scan, new_id
from pointloom.sources.parts import append_rows

#: Records that a task reads at once.
TASK_RECORDS = 1_000_000
#: What points look like without a colour.
GREY = (180, 195, 210, 255)
WKT = ("LASF_Projection", 2112)
#: User ids of records that describe how a file was stored, not what it holds.
STORAGE_RECORDS = ("copc", "laszip encoded")

_XYZ = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2")]
_OLD = [*_XYZ, ("returns", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_NEW = [*_XYZ, ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
_GPS, _RGB, _NIR = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("nir", "<u2")]
#: The fields of each point format that is read; those with waveforms are not.
FORMATS = {0: _OLD, 1: _OLD + _GPS, 2: _OLD + _RGB, 3: _OLD + _GPS + _RGB, 6: _NEW, 7: _NEW + _RGB, 8: _NEW + _RGB + _NIR}
ATTRIBUTES = "intensity int, return_number short, number_of_returns short, scan_direction boolean, edge_of_flight_line boolean, classification short, synthetic boolean, key_point boolean, withheld boolean, overlap boolean, scanner_channel short, scan_angle double, user_data short, point_source_id int, gps_time double, red int, green int, blue int, nir int, extra binary"
SCHEMA = f"chunk int, idx int, valid boolean, x double, y double, z double, r short, g short, b short, a short, {ATTRIBUTES}"


@dataclass(frozen=True)
class Header:
    version: tuple[int, int]
    format: int
    record_bytes: int
    offset: int
    count: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    encoding: int
    records: tuple[tuple[str, int, str, bytes], ...]

    @property
    def wkt(self) -> str | None:
        return next((d.split(b"\0")[0].decode("utf-8", "replace") for u, k, _, d in self.records if (u, k) == WKT), None)


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    return store.open_input_file(inner)


def read_header(path: str) -> Header:
    with _open(path) as f:
        h = f.read_at(375, 0)
        if h[:4] != b"LASF":
            raise UnsupportedFormat("not a LAS file")
        version, size = (h[24], h[25]), struct.unpack_from("<H", h, 94)[0]
        offset, n_vlr, fmt, length, count = struct.unpack_from("<IIBHI", h, 96)
        if fmt & 0xC0:
            raise UnsupportedFormat("compressed points (LAZ) are not read")
        if fmt not in FORMATS or length < np.dtype(FORMATS[fmt]).itemsize:
            raise UnsupportedFormat(f"point format {fmt}")
        scale, shift = struct.unpack_from("<3d", h, 131), struct.unpack_from("<3d", h, 155)
        evlr = (0, 0)
        if version >= (1, 4):
            evlr = struct.unpack_from("<QI", h, 235)
            count = struct.unpack_from("<Q", h, 247)[0]
        records, at = [], size
        for k in range(n_vlr + evlr[1]):
            wide = k >= n_vlr
            if k == n_vlr:
                at = evlr[0]
            head = f.read_at(60 if wide else 54, at)
            user, number, n = struct.unpack_from("<16sHQ" if wide else "<16sHH", head, 2)
            text = head[28:60] if wide else head[22:54]
            at += len(head)
            records.append((user.split(b"\0")[0].decode("latin-1"), number, text.split(b"\0")[0].decode("latin-1"), f.read_at(n, at)))
            at += n
        return Header(version, fmt, length, offset, count, scale, shift, struct.unpack_from("<H", h, 6)[0], tuple(records))


def _dtype(h: Header) -> np.dtype:
    base = FORMATS[h.format]
    extra = h.record_bytes - np.dtype(base).itemsize
    return np.dtype([*base, ("extra", f"V{extra}")] if extra else base)


def decode(h: Header, raw: bytes, first: int) -> pa.RecordBatch:
    """Records from number `first` on as the columns of SCHEMA; a chunk holds 65,536 of them."""
    d = np.frombuffer(raw, _dtype(h))
    n, new = len(d), h.format >= 6
    at = np.arange(first, first + n)
    out = [at >> 16, at & 0xFFFF]
    xyz = [d[c] * s + o for c, s, o in zip("XYZ", h.scale, h.shift, strict=True)]
    out += [np.logical_and.reduce([np.isfinite(v) for v in xyz]), *xyz]
    has = d.dtype.names
    colour = [d[c] >> 8 if c in has else np.full(n, g) for c, g in zip(("red", "green", "blue"), GREY, strict=False)] + [np.full(n, 255)]
    out += colour
    ret, flags, cls = d["returns"], d["flags"] if new else d["returns"], d["classification"]
    bit = lambda x, k: (x >> k & 1).astype(bool)
    if new:
        out += [d["intensity"], ret & 15, ret >> 4, bit(flags, 6), bit(flags, 7), cls, bit(flags, 0), bit(flags, 1), bit(flags, 2), bit(flags, 3), flags >> 4 & 3, d["scan_angle"] * 0.006]
    else:
        out += [d["intensity"], ret & 7, ret >> 3 & 7, bit(ret, 6), bit(ret, 7), cls & 31, bit(cls, 5), bit(cls, 6), bit(cls, 7), np.zeros(n, bool), np.zeros(n, np.int16), d["scan_angle"].astype(float)]
    out += [d["user_data"], d["point_source_id"]]
    kinds = [pa.int32(), pa.int32(), pa.bool_(), *[pa.float64()] * 3, *[pa.int16()] * 4, pa.int32(), pa.int16(), pa.int16(), pa.bool_(), pa.bool_(), pa.int16(), *[pa.bool_()] * 4, pa.int16(), pa.float64(), pa.int16(), pa.int32()]
    cols = [pa.array(np.asarray(c), k, safe=False) if k != pa.bool_() else pa.array(np.asarray(c, bool)) for c, k in zip(out, kinds, strict=True)]
    for c, k in (("gps_time", pa.float64()), ("red", pa.int32()), ("green", pa.int32()), ("blue", pa.int32()), ("nir", pa.int32())):
        cols.append(pa.array(d[c].astype(np.float64 if k == pa.float64() else np.int32)) if c in has else pa.nulls(n, k))
    cols.append(pa.array([bytes(v) for v in d["extra"]], pa.binary()) if "extra" in has else pa.nulls(n, pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, records: int):
        self.path, self.records = path, records

    def partitions(self):
        n = read_header(self.path).count
        return [_Range(k, min(k + self.records, n)) for k in range(0, n, self.records)] or [_Range(0, 0)]

    def read(self, part):
        h = read_header(self.path)
        with _open(self.path) as f:
            for k in range(part.first, part.last, 50_000):
                n = min(50_000, part.last - k)
                raw = f.read_at(n * h.record_bytes, h.offset + k * h.record_bytes)
                if len(raw) < n * h.record_bytes:
                    raise UnsupportedFormat("the file ends before its points do")
                yield decode(h, raw, k)


class LasSource(DataSource):
    """spark.read.format("las").load(path); option records: how many a task reads."""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("records", TASK_RECORDS)))


def read(spark: SparkSession, path: str, records: int = TASK_RECORDS) -> DataFrame:
    spark.dataSource.register(LasSource)
    return spark.read.format("las").option("records", records).load(path)


def scan_of(spark: SparkSession, path: str, name: str) -> tuple[Scan, DataFrame]:
    h = read_header(path)
    kept = [{"user": u, "record": k, "description": t, "data": d.hex()} for u, k, t, d in h.records if u not in STORAGE_RECORDS]
    las = {"format": h.format, "version": list(h.version), "shift": list(h.shift), "encoding": h.encoding, "records": kept, "extra_bytes": h.record_bytes - np.dtype(FORMATS[h.format]).itemsize}
    return Scan(new_id(), name, crs=h.wkt, las=las), read(spark, path)


def conflicts(scans: list[Scan]) -> dict[str, bool]:
    """What scans' metadata differ in: extra bytes, the meaning of GPS times, coordinate systems, other records."""
    own = [s.las or {} for s in scans]
    told = lambda x: {(r["user"], r["record"], r["data"]) for r in x.get("records", ()) if (r["user"], r["record"]) != WKT}
    differ = lambda f: len({repr(f(x)) for x in own}) > 1
    return {"extra_bytes": differ(lambda x: x.get("extra_bytes", 0)), "gps_time": differ(lambda x: x.get("encoding", 0) & 1), "crs": len({s.crs for s in scans}) > 1, "records": differ(lambda x: sorted(told(x)))}


def common_records(scans: list[Scan]) -> list[dict]:
    """Records that all scans have, by user, number and data; each once."""
    own = [{(r["user"], r["record"], r["data"]): r for r in (s.las or {}).get("records", ())} for s in scans]
    return [r for k, r in own[0].items() if all(k in o for o in own[1:])] if own else []


def choose_format(gps: bool, colour: bool, extended: bool, nir: bool) -> int:
    """The least format that holds what there is."""
    if extended or nir:
        return 8 if nir else 7 if colour else 6
    return (3 if colour else 1) if gps else (2 if colour else 0)


def choose_scale(lo: np.ndarray, hi: np.ndarray) -> tuple[float, np.ndarray]:
    """The finest of four scales at which the extent fits 32 bits, and the shift: whole units below the least corner."""
    shift = np.floor(lo)
    scale = next((s for s in (1e-4, 1e-3, 1e-2, 1e-1) if (float(np.max(hi - shift, initial=0.0)) / s) < 2e9), None)
    if scale is None:
        raise IncompatibleMetadata("the points are too far apart")
    return scale, shift


def export(points: DataFrame, target: str, scans: list[Scan], omit_incompatible: bool = False) -> int:
    """Writes points (project coordinates) to one file and returns their number. The file appears when it is whole and
    replaces none. Metadata that differ between scans are an error, or left out where that is asked for."""
    if os.path.exists(target):
        raise TargetExists(target)
    found = conflicts(scans)
    if found["crs"] and not omit_incompatible:
        raise CoordinateSystemMismatch("the scans' coordinate systems differ")
    if any(found.values()) and not omit_incompatible:
        raise IncompatibleMetadata(", ".join(k for k, v in found.items() if v))
    have = set(points.columns)
    col = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)
    some = points.agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"), *((F.count(c) if c in have else F.lit(0)).alias(f"n_{c}") for c in ("gps_time", "red", "nir"))).first()
    n = some["n"]
    lo, hi = (np.array([some[f"{k}{c}"] or 0.0 for c in "xyz"]) for k in ("lo", "hi"))
    scale, shift = choose_scale(lo, hi)
    wkt = scans[0].crs if scans and not found["crs"] else None
    fmt = choose_format(some["n_gps_time"] > 0, some["n_red"] > 0, wkt is not None or any((s.las or {}).get("format", 0) >= 6 for s in scans), some["n_nir"] > 0)
    extra = 0 if found["extra_bytes"] or not scans else (scans[0].las or {}).get("extra_bytes", 0)
    new = fmt >= 6
    dtype = np.dtype([*FORMATS[fmt], ("extra", f"V{extra}")] if extra else FORMATS[fmt])
    wanted = [col(c, 0).cast("double").alias(c) for c in ("intensity", "return_number", "number_of_returns", "classification", "scanner_channel", "scan_angle", "user_data", "point_source_id", "gps_time", "red", "green", "blue", "nir")]
    wanted += [col(c, False).cast("boolean").alias(c) for c in ("scan_direction", "edge_of_flight_line", "synthetic", "key_point", "withheld", "overlap")]
    rows = points.select("x", "y", "z", *wanted, *([F.col("extra")] if extra else []))
    
    def encode(batches, write) -> np.ndarray:
        returns = np.zeros(15, np.int64)
        for b in batches:
            d, own = _encoded(b, dtype, new, scale, shift)
            write(d.tobytes())
            returns += own
        return returns

    records = [(r["user"], r["record"], r["description"], bytes.fromhex(r["data"])) for r in common_records(scans) if (r["user"], r["record"]) != WKT] + ([(*WKT, "WKT", wkt.encode() + b"\0")] if wkt else [])
    vlrs = b"".join(struct.pack("<H16sHH32s", 0, u.encode("latin-1"), k, len(d), t.encode("latin-1")[:32]) + d for u, k, t, d in records)
    size = 375 if new else 227
    by_return = np.zeros(15, np.int64)
    part = f"{target}.{uuid.uuid4().hex}.part"

    def head() -> bytes:
        h = bytearray(size)
        struct.pack_into("<4sHH", h, 0, b"LASF", 0, ((scans[0].las or {}).get("encoding", 0) & 1 if scans and not found["gps_time"] else 0) | (16 if wkt else 0))
        h[24:26] = bytes((1, 4 if new else 2))
        struct.pack_into("<32s32s", h, 26, b"export", b"pointloom")
        small = n if n < 1 << 32 and not new else 0
        struct.pack_into("<HIIBHI5I", h, 94, size, size + len(vlrs), len(records), fmt, dtype.itemsize, small, *(by_return[:5].tolist() if small else [0] * 5))
        struct.pack_into("<3d3d6d", h, 131, scale, scale, scale, *shift, hi[0], lo[0], hi[1], lo[1], hi[2], lo[2])
        if new:
            struct.pack_into("<Q15Q", h, 247, n, *by_return.tolist())
        return bytes(h)

    try:
        with open(part, "wb") as f:
            f.write(bytes(size) + vlrs)
            for returns in append_rows(rows, encode, f"{part}s", f):
                by_return += returns
            f.seek(0)
            f.write(head())
        os.rename(part, target)
    finally:
        if os.path.exists(part):
            os.unlink(part)
    return n


def _encoded(b: pa.RecordBatch, dtype: np.dtype, new: bool, scale: float, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of a batch, and how many of them are of each return."""
    c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in b.schema.names if k != "extra"}
    d = np.zeros(b.num_rows, dtype)
    for k, a in enumerate("xyz"):
        d[a.upper()] = np.floor((c[a] - shift[k]) / scale + 0.5).astype(np.int32)
    top = 15 if new else 7
    ret, total = np.clip(c["return_number"], 0, top).astype(np.uint8), np.clip(c["number_of_returns"], 0, top).astype(np.uint8)
    flag = {k: c[k].astype(np.uint8) for k in ("scan_direction", "edge_of_flight_line", "synthetic", "key_point", "withheld", "overlap")}
    d["intensity"], d["user_data"], d["point_source_id"] = c["intensity"], c["user_data"], c["point_source_id"]
    if new:
        d["returns"] = ret | total << 4
        d["flags"] = flag["synthetic"] | flag["key_point"] << 1 | flag["withheld"] << 2 | flag["overlap"] << 3 | (c["scanner_channel"].astype(np.uint8) & 3) << 4 | flag["scan_direction"] << 6 | flag["edge_of_flight_line"] << 7
        d["classification"], d["scan_angle"] = c["classification"], np.rint(c["scan_angle"] / 0.006)
    else:
        d["returns"] = ret | total << 3 | flag["scan_direction"] << 6 | flag["edge_of_flight_line"] << 7
        d["classification"] = (c["classification"].astype(np.uint8) & 31) | flag["synthetic"] << 5 | flag["key_point"] << 6 | flag["withheld"] << 7
        d["scan_angle"] = np.clip(np.rint(c["scan_angle"]), -90, 90)
    for k in ("gps_time", "red", "green", "blue", "nir"):
        if k in dtype.names:
            d[k] = c[k]
    if "extra" in (dtype.names or ()):
        wide = dtype["extra"].itemsize
        d["extra"] = np.array([bytes(x or b"").ljust(wide, b"\0") for x in b.column("extra").to_pylist()], f"V{wide}")
    return d, np.bincount(np.clip(ret.astype(int) - 1, 0, 14), minlength=15)
