"""Rigid transforms, boxes, cameras and selections: matrices on the driver, column expressions over points."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Xyz = tuple[Column, Column, Column]


def xyz(x: str = "x", y: str = "y", z: str = "z") -> Xyz:
    return F.col(x), F.col(y), F.col(z)


# ---- rotations -----------------------------------------------------------------------------------------------------


def quaternion_matrix(q) -> np.ndarray:
    """3 x 3 rotation of a quaternion x, y, z, w, which is normalised first; a zero one turns nothing."""
    x, y, z, w = np.asarray(q, float) / (np.linalg.norm(q) or 1.0) if np.linalg.norm(q) else (0.0, 0.0, 0.0, 1.0)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def matrix_quaternion(r: np.ndarray) -> np.ndarray:
    """The quaternion x, y, z, w of a rotation, w not negative."""
    k = np.array([[r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0], [r[1, 0] + r[0, 1], r[1, 1] - r[0, 0] - r[2, 2], 0, 0], [r[2, 0] + r[0, 2], r[2, 1] + r[1, 2], r[2, 2] - r[0, 0] - r[1, 1], 0], [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], r[0, 0] + r[1, 1] + r[2, 2]]]) / 3
    q = np.linalg.eigh(k)[1][:, -1]  # eigh reads the lower triangle
    return q if q[3] >= 0 else -q


def rotation_vector(v) -> np.ndarray:
    """The rotation about v by its length in radians."""
    a = float(np.linalg.norm(v))
    if a < 1e-15:
        return np.eye(3)
    return quaternion_matrix([*(np.asarray(v) / a * math.sin(a / 2)), math.cos(a / 2)])


def euler_quaternion(rx: float, ry: float, rz: float) -> np.ndarray:
    """Rotation about X, then about the turned Y, then Z (radians), as a quaternion."""
    return matrix_quaternion(rotation_vector([rx, 0, 0]) @ rotation_vector([0, ry, 0]) @ rotation_vector([0, 0, rz]))


def quaternion_euler(q) -> tuple[float, float, float]:
    r = quaternion_matrix(q)
    y = math.asin(max(-1.0, min(1.0, r[0, 2])))
    if abs(r[0, 2]) > 1 - 1e-12:
        return math.atan2(r[2, 1], r[1, 1]), y, 0.0
    return math.atan2(-r[1, 2], r[2, 2]), y, math.atan2(-r[0, 1], r[0, 0])


@dataclass(frozen=True)
class Pose:
    """A rigid transform: translation t and quaternion q (x, y, z, w)."""

    t: tuple[float, float, float] = (0.0, 0.0, 0.0)
    q: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 1.0)

    @property
    def matrix(self) -> np.ndarray:
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = quaternion_matrix(self.q), self.t
        return m

    @staticmethod
    def of(m: np.ndarray) -> Pose:
        return Pose(tuple(map(float, m[:3, 3])), tuple(map(float, matrix_quaternion(m[:3, :3]))))

    @staticmethod
    def from_e57(translation, rotation_wxyz) -> Pose:
        w, x, y, z = rotation_wxyz
        return Pose(tuple(translation), (x, y, z, w))

    def to_e57(self) -> tuple[tuple[float, ...], tuple[float, ...]]:
        x, y, z, w = np.asarray(self.q) / np.linalg.norm(self.q)
        return self.t, (float(w), float(x), float(y), float(z))

    def is_identity(self) -> bool:
        return bool(np.allclose(self.matrix, np.eye(4), atol=1e-12))


def affine(m: np.ndarray, p: Xyz) -> Xyz:
    """The columns of m * p, each ((m0 x + m1 y) + m2 z) + m3."""
    return tuple(((F.lit(float(r[0])) * p[0] + F.lit(float(r[1])) * p[1]) + F.lit(float(r[2])) * p[2]) + F.lit(float(r[3])) for r in m[:3])


def distance2(a: Xyz, b) -> Column:
    dx, dy, dz = (u - (v if isinstance(v, Column) else F.lit(float(v))) for u, v in zip(a, b, strict=True))
    return (dx * dx + dy * dy) + dz * dz


# ---- boxes ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bounds:
    lo: tuple[float, float, float]
    hi: tuple[float, float, float]

    @property
    def center(self) -> np.ndarray:
        return (np.array(self.lo) + np.array(self.hi)) / 2

    @property
    def radius(self) -> float:
        return float(np.linalg.norm(np.array(self.hi) - np.array(self.lo)) / 2)

    @property
    def corners(self) -> np.ndarray:
        return np.array([[(self.hi if k >> a & 1 else self.lo)[a] for a in range(3)] for k in range(8)])

    def include(self, p) -> Bounds:
        return Bounds(tuple(np.minimum(self.lo, p).tolist()), tuple(np.maximum(self.hi, p).tolist()))

    @staticmethod
    def at(p) -> Bounds:
        return Bounds(tuple(p), tuple(p))

    def moved(self, m: np.ndarray) -> Bounds:
        """Of the corners as m places them."""
        c = self.corners @ m[:3, :3].T + m[:3, 3]
        return Bounds(tuple(c.min(0).tolist()), tuple(c.max(0).tolist()))


@dataclass(frozen=True)
class CropBox:
    """An oriented box: centre, full size and unit quaternion."""

    center: tuple[float, float, float]
    size: tuple[float, float, float]
    q: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 1.0)

    def check(self) -> None:
        if not all(math.isfinite(s) and s > 0 for s in self.size) or abs(float(np.linalg.norm(self.q)) - 1) > 1e-6 or not all(map(math.isfinite, self.center)):
            raise ValueError("a box needs a positive size and a unit quaternion")

    @property
    def unit(self) -> np.ndarray:
        """Maps the box to [-1, 1] in each axis."""
        m = np.eye(4)
        r = quaternion_matrix(self.q) * (np.array(self.size) / 2)[None, :]
        m[:3, :3] = np.linalg.inv(r)
        m[:3, 3] = -m[:3, :3] @ np.array(self.center)
        return m

    def contains(self, p: Xyz) -> Column:
        u = affine(self.unit, p)
        return (F.abs(u[0]) <= 1) & (F.abs(u[1]) <= 1) & (F.abs(u[2]) <= 1)

    @property
    def corners(self) -> np.ndarray:
        return Bounds((-1, -1, -1), (1, 1, 1)).corners @ (quaternion_matrix(self.q) * (np.array(self.size) / 2)).T + np.array(self.center)

    @property
    def bounds(self) -> Bounds:
        c = self.corners
        return Bounds(tuple(c.min(0).tolist()), tuple(c.max(0).tolist()))

    def around(self, p: Xyz) -> Column:
        """An axis-aligned condition that holds wherever contains() does: Parquet can skip row groups by it."""
        lo, hi = self.corners.min(0), self.corners.max(0)
        pad = 1e-9 * (1 + np.abs(self.corners).max())
        out = F.lit(True)
        for c, a, b in zip(p, lo - pad, hi + pad, strict=True):
            out = out & (c >= float(a)) & (c <= float(b))
        return out

    def resized(self, axis: int, face: int, by: float) -> CropBox:
        """One face (1 or -1 along axis) moved by a length; the opposite one stays; sizes stay within 1 mm and 1000 km."""
        size = list(self.size)
        size[axis] = min(max(size[axis] + by, 1e-3), 1e6)
        shift = quaternion_matrix(self.q)[:, axis] * face * (size[axis] - self.size[axis]) / 2
        return replace(self, size=tuple(size), center=tuple((np.array(self.center) + shift).tolist()))


# ---- cameras and selections ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Camera:
    """A view: target, yaw and pitch (radians), distance from the target, and the view's shape."""

    target: tuple[float, float, float]
    yaw: float = 0.0
    pitch: float = 0.0
    distance: float = 10.0
    fov: float = math.radians(60)
    aspect: float = 1.0
    near: float = 0.01
    far: float = 1e4
    orthographic: bool = False

    @property
    def forward(self) -> np.ndarray:
        return np.array([math.cos(self.pitch) * math.cos(self.yaw), math.cos(self.pitch) * math.sin(self.yaw), math.sin(self.pitch)])

    @property
    def eye(self) -> np.ndarray:
        return np.array(self.target) - self.forward * self.distance

    @property
    def half_height(self) -> float:
        return self.distance * math.tan(self.fov / 2)

    @property
    def view(self) -> np.ndarray:
        f = self.forward
        right = np.cross(f, [0.0, 0.0, 1.0])
        right = right / np.linalg.norm(right) if np.linalg.norm(right) > 1e-9 else np.array([math.sin(self.yaw), -math.cos(self.yaw), 0.0])
        m = np.eye(4)
        m[0, :3], m[1, :3], m[2, :3] = right, np.cross(right, f), -f
        m[:3, 3] = -m[:3, :3] @ self.eye
        return m

    @property
    def projection(self) -> np.ndarray:
        """Depth 0 at near and 1 at far."""
        n, f, m = self.near, self.far, np.zeros((4, 4))
        if self.orthographic:
            h = self.half_height
            m[0, 0], m[1, 1], m[2, 2], m[2, 3], m[3, 3] = 1 / (h * self.aspect), 1 / h, 1 / (n - f), n / (n - f), 1
        else:
            g = 1 / math.tan(self.fov / 2)
            m[0, 0], m[1, 1], m[2, 2], m[2, 3], m[3, 2] = g / self.aspect, g, f / (n - f), n * f / (n - f), -1
        return m

    @property
    def matrix(self) -> np.ndarray:
        return self.projection @ self.view

    def clip(self, p: Xyz) -> tuple[Column, Column, Column, Column]:
        m = self.matrix
        return tuple(((F.lit(float(r[0])) * p[0] + F.lit(float(r[1])) * p[1]) + F.lit(float(r[2])) * p[2]) + F.lit(float(r[3])) for r in m)

    def depth(self, p: Xyz) -> Column:
        """The distance along the line of sight."""
        f, e = self.forward, self.eye
        return (F.lit(float(f[0])) * (p[0] - float(e[0])) + F.lit(float(f[1])) * (p[1] - float(e[1]))) + F.lit(float(f[2])) * (p[2] - float(e[2]))

    def project(self, p: Xyz) -> Column:
        """Struct u, v (-1 to 1), w (0 to 1); null behind the camera or outside near and far."""
        x, y, z, w = self.clip(p)
        return F.when((w > 0) & (z >= 0) & (z <= w), F.struct((x / w).alias("u"), (y / w).alias("v"), (z / w).alias("w")))

    def sees(self, b: Bounds) -> bool:
        """Whether a box may be in view: false only if all its corners are beyond one plane."""
        c = np.c_[b.corners, np.ones(8)] @ self.matrix.T
        x, y, z, w = c.T
        return not any(bool(np.all(o)) for o in (x < -w, x > w, y < -w, y > w, z < 0, z > w))

    @staticmethod
    def looking_at(eye, target, **more) -> Camera:
        d = np.array(target, float) - np.array(eye, float)
        n = float(np.linalg.norm(d))
        return Camera(tuple(target), math.atan2(d[1], d[0]), math.asin(d[2] / n), n, **more)

    @staticmethod
    def framing(b: Bounds, yaw: float = 0.7, pitch: float = -0.5, **more) -> Camera:
        r = max(b.radius, 1e-3)
        fov = more.get("fov", math.radians(60))
        return Camera(tuple(b.center.tolist()), yaw, pitch, r / math.sin(fov / 2), near=r * 1e-3, far=r * 1e2, **more)

    def ray(self, u: float, v: float) -> tuple[np.ndarray, np.ndarray]:
        """Origin and unit direction through a place of the view."""
        inv = np.linalg.inv(self.matrix)
        a, b = (inv @ [u, v, w, 1] for w in (0.0, 1.0))
        a, b = a[:3] / a[3], b[:3] / b[3]
        return a, (b - a) / np.linalg.norm(b - a)

    def metres_per_point(self, depth: float, height: int) -> float:
        return 2 * (self.half_height if self.orthographic else depth * math.tan(self.fov / 2)) / height


def plane_hit(origin, direction, point, normal) -> np.ndarray | None:
    d = float(np.dot(direction, normal))
    if abs(d) < 1e-12:
        return None
    t = float(np.dot(np.subtract(point, origin), normal)) / d
    return np.array(origin) + t * np.array(direction) if t >= 0 else None


def in_polygon(u: Column, v: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule, each edge half open in v."""
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if ay == by:  # never crossed
            continue
        crosses = (F.lit(float(ay)) > v) != (F.lit(float(by)) > v)
        inside = inside != (crosses & (u < float(bx - ax) * (v - float(ay)) / float(by - ay) + float(ax)))
    return inside


#: The columns of Selection.clipped().
CLIPPED = ("_cx", "_cy", "_cz", "_cw")


@dataclass(frozen=True)
class Selection:
    """A polygon drawn on a view; inside or outside; optionally no deeper than depth metres behind the nearest point."""

    camera: Camera
    polygon: list[tuple[float, float]] = field(default_factory=list)
    inside: bool = True
    depth: float | None = None

    def check(self) -> None:
        if len(self.polygon) < 3 or not all(math.isfinite(c) for p in self.polygon for c in p):
            raise ValueError("a selection needs three finite vertices")
        if self.depth is not None and not (math.isfinite(self.depth) and self.depth > 0):
            raise ValueError("a selection's depth must be positive")

    @property
    def depth_limited(self) -> bool:
        return self.inside and self.depth is not None

    def clipped(self, points):
        """points with _cx, _cy, _cz, _cw, their place before the camera. They come from a generator of one row, beyond
        which Spark moves no condition, so that a polygon of many edges reads them rather than spelling them out anew."""
        return points.select("*", F.inline(F.array(F.struct(*(c.alias(n) for c, n in zip(self.camera.clip(xyz()), CLIPPED, strict=True))))))

    def contains(self, p: Xyz, clip: tuple[Column, ...] | None = None) -> Column:
        """The depth of a point that is in the polygon and between near and far, else null. clip: clipped()'s columns."""
        x, y, z, w = clip or self.camera.clip(p)
        return F.when((w > 0) & (z >= 0) & (z <= w) & in_polygon(x / w, y / w, self.polygon), self.camera.depth(p))

    def covers(self, p: Xyz, clip: tuple[Column, ...] | None = None) -> Column:
        """Whether a point in front of the camera, at any depth, is in the polygon."""
        x, y, _, w = clip or self.camera.clip(p)
        return F.coalesce(F.when(w > 0, in_polygon(x / w, y / w, self.polygon)), F.lit(False))

    def excludes(self, p: Xyz, limit: float | Column | None = None, clip: tuple[Column, ...] | None = None) -> Column:
        """Whether a point is selected. limit: the greatest depth, where the depth is limited."""
        if self.depth_limited:
            d = self.contains(p, clip)
            return F.coalesce(d <= (limit if isinstance(limit, Column) else F.lit(limit)), F.lit(False))
        return self.covers(p, clip) if self.inside else ~self.covers(p, clip)

    def may_touch(self, b: Bounds, pad: float = 1e-6) -> bool:
        """False only if no point of a box can be selected by the polygon's box of directions."""
        c = b.corners
        c = c + np.sign(c - c.mean(0)) * pad * (1 + np.abs(c))
        x, y, _, w = (np.c_[c, np.ones(8)] @ self.camera.matrix.T).T
        us, vs = zip(*self.polygon, strict=True)
        return not any(bool(np.all(o)) for o in (w <= 0, x < min(us) * w, x > max(us) * w, y < min(vs) * w, y > max(vs) * w)) or bool((w <= 0).any() and (w > 0).any())


# ---- scalar columns --------------------------------------------------------------------------------------------------


def cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def spread(c: Column) -> Column:
    """The low 21 bits of a long, two zeros between each and the next."""
    x = c.bitwiseAND(F.lit(0x1FFFFF))
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(cx: Column, cy: Column, cz: Column) -> Column:
    return spread(cx).bitwiseOR(F.shiftleft(spread(cy), 1)).bitwiseOR(F.shiftleft(spread(cz), 2))


def scaled(v: Column, lo: float, hi: float, top: int) -> Column:
    """(v - lo) / (hi - lo) * top, clamped and rounded half up."""
    return F.floor(F.least(F.greatest((v - lo) / (hi - lo) * top, F.lit(0.0)), F.lit(float(top))) + 0.5).cast("int")


def spherical_xyz(r: Column, azimuth: Column, elevation: Column) -> Xyz:
    return r * F.cos(elevation) * F.cos(azimuth), r * F.cos(elevation) * F.sin(azimuth), r * F.sin(elevation)


def measure(a: Xyz, b: Xyz) -> Column:
    """Struct of the length, the horizontal length and the rise from a to b."""
    dx, dy, dz = (v - u for u, v in zip(a, b, strict=True))
    return F.struct(F.sqrt((dx * dx + dy * dy) + dz * dz).alias("length"), F.sqrt(dx * dx + dy * dy).alias("horizontal"), dz.alias("rise"))


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, 1 / 2.4) * 1.055 - 0.055)


@dataclass(frozen=True)
class Equirectangular:
    """A panorama of width by height pixels: bearings of pixels and pixels of directions."""

    width: int
    height: int

    def bearing(self, px: Column, py: Column) -> Xyz:
        a = (F.lit(self.width / 2) - px) * (2 * math.pi / self.width)
        e = F.greatest(F.least((F.lit(self.height / 2) - py) * (math.pi / self.height), F.lit(math.pi / 2)), F.lit(-math.pi / 2))
        return F.cos(e) * F.cos(a), F.cos(e) * F.sin(a), F.sin(e)

    def pixel(self, d: Xyz) -> tuple[Column, Column]:
        a, e = F.atan2(d[1], d[0]), F.atan2(d[2], F.hypot(d[0], d[1]))
        return F.pmod(F.lit(self.width / 2) - a / (2 * math.pi / self.width), F.lit(float(self.width))), F.lit(self.height / 2) - e / (math.pi / self.height)

    def pixel_distance(self, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
        w = float(self.width)
        return F.hypot(F.pmod(a[0] - b[0] + w / 2, F.lit(w)) - w / 2, a[1] - b[1])
