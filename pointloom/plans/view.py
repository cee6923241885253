"""Views of a project: the stored nodes that a camera needs, read by their files and handed on as they come in.

The nodes to show are chosen from the scans' node tables, cut down in Spark to what the camera can reach. Nodes that an
earlier request read, and that no edit has changed since, are handed on at once; the others are read in the order of
their weight, a few files at a time. A new request stops the last one's work.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import Bounds, Camera, Selection
from pointloom.operators import filters, layers, octree, tiles
from pointloom.plans.jobs import Job
from pointloom.plans.project import REF, PointProject

#: Points that a view shows, that it keeps for later requests, and that it reads at a time.
BUDGET, KEPT, STEP = 2_000_000, 8_000_000, 200_000


@dataclass
class StoredNode:
    """A display node: key (scan, node), bounds of what is in and below it in project coordinates, how many visible points
    are its own, and its files with the tiles in them."""

    key: tuple[str, int]
    bounds: Bounds
    count: int
    files: dict[str, int] = field(default_factory=dict)
    parent: tuple[str, int] | None = None


@dataclass
class Part:
    """Points of some nodes, with their scan, node and reference; cached: whether an earlier request had read them."""

    nodes: list[tuple[str, int]]
    points: pa.Table
    cached: bool
    files: list[str]


def reachable(camera: Camera, inverse: np.ndarray, lo: tuple[float, float, float], size: float) -> Column:
    """Whether a node (node, level), whose cube's parent must be near enough for its children to be looked at, can be
    shown. Errs towards yes."""
    half = float(np.sqrt(3)) * size / F.pow(F.lit(2.0), F.col("level"))  # the radius of the parent's cube
    if camera.orthographic:
        return (F.col("level") == 0) | (half / float(camera.distance) > octree.SMALLEST)
    eye = inverse @ [*camera.eye, 1.0]
    off = [(F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 - float(e) for c, e in zip("xyz", eye[:3], strict=True)]
    far = F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]) - 4 * half
    return (F.col("level") == 0) | (far <= 0) | (half / far > octree.SMALLEST)


class View:
    """A project's view. request() gives its points in parts; what has been read is kept, up to `kept` points."""

    def __init__(self, project: PointProject, budget: int = BUDGET, kept: int = KEPT, step: int = STEP):
        self.project, self.budget, self.kept, self.step = project, budget, kept, step
        self.job: Job | None = None
        self.shown: list[pa.Table] = []
        self.held: OrderedDict[tuple, pa.Table] = OrderedDict()
        self.counts: tuple[object, dict[str, dict[int, int]]] | None = None

    @property
    def labels(self) -> tuple:
        """What decides which points of a node are visible."""
        s = self.project.history.current
        return (s.labels, tuple(s.shown))

    def visible_counts(self) -> dict[str, dict[int, int]] | None:
        """By scan and node the visible points, where labels hide some; None where all valid points are visible. Worked
        out once for each state of the labels."""
        s = self.project.history.current
        if not s.labels and 0 in s.shown:
            return None
        if self.counts is None or self.counts[0] != self.labels:
            rows = self.project.points().groupBy("scan", "_node").agg(F.count("*").alias("n")).toLocalIterator()  # a row for each node
            out: dict[str, dict[int, int]] = {}
            for r in rows:
                out.setdefault(r["scan"], {})[r["_node"]] = r["n"]
            self.counts = (self.labels, out)
        return self.counts[1]

    def nodes(self, camera: Camera) -> list[StoredNode]:
        """The nodes that the camera can reach: as many as a view can show, however large the project."""
        counts, out = self.visible_counts(), []
        for scan in self.project.history.current.scans:
            world = self.project.history.world(scan)
            bounds = self.project.history.known[scan].bounds
            if bounds is None:
                continue
            lo, size = tiles.cube(bounds)
            found: dict[int, StoredNode] = {}
            for r in self.project.nodes(scan).where(reachable(camera, np.linalg.inv(world), lo, size)).collect():
                if (node := found.get(r["node"])) is None:
                    box = Bounds((r["min_x"], r["min_y"], r["min_z"]), (r["max_x"], r["max_y"], r["max_z"])).moved(world)
                    node = found[r["node"]] = StoredNode((scan, r["node"]), box, 0)
                node.count += r["n"] if counts is None else 0
                node.files[r["file"]] = r["tile"]
            if counts is not None:
                for key, node in found.items():
                    node.count = counts.get(scan, {}).get(key, 0)
            found = {k: n for k, n in found.items() if n.count}
            for key, node in found.items():
                above = key >> 3
                while above and above not in found:  # a node whose points all went up or are hidden shows nothing itself
                    above >>= 3
                node.parent = (scan, above) if above else None
            out += found.values()
        return out

    def request(self, camera: Camera) -> Iterator[Part]:
        """The points of a camera's view: what is held first, then the rest by weight. Starting a request cancels the one
        before, whose iterator ends with Cancelled."""
        if self.job is not None:
            self.job.cancel()
        job = self.job = Job(self.project.spark)
        shown = self.shown = []

        def parts():
            for part in self._parts(camera, job):
                shown.append(part.points)
                yield part

        return parts()

    def _parts(self, camera: Camera, job: Job) -> Iterator[Part]:
        job.check()
        chosen = octree.select_view(job.run(lambda: self.nodes(camera)), camera, self.budget)
        have = [(n, q) for n, q in chosen if (n.key, self.labels) in self.held]
        if have:
            for n, _ in have:
                self.held.move_to_end((n.key, self.labels))
            yield Part([n.key for n, _ in have], pa.concat_tables([_even(self.held[n.key, self.labels], q) for n, q in have]), True, [])
        step, size = [], 0
        missing = [(n, q) for n, q in chosen if (n.key, self.labels) not in self.held]
        for k, (n, q) in enumerate(missing):
            step.append((n, q))
            size += n.count
            if size >= self.step or k == len(missing) - 1:
                job.check()
                files, own = self._read([n for n, _ in step], job)
                job.check()
                yield Part([n.key for n, _ in step], pa.concat_tables([_even(own[n.key], q) for n, q in step]), False, files)
                step, size = [], 0

    def preview(self, selection: Selection) -> pa.Table:
        """The points of the last request, as far as they came, that a selection would move: scan, chunk, idx. A limited
        depth counts from the nearest of them."""
        if not self.shown:
            return pa.table({"scan": pa.array([], pa.string()), "chunk": pa.array([], pa.int32()), "idx": pa.array([], pa.int32())})
        points = self.project.spark.createDataFrame(pa.concat_tables(self.shown).select(["scan", "chunk", "idx", "x", "y", "z"]))
        nearest = filters.selection_nearest(points, selection).first()["nearest"] if selection.depth_limited else None
        if selection.depth_limited and nearest is None:
            points = points.limit(0)
        return filters.move_selection(points, selection, nearest).select("scan", "chunk", "idx").toArrow()

    def frame(self, nodes: list[StoredNode]) -> DataFrame:
        """The visible points of some nodes of one scan, from their files only."""
        scan, project = nodes[0].key[0], self.project
        folder = f"{project.path('points')}/scan_{scan}"
        files = sorted({f for n in nodes for f in n.files})
        held = sorted({t for n in nodes for t in n.files.values()})
        own = project.spark.read.parquet(*(f"{folder}/{f}" for f in files)).where(F.col("_node").isin([n.key[1] for n in nodes]))
        state = project.history.current
        changes = project._table("labels", scan) if state.labels else None
        if changes is None:
            own = own.withColumn("code", F.lit(0).cast("short"))
        else:
            seq = F.array_position(F.lit(list(state.labels)), F.col("patch"))
            last = layers.last_labels(changes.where(F.col("patch").isin(list(state.labels)) & F.col("_tile").isin(held)).withColumn("seq", seq), REF)
            own = layers.labelled(own, last, REF)
        return layers.visible(own, state.shown, "valid")

    def _read(self, nodes: list[StoredNode], job: Job) -> tuple[list[str], dict[tuple, pa.Table]]:
        out, files = {}, []
        for scan in dict.fromkeys(n.key[0] for n in nodes):
            own = [n for n in nodes if n.key[0] == scan]
            df = self.frame(own)
            files += df.inputFiles() if not self.project.history.current.labels else sorted({f for n in own for f in n.files})
            m = self.project.history.world(scan)
            table = job.run(lambda df=df: df.select("_node", "scan", "chunk", "idx", "x", "y", "z", *(c for c in "rgb" if c in df.columns)).toArrow())
            place = np.stack([table.column(c).to_numpy() for c in "xyz"], 1) @ m[:3, :3].T + m[:3, 3]
            for k, c in enumerate("xyz"):
                table = table.set_column(table.schema.get_field_index(c), c, pa.array(place[:, k]))
            node = table.column("_node").to_numpy()
            order = np.lexsort((table.column("idx").to_numpy(), table.column("chunk").to_numpy(), node))
            table, node = table.take(pa.array(order)), node[order]
            for n in own:
                lo, hi = np.searchsorted(node, n.key[1]), np.searchsorted(node, n.key[1], side="right")
                out[n.key] = self.held[n.key, self.labels] = table.slice(lo, hi - lo)
        total = sum(len(t) for t in self.held.values())
        while total > self.kept and len(self.held) > len(nodes):
            total -= len(self.held.popitem(last=False)[1])
        return files, out


def _even(points: pa.Table, quota: int) -> pa.Table:
    """Elements k * n / quota of a node's points; all where the quota is not less."""
    n = len(points)
    return points if quota >= n else points.take(pa.array(np.arange(quota, dtype=np.int64) * n // max(1, quota)))
