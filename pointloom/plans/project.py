"""A project: points and label changes in Parquet below a folder, and the state that says what of them counts."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import shutil
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, replace
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.errors import InvalidState, ProjectLocked, TargetExists, UnsupportedFormat
from pointloom.functions.geometry import Bounds, CropBox, Pose, Selection, affine, xyz
from pointloom.operators import filters, hierarchy, layers, registration, statistics, tiles
from pointloom.plans.state import DEFAULT_LAYER, History, Layer, Panorama, Scan, State, new_id

#: A point of a scan, and its tile, by which points and labels are dealt out alike.
POINT = ("chunk", "idx")
REF = (*POINT, "_tile")
VERSION = 3
LABELS = "chunk int, idx int, code short, _tile bigint, patch string"
#: Points of a bucket of a scan's tables: at most, and at least, between which a scan is dealt out to all cores.
BUCKET, LEAST_BUCKET = 2_000_000, 250_000
#: Bytes of a row group, which a region can skip, label patches of a state beyond which they are made one, and scans that
#: are imported at a time.
ROW_GROUP, MOST_PATCHES, IMPORTS = 1 << 20, 64, 4
#: Ranges of node keys that a region is turned into at most, and the level below which it is not told apart.
MOST_RANGES, REGION_LEVEL = 64, 5


def inner_path(name: str) -> str:
    """A path below the project; anything that could lead out of it is an error."""
    parts = name.split("/")
    if not name or any(p in ("", ".", "..") or "\\" in p or "\0" in p for p in parts):
        raise InvalidState(f"{name!r} leads out of the project")
    return name


#: Lock files that this process holds, by path, and how often.
_held: dict[str, list] = {}


class ProjectLock:
    """The right to change a project: one process at a time. It ends with the process, whatever becomes of it; within a
    process it can be taken again."""

    def __init__(self, root: str):
        self.path = os.path.realpath(f"{root}/project.lock")
        if self.path in _held:
            _held[self.path][1] += 1
            return
        file = open(self.path, "a+")  # noqa: SIM115
        try:
            fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            file.close()
            raise ProjectLocked(f"{root} is in use by another process") from e
        _held[self.path] = [file, 1]

    def release(self) -> None:
        if self.path is None:
            return
        held, self.path = _held[self.path], self.path
        held[1] -= 1
        if not held[1]:
            _held.pop(self.path)
            held[0].close()
        self.path = None


class PointProject:
    """Layout: points/scan_<id>/ (chunk, idx, valid, x, y, z, r, g, b, a and the source's attributes, bucketed by _tile and
    sorted by _node), nodes/scan_<id>/ (the display nodes, their files and bounds), labels/scan_<id>/patch=<id>/ (chunk,
    idx, code, _tile, in the points' buckets, so that they meet without moving points), project.json (scans, revisions,
    working state), project.lock. Points are written once and never again. Only one process has a project open; close()
    ends that, or the end of a with block."""

    #: How an import lays points out: points of a tile, of a leaf and of a bucket at most, and cells along a node's side.
    tile_points, leaf_points, bucket_points, grid = tiles.MOST_TILE, tiles.MOST_LEAF, BUCKET, tiles.GRID

    def __init__(self, spark: SparkSession, root: str, history: History | None = None):
        self.spark, self.root = spark, root
        self.history = history or History()
        # points and labels are both dealt out by _tile alone; by default Spark would move them to join on more columns
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.lock = ProjectLock(root)

    def close(self) -> None:
        self.lock.release()

    def __enter__(self) -> PointProject:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    # ---- files

    @staticmethod
    def create(spark: SparkSession, root: str) -> PointProject:
        if os.path.exists(f"{root}/project.json"):
            raise TargetExists(root)
        os.makedirs(root, exist_ok=True)
        project = PointProject(spark, root)
        project.store()
        return project

    def store(self) -> None:
        """Replaces project.json as a whole."""
        h = self.history
        text = json.dumps({"version": VERSION, "scans": {k: asdict(s) for k, s in h.known.items()}, "revisions": {k: r.to_json() for k, r in h.revisions.items()}, "current": h.saved_id, "draft": h.draft.to_json() if h.draft else None})
        part = f"{self.root}/.project.json.{new_id()}"
        Path(part).write_text(text)
        os.replace(part, f"{self.root}/project.json")

    @staticmethod
    def load(spark: SparkSession, root: str) -> PointProject:
        project = PointProject(spark, root)
        try:
            project.history = PointProject._read(root)
        except BaseException:
            project.close()
            raise
        return project

    @staticmethod
    def _read(root: str) -> History:
        d = json.loads(Path(f"{root}/project.json").read_text())
        if d.get("version") != VERSION:
            raise InvalidState("another version's project")
        h = History()
        pose = lambda p: Pose(tuple(p["t"]), tuple(p["q"])) if p else None
        box = lambda b: Bounds(tuple(b["lo"]), tuple(b["hi"])) if b else None
        h.known = {k: Scan(**s | {"pose": pose(s["pose"]), "bounds": box(s["bounds"]), "attributes": tuple(s["attributes"]), "images": tuple(s["images"])}) for k, s in d["scans"].items()}
        h.revisions = {k: State.of_json(r) for k, r in d["revisions"].items()}
        h.saved_id, h.draft = d["current"], State.of_json(d["draft"]) if d["draft"] else None
        if h.saved_id not in h.revisions:
            raise InvalidState("no current revision")
        for s in h.states():
            s.check(h.known)
        return h

    def path(self, name: str) -> str:
        return f"{self.root}/{inner_path(name)}"

    # ---- import

    def import_points(self, scans: list[tuple[Scan, DataFrame]], folder: str | None = None) -> list[str]:
        """Adds scans in one edit; with a folder's name, or of more than one, in a folder of their own."""
        with ThreadPoolExecutor(IMPORTS) as pool:
            jobs = [pool.submit(self._stored, scan, points) for scan, points in scans]
        failed = next((e for j in jobs if (e := j.exception()) is not None), None)
        if failed is not None:
            for s in (j.result() for j in jobs if j.exception() is None):
                for kind in ("points", "nodes"):
                    shutil.rmtree(f"{self.path(kind)}/scan_{s.id}", ignore_errors=True)
            raise failed
        added = [j.result() for j in jobs]
        self.history.known.update({s.id: s for s in added})
        ids = [s.id for s in added]

        def change(s: State) -> State:
            s = replace(s, scans=(*s.scans, *ids))
            if folder is None and len(ids) < 2:
                return s
            from pointloom.plans.state import Group

            g = Group(new_id(), folder or "Import")
            return replace(s, groups=(*s.groups, g), member_of=s.member_of | dict.fromkeys(ids, g.id))

        self.history.edit("import", change, scans=len(ids))
        self.store()
        return ids

    def _stored(self, scan: Scan, points: DataFrame) -> Scan:
        """Writes a scan's points beside the project's, in the nodes of its octree, and moves them in as a whole."""
        target, part = f"{self.path('points')}/scan_{scan.id}", f"{self.path('staging')}/{new_id()}"
        nodes = f"{self.path('nodes')}/scan_{scan.id}"
        if os.path.exists(target):
            raise TargetExists(target)
        steps = 0

        def written(df: DataFrame) -> DataFrame:
            nonlocal steps
            steps += 1
            df.write.parquet(f"{part}/step{steps}")
            return self.spark.read.parquet(f"{part}/step{steps}")

        try:
            os.makedirs(f"{part}/points")
            valid = F.col("valid")
            b = points.agg(F.count("*").alias("records"), F.count_if(valid).alias("n"), *(f(F.when(valid, F.col(c))).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz")).first()
            bounds = Bounds((b["lox"], b["loy"], b["loz"]), (b["hix"], b["hiy"], b["hiz"])) if b["n"] else None
            cores = self.spark.sparkContext.defaultParallelism
            in_bucket = min(self.bucket_points, max(LEAST_BUCKET, b["records"] // (2 * cores)))
            buckets, (lo, size) = -(-max(1, b["records"]) // in_bucket), tiles.cube(bounds)
            laid, deepest = tiles.tiled(points.withColumn("scan", F.lit(scan.id)), lo, size, POINT, written, self.tile_points)
            built = tiles.with_nodes(laid, lo, size, POINT, buckets, self.leaf_points, self.grid)
            self._bucketed(built, f"{part}/built", buckets, "_waiting", dealt=True)
            kept = [f"{part}/built/_waiting=false"]
            if os.path.isdir(late := f"{part}/built/_waiting=true"):
                above = tiles.above_tiles(self.spark.read.parquet(late), lo, size, POINT, deepest, written, self.grid)
                self._bucketed(above, f"{part}/above", buckets)
                kept.append(f"{part}/above")
            if not b["records"]:
                built.drop("_waiting").write.mode("overwrite").parquet(f"{part}/points")
            for folder in kept:
                for name in os.listdir(folder) if os.path.isdir(folder) else ():
                    if name.endswith(".parquet"):
                        os.rename(f"{folder}/{name}", f"{part}/points/{name}")
            own = self.spark.read.parquet(f"{part}/points")
            tiles.node_table(own).coalesce(1).write.parquet(f"{part}/nodes")
            os.makedirs(self.path("points"), exist_ok=True)
            os.makedirs(self.path("nodes"), exist_ok=True)
            os.rename(f"{part}/nodes", nodes)
            os.rename(f"{part}/points", target)
        finally:
            shutil.rmtree(part, ignore_errors=True)
        return replace(scan, bounds=bounds, records=b["records"], valid=b["n"], buckets=buckets, attributes=tuple(own.columns))

    def _bucketed(self, rows: DataFrame, path: str, buckets: int, *parts: str, dealt: bool = False) -> None:
        """Writes rows to a folder in buckets by _tile, sorted by _node where there is one. dealt: they lie in as many
        partitions by _tile already."""
        name = f"pointloom_{new_id().replace('-', '')}"
        order = ["_node", "chunk", "idx"] if "_node" in rows.columns else ["_tile", "chunk", "idx"]
        w = (rows if dealt else rows.repartition(buckets, "_tile")).write.format("parquet").option("path", path).option("parquet.block.size", ROW_GROUP)
        w = w.partitionBy(*parts) if parts else w
        w.bucketBy(buckets, "_tile").sortBy(*order).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # an external table: its files stay

    def _table(self, kind: str, scan: str) -> DataFrame | None:
        """A scan's points or labels as a bucketed table of the session; None where there are no files."""
        path = os.path.abspath(f"{self.path(kind)}/scan_{scan}")
        if not os.path.isdir(path):
            return None
        name = f"pointloom_{kind}_{hashlib.md5(path.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            labels = kind == "labels"
            columns = LABELS if labels else self.spark.read.parquet(path).schema.toDDL()
            where = path.replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {'PARTITIONED BY (patch)' if labels else ''} CLUSTERED BY (_tile) INTO {self.history.known[scan].buckets} BUCKETS LOCATION '{where}'")
            if labels:
                self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return self.spark.table(name)

    def import_file(self, source: str) -> list[str]:
        from pointloom.sources import e57, las

        kind = Path(source).suffix.lower()
        name = Path(source).stem
        if kind == ".las":
            return self.import_points([las.scan_of(self.spark, source, name)])
        if kind == ".e57":
            pictures = self._keep_images(e57.read_images(source))
            own = [(replace(scan, images=tuple(p for p in pictures if p["scan"] and p["scan"] == scan.guid)), points) for scan, points in e57.scans_of(self.spark, source)]
            return self.import_points(own, folder=name)
        raise UnsupportedFormat(f"{kind or source}: only LAS and E57 files are read here")

    def _keep_images(self, images: list) -> list[dict]:
        """Writes pictures below the project; what is said of each, and its file."""
        out = []
        os.makedirs(self.path("images"), exist_ok=True)
        for image in images:
            file = f"images/{new_id()}"
            Path(self.path(file)).write_bytes(image.data)
            if image.mask:
                Path(f"{self.path(file)}.mask").write_bytes(image.mask)
            out.append({"file": file, "masked": bool(image.mask), **{k: v for k, v in asdict(image).items() if k not in ("data", "mask")}})
        return out

    def _images(self) -> list:
        """The pictures of the current scans, moved as their scans were, and the panoramas."""
        from pointloom.sources import e57

        h, out = self.history, []
        for s in h.current.scans:
            for d in h.known[s].images:
                d = dict(d)
                path = self.path(d.pop("file"))
                mask = Path(f"{path}.mask").read_bytes() if d.pop("masked") else b""
                pose = Pose(tuple(d["pose"]["t"]), tuple(d["pose"]["q"])) if d["pose"] else Pose()
                out.append(e57.Image(**d | {"data": Path(path).read_bytes(), "mask": mask, "scan": s, "pose": Pose.of(h.current.correction(s) @ pose.matrix)}))
        for p in h.current.panoramas:
            out.append(e57.panorama_image(h.current.names.get(p.id, p.name), p.id, Path(self.path(p.path)).read_bytes(), Pose.of(h.current.correction(p.id)), p.width, p.height))
        return out

    def import_panorama(self, source: str) -> Panorama:
        from pointloom.sources.images import image_size

        w, h = image_size(Path(source).read_bytes()[:1 << 20])
        if abs(w / h - 2) >= 0.02:
            raise UnsupportedFormat("a panorama is twice as wide as high")
        p = Panorama(new_id(), Path(source).stem, w, h, f"panoramas/{Path(source).name}")
        os.makedirs(self.path("panoramas"), exist_ok=True)
        shutil.copyfile(source, self.path(p.path))
        b = self.history.bounds()
        self.history.add_panorama(p, Pose(tuple(b.center.tolist())) if b else Pose())
        self.store()
        return p

    # ---- points

    def records(self, scans: list[str] | None = None, around: Bounds | None = None, touched: Callable[[np.ndarray], Callable[[Bounds], bool]] | None = None, level: int | None = None) -> DataFrame:
        """All records of the current scans, with their layer; attributes that a scan lacks are null.

        around: in project coordinates, a box beyond which records may be left out; Parquet skips row groups by it.
        touched: gives, for a scan's world matrix, a condition on boxes in the scan's own coordinates; display nodes whose
        box fails it may be left out, as ranges of node keys, by which Parquet skips too. level: the last display level;
        what lies below is left out, and records without a place. No point of a labelled scan is moved to meet its label."""
        own = [s for s in self.history.current.scans if scans is None or s in scans]
        out = None
        for s in own:
            part = self._table("points", s)
            if around is not None:
                b = around.moved(np.linalg.inv(self.history.world(s)))
                slack = 1e-9 * (1 + np.abs([around.lo, around.hi, b.lo, b.hi]).max())  # of rounding on both ways
                for c, lo, hi in zip(xyz(), b.lo, b.hi, strict=True):
                    part = part.where(c.between(float(lo - slack), float(hi + slack)))
            if touched is not None:
                ranges = self.key_ranges(s, touched(self.history.world(s)))
                part = part.where(reduce(lambda a, b: a | b, (F.col("_node").between(lo, hi) for lo, hi in ranges), F.lit(False)))
            if level is not None:
                part = part.where(F.col("_node").between(tiles.ROOT, (1 << 3 * (level + 1)) - 1))
            part = self._labelled(part, s)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out if out is not None else self.spark.createDataFrame([], "scan string, chunk int, idx int, _tile bigint, _node bigint, valid boolean, x double, y double, z double, code short")

    def _labelled(self, part: DataFrame, scan: str) -> DataFrame:
        patches = self.history.current.labels
        changes = self._table("labels", scan) if patches else None
        if changes is None:
            return part.withColumn("code", F.lit(DEFAULT_LAYER).cast("short"))
        changes = changes.where(F.col("patch").isin(list(patches))).withColumn("seq", F.array_position(F.lit(list(patches)), F.col("patch")))
        return layers.labelled(part, layers.last_labels(changes, REF).hint("shuffle_hash"), REF)

    def nodes(self, scan: str) -> DataFrame:
        """A scan's display nodes: node, level, tile, file, n, and bounds in its own coordinates."""
        return self.spark.read.parquet(f"{self.path('nodes')}/scan_{scan}")

    def key_ranges(self, scan: str, condition: Callable[[Bounds], bool]) -> list[tuple[int, int]]:
        """Ranges of node keys that hold every node whose box meets a condition: MOST_RANGES at most, the smallest gaps
        closed. Nodes are asked where they lie and told apart down to REGION_LEVEL levels below the root."""

        def ask(batches):
            for b in batches:
                box = np.stack([np.asarray(b.column(f"{n}_{c}")) for n in ("min", "max") for c in "xyz"], 1)
                ok = np.array([condition(Bounds(tuple(x[:3]), tuple(x[3:]))) for x in box.tolist()], bool)
                yield pa.RecordBatch.from_arrays([b.column("node").filter(pa.array(ok)), b.column("level").filter(pa.array(ok))], names=["node", "level"])

        met = self.nodes(scan).drop("tile", "file", "n").distinct().mapInArrow(ask, "node bigint, level int")
        coarse = F.expr(f"shiftright(node, greatest(level - {REGION_LEVEL}, 0) * 3)")
        rows = met.groupBy("level", coarse).agg(F.min("node").alias("lo"), F.max("node").alias("hi")).collect()  # 18 * 8^REGION_LEVEL at most
        spans = sorted((r["lo"], r["hi"]) for r in rows)
        gaps = sorted(range(1, len(spans)), key=lambda k: spans[k][0] - spans[k - 1][1])
        closed = set(gaps[: max(0, len(spans) - MOST_RANGES)])
        out: list[tuple[int, int]] = []
        for k, (lo, hi) in enumerate(spans):
            if k in closed:
                out[-1] = (out[-1][0], max(hi, out[-1][1]))
            else:
                out.append((lo, hi))
        return out

    def points(self, scans: list[str] | None = None, around: Bounds | None = None, **how) -> DataFrame:
        """Valid points of visible layers; how: as of records()."""
        return layers.visible(self.records(scans, around, **how), self.history.current.shown, "valid")

    def world_points(self, scans: list[str] | None = None, around: Bounds | None = None, **how) -> DataFrame:
        """points() in project coordinates, with the scan's place in the order."""
        out = self.points(scans, around, **how)
        rows = [(s, k, *(float(v) for v in self.history.world(s)[:3].ravel())) for k, s in enumerate(self.history.current.scans)]
        m = self.spark.createDataFrame(rows, "scan string, scan_order int, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(4)))
        joined = out.join(F.broadcast(m), "scan")  # a row for each scan
        world = [((F.col(f"m{i}0") * F.col("x") + F.col(f"m{i}1") * F.col("y")) + F.col(f"m{i}2") * F.col("z") + F.col(f"m{i}3")).alias(f"w{c}") for i, c in enumerate("xyz")]
        return joined.select(*[c for c in out.columns if c not in "xyz"], "scan_order", *world).withColumnsRenamed({"wx": "x", "wy": "y", "wz": "z"})

    # ---- moving points between layers

    def move(self, moved: DataFrame, target: str | int, kind: str, always: bool = False, **details) -> int:
        """Relabels points (scan, ref, code) into a layer, which is made, hidden, if it does not exist. Moving none changes
        nothing. scans: those that were asked, None for all; the log has them in their shortest form."""
        state = self.history.current
        if "scans" in details:
            details["scans"] = state.scans_record(details["scans"])
        known = next((x for x in state.layers if target in (x.code, x.name)), None)
        layer = known or Layer(state.free_code(), str(target), False)
        changes = layers.relabel(moved, layer.code, ("scan", *REF))
        patch, n = self._patch(changes)
        if not n and not always:
            return 0
        added = () if known else (layer,)
        self.history.edit(kind, lambda s: replace(s, labels=(*s.labels, *([patch] if n else [])), layers=(*s.layers, *added)), target=layer.code, moved=n, **details)
        if len(self.history.current.labels) > MOST_PATCHES:
            self.compact_labels()
        self.store()
        return n

    def _patch(self, changes: DataFrame) -> tuple[str, int]:
        """Writes labels (scan, ref, code) in the buckets of their scans' points; the patch and their number."""
        patch, part, n = new_id(), f"{self.path('staging')}/{new_id()}", 0
        try:
            changes.select("scan", *REF, "code").write.partitionBy("scan").parquet(part)
            for folder in sorted(x for x in os.listdir(part) if x.startswith("scan=")):
                scan = folder[5:]
                own = self.spark.read.parquet(f"{part}/{folder}")
                n += own.count()
                path = os.path.abspath(f"{self.path('labels')}/scan_{scan}")
                self._bucketed(own, f"{path}/patch={patch}", self.history.known[scan].buckets)
                name = f"pointloom_labels_{hashlib.md5(path.encode()).hexdigest()}"
                if self.spark.catalog.tableExists(name):
                    self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (patch='{patch}')")
        finally:
            shutil.rmtree(part, ignore_errors=True)
        return patch, n

    def compact_labels(self) -> None:
        """Makes the working state's patches one, of each point's last label. Other states keep theirs."""
        h, patches = self.history, self.history.current.labels
        out = None
        for s in h.current.scans:
            if (t := self._table("labels", s)) is not None:
                own = t.where(F.col("patch").isin(list(patches))).withColumn("seq", F.array_position(F.lit(list(patches)), F.col("patch")))
                own = layers.last_labels(own, REF).where(F.col("code") != DEFAULT_LAYER).withColumn("scan", F.lit(s))
                out = own if out is None else out.unionByName(own)
        if out is None or len(patches) < 2:
            return
        patch, n = self._patch(out)
        h.draft = replace(h.draft or h.current, labels=(patch,) if n else ())
        self.store()

    def subsample(self, size: float, target: str = "Subsampled", scans: list[str] | None = None) -> int:
        return self.move(filters.voxel_subsample(self.points(scans), size, REF), target, "subsample", scans=scans, voxel=size)

    def subsample_merged(self, size: float, target: str = "Subsampled", scans: list[str] | None = None) -> int:
        return self.move(filters.voxel_subsample_merged(self.world_points(scans), size, ("scan_order", *REF)), target, "subsample", scans=scans, voxel=size, merged=True)

    def remove_noise(self, radius: float = 0.05, min_neighbours: int = 4, target: str = "Noise", scans: list[str] | None = None) -> int:
        return self.move(filters.remove_noise(self.points(scans), radius, min_neighbours, REF), target, "noise_filter", scans=scans, radius=radius, neighbours=min_neighbours)

    def remove_outliers(self, k: int = 6, deviations: float = 1.0, reach: float = 0.5, target: str = "Noise", scans: list[str] | None = None) -> int:
        return self.move(filters.remove_outliers(self.points(scans), k, deviations, reach, REF), target, "outlier_filter", scans=scans, neighbours=k, deviations=deviations)

    def scanners(self) -> dict[str, np.ndarray]:
        return {s: self.history.world(s)[:3, 3] for s in self.history.current.scans if self.history.scanner(s) is not None}

    def reduce_overlap(self, size: float = 0.1, target: str = "Overlap", scans: list[str] | None = None) -> int:
        order = {s: k for k, s in enumerate(self.history.current.scans)}
        rows = [(order[s], *map(float, p)) for s, p in self.scanners().items()]
        at = self.spark.createDataFrame(rows, "scan_order int, sx double, sy double, sz double")
        return self.move(filters.reduce_overlap(self.world_points(scans), size, REF, at, "scan_order"), target, "reduce_overlap", scans=scans, size=size)

    def remove_moving(self, degrees: float = 0.1, tolerance: float = 0.05, min_scans: int = 2, target: str = "Moving", scans: list[str] | None = None) -> int:
        frames = {s: np.linalg.inv(self.history.world(s)) for s in self.scanners()}
        return self.move(filters.remove_moving(self.world_points(scans), frames, REF, degrees, tolerance, min_scans), target, "moving_objects", scans=scans, degrees=degrees)

    def move_box(self, box: CropBox, inside: bool, target: str, scans: list[str] | None = None) -> int:
        box.check()
        around = box.bounds if inside else None
        return self.move(filters.move_box(self.world_points(scans, around), box, inside), target, "box", scans=scans, inside=inside)

    def selected_points(self, selection: Selection, scans: list[str] | None = None) -> DataFrame:
        """world_points() without the nodes that a selection of what is inside cannot touch."""
        if not selection.inside:
            return self.world_points(scans)
        return self.world_points(scans, touched=lambda world: lambda box: selection.may_touch(box.moved(world)))

    def move_selection(self, selection: Selection, target: str, scans: list[str] | None = None) -> int:
        """A limited depth counts from the nearest selected point of all scans."""
        if not selection.depth_limited:
            return self.move(filters.move_selection(self.selected_points(selection, scans), selection), target, "selection", scans=scans)
        nearest = self.selection_nearest(selection)
        if nearest is None:
            return 0
        return self.move(filters.move_selection(self.selected_points(selection, scans), selection, nearest), target, "selection", scans=scans, depth=selection.depth)

    def selection_nearest(self, selection: Selection, scans: list[str] | None = None) -> float | None:
        return filters.selection_nearest(self.selected_points(selection, scans), selection).first()["nearest"]

    def move_layer_points(self, source: str | int, target: str | int) -> int:
        """All records of a layer, shown or not, valid or not."""
        code = self.history.current.layer(source).code
        return self.move(self.records().where(F.col("code") == code), target, "move_layer", source=code)

    def delete_layer(self, layer: str | int) -> int:
        """Its points go back to the default layer."""
        code = self.history.current.layer(layer).code
        if code == DEFAULT_LAYER:
            raise InvalidState("the default layer stays")
        n = self.move(self.records().where(F.col("code") == code), DEFAULT_LAYER, "delete_layer", always=True, layer=code)
        h = self.history
        h.draft = replace(h.draft, layers=tuple(x for x in h.draft.layers if x.code != code))
        self.store()
        return n

    # ---- answers

    def layer_counts(self) -> DataFrame:
        own = self.spark.createDataFrame([(x.code,) for x in self.history.current.layers], "code short")
        return layers.layer_counts(self.records(), own)

    def visible_bounds(self) -> DataFrame:
        return layers.bounds(self.points(), "scan")

    def world_matrix(self, scan: str) -> np.ndarray:
        return self.history.world(scan)

    def anchors(self, scans: list[str]) -> dict[str, tuple[float, float, float]]:
        return {r["scan"]: (r["ax"], r["ay"], r["az"]) for r in statistics.scan_anchor(self.world_points(scans)).collect()}

    def scatter_scans(self, scans: list[str], seed: int) -> None:
        self.history.scatter(scans, self.anchors(scans), seed)
        self.store()

    def sample_points(self, scans: list[str], budget: int, around: Bounds | None = None) -> DataFrame:
        """World points of whole display levels, the coarsest first, until their number reaches the budget; what is over one
        and a half times it is thinned evenly. Files below those levels are not read."""
        counts: dict[int, int] = {}
        for s in scans:
            for r in self.nodes(s).groupBy("level").agg(F.sum("n").alias("n")).collect():  # a row for each level
                counts[r["level"]] = counts.get(r["level"], 0) + r["n"]
        last, total = tiles.levels_within(counts, budget)
        out = self.world_points(scans, around, level=last)
        if total <= 1.5 * budget:
            return out
        return out.where(F.pmod(F.xxhash64("scan", *REF), F.lit(1 << 20)) < int((1 << 20) * budget / total))

    def icp(self, item: str, reference: list[str], samples: int = 60_000, whole: bool = False, **options) -> tuple[Pose, registration.IcpResult]:
        """The item's own transform that aligns it to the reference scans; nothing is changed. Of both sides samples of
        whole display levels are aligned on the driver or, where whole is set, all points in Spark."""
        moving = self.history.current.within(item)
        target = [s for s in reference if s not in moving]
        if not moving or not target:
            raise InvalidState("nothing to align")
        reach = options.get("max_distance", 0.5)
        box = None
        for s in moving:
            if (b := self.history.known[s].bounds) is not None:
                b = b.moved(self.world_matrix(s))
                box = b if box is None else box.include(b.lo).include(b.hi)
        if box is None:
            raise InvalidState("nothing to align")
        box = Bounds(tuple(v - reach for v in box.lo), tuple(v + reach for v in box.hi))
        near = lambda df: reduce(lambda a, c: a.where(c[0].between(float(c[1]), float(c[2]))), zip(xyz(), box.lo, box.hi, strict=True), df)
        if whole:
            result = registration.icp_tables(self.world_points(moving), near(self.world_points(target, box)), ("scan", *POINT), **options)
        else:
            own, to = self.sample_points(moving, samples), near(self.sample_points(target, 4 * samples, box))
            result = registration.icp(registration.samples(own, samples, ("scan", *REF)), registration.samples(to, 4 * samples, ("scan", *REF)), **options)
        return self.history.moved_pose(item, result.motion), result

    def align_globally(self, scans: list[str] | None = None, fixed: tuple = (), samples: int = 30_000, whole: bool = False, **options) -> registration.GlobalResult:
        """Motions that bring overlapping scans together: from samples of whole display levels on the driver or, where whole
        is set, from all points in Spark."""
        own = scans or list(self.history.current.scans)
        if whole:
            return registration.adjust_tables(self.world_points(own), POINT, fixed, **options)
        return registration.align_globally({s: registration.samples(self.sample_points([s], samples), samples, ("scan", *REF)) for s in own}, fixed, **options)

    def cleanup(self) -> dict[str, int]:
        """Removes what no state refers to; the state is written first."""
        inner = lambda d: os.listdir(d) if os.path.isdir(d) else []
        stored = {f"labels/{s}/{p}": p.removeprefix("patch=") for s in inner(self.path("labels")) for p in inner(self.path(f"labels/{s}")) if p.startswith("patch=")}
        found = self.history.unreferenced(set(self.history.known), set(stored.values()), {p.id for s in self.history.states() for p in s.panoramas})
        for s in found["scans"]:
            self.history.known.pop(s)
        self.store()
        files = n = 0
        gone = [f"{kind}/scan_{s}" for kind in ("points", "nodes", "labels") for s in found["scans"]] + [f for f, p in stored.items() if p in found["patches"]]
        for s in {f.split("/")[1] for f in gone if f.startswith("labels/")}:  # the session's table of what is left is made anew
            self.spark.sql(f"DROP TABLE IF EXISTS pointloom_labels_{hashlib.md5(os.path.abspath(self.path(f'labels/{s}')).encode()).hexdigest()}")
        for folder in map(self.path, gone):
            for d, _, names in os.walk(folder):
                files, n = files + len(names), n + sum(os.path.getsize(f"{d}/{x}") for x in names)
            shutil.rmtree(folder, ignore_errors=True)
        return {"scans": len(found["scans"]), "patches": len(found["patches"]), "files": files, "bytes": n}

    def export_las(self, target: str, merged: bool = True, omit_incompatible: bool = False) -> int:
        from pointloom.sources import las

        if merged:
            return las.export(self.world_points(), target, [self.history.known[s] for s in self.history.current.scans], omit_incompatible)
        os.makedirs(target, exist_ok=True)
        stems = safe_stems([self.history.name_of(s) for s in self.history.current.scans])
        paths = [f"{target}/{x}.las" for x in stems]
        if any(os.path.exists(p) for p in paths):
            raise TargetExists("a file is there already")
        return sum(las.export(self.world_points([s]), p, [self.history.known[s]], omit_incompatible) for s, p in zip(self.history.current.scans, paths, strict=True))

    def export_e57(self, target: str) -> int:
        from pointloom.sources import e57

        scans = self.history.current.scans
        return e57.export(target, [(self.history.known[s], self.history.name_of(s), Pose.of(self.history.world(s)), self.records([s]).where(F.col("code").isin(self.history.current.shown))) for s in scans], tuple(self._images()))


def safe_stems(names: list[str]) -> list[str]:
    """File names without what file systems refuse, different in lower case too."""
    return hierarchy.numbered_stems([hierarchy.bare_stem(n) for n in names])


def world_of(matrix: np.ndarray, points: DataFrame) -> DataFrame:
    """points in other coordinates."""
    return points.withColumns(dict(zip("xyz", affine(matrix, xyz()), strict=True)))
