"""A project's versioned state: scans, layers, folders, transforms, registrations, panoramas, revisions, undo.

A state is an immutable value; an edit makes the next one from it, with a new operation at its log's end, and checks
it. Points and labels are tables elsewhere (plans.project); a state only names them.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import numpy as np

from pointloom.errors import InvalidState
from pointloom.functions.geometry import Bounds, Pose, rotation_vector

DEFAULT_LAYER = 0
MOST_LAYERS = 256
MOST_UNDO = 200


@dataclass(frozen=True)
class Layer:
    code: int
    name: str
    visible: bool = True


@dataclass(frozen=True)
class Scan:
    """What is fixed at import. pose: as in the source, None without one; bounds in the scan's own coordinates; images:
    what the source says of each picture of the scan, and the file below the project that holds it; buckets: the number
    that its points and labels are dealt out to."""

    id: str
    name: str
    pose: Pose | None = None
    bounds: Bounds | None = None
    records: int = 0
    valid: int = 0
    crs: str | None = None
    attributes: tuple[str, ...] = ()
    las: dict | None = None
    guid: str = ""
    images: tuple[dict, ...] = ()
    buckets: int = 1


@dataclass(frozen=True)
class Group:
    id: str
    name: str
    parent: str | None = None


@dataclass(frozen=True)
class Registration:
    method: str
    pose: Pose
    rms: float | None = None
    overlap: float | None = None
    distance: float | None = None
    stopped: bool = False
    references: int = 0
    at: int = 0


@dataclass(frozen=True)
class Panorama:
    id: str
    name: str
    width: int
    height: int
    path: str = ""


@dataclass(frozen=True)
class State:
    id: str
    parent: str | None = None
    name: str | None = None
    operations: tuple[dict, ...] = ()
    saved_at: int | None = None
    scans: tuple[str, ...] = ()
    layers: tuple[Layer, ...] = (Layer(DEFAULT_LAYER, "Default"),)
    labels: tuple[str, ...] = ()
    transforms: dict[str, Pose] = field(default_factory=dict)
    groups: tuple[Group, ...] = ()
    member_of: dict[str, str] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    registrations: dict[str, Registration] = field(default_factory=dict)
    panoramas: tuple[Panorama, ...] = ()
    pairs: dict[str, tuple] = field(default_factory=dict)

    @property
    def shown(self) -> list[int]:
        return [x.code for x in self.layers if x.visible]

    def layer(self, name_or_code: str | int) -> Layer:
        for x in self.layers:
            if name_or_code in (x.code, x.name):
                return x
        raise InvalidState(f"no layer {name_or_code}")

    def free_code(self) -> int:
        used = {x.code for x in self.layers}
        for k in range(MOST_LAYERS):
            if k not in used:
                return k
        raise InvalidState("no layer is free")

    def parent_of(self, item: str) -> str | None:
        return next((g.parent for g in self.groups if g.id == item), self.member_of.get(item))

    def above(self, item: str) -> list[str]:
        """The folders that hold an item, the innermost first."""
        out, at = [], self.parent_of(item)
        while at is not None:
            if at in out:
                raise InvalidState("folders hold each other")
            out.append(at)
            at = self.parent_of(at)
        return out

    def within(self, item: str) -> list[str]:
        """The scans in a folder at any depth, or the scan itself."""
        return [s for s in self.scans if s == item or item in self.above(s)]

    def scans_record(self, taken: list[str] | None) -> str | dict | list:
        """The shortest way to say which of the scans an operation took: all, the ones left out, or the ones taken."""
        own = [s for s in self.scans if taken is None or s in taken]
        left = [s for s in self.scans if s not in own]
        if not left:
            return "all"
        return {"except": left} if len(left) < len(own) else own

    def children(self, parent: str | None) -> list[str]:
        """Folders first, then scans and panoramas."""
        return [g.id for g in self.groups if g.parent == parent] + [i for i in (*self.scans, *(p.id for p in self.panoramas)) if self.member_of.get(i) == parent]

    def display_order(self, parent: str | None = None, depth: int = 0) -> list[tuple[str, int]]:
        """All items with their depth, each folder before what it holds, folders before others."""
        out = []
        for i in self.children(parent):
            out.append((i, depth))
            if any(g.id == i for g in self.groups):
                out += self.display_order(i, depth + 1)
        return out

    def totals(self, records: dict[str, int]) -> dict[str, tuple[int, int]]:
        """Of each folder the scans at any depth and their records."""
        return {g.id: (len(own := self.within(g.id)), sum(records.get(s, 0) for s in own)) for g in self.groups}

    def frame(self, item: str) -> np.ndarray:
        """What the folders above an item do to it."""
        m = np.eye(4)
        for g in self.above(item):
            if g in self.transforms:
                m = self.transforms[g].matrix @ m
        return m

    def own(self, item: str) -> np.ndarray:
        return self.transforms[item].matrix if item in self.transforms else np.eye(4)

    def correction(self, item: str) -> np.ndarray:
        return self.frame(item) @ self.own(item)

    def check(self, known: dict[str, Scan], patches: set[str] | None = None) -> None:
        for s in self.scans:
            if s not in known:
                raise InvalidState(f"unknown scan {s}")
        if patches is not None and not set(self.labels) <= patches:
            raise InvalidState("unknown labels")
        codes = [x.code for x in self.layers]
        if len(set(codes)) < len(codes) or DEFAULT_LAYER not in codes or not all(0 <= c < MOST_LAYERS for c in codes):
            raise InvalidState("layers need different codes and a default one")
        ids = {g.id for g in self.groups}
        if len(ids) < len(self.groups) or any(g.parent is not None and g.parent not in ids for g in self.groups) or any(g not in ids for g in self.member_of.values()):
            raise InvalidState("unknown or repeated folder")
        for g in self.groups:
            self.above(g.id)
        for pose in self.transforms.values():
            if not np.isfinite(pose.matrix).all():
                raise InvalidState("a transform is not finite")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of_json(text: str) -> State:
        d = json.loads(text)
        pose = lambda p: Pose(tuple(p["t"]), tuple(p["q"])) if p else None
        return State(**d | {"operations": tuple(d["operations"]), "scans": tuple(d["scans"]), "labels": tuple(d["labels"]), "layers": tuple(Layer(**x) for x in d["layers"]), "groups": tuple(Group(**x) for x in d["groups"]), "transforms": {k: pose(v) for k, v in d["transforms"].items()}, "registrations": {k: Registration(**v | {"pose": pose(v["pose"])}) for k, v in d["registrations"].items()}, "panoramas": tuple(Panorama(**x) for x in d["panoramas"]), "pairs": {k: tuple(map(tuple, v)) for k, v in d["pairs"].items()}})


def new_id() -> str:
    return str(uuid.uuid4())


class History:
    """The saved revisions, the working state and what can be undone."""

    def __init__(self, known: dict[str, Scan] | None = None):
        self.known: dict[str, Scan] = known or {}
        first = State(new_id(), operations=({"kind": "create"},), name="Start", saved_at=int(time.time()))
        self.revisions: dict[str, State] = {first.id: first}
        self.saved_id = first.id
        self.draft: State | None = None
        self.undone: list[tuple] = []
        self.done: list[tuple] = []

    @property
    def current(self) -> State:
        return self.draft or self.revisions[self.saved_id]

    @property
    def base(self) -> State:
        return self.revisions[self.saved_id]

    def has_unsaved_changes(self) -> bool:
        return self.draft is not None

    def edit(self, kind: str, change: Callable[[State], State], **details) -> State:
        """The next state, with its operation logged; a change that fails or is not valid leaves the state as it was."""
        now = self.current
        new = change(now)
        new = replace(new, id=new_id(), parent=self.saved_id, name=None, saved_at=None, operations=(*(now.operations if self.draft else ()), {"kind": kind, **details}))
        new.check(self.known)
        self._remember()
        self.draft = new
        return new

    def _remember(self) -> None:
        self.done = [*self.done, (self.saved_id, self.draft)][-MOST_UNDO:]
        self.undone = []

    def undo(self) -> bool:
        if not self.done:
            return False
        self.undone.append((self.saved_id, self.draft))
        self.saved_id, self.draft = self.done.pop()
        return True

    def redo(self) -> bool:
        if not self.undone:
            return False
        self.done.append((self.saved_id, self.draft))
        self.saved_id, self.draft = self.undone.pop()
        return True

    # ---- revisions

    def save(self, name: str) -> State:
        if self.draft is None:
            raise InvalidState("nothing to save")
        if not name.strip():
            raise InvalidState("a revision needs a name")
        new = replace(self.draft, name=name.strip(), saved_at=int(time.time()))
        self.revisions[new.id], self.saved_id, self.draft = new, new.id, None
        self.done, self.undone = [], []
        return new

    def switch(self, revision: str) -> None:
        if self.draft is not None:
            raise InvalidState("changes are not saved")
        if revision not in self.revisions:
            raise InvalidState("no such revision")
        self.saved_id = revision
        self.done, self.undone = [], []

    def discard(self) -> None:
        self.draft, self.done, self.undone = None, [], []

    def restore(self, state: State) -> None:
        """Makes a state of before the working one, with its identity."""
        state.check(self.known)
        self.draft = None if state.id in self.revisions else state
        if state.id in self.revisions:
            self.saved_id = state.id

    def rename(self, revision: str, name: str) -> None:
        if not name.strip():
            raise InvalidState("a revision needs a name")
        self.revisions[revision] = replace(self.revisions[revision], name=name.strip())

    def delete(self, revision: str) -> None:
        """Its children become its parent's."""
        if revision == self.saved_id or len(self.revisions) == 1:
            raise InvalidState("the current revision stays")
        gone = self.revisions.pop(revision)
        self.revisions = {k: replace(r, parent=gone.parent) if r.parent == revision else r for k, r in self.revisions.items()}
        if self.draft is not None and self.draft.parent == revision:
            self.draft = replace(self.draft, parent=gone.parent)

    def states(self) -> list[State]:
        return [*self.revisions.values(), *([self.draft] if self.draft else []), *(d for _, d in (*self.done, *self.undone) if d)]

    # ---- layers

    def create_layer(self, name: str, visible: bool = True) -> Layer:
        name = name.strip()
        if not name or any(x.name == name for x in self.current.layers):
            raise InvalidState("a layer needs a name of its own")
        new = Layer(self.current.free_code(), name, visible)
        self.edit("create_layer", lambda s: replace(s, layers=(*s.layers, new)), layer=new.code, name=name)
        return new

    def _change_layer(self, code: int, **change) -> Callable[[State], State]:
        self.current.layer(code)
        return lambda s: replace(s, layers=tuple(replace(x, **change) if x.code == code else x for x in s.layers))

    def rename_layer(self, code: int, name: str) -> None:
        if code == DEFAULT_LAYER or not name.strip():
            raise InvalidState("the default layer keeps its name, and others need one")
        self.edit("rename_layer", self._change_layer(code, name=name.strip()), layer=code, name=name.strip())

    def set_layer_visible(self, code: int, visible: bool) -> None:
        self.edit("layer_visibility", self._change_layer(code, visible=visible), layer=code, visible=visible)

    # ---- folders

    def create_group(self, name: str, parent: str | None = None) -> Group:
        new = Group(new_id(), name.strip(), parent)
        if not new.name:
            raise InvalidState("a folder needs a name")
        self.edit("create_group", lambda s: replace(s, groups=(*s.groups, new)), group=new.id, name=new.name)
        return new

    def rename_group(self, group: str, name: str) -> None:
        if not name.strip():
            raise InvalidState("a folder needs a name")
        self.edit("rename_group", lambda s: replace(s, groups=tuple(replace(g, name=name.strip()) if g.id == group else g for g in s.groups)), group=group, name=name.strip())

    @staticmethod
    def _placed(s: State, item: str, parent: str | None) -> State:
        """The item in another folder, its own transform changed so that it stays where it is."""
        world = s.correction(item)
        if any(g.id == item for g in s.groups):
            s = replace(s, groups=tuple(replace(g, parent=parent) if g.id == item else g for g in s.groups))
        else:
            members = {k: v for k, v in s.member_of.items() if k != item}
            s = replace(s, member_of=members | ({item: parent} if parent is not None else {}))
        own = Pose.of(np.linalg.inv(s.frame(item)) @ world)
        return replace(s, transforms={k: v for k, v in s.transforms.items() if k != item} | ({} if own.is_identity() else {item: own}))

    def move_to_group(self, items: list[str], parent: str | None) -> None:
        def change(s: State) -> State:
            for i in items:
                if parent is not None and (parent == i or i in s.above(parent)):
                    raise InvalidState("a folder cannot go into itself")
                s = self._placed(s, i, parent)
            return s

        self.edit("move", change, items=list(items), parent=parent)

    def ungroup(self, group: str) -> None:
        def change(s: State) -> State:
            parent = s.parent_of(group)
            for i in s.children(group):
                s = self._placed(s, i, parent)
            return replace(s, groups=tuple(g for g in s.groups if g.id != group), transforms={k: v for k, v in s.transforms.items() if k != group}, registrations={k: v for k, v in s.registrations.items() if k != group})

        self.edit("ungroup", change, group=group)

    def remove_items(self, items: list[str], kind: str = "remove_items") -> None:
        """Scans, folders with all in them, and panoramas leave the state."""

        def change(s: State) -> State:
            gone = set(items)
            gone |= {g.id for g in s.groups if gone & set(s.above(g.id))}
            gone |= {i for i in (*s.scans, *(p.id for p in s.panoramas)) if i in gone or gone & set(s.above(i))}
            left = lambda d: {k: v for k, v in d.items() if k not in gone}
            return replace(s, scans=tuple(x for x in s.scans if x not in gone), groups=tuple(g for g in s.groups if g.id not in gone), panoramas=tuple(p for p in s.panoramas if p.id not in gone), transforms=left(s.transforms), member_of=left(s.member_of), names=left(s.names), registrations=left(s.registrations), pairs=left(s.pairs))

        self.edit(kind, change, items=list(items))

    def remove_scans(self, scans: list[str]) -> None:
        self.remove_items(scans, "remove_scans")

    def name_of(self, scan: str) -> str:
        return self.current.names.get(scan, self.known[scan].name)

    def rename_scans(self, names: dict[str, str]) -> int:
        """A scan's imported name, or none, takes the renaming back; returns how many names changed."""
        new = dict(self.current.names)
        for s, n in names.items():
            n = n.strip()
            if not n or n == self.known[s].name:
                new.pop(s, None)
            else:
                new[s] = n
        changed = sum(1 for s in names if new.get(s) != self.current.names.get(s))
        if changed:
            self.edit("rename_scans", lambda s: replace(s, names=new), count=changed)
        return changed

    # ---- transforms and registrations

    def set_transform(self, item: str, pose: Pose) -> None:
        self.edit("transform", lambda s: replace(s, transforms={k: v for k, v in s.transforms.items() if k != item} | ({} if pose.is_identity() else {item: pose})), item=item)

    def moved_pose(self, item: str, motion: np.ndarray) -> Pose:
        """The item's own transform after a motion in project coordinates."""
        above = self.current.frame(item)
        return Pose.of(np.linalg.inv(above) @ motion @ above @ self.current.own(item))

    def apply_alignments(self, fits: dict[str, tuple[Pose, dict]], kind: str = "align_all") -> None:
        def change(s: State) -> State:
            poses = dict(s.transforms)
            records = dict(s.registrations)
            for item, (pose, fit) in fits.items():
                poses.pop(item, None)
                if not pose.is_identity():
                    poses[item] = pose
                records[item] = Registration(pose=pose, at=int(time.time()), **fit)
            return replace(s, transforms=poses, registrations=records)

        self.edit(kind, change, items=list(fits))

    def apply_alignment(self, item: str, pose: Pose, **fit) -> None:
        self.apply_alignments({item: (pose, fit)}, "align")

    def registration(self, item: str) -> Registration | None:
        """The item's own, while it still stands where that put it."""
        r = self.current.registrations.get(item)
        return r if r is not None and np.abs(r.pose.matrix - self.current.own(item)).max() <= 1e-6 else None

    def scan_registration(self, scan: str) -> tuple[str, Registration] | None:
        """The nearest valid one of the scan and the folders that hold it."""
        for item in (scan, *self.current.above(scan)):
            if (r := self.registration(item)) is not None:
                return item, r
        return None

    def scatter(self, scans: list[str], anchors: dict[str, tuple[float, float, float]], seed: int) -> None:
        """Turns each scan about Z by an angle that the seed gives, and gathers their anchors (project coordinates) at the
        mean place, on the lowest height."""
        to = np.array([np.mean([anchors[s][0] for s in scans]), np.mean([anchors[s][1] for s in scans]), min(anchors[s][2] for s in scans)])
        angles = splitmix_angles(seed, len(scans))

        def change(s: State) -> State:
            poses = dict(s.transforms)
            for scan, a in zip(scans, angles, strict=True):
                m, back = np.eye(4), np.eye(4)
                m[:3, :3] = rotation_vector([0, 0, a])
                back[:3, 3] = -np.array(anchors[scan])
                m[:3, 3] = to
                above = s.frame(scan)
                poses[scan] = Pose.of(np.linalg.inv(above) @ m @ back @ above @ s.own(scan))
            return replace(s, transforms=poses)

        self.edit("scatter", change, scans=list(scans), seed=seed)

    # ---- panoramas

    def add_panorama(self, p: Panorama, pose: Pose) -> None:
        self.edit("import_panorama", lambda s: replace(s, panoramas=(*s.panoramas, p), transforms=s.transforms | ({} if pose.is_identity() else {p.id: pose})), panorama=p.id, name=p.name)

    def rename_panorama(self, panorama: str, name: str) -> None:
        self.edit("rename_panorama", lambda s: replace(s, names=s.names | {panorama: name.strip()}), panorama=panorama)

    def place_panorama(self, panorama: str, world: np.ndarray, pairs: list[tuple], rms: float) -> None:
        pose = Pose.of(np.linalg.inv(self.current.frame(panorama)) @ world)
        record = Registration("pairs", pose, rms=rms, references=len(pairs), at=int(time.time()))
        self.edit("place_panorama", lambda s: replace(s, transforms=s.transforms | {panorama: pose}, pairs=s.pairs | {panorama: tuple(map(tuple, pairs))}, registrations=s.registrations | {panorama: record}), panorama=panorama)

    # ---- geometry of scans

    def world(self, scan: str) -> np.ndarray:
        """From the scan's own coordinates to the project's: folders, own transform, original pose."""
        pose = self.known[scan].pose
        return self.current.correction(scan) @ (pose.matrix if pose else np.eye(4))

    def scanner(self, scan: str) -> np.ndarray | None:
        """Where the scanner stood, in the scan's coordinates: their origin, if the scan has a pose that no other current
        one shares and the origin is no farther from its box than that is wide."""
        own = self.known[scan]
        if own.pose is None or own.bounds is None or any(self.known[s].pose == own.pose for s in self.current.scans if s != scan):
            return None
        lo, hi = np.array(own.bounds.lo), np.array(own.bounds.hi)
        gap = np.linalg.norm(np.maximum(np.maximum(lo, -hi), 0))
        return np.zeros(3) if gap <= 2 * own.bounds.radius else None

    def bounds(self) -> Bounds | None:
        """Of the corners of all scans' boxes, in project coordinates."""
        out = None
        for s in self.current.scans:
            if (b := self.known[s].bounds) is not None:
                b = b.moved(self.world(s))
                out = b if out is None else out.include(b.lo).include(b.hi)
        return out

    def unreferenced(self, scans: set[str], patches: set[str], panoramas: set[str]) -> dict[str, set[str]]:
        """What no state refers to."""
        states = self.states()
        return {"scans": scans - {x for s in states for x in s.scans}, "patches": patches - {x for s in states for x in s.labels}, "panoramas": panoramas - {p.id for s in states for p in s.panoramas}}


def splitmix_angles(seed: int, n: int) -> list[float]:
    """n angles of a full turn from a 64-bit seed, by the SplitMix64 generator."""
    # fixed values of that generator
    step, first, second = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
    word, out = (1 << 64) - 1, []
    for _ in range(n):
        seed = (seed + step) & word
        z = seed
        z = ((z ^ (z >> 30)) * first) & word
        z = ((z ^ (z >> 27)) * second) & word
        out.append(((z ^ (z >> 31)) >> 11) / (1 << 53) * 2 * math.pi)
    return out


def operation_counts(operations) -> list[tuple[str, int]]:
    """Kinds of operations and how many, in the order of their first."""
    out: dict[str, int] = {}
    for o in operations:
        out[o["kind"]] = out.get(o["kind"], 0) + 1
    return list(out.items())


def revision_lanes(revisions: list[State]) -> dict[str, int]:
    """A column for each revision of a graph, the newest first: a child's lane goes on to its parent; lanes are reused."""
    open_lanes: list[str | None] = []
    out = {}
    for r in sorted(revisions, key=lambda r: -(r.saved_at or 0)):
        lane = open_lanes.index(r.id) if r.id in open_lanes else next((k for k, x in enumerate(open_lanes) if x is None), len(open_lanes))
        while lane >= len(open_lanes):
            open_lanes.append(None)
        open_lanes = [None if x == r.id else x for x in open_lanes]
        if r.parent is not None and r.parent not in open_lanes:
            open_lanes[lane] = r.parent
        out[r.id] = lane
    return out
