import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.errors import InvalidState, TargetExists, UnsupportedFormat
from pointloom.functions.geometry import CropBox, Pose, rotation_vector
from pointloom.plans.project import PointProject, inner_path, safe_stems
from pointloom.plans.state import History, Scan, operation_counts, revision_lanes, splitmix_angles
from pointloom.sources import demo, las


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    p = PointProject.create(spark, str(tmp_path_factory.mktemp("p")))
    p.import_points(demo.demo_scans(spark, 32))
    return p


def total(p):
    return {r["code"]: r["n"] for r in p.layer_counts().collect()}


def test_filters_move_points_and_undo_brings_them_back(spark, project):
    h = project.history
    assert total(project) == {0: 2048}
    n = project.subsample(0.25)
    assert 0 < n < 2048 and total(project) == {0: 2048 - n, 1: n}
    assert project.points().count() == 2048 - n
    assert project.subsample(0.25) == 0
    assert project.subsample_merged(0.25) >= 0
    again = PointProject.load(spark, project.root)
    assert again.history.current == h.current and total(again) == total(project)
    while h.undo():
        pass
    assert h.redo() and h.redo()
    assert total(project)[0] == 2048 - n
    inside = project.move_box(CropBox((0, 0, 0), (1, 1, 9)), True, "Box")
    outside = project.move_box(CropBox((0, 0, 0), (1, 1, 9)), False, "Rest")
    assert inside + outside == 2048 - n and project.points().count() == 0
    assert project.move_layer_points("Rest", "Box") == outside
    assert project.delete_layer("Box") == inside + outside
    assert project.points().count() == 2048 - n
    kinds = dict(operation_counts(h.current.operations))
    assert kinds["box"] == 2 and kinds["delete_layer"] == 1


def test_noise_and_bounds(project):
    assert project.remove_noise(0.001, 1, "Noise") > 0
    project.history.undo()
    assert project.remove_outliers(3, 0.5, 1.0, "Noise") >= 0
    b = project.history.bounds()
    assert b.lo[0] == -2.0 and b.hi[0] > 4
    assert project.visible_bounds().count() == 2


def test_las_round_trip(spark, project, tmp_path):
    n = project.export_las(f"{tmp_path}/all.las")
    back = las.read(spark, f"{tmp_path}/all.las", 500)
    assert back.count() == n == project.points().count()
    a = sorted(map(tuple, project.world_points().select(*(F.round(c, 3) for c in "xyz")).collect()))
    b = sorted(map(tuple, back.select(*(F.round(c, 3) for c in "xyz")).collect()))
    assert np.abs(np.array(a) - np.array(b)).max() <= 0.0011
    with pytest.raises(TargetExists):
        project.export_las(f"{tmp_path}/all.las")
    assert project.export_las(f"{tmp_path}/each", merged=False) == n
    other = PointProject.create(spark, f"{tmp_path}/other")
    other.import_file(f"{tmp_path}/all.las")
    assert other.points().count() == n
    with pytest.raises(UnsupportedFormat):
        other.import_file("x.ply")


def test_las_keeps_attributes(spark, tmp_path):
    row = spark.range(24).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), F.lit(1.5).alias("z"), (F.col("id") * 50).cast("int").alias("intensity"), F.lit(2).alias("return_number"), F.lit(3).alias("number_of_returns"), F.lit(5).alias("classification"), F.lit(True).alias("withheld"), F.lit(True).alias("edge_of_flight_line"), F.lit(12.0).alias("scan_angle"), F.lit(7).alias("user_data"), F.lit(9).alias("point_source_id"), (F.col("id") / 8.0).alias("gps_time"), (F.col("id") * 100).cast("int").alias("red"), F.lit(65535).alias("green"), F.lit(7).alias("blue"), F.lit(11).alias("nir"))
    for nir, fmt in ((True, 8), (False, 3)):
        df = row if nir else row.drop("nir")
        path = f"{tmp_path}/{fmt}.las"
        las.export(df, path, [Scan("a", "a")])
        assert las.read_header(path).format == fmt
        back = las.read(spark, path)
        for c in df.columns:
            got = [r[0] for r in back.orderBy("idx").select(c).collect()]
            want = [r[0] for r in df.orderBy("x").select(c).collect()]
            assert np.allclose(np.array(sorted(got), float), np.array(sorted(want), float), atol=1e-3), c


def test_las_conflicts(spark, tmp_path):
    a, b = Scan("a", "a", crs="X"), Scan("b", "b", crs="Y")
    assert las.conflicts([a, b])["crs"] and not las.conflicts([a, a])["crs"]
    with pytest.raises(Exception, match="coordinate"):
        las.export(spark.range(1).selectExpr("0D AS x", "0D AS y", "0D AS z"), f"{tmp_path}/x.las", [a, b])
    assert las.choose_format(False, False, False, False) == 0 and las.choose_format(True, True, True, False) == 7
    (tmp_path / "bad.las").write_bytes(b"LASF" + bytes(400))
    with pytest.raises((UnsupportedFormat, Exception)):
        las.read(spark, f"{tmp_path}/bad.las").count()


def history(n=3):
    h = History({f"s{k}": Scan(f"s{k}", f"Scan {k}", Pose((float(k), 0, 0))) for k in range(n)})
    from dataclasses import replace

    h.edit("import", lambda s: replace(s, scans=tuple(h.known)))
    return h


def test_folders_keep_places():
    h = history()
    h.set_transform("s1", Pose((0, 1, 0), tuple(np.r_[0, 0, np.sin(0.3), np.cos(0.3)])))
    a = h.create_group("A")
    b = h.create_group("B", a.id)
    h.set_transform(a.id, Pose((5, 5, 5)))
    before = {s: h.world(s) for s in h.known}
    h.move_to_group(["s0", "s1"], b.id)
    assert all(np.allclose(h.world(s), before[s]) for s in h.known)
    assert h.current.within(a.id) == ["s0", "s1"] and h.current.children(None)[0] == a.id
    with pytest.raises(InvalidState):
        h.move_to_group([a.id], b.id)
    h.ungroup(a.id)
    assert all(np.allclose(h.world(s), before[s]) for s in h.known)
    h.remove_items([b.id])
    assert h.current.scans == ("s2",)
    h.undo()
    assert len(h.current.scans) == 3


def test_scans_in_the_log():
    s = history(5).current
    assert s.scans_record(None) == "all" and s.scans_record(["s4", "s1"]) == ["s1", "s4"]
    assert s.scans_record(["s0", "s1", "s2"]) == {"except": ["s3", "s4"]} and s.scans_record([]) == []


def test_revisions():
    h = history()
    first = h.save("one").id
    h.create_layer("L")
    assert h.has_unsaved_changes()
    with pytest.raises(InvalidState):
        h.switch(first)
    second = h.save("two").id
    h.switch(first)
    assert len(h.current.layers) == 1
    h.switch(second)
    h.delete(first)
    assert h.revisions[second].parent != first
    with pytest.raises(InvalidState):
        h.delete(second)
    with pytest.raises(InvalidState):
        h.rename_layer(0, "x")
    assert set(revision_lanes(list(h.revisions.values()))) == set(h.revisions)
    state = type(h.current).of_json(h.current.to_json())
    assert state == h.current


def test_names_and_registrations():
    h = history()
    assert h.rename_scans({"s0": " New ", "s1": "Scan 1"}) == 1 and h.name_of("s0") == "New"
    assert h.rename_scans({"s0": ""}) == 1 and h.name_of("s0") == "Scan 0"
    g = h.create_group("G")
    h.move_to_group(["s0"], g.id)
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = rotation_vector([0, 0, 0.1]), [1, 2, 3]
    h.apply_alignment(g.id, h.moved_pose(g.id, m), method="icp", rms=0.01)
    assert h.scan_registration("s0")[0] == g.id
    h.set_transform(g.id, Pose((9, 9, 9)))
    assert h.scan_registration("s0") is None
    h.scatter(["s1", "s2"], {"s1": (0, 0, 0), "s2": (4, 0, 1)}, 7)
    for s, a in (("s1", (0, 0, 0)), ("s2", (4, 0, 1))):
        base = h.known[s].pose.matrix
        assert np.allclose((h.world(s) @ np.linalg.inv(base) @ [*a, 1])[:3], [2, 0, 0])
    assert splitmix_angles(7, 2) == splitmix_angles(7, 3)[:2]


def test_paths_stems_and_tables():
    from pointloom.sources import tables
    from pointloom.sources.images import image_size

    for bad in ("../x", "a/../b", "", "a//b", "/a"):
        with pytest.raises(InvalidState):
            inner_path(bad)
    assert safe_stems(['a/b', 'A/B', 'a_b_2', ' ', 'x?']) == ["a_b", "A_B_2", "a_b_2_2", "scan", "x_"]
    text = tables.registration_csv([{"item": 'a,"b"', "rms": 1}])
    assert text.startswith("﻿item,") and '"a,""b"""' in text
    assert tables.pasted_names("item\tname\n1\tA\n2\tB\n") == ["A", "B"]
    with pytest.raises(UnsupportedFormat):
        image_size(b"GIF89a")


def test_streamed_import(spark, tmp_path):
    from pointloom.streaming.imports import dropped_points, first_of_voxels

    p = demo.demo_points(spark, 16).withColumn("scan", F.lit(0))
    p.where("idx < 128").write.parquet(f"{tmp_path}/in/a")
    source = dropped_points(spark, f"{tmp_path}/in/*", p.schema.simpleString()[7:-1].replace(":", " "))
    for _ in range(2):
        first_of_voxels(source, 0.5, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        if not (tmp_path / "in/b").exists():
            p.where("idx >= 128").write.parquet(f"{tmp_path}/in/b")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.select("cx", "cy", "cz").distinct().count() > 0


def test_e57_round_trip(spark, project, tmp_path):
    from pointloom.sources import e57

    assert int(e57.page_sums(np.frombuffer(b"123456789", np.uint8)[None])[0]) == 0xE3069283  # the check value of CRC-32C
    n = project.export_e57(f"{tmp_path}/all.e57")
    assert n == project.records().where(F.col("code").isin(project.history.current.shown)).count()
    other = PointProject.create(spark, f"{tmp_path}/other")
    ids = other.import_file(f"{tmp_path}/all.e57")
    assert len(ids) == 2 and other.history.current.groups[0].name == "all"
    own = ("x", "y", "z", "r", "row", "col")
    a = sorted(map(tuple, project.world_points().select(*own).collect()))
    b = sorted(map(tuple, other.world_points().select(*own).collect()))
    assert np.allclose(np.array(a, float), np.array(b, float), atol=1e-9)
    with pytest.raises(TargetExists):
        project.export_e57(f"{tmp_path}/all.e57")
    raw = bytearray((tmp_path / "all.e57").read_bytes())
    raw[-500] ^= 1
    (tmp_path / "bad.e57").write_bytes(raw)
    with pytest.raises((UnsupportedFormat, Exception)):
        other.import_file(f"{tmp_path}/bad.e57")


def test_e57_integers_are_exact():
    from pointloom.sources import e57

    f = e57.Field("rowIndex", "int", 64, -(1 << 63), (1 << 63) - 1)
    narrow = e57.Field("k", "int", 11, -3, 2000)
    v, k = np.array([2**54 + 1, -5, 2**54 + 3], np.int64), np.array([-3, 2000, 17])
    streams = [(v.view(np.uint64) + np.uint64(1 << 63)).tobytes(), np.packbits(e57._packed(k + 3, 11), bitorder="little").tobytes()]
    packet = e57.struct.pack("<HHH", 2, *map(len, streams)) + b"".join(streams)
    packet += bytes(-(len(packet) + 4) % 4)
    flat = e57.struct.pack("<B7xQQQ", 1, 0, 32, 0) + e57.struct.pack("<BBH", 1, 0, len(packet) + 3) + packet
    flat += bytes(-len(flat) % e57.DATA)

    class File:
        def read_at(self, n, at):
            return (flat + bytes(e57.SUM))[at : at + n]

    got = next(e57._columns(File(), e57.Data("", "", None, 0, 3, (f, narrow), {})))
    assert got["rowIndex"].tolist() == v.tolist() and got["k"].tolist() == k.tolist()


def test_e57_ranges_of_uneven_packets():
    from pointloom.sources import e57

    rng, n = np.random.default_rng(3), 5003
    fields = (e57.Field("x", "double"), e57.Field("k", "int", 11, -3, 2000), e57.Field("same", "int", 0, 7, 7), e57.Field("s", "int", 3, 0, 7), e57.Field("y", "float"))
    want = {"x": rng.normal(size=n), "k": rng.integers(-3, 2001, n), "same": np.full(n, 7), "s": rng.integers(0, 8, n), "y": rng.normal(size=n).astype("f4")}
    pack = lambda v, bits: np.packbits(e57._packed(v, bits), bitorder="little").tobytes()
    streams = [want["x"].tobytes(), pack(want["k"] + 3, 11), b"", pack(want["s"], 3), want["y"].tobytes()]
    flat, at = e57.struct.pack("<B7xQQQ", 1, 0, 32, 0), [0] * 5
    while any(a < len(s) for a, s in zip(at, streams, strict=True)):
        if rng.random() < 0.2:  # an index packet, which readers pass over
            flat += e57.struct.pack("<BBH", 0, 0, 31) + bytes(28)
        sizes = [int(min(len(s) - a, rng.integers(0, 900))) for a, s in zip(at, streams, strict=True)]
        body = e57.struct.pack("<H5H", 5, *sizes) + b"".join(s[a : a + k] for a, k, s in zip(at, sizes, streams, strict=True))
        body += bytes(-(len(body) + 4) % 4)
        flat += e57.struct.pack("<BBH", 1, 0, len(body) + 3) + body
        at = [a + k for a, k in zip(at, sizes, strict=True)]
    flat += bytes(-len(flat) % e57.DATA)
    raw = b"".join(flat[k : k + e57.DATA] + bytes(e57.SUM) for k in range(0, len(flat), e57.DATA))

    class File:
        def read_at(self, n, at):
            return raw[at : at + n]

    d = e57.Data("", "", None, 0, n, fields, {})
    for records in (8, 100, 1000, 6000):
        parts = e57.ranges(File(), d, records)
        assert len(parts) == -(-n // (records // 8 * 8)) and sum(p.records for p in parts) == n
        got = [c for p in parts for c in e57._columns(File(), d, p)]
        for name, v in want.items():
            assert np.array_equal(np.concatenate([c[name] for c in got]), v)
    assert e57.ranges(File(), e57.Data("", "", None, 0, 0, fields, {}), 100) == []


def test_e57_is_read_by_many_tasks(spark, project, tmp_path):
    from pointloom.sources import e57

    project.export_e57(f"{tmp_path}/all.e57")
    for scan in range(2):
        whole, parts = (e57.read(spark, f"{tmp_path}/all.e57", scan, records=n) for n in (1 << 20, 64))
        n = whole.count()
        assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() == -(-n // 64) > 1
        assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


def test_commands(spark, tmp_path, capsys):
    from pointloom import cli

    root = f"{tmp_path}/p"
    assert len(cli.run(spark, ["demo", root])) == 2
    assert cli.run(spark, ["subsample", root, "0.2"])[0].endswith("points moved")
    assert cli.run(spark, ["noise", root, "--radius", "0.01"])[0].endswith("points moved")
    lines = cli.run(spark, ["inspect", root])
    assert lines[0].startswith("Demo 1: 16384 records") and any(x.startswith("Subsampled: ") for x in lines)
    assert cli.run(spark, ["export-las", root, f"{tmp_path}/x.las"])[0].endswith("points written")
    assert cli.run(spark, ["import", root, f"{tmp_path}/x.las"])
    with pytest.raises(SystemExit):
        cli.run(spark, ["paint", root])


def test_jobs(spark):
    from pointloom.errors import Cancelled
    from pointloom.plans.jobs import Job

    job = Job(spark)
    assert sum(r[0] for r in job.rows(spark.range(10))) == 45
    job.cancel()
    with pytest.raises(Cancelled):
        job.run(lambda: spark.range(10).count())


def test_colours_and_views(spark):
    from pointloom.functions import colour
    from pointloom.functions.geometry import Bounds, Camera
    from pointloom.operators import octree

    row = spark.range(1).select(colour.by_scan(F.lit(11)).alias("s"), colour.turbo(F.lit(2.0)).alias("t"), colour.shade([F.lit(2.0)] * 8, F.lit(2.0), 1.0).alias("d")).first()
    assert row.s == "#f28e2b" and 0 <= row.t.r <= 1 and row.d == 1.0
    p = demo.demo_points(spark, 32).withColumn("scan", F.lit(0))
    levels = octree.additive_levels(p, (-2.0, -2.0, -1.0), 4.0, 2, ("chunk", "idx"), grid=8).cache()
    nodes = octree.nodes_of(octree.view_nodes(levels))
    chosen = octree.select_view(nodes, Camera.framing(Bounds((-2, -2, -1), (2, 2, 1))), 10**6)
    shown = octree.view_points(levels, chosen, ("chunk", "idx"))
    assert shown.count() == sum(n for _, n in chosen)
    assert shown.where((F.abs(F.col("dx") + F.col("ox") - F.col("x")) > 1e-5)).count() == 0
    spaced = octree.view_spacings(p, chosen)
    assert spaced.where("spacing IS NULL").count() == 0 and spaced.count() == 1024


def test_images_go_along(spark, tmp_path):
    import struct
    import zlib

    from pointloom.sources import e57

    head = struct.pack(">IIBBBBB", 128, 64, 8, 0, 0, 0, 0)
    photo = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head)) + bytes(2000)
    (tmp_path / "pano.png").write_bytes(photo)
    (tmp_path / "wide.png").write_bytes(photo.replace(struct.pack(">II", 128, 64), struct.pack(">II", 96, 32)))
    p = PointProject.create(spark, f"{tmp_path}/p")
    p.import_points(demo.demo_scans(spark, 8))
    with pytest.raises(UnsupportedFormat):
        p.import_panorama(f"{tmp_path}/wide.png")
    pano = p.import_panorama(f"{tmp_path}/pano.png")
    scan = p.history.current.scans[1]
    pin = e57.Image("front", "g1", "pinholeRepresentation", "jpegImage", b"\xff\xd8" + bytes(1500), Pose((1, 2, 3)), scan, {"imageWidth": 10, "focalLength": 0.5}, b"mask")
    e57.export(f"{tmp_path}/a.e57", [(p.history.known[s], "n", Pose(), p.records([s])) for s in p.history.current.scans], (pin, *p._images()))
    first = e57.read_images(f"{tmp_path}/a.e57")
    assert first[0] == pin and first[1].data == photo and first[1].numbers["imageWidth"] == 128
    q = PointProject.create(spark, f"{tmp_path}/q")
    ids = q.import_file(f"{tmp_path}/a.e57")
    assert [len(q.history.known[i].images) for i in ids] == [0, 1]
    q.history.set_transform(ids[1], Pose((5, 0, 0)))
    q = PointProject.load(spark, q.root) if not q.store() else q
    q.export_e57(f"{tmp_path}/b.e57")
    back = e57.read_images(f"{tmp_path}/b.e57")
    assert len(back) == 1 and back[0].pose.t == (6.0, 2.0, 3.0) and back[0].mask == b"mask" and back[0].scan == ids[1]
    assert pano.width == 128


def test_order_totals_pick_and_grey(spark):
    from pointloom.functions.geometry import Camera
    from pointloom.operators.octree import nearest_pick
    from pointloom.sources import e57

    h = history()
    a = h.create_group("A")
    b = h.create_group("B", a.id)
    h.move_to_group(["s1"], b.id)
    assert h.current.display_order() == [(a.id, 0), (b.id, 1), ("s1", 2), ("s0", 0), ("s2", 0)]
    assert h.current.totals({"s0": 5, "s1": 7})[a.id] == (1, 7)
    p = spark.createDataFrame([(1, 5.0, 0.0, 0.0), (2, 3.0, 0.0, 0.0), (3, 5.0, 1.0, 0.0)], "id int, x double, y double, z double")
    camera = Camera((5, 0, 0), 0.0, 0.0, 5.0)
    assert nearest_pick(p, camera, 0.0, 0.0, 0.05, ("id",)).first()["id"] == 2
    assert nearest_pick(p, camera, 0.9, 0.9, 0.05, ("id",)).count() == 0
    d = e57.Data("", "", None, 0, 200, (e57.Field("intensity", "double"),), {})
    pts = spark.range(200).selectExpr("0 AS chunk", "CAST(id AS int) AS idx", "CAST(id AS double) AS intensity", "CAST(180 AS short) AS r", "CAST(195 AS short) AS g", "CAST(210 AS short) AS b")
    got = {r["idx"]: r["r"] for r in e57.coloured(d, pts).collect()}
    assert got[0] == 0 and got[199] == 255 and got[1] == 0 and 120 < got[99] < 130
    assert e57.coloured(d, pts.limit(50)).select("r").distinct().count() == 1


def rows_scanned(df):
    """Runs df and returns how many rows its Parquet scans gave."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    todo, n = [plan], 0
    while todo:
        node = todo.pop()
        kids = node.children()
        todo += [kids.apply(k) for k in range(kids.size())]
        if "Scan" in node.nodeName():
            n += node.metrics().apply("numOutputRows").value()
    return n


def test_a_box_skips_what_is_far_off(spark, tmp_path):
    p = PointProject.create(spark, f"{tmp_path}/p")
    p.import_points([(Scan("a", "a", Pose((100.0, 0.0, 0.0))), demo.demo_points(spark, 512))])
    box = CropBox((98.2, -1.8, 0), (0.2, 0.2, 9))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = p.world_points(None, box.bounds).select("x", "y", "z")
        assert rows_scanned(found) < 512 * 512 / 4
        all_rows = p.world_points().where(box.contains((F.col("x"), F.col("y"), F.col("z"))))
        assert found.where(box.contains((F.col("x"), F.col("y"), F.col("z")))).count() == all_rows.count() > 500
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    n = all_rows.count()
    assert p.move_box(box, True, "Box") == n


def test_one_process_has_a_project_open(spark, tmp_path):
    import subprocess
    import sys

    p = PointProject.create(spark, f"{tmp_path}/p")
    again = PointProject.load(spark, p.root)
    code = "import sys\nfrom pointloom.plans.project import ProjectLock\nfrom pointloom.errors import ProjectLocked\ntry:\n    ProjectLock(sys.argv[1])\nexcept ProjectLocked:\n    sys.exit(7)"
    tried = lambda: subprocess.run([sys.executable, "-c", code, p.root], check=False).returncode
    assert tried() == 7
    p.close()
    assert tried() == 7
    with again:
        pass
    assert tried() == 0


def test_an_import_that_fails_leaves_nothing(spark, tmp_path):
    p = PointProject.create(spark, f"{tmp_path}/p")
    bad = demo.demo_points(spark, 16).withColumn("x", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        p.import_points([(Scan("a", "a"), demo.demo_points(spark, 16)), (Scan("b", "b"), bad)])
    assert not p.history.known and not list((tmp_path / "p" / "points").iterdir()) and not list((tmp_path / "p" / "staging").iterdir())
    assert p.import_points([(Scan("a", "a"), demo.demo_points(spark, 16))]) == ["a"]


def test_many_edits_are_one_relation(spark, tmp_path):
    p = PointProject.create(spark, f"{tmp_path}/p")
    p.import_points([(Scan("a", "a"), demo.demo_points(spark, 16))])
    for k in range(6):
        p.move(p.records().where(F.col("idx") % 7 == k), "A" if k % 2 else "B", "box")
    plan = p.records()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 2
    at = {r["idx"]: r["code"] for r in p.records().collect()}
    codes = {x.name: x.code for x in p.history.current.layers}
    assert all(at[i] == (0 if i % 7 == 6 else codes["A" if i % 7 % 2 else "B"]) for i in range(256))


def test_parts_of_odd_sizes_make_one_file(spark, tmp_path):
    """Tasks write their own packets; records that fill no byte of every stream come last."""
    from pointloom.sources import e57

    points = demo.demo_points(spark, 40).withColumn("valid", F.col("idx") % 3 != 0).repartition(7)
    n = e57.export(f"{tmp_path}/a.e57", [(Scan("a", "a"), "a", Pose((1.0, 2.0, 3.0)), points)])
    assert n == 1600 and [p.name for p in tmp_path.iterdir()] == ["a.e57"]
    [(scan, back)] = e57.scans_of(spark, f"{tmp_path}/a.e57")
    assert np.allclose(scan.pose.t, (1, 2, 3))
    own = lambda df: sorted(map(tuple, df.where("valid").select("x", "y", "z", "r", "g", "b").collect()))
    colours = lambda df: sorted(map(tuple, df.where("NOT valid").select("r", "g", "b").collect()))
    assert own(back) == own(points) and colours(back) == colours(points) and back.count() == 1600
    assert las.export(points, f"{tmp_path}/a.las", [Scan("a", "a")]) == 1600
    assert las.read(spark, f"{tmp_path}/a.las").count() == 1600 and len(list(tmp_path.iterdir())) == 2


def test_import_makes_a_project_and_takes_panoramas(spark, tmp_path):
    import struct

    from pointloom import cli

    las.export(demo.demo_points(spark, 16), f"{tmp_path}/a.las", [Scan("a", "a")])
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBBI", 13, b"IHDR", 200, 100, 8, 2, 0, 0, 0, 0))
    lines = cli.run(spark, ["import", f"{tmp_path}/p", f"{tmp_path}/a.las", f"{tmp_path}/b.png"])
    assert [x.split()[0] for x in lines] == ["scan", "panorama"]
    with PointProject.load(spark, f"{tmp_path}/p") as p:
        assert p.points().count() == 256 and [(x.width, x.height) for x in p.history.current.panoramas] == [(200, 100)]
