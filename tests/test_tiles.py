"""The stored octree, labels that meet points where they lie, and views that read files of nodes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.errors import Cancelled
from pointloom.functions.geometry import Bounds, Camera, Pose, Selection
from pointloom.operators import octree, tiles
from pointloom.plans.project import PointProject
from pointloom.plans.state import Scan
from pointloom.plans.view import View
from pointloom.session import checkpoint
from pointloom.sources import demo


def uneven(spark, n=12_000):
    """A sheet, a dense corner, a pile of equal points, and records without a place."""
    rng = np.random.default_rng(7)
    p = rng.uniform(0, 8, (n, 3)) * [1, 1, 0.05]
    p[: n // 3] = rng.normal(size=(n // 3, 3)) * 0.01 + 5
    p[n // 3 : n // 3 + 900] = [7.0, 7.0, 0.1]
    rows = [(0, k, bool(k % 50), *map(float, p[k]), 1, 2, 3, 255) for k in range(n)]
    return spark.createDataFrame(rows, "chunk int, idx int, valid boolean, x double, y double, z double, r short, g short, b short, a short")


def small(spark, root):
    p = PointProject.create(spark, root)
    p.tile_points, p.leaf_points, p.bucket_points, p.grid = 500, 100, 1500, 8
    return p


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    p = small(spark, str(tmp_path_factory.mktemp("t")))
    p.import_points([(Scan("a", "a", Pose((100.0, 0.0, 0.0))), uneven(spark))])
    return p


def test_every_point_is_in_one_node(spark, stored):
    rows = stored.records().select("idx", "valid", "x", "y", "z", "_tile", "_node").toPandas()
    assert len(rows) == 12_000 == rows["idx"].nunique()
    want = {r["idx"]: (r["x"], r["y"], r["z"]) for r in uneven(spark).collect()}
    assert all(want[i] == (x, y, z) for i, x, y, z in rows[["idx", "x", "y", "z"]].itertuples(index=False))
    lo, size = tiles.cube(stored.history.known["a"].bounds)
    assert (rows[~rows["valid"]]["_node"] == tiles.NOWHERE).all()
    own = rows[rows["valid"]]
    level = own["_node"].map(lambda k: (k.bit_length() - 1) // 3).to_numpy()
    cells = np.floor((own[["x", "y", "z"]].to_numpy() - lo) / size * (1 << level)[:, None]).astype(int)
    key = [sum(((int(c[a]) >> b & 1) << 3 * b + a) for a in range(3) for b in range(lv)) | 1 << 3 * lv for c, lv in zip(cells, level, strict=True)]
    assert (np.array(key) == own["_node"].to_numpy()).all()
    counts = rows.groupby("_tile").size()
    assert counts.max() <= 500 and len(counts) > 20 and level.max() > 5
    # a node that has children keeps one point of a cell of its grid
    nodes = set(own["_node"])
    inner = {k >> 3 * j for k in nodes for j in range(1, 18) if k >> 3 * j}
    step = size / (1 << level) / 8
    cell = np.floor((own[["x", "y", "z"]].to_numpy() - lo) / step[:, None]).astype(int)
    seen = [(k, *c) for k, c in zip(own["_node"], cell.tolist(), strict=True) if k in inner]
    assert len(seen) == len(set(seen)) > 50 and 1 in inner


def test_the_root_takes_what_is_nearest_its_cells_centres(spark, stored):
    """Two levels only: the root's points are those that a plain search finds."""
    p = small(spark, stored.root + "2")
    p.tile_points, p.leaf_points = 10**6, 2500
    own = uneven(spark).where("idx >= 6000 AND valid")
    p.import_points([(Scan("b", "b"), own)])
    lo, size = tiles.cube(p.history.known["b"].bounds)
    rows = p.records().select("idx", "x", "y", "z", "_node").toPandas()
    place = rows[["x", "y", "z"]].to_numpy()
    assert {(k.bit_length() - 1) // 3 for k in rows["_node"]} == {0, 1}
    step = size / 8
    cell = np.floor((place - lo) / step)
    far = ((place - lo - (cell + 0.5) * step) ** 2).sum(1)
    best = {}
    for c, d, i in zip(map(tuple, cell.tolist()), far, rows["idx"], strict=True):
        best[c] = min(best.get(c, (np.inf, 0)), (d, i))
    assert {i for _, i in best.values()} == set(rows[rows["_node"] == 1]["idx"])


def test_node_table(spark, stored):
    table = stored.nodes("a").toPandas()
    assert table["n"].sum() == 11_760 and table["level"].max() > 5
    root = table[table["node"] == 1].iloc[0]
    b = stored.history.known["a"].bounds
    assert (root["min_x"], root["max_z"]) == (b.lo[0], b.hi[2])  # of the node and all below it
    for file, rows in table.groupby("file"):
        held = {r["_node"] for r in spark.read.parquet(f"{stored.root}/points/scan_a/{file}").select("_node").distinct().collect()} - {0}
        assert held == set(rows["node"])


def test_tiles_by_counts_go_on_below_a_full_cell(spark, tmp_path):
    """More than a round of levels, down to equal places, which are cut into parts."""
    p = uneven(spark).withColumn("valid", F.lit(True))
    steps = iter(range(99))

    def written(df):
        path = f"{tmp_path}/{next(steps)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    out, deepest = tiles.tiled(p, (0.0, 0.0, 0.0), 8.1, ("chunk", "idx"), written, 100)
    counts = {r["_tile"]: r["count"] for r in out.groupBy("_tile").count().collect()}
    assert sum(counts.values()) == 12_000 and deepest == tiles.DEPTH
    parts = [t for t in counts if t >> tiles.KEY_BITS]
    assert len(parts) >= 8 and len({t & (1 << tiles.KEY_BITS) - 1 for t in parts}) == 1
    keys = {t & (1 << tiles.KEY_BITS) - 1 for t in counts}
    assert not any(k >> 3 * j in keys for k in keys for j in range(1, 18))  # no tile within another
    assert max(n for t, n in counts.items() if (t & (1 << tiles.KEY_BITS) - 1).bit_length() <= 3 * tiles.DEPTH) <= 100


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange"), plan


def test_labels_meet_points_where_they_lie(spark, tmp_path):
    p = small(spark, f"{tmp_path}/p")
    p.import_points([(Scan("a", "a"), uneven(spark)), (Scan("b", "b"), uneven(spark, 3000))])
    want = {}
    for k in range(12):
        code = p.history.create_layer(f"L{k}").code if k < 4 else p.history.current.layer(f"L{k % 4}").code
        some = p.records().where((F.col("idx") % 12 == k) | (F.col("idx") % 7 == k))
        p.move(some, code, "test")
        want |= {(s, i): code for s, n in (("a", 12_000), ("b", 3000)) for i in range(n) if i % 12 == k or i % 7 == k}
    assert len(p.history.current.labels) == 12
    read = p.records()
    n, plan = exchanges(read)
    assert n == 0 and "SelectedBucketsCount" in plan, plan
    got = {(r["scan"], r["idx"]): r["code"] for r in read.select("scan", "idx", "code").collect()}
    assert len(got) == 15_000 and {k: v for k, v in got.items() if v} == want
    before = p.history.current.labels
    p.compact_labels()
    assert len(p.history.current.labels) == 1 and exchanges(p.records())[0] == 0
    again = PointProject.load(spark, p.root)
    for q in (p, again):
        assert {(r["scan"], r["idx"]): r["code"] for r in q.records().select("scan", "idx", "code").collect()} == got
    p.history.undo()
    assert p.history.current.labels == before[:-1]
    while p.history.undo():
        pass
    assert p.records().where("code <> 0").count() == 0


def test_old_patches_are_made_one(spark, tmp_path, monkeypatch):
    from pointloom.plans import project

    monkeypatch.setattr(project, "MOST_PATCHES", 3)
    p = small(spark, f"{tmp_path}/p")
    p.import_points([(Scan("a", "a"), uneven(spark, 600))])
    for k in range(5):
        p.move(p.records().where(F.col("idx") % 5 == k), "one", "test")
    assert len(p.history.current.labels) <= 3 and p.records().where("code = 1").count() == 600
    assert p.delete_layer("one") == 600 and p.records().where("code = 1").count() == 0


def rows_scanned(df):
    df._jdf.queryExecution().executedPlan().executeCollect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kids = node.children()
        todo += [kids.apply(k) for k in range(kids.size())]
        if "Scan" in node.nodeName():
            n += node.metrics().apply("numOutputRows").value()
    return n


def test_a_selection_reads_what_it_can_touch(spark, tmp_path):
    p = PointProject.create(spark, f"{tmp_path}/p")
    p.leaf_points, p.tile_points, p.grid = 4096, 65_536, 32
    p.import_points([(Scan("a", "a", Pose((100.0, 0.0, 0.0))), demo.demo_points(spark, 512))])
    camera = Camera((101.5, 1.5, 0.0), 0.3, -1.2, 6.0)
    selection = Selection(camera, [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        inside = selection.covers((F.col("x"), F.col("y"), F.col("z")))
        found = p.selected_points(selection).select("x", "y", "z")
        assert rows_scanned(found) < 512 * 512 / 3
        want = p.world_points().where(inside).count()
        assert found.where(inside).count() == want > 100
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert p.move_selection(selection, "Picked") == want
    rest = Selection(camera, selection.polygon, inside=False)
    assert p.move_selection(rest, "Rest") == 512 * 512 - want


def test_views_read_what_is_new(spark, stored):
    view = View(stored, budget=4000, step=300)
    b = stored.history.bounds()
    first = Camera.framing(Bounds((104.9, 4.9, 4.9), (105.1, 5.1, 5.1)))
    parts = list(view.request(first))
    shown = [n for p in parts for n in p.nodes]
    assert len(parts) > 1 and len(shown) == len(set(shown)) and not any(p.cached for p in parts)
    chosen = octree.select_view(view.nodes(first), first, 4000)
    assert [n.key for n, _ in chosen] == shown  # the best first
    assert sum(p.points.num_rows for p in parts) == sum(q for _, q in chosen) <= 4000
    place = np.concatenate([np.asarray(p.points.column("x")) for p in parts])
    assert 99.9 < place.min() and place.max() < 108.1
    second = Camera.framing(b)
    again = list(view.request(second))
    old = {n for p in again if p.cached for n in p.nodes}
    new = [n for p in again if not p.cached for n in p.nodes]
    assert old and old <= set(shown) and not set(new) & set(shown)
    files = {r["file"] for r in stored.nodes("a").where(F.col("node").isin([n for _, n in new])).collect()}
    read = {f.split("/")[-1] for p in again for f in p.files}
    assert read == files
    look = Camera((105.0, 5.0, 5.0), 0.3, -1.2, 3.0)
    selection = Selection(look, [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)])
    marked = set(view.preview(selection).column("idx").to_pylist())
    moves = {r["idx"] for r in stored.world_points().where(selection.covers((F.col("x"), F.col("y"), F.col("z")))).select("idx").collect()}
    drawn = {i for p in again for i in p.points.column("idx").to_pylist()}
    assert marked == moves & drawn and marked
    third = list(view.request(second))
    assert len(third) == 1 and third[0].cached and third[0].files == []
    early = view.request(Camera.framing(Bounds((100.0, 0.0, 0.0), (101.0, 1.0, 0.4))))
    late = view.request(second)
    with pytest.raises(Cancelled):
        list(early)
    assert len(list(late)) == 1


def test_samples_are_whole_levels(spark, stored):
    counts = {r["level"]: r["n"] for r in stored.nodes("a").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    budget = counts[0] + counts[1] + 1
    last, total = tiles.levels_within(counts, budget)
    assert last == 2 and total == counts[0] + counts[1] + counts[2]
    got = stored.sample_points(["a"], budget)
    levels = got.select(tiles.level_of(F.col("_node")).alias("k")).groupBy("k").count().collect()
    assert {r["k"] for r in levels} <= {0, 1, 2} and got.count() <= max(1.5 * budget, 1.2 * budget)
    assert stored.sample_points(["a"], 10**6).count() == 11_760
    s = stored.history.current
    assert s.scans_record(None) == s.scans_record(["a"]) == "all"


def test_views_show_visible_points(spark, tmp_path):
    p = small(spark, f"{tmp_path}/p")
    p.import_points([(Scan("a", "a"), uneven(spark, 3000))])
    view = View(p, budget=10**6)
    camera = Camera.framing(p.history.bounds())
    ids = lambda parts: [i for x in parts for i in x.points.column("idx").to_pylist()]
    first = ids(view.request(camera))
    assert len(first) == sum(q for _, q in octree.select_view(view.nodes(camera), camera, 10**6)) > 500
    p.subsample(0.5)
    left = {r["idx"] for r in p.points().select("idx").collect()}
    second = ids(view.request(camera))
    assert set(first) & left <= set(second) <= left and not set(first) <= left
    assert len(ids(View(p, budget=3).request(camera))) <= 3
    p.history.undo()
    assert ids(view.request(camera)) == first or set(ids(view.request(camera))) == set(first)


def test_an_empty_scan_and_one_without_places(spark, tmp_path):
    p = small(spark, f"{tmp_path}/p")
    p.import_points([(Scan("a", "a"), uneven(spark, 100).limit(0)), (Scan("b", "b"), uneven(spark, 100).withColumn("valid", F.lit(False)))])
    assert p.records().count() == 100 and p.points().count() == 0
    assert p.nodes("a").count() == p.nodes("b").count() == 0 and p.history.bounds() is None
    assert list(View(p).request(Camera.framing(Bounds((0, 0, 0), (1, 1, 1))))) == []


def test_small_tiles_are_taken_together(spark):
    """Nodes of many tiles, some without a place and one cut in parts, are those of each tile by itself."""
    rng = np.random.default_rng(8)
    p = np.round(rng.uniform(0, 64, (3000, 3)) ** 1.5 / 8, 1)
    p[:400] = 7.7
    rows = [(k, bool(k % 50), *map(float, v)) for k, v in enumerate(p)]
    points = spark.createDataFrame(rows, "ref long, valid boolean, x double, y double, z double")
    laid = checkpoint(tiles.tiled(points, (0.0, 0.0, 0.0), 64.0, ("ref",), checkpoint, 60)[0])
    own = {r["ref"]: r for r in laid.collect()}
    want = {}
    by_tile = {}
    for k, r in own.items():
        by_tile.setdefault(r["_tile"], []).append(k)
    for tile, refs in by_tile.items():
        key = tile & (1 << tiles.KEY_BITS) - 1
        if key == tiles.NOWHERE:
            want |= {k: (0, False) for k in refs}
            continue
        refs, top = sorted(refs), (key.bit_length() - 1) // 3
        code = np.array([own[k]["_code"] for k in refs])
        level = tiles.lift(p[refs], code, np.arange(len(refs)), top, (0.0, 0.0, 0.0), 64.0, 10, 4)
        node = (np.int64(1) << 3 * level) | code >> 3 * (tiles.DEPTH - level)
        want |= {k: (int(n), bool(v == top and top > 0)) for k, n, v in zip(refs, node, level, strict=True)}
    for tasks in (1, 3, None):
        built = tiles.with_nodes(laid, (0.0, 0.0, 0.0), 64.0, ("ref",), tasks, 10, 4)
        assert {r["ref"]: (r["_node"], r["_waiting"]) for r in built.collect()} == want
    assert len(by_tile) > 100
    t = pa.table({"_tile": [1, 1, 2, 2, 2, 2, 3, 5, 5], "v": range(9)})
    got = [x.column("_tile").to_pylist() for x in tiles.whole_tiles(t.to_batches(max_chunksize=2), 3)]
    assert [v for x in got for v in x] == t.column("_tile").to_pylist() and len(got) > 2
    assert not any(set(a) & set(b) for k, a in enumerate(got) for b in got[k + 1 :])
