"""Filters against brute force on a fixed cloud, whatever its partitions."""

import numpy as np
import pytest

from pointloom.errors import InvalidState
from pointloom.functions.geometry import CropBox, rotation_vector
from pointloom.operators import filters, hierarchy, octree, statistics

REF = ("chunk", "idx")


def words(seed):
    """The xorshift generator on 64 bits, in [0, 1)."""
    s, mask = seed, (1 << 64) - 1
    while True:
        s ^= s << 13 & mask
        s ^= s >> 7
        s ^= s << 17 & mask
        yield (s >> 11) / (1 << 53)


def fixed_cloud():
    u = words(88172645463325252)
    pts = [((k % 2) * 3 + next(u) * 2, (k // 2) * 3 + next(u) * 2, next(u) * 0.05) for k in range(4) for _ in range(200)]
    pts += [(next(u) * 30 - 10, next(u) * 30 - 10, next(u) * 9 + 2) for _ in range(20)]
    return np.array(pts + pts[:3])


def table(spark, p, scan=None, parts=4):
    scan = np.zeros(len(p), int) if scan is None else scan
    rows = [(int(s), i // 64, i % 64, *map(float, q)) for i, (s, q) in enumerate(zip(scan, p, strict=True))]
    return spark.createDataFrame(rows, "scan int, chunk int, idx int, x double, y double, z double").repartition(parts)


def indexes(df):
    return sorted(r["chunk"] * 64 + r["idx"] for r in df.select(*REF).collect())


@pytest.mark.parametrize("parts", [1, 7])
def test_noise(spark, parts):
    p = fixed_cloud()
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    want = np.flatnonzero((d2 <= 0.2**2).sum(1) - 1 < 4).tolist()
    assert indexes(filters.remove_noise(table(spark, p, parts=parts), 0.2, 4, REF)) == want


def test_noise_on_a_pile_of_copies(spark):
    p = np.r_[np.zeros((5000, 3)), [[9.0, 9.0, 9.0]]]
    assert indexes(filters.remove_noise(table(spark, p), 0.5, 4, REF)) == [5000]


@pytest.mark.parametrize("parts", [1, 7])
def test_voxels(spark, parts):
    p = fixed_cloud()
    best = {}
    for i, q in enumerate(p):
        c = np.floor(q / 0.5)
        k = (float((((q - (c + 0.5) * 0.5) ** 2)[[0]].sum() + ((q - (c + 0.5) * 0.5) ** 2)[[1]].sum()) + ((q - (c + 0.5) * 0.5) ** 2)[2]), i)
        best[tuple(c)] = min(best.get(tuple(c), k), k)
    want = sorted(set(range(len(p))) - {i for _, i in best.values()})
    assert indexes(filters.voxel_subsample(table(spark, p, parts=parts), 0.5, REF)) == want


def test_outliers(spark):
    p = fixed_cloud()
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.sort(d, 1)[:, :6]
    m = np.where(near[:, 5] <= 0.5, near.mean(1), np.nan)
    mu, sigma = np.nanmean(m), np.sqrt(max(np.nanmean(m * m) - np.nanmean(m) ** 2, 0))
    want = np.flatnonzero(np.isnan(m) | (m > mu + sigma)).tolist()
    assert indexes(filters.remove_outliers(table(spark, p), 6, 1.0, 0.5, REF)) == want


def test_overlap_keeps_the_denser_scan(spark):
    dense = np.stack(np.meshgrid(np.arange(0, 2, 0.02), np.arange(0, 1, 0.02), [0.0]), -1).reshape(-1, 3)
    sparse = np.stack(np.meshgrid(np.arange(1, 3, 0.05), np.arange(0, 1, 0.05), [0.0]), -1).reshape(-1, 3)
    p = np.r_[dense, sparse]
    scan = np.r_[np.zeros(len(dense), int), np.ones(len(sparse), int)]
    moved = indexes(filters.reduce_overlap(table(spark, p, scan), 0.1, REF))
    assert moved and min(moved) >= len(dense)
    assert max(p[moved, 0]) < 2.2


@pytest.mark.parametrize("cells", [1, 300, 500_000])
def test_moving(spark, monkeypatch, cells):
    """A wall seen by three scanners, and someone before it whom only the first saw; wide cells of any size lose nothing."""
    monkeypatch.setattr(filters, "COARSE_CELLS", cells)
    yz = np.stack(np.meshgrid(np.arange(-3, 3, 0.02), np.arange(-1, 1, 0.02)), -1).reshape(-1, 2)
    wall = np.c_[np.full(len(yz), 10.0), yz]
    person = np.c_[np.full(50, 5.0), np.linspace(-0.2, 0.2, 50), np.linspace(-0.5, 0.5, 50)]
    p = np.r_[wall, person, wall, wall]
    scan = np.r_[np.zeros(len(wall) + 50, int), np.ones(len(wall), int), np.full(len(wall), 2)]
    frames = {}
    for k, y in enumerate((0.0, 1.0, -1.0)):
        frames[k] = np.eye(4)
        frames[k][1, 3] = -y
    t = table(spark, p, scan)
    moved = indexes(filters.remove_moving(t, frames, REF, 0.5, 0.05, 2))
    assert moved == list(range(len(wall), len(wall) + 50))


def test_wide_cells_are_bounded():
    for degrees, scans in ((0.1, 1), (0.1, 299), (0.01, 40_000), (5, 1), (5, 1_000_000)):
        columns, rows = round(360 / degrees), round(180 / degrees)
        k = filters._coarse(degrees, scans)
        assert scans * -(-columns // k) * -(-rows // k) <= max(filters.COARSE_CELLS, scans)


def test_box_and_its_complement(spark):
    p = fixed_cloud()
    q = (0.0, 0.0, float(np.sin(0.2)), float(np.cos(0.2)))
    box = CropBox((1.0, 1.0, 0.0), (2.0, 1.5, 1.0), q)
    local = (p - box.center) @ rotation_vector([0, 0, 0.4])
    inside = (np.abs(local) <= np.array(box.size) / 2).all(1)
    t = table(spark, p)
    assert indexes(filters.move_box(t, box, True)) == np.flatnonzero(inside).tolist()
    assert indexes(filters.move_box(t, box, False)) == np.flatnonzero(~inside).tolist()
    with pytest.raises(ValueError):
        filters.move_box(t, CropBox((0, 0, 0), (0, 1, 1)), True)


def test_levels_hold_each_point_once(spark):
    p = fixed_cloud()
    levels = octree.additive_levels(table(spark, p), (-10.0, -10.0, -1.0), 32.0, 3, REF, grid=8).cache()
    assert indexes(levels) == list(range(len(p)))
    nodes = octree.nodes_of(octree.view_nodes(levels))
    assert sum(n.count for n in nodes) == len(p)
    assert sum(v for k, v in octree.estimates(nodes).items() if k[1] == 0) == len(p)
    from pointloom.functions.geometry import Bounds, Camera

    camera = Camera.framing(Bounds((-10, -10, -1), (22, 22, 12)))
    whole = octree.select_view(nodes, camera, 10**6)
    some = octree.select_view(nodes, camera, 120)
    assert sum(n for _, n in some) <= 120 < sum(n for _, n in whole)
    assert [n.key for n, _ in some] == [n.key for n, _ in whole][: len(some)] or len(some) == 1


def test_culling_never_skips_a_point(spark):
    from pointloom.functions.geometry import Bounds, Camera, Selection

    rng = np.random.default_rng(4)
    for ortho in (False, True):
        camera = Camera((0, 0, 0), 0.3, -0.2, 10.0, orthographic=ortho)
        sel = Selection(camera, [(-0.5, -0.5), (0.5, -0.4), (0.1, 0.6)])
        m = camera.matrix
        for _ in range(500):
            c, h = rng.uniform(-12, 12, 3), rng.uniform(0.01, 4, 3)
            p = c + rng.uniform(-1, 1, (32, 3)) * h
            x, y, z, w = (np.c_[p, np.ones(32)] @ m.T).T
            b = Bounds(tuple(c - h), tuple(c + h))
            seen = (w > 0) & (np.abs(x) <= w) & (np.abs(y) <= w) & (z >= 0) & (z <= w)
            assert camera.sees(b) or not seen.any()
            inside = w > 0
            u, v = x / np.where(w == 0, 1, w), y / np.where(w == 0, 1, w)
            hit = np.zeros(32, bool)
            for (ax, ay), (bx, by) in zip(sel.polygon, sel.polygon[1:] + sel.polygon[:1], strict=True):
                hit ^= ((ay > v) != (by > v)) & (u < (bx - ax) * (v - ay) / (by - ay) + ax)
            assert sel.may_touch(b) or not (inside & hit).any()


def test_percentiles_of_large_groups_are_exact(spark):
    from pyspark.sql import functions as F

    from pointloom.operators.statistics import percentile_rows

    p = spark.range(30_000).select((F.col("id") % 3).alias("scan"), (F.pmod(F.xxhash64("id"), F.lit(997)) / 7.0).alias("v")).withColumn("w", F.when(F.col("scan") == 2, F.lit(1.5)).otherwise(F.col("v")))
    shares = {"a": (0.01, False), "b": (0.5, True), "c": (0.99, False), "d": (0.5, None)}
    whole = {r["scan"]: r.asDict() for r in percentile_rows(p, "w", shares, "scan").collect()}
    parts = {r["scan"]: r.asDict() for r in percentile_rows(p, "w", shares, "scan", ranked=100).collect()}
    assert whole == parts and whole[2]["b"] == 1.5
    for s in (0, 1):
        v = np.sort([r[0] for r in p.where(F.col("scan") == s).select("w").collect()])
        assert whole[s] == {"scan": s, "a": v[int((len(v) - 1) * 0.01)], "b": v[int((len(v) - 1) * 0.5 + 0.5)], "c": v[int((len(v) - 1) * 0.99)], "d": v[len(v) // 2]}


def test_a_stack_of_points_counts_as_its_number(spark):
    """20,000 points at one place, and others around: neighbours are counted with their copies."""
    import time

    pile = spark.range(20_000).selectExpr("id AS ref", "0L AS scan", "0.0D AS x", "0.0D AS y", "0.0D AS z")
    rest = spark.createDataFrame([(20_000, 0, 0.1, 0.0, 0.0), (20_001, 0, 0.1, 0.0, 0.0), (20_002, 0, 5.0, 0.0, 0.0)], pile.schema)
    points = pile.union(rest)
    began = time.time()
    m = {r["ref"]: r["m"] for r in filters.mean_distances(points, 3, 0.5, ("ref",)).where("ref % 5000 = 0 OR ref >= 20000").collect()}
    assert m[0] == m[5000] == 0 and abs(m[20_000] - (0 + 0.1 + 0.1) / 3) < 1e-12 and m[20_002] is None
    gaps = {r["ref"]: r["gap"] for r in statistics.nearest_gap(points, 0.5, ("ref",)).where("ref % 5000 = 0 OR ref >= 20000").collect()}
    assert gaps == {0: 0.0, 5000: 0.0, 10_000: 0.0, 15_000: 0.0, 20_000: 0.0, 20_001: 0.0}
    assert time.time() - began < 30


def dense_embeddings(spark, folder, n):
    """n vectors of scans 0 and 1 each, most of them far nearer to each other than any reach, some alone, some copies."""
    rng = np.random.default_rng(7)
    p = rng.normal(0, 0.02, (2 * n, 3))
    p[:40] = rng.uniform(-0.4, 0.4, (40, 3))
    p[100:140:2], p[50:70] = p[101:141:2], p[n + 50 : n + 70] * 1.5
    p = p.astype(np.float32).astype(float)
    label = (np.arange(2 * n) >= n).astype(int)
    rows = [(k, int(s), list(map(float, v))) for k, (s, v) in enumerate(zip(label, p, strict=True))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return p, label


def nearest_of(p, q, itself):
    """By brute force, in blocks: squared distance and index of the first nearest."""
    d2, at = np.empty(len(p)), np.empty(len(p), int)
    for lo in range(0, len(p), 500):
        e = p[lo : lo + 500, None] - q[None]
        d = (e[:, :, 0] * e[:, :, 0] + e[:, :, 1] * e[:, :, 1]) + e[:, :, 2] * e[:, :, 2]
        if itself:
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        at[lo : lo + 500] = d.argmin(1)
        d2[lo : lo + 500] = d.min(1)
    return d2, at


def test_nearest_of_another_dense_scan(spark, tmp_path):
    import time

    from pointloom.plans import queries

    n = 25_000
    p, _ = dense_embeddings(spark, tmp_path, n)
    began = time.time()
    got = {r["moving"]: (r["target"], r["distance"]) for r in queries.icp_pairs(spark, str(tmp_path)).collect()}
    assert time.time() - began < 60
    some = np.r_[:200, 200:n:25]
    d2, at = nearest_of(p[some], p[n:], False)
    want = {int(k): (int(j) + n, round(float(np.sqrt(d)), 6)) for k, d, j in zip(some, d2, at, strict=True) if d <= 0.25 * 0.25}
    assert {k: v[0] for k, v in got.items() if k in set(some.tolist())} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - v[1]) < 2e-6 for k, v in want.items())


def test_spacing_of_dense_scans(spark, tmp_path):
    import time

    from pointloom.plans import queries

    n = 25_000
    p, label = dense_embeddings(spark, tmp_path, n)
    began = time.time()
    got = {r["scan"]: r["spacing"] for r in queries.median_spacing(spark, str(tmp_path)).collect()}
    assert time.time() - began < 60
    for s in (0, 1):
        own = p[label == s]
        d2, _ = nearest_of(own, own, True)
        gaps = np.sort(np.sqrt(d2[d2 <= 0.25]))
        assert abs(got[s] - gaps[len(gaps) // 2]) < 1e-6


def test_copies_without_a_distance_have_no_gap(spark):
    rows = [(0, 0, float("nan"), 0.0, 0.0), (1, 0, float("nan"), 0.0, 0.0), (2, 0, float("inf"), 0.0, 0.0), (3, 0, float("inf"), 0.0, 0.0), (4, 0, None, 0.0, 0.0), (5, 0, None, 0.0, 0.0), (6, 0, 0.0, 0.0, 0.0), (7, 0, 0.1, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "ref long, scan long, x double, y double, z double")
    assert {r["ref"]: r["gap"] for r in statistics.nearest_gap(points, 0.5, ("ref",)).collect()} == {6: 0.1, 7: 0.1}


@pytest.mark.parametrize("ranked", [3, 50, 100_000])
def test_thinning_takes_even_indexes(spark, ranked):
    rng = np.random.default_rng(4)
    rows = [(k, int(v), j) for k, n in ((0, 200), (1, 7), (2, 1)) for j, v in enumerate(rng.integers(0, 40, n) ** 2)]
    points = spark.createDataFrame(rows, "scan int, a long, b long").repartition(3)
    quotas = spark.createDataFrame([(0, 30), (1, 3), (2, 5)], "scan int, quota int")
    got = sorted((r["scan"], r["a"], r["b"]) for r in octree.thinned(points, quotas, ("scan",), ("a", "b"), ranked).collect())
    want = []
    for k, q in ((0, 30), (1, 3), (2, 5)):
        own = sorted(r for r in rows if r[0] == k)
        want += own if q >= len(own) else [own[i * len(own) // q] for i in range(q)]
    assert got == sorted(want)


def test_ancestors_by_doubling(spark):
    rows = [(k, k - 1 if k % 50 else None) for k in range(200)] + [(500, 499)]
    got = {(r["id"], r["above"]): r["depth"] for r in hierarchy.ancestors(spark.createDataFrame(rows, "id long, parent long")).collect()}
    want = {(k, k - d): d for k in range(200) for d in range(k % 50 + 1)} | {(500, 500): 0}
    assert got == want
    with pytest.raises(InvalidState):
        hierarchy.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"))


def test_stems_differ_in_lower_case_too(spark):
    names = ["a" * 40 + "x", "a" * 40 + "y", "Scan", "scan", 'sc?n', "sc_n", " ", None]
    got = {r["id"]: r["stem"] for r in hierarchy.unique_stems(spark.createDataFrame(list(enumerate(names)), "id int, name string")).collect()}
    assert got == {0: names[0], 1: names[1], 2: "Scan", 3: "scan_2", 4: "sc_n", 5: "sc_n_2", 6: "scan_3", 7: "scan_4"}


def test_depths_of_a_long_chain(spark):
    chain = spark.range(10_000).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent")
    got = hierarchy.depths(chain)
    assert got.where("depth = id").count() == 10_000
    assert hierarchy.depths(spark.createDataFrame([(1, 7), (2, 1)], "id long, parent long")).where("depth = id - 1").count() == 2
    with pytest.raises(InvalidState):
        hierarchy.depths(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"))


def test_stems_of_files_and_tables_are_the_same(spark):
    names = ["a", "a", "a_2", "b.", "B", None, " ", "x/y", "X_Y", "scan_2", "scan", "a", "\x85", "é", "É"]
    want = ["a", "a_2", "a_2_2", "b", "B_2", "scan", "scan_2", "x_y", "X_Y_2", "scan_2_2", "scan_3", "a_3", "_", "é", "É"]
    assert hierarchy.numbered_stems([hierarchy.bare_stem(n) for n in names]) == want
    table = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    assert [r["stem"] for r in hierarchy.unique_stems(table).orderBy("id").collect()] == want
