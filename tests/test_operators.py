"""Invariants and small fixtures of the point operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.functions import hilbert, scalar
from cairn.operators import bootstrap, features, frames, geometry, grid, labels, merge, metrics, neighbors, sampling, segments, spread, visibility
from cairn.sources import sinks


def cloud(spark, xyz, tile=0, **more):
    frame = pd.DataFrame(np.asarray(xyz, float), columns=["x", "y", "z"])
    frame.insert(0, "point_id", np.arange(len(frame)))
    frame.insert(0, "tile", tile)
    for k, v in more.items():
        frame[k] = v
    return spark.createDataFrame(frame)


def plane(n=23, scale=1.0):
    g = np.linspace(-2, 2, n) * scale
    x, y = np.meshgrid(g, g)
    return np.c_[x.ravel(), y.ravel(), np.zeros(x.size)]


def brute_knn(xyz, k, exclude=False):
    out = {}
    for i, p in enumerate(xyz):
        d = ((xyz - p) ** 2).sum(1)
        order = sorted((v, j) for j, v in enumerate(d) if not (exclude and j == i))[:k]
        out[i] = [j for _, j in order]
    return out


@pytest.mark.parametrize("exclude", [False, True])
def test_knn_equals_brute_force(spark, exclude):
    rng = np.random.default_rng(0)
    xyz = np.r_[rng.normal(0, 1, (150, 3)), rng.normal(50, 0.1, (60, 3)), np.zeros((5, 3)), [[1e4, 0, 0]]].round(3)
    pts = cloud(spark, xyz)
    got = neighbors.knn(pts, pts, 6, exclude_self=exclude).toPandas().sort_values(["src", "rank"]).groupby("src").dst.apply(list).to_dict()
    assert got == brute_knn(xyz, 6, exclude)


@pytest.mark.parametrize("exclude", [False, True])
def test_knn_over_many_leaves(spark, monkeypatch, exclude):
    """A dense core, a far rim, copies of one place, places that share an axis, and rows without a place."""
    monkeypatch.setattr(neighbors, "LEAF", 16)
    g = np.random.default_rng(4)
    xyz = np.concatenate([g.normal(0, 0.01, (300, 3)), g.uniform(-1e4, 1e4, (60, 3)), np.full((150, 3), 7.0), np.c_[np.full(100, 3.0), g.uniform(0, 5, (100, 2))]])
    xyz[5, 0] = np.nan
    pts = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(xyz)], "tile int, point_id long, x double, y double, z double")
    pts = pts.withColumn("x", F.when(F.col("point_id") != 5, F.col("x")))
    got = neighbors.knn(pts, pts, 6, exclude_self=exclude).toPandas().sort_values(["src", "rank"]).groupby("src").dst.apply(list).to_dict()
    want = {}
    for i, p in enumerate(xyz):
        d = sum((xyz[:, c] - p[c]) ** 2 for c in range(3))
        near = [j for j in np.argsort(d, kind="stable") if np.isfinite(d[j]) and not (exclude and i == j)]
        if i != 5:
            want[i] = near[:6]
    assert got == want
    edges = neighbors.radius_edges(pts, pts, 2.0).toPandas()
    assert set(zip(edges.src, edges.dst, strict=True)) == {(i, j) for i in want for j in want if sum((xyz[j, c] - xyz[i, c]) ** 2 for c in range(3)) <= 4.0}
    assert len(edges) == len(edges.drop_duplicates(["src", "dst"]))


def test_knn_of_small_cloud_is_padded(spark):
    pts = cloud(spark, [[0, 0, 0], [1, 0, 0]])
    got = neighbors.knn(pts, pts, 4, pad=True).toPandas().sort_values(["src", "rank"])
    assert got.dst.tolist() == [0, 1, -1, -1, 1, 0, -1, -1]


def test_ball_query_stride(spark):
    xyz = np.c_[np.linspace(0, 0.9, 10), np.zeros(10), np.zeros(10)]
    got = neighbors.ball_query(cloud(spark, xyz), cloud(spark, xyz), 5.0, 4).toPandas()
    assert got[got.src == 0].sort_values("rank").dst.tolist() == [0, 2, 5, 7]


def test_local_geometry_of_plane_line_and_scale(spark):
    for scale in (1.0, 4.0):
        got = geometry.local_geometry(cloud(spark, plane(scale=scale)), 32, None).toPandas()
        assert got.geom_valid.all() and got.nz.abs().median() > 0.99 and (got.curvature < 1e-5).mean() > 0.95
    line = geometry.local_geometry(cloud(spark, np.c_[np.linspace(-4, 4, 200), np.zeros((200, 2))]), 16, None).toPandas()
    assert line.linearity.median() > 0.99 and line.planarity.max() < 1e-5


def test_local_geometry_at_map_coordinates(spark):
    xyz = np.random.default_rng(1).normal(0, 2, (400, 3)).round(3)
    near = geometry.local_geometry(cloud(spark, xyz), 16, None).toPandas().sort_values("point_id")
    far = geometry.local_geometry(cloud(spark, xyz + [2_600_000, 1_200_000, 500]), 16, None).toPandas().sort_values("point_id")
    assert np.allclose(near[["linearity", "planarity", "curvature"]], far[["linearity", "planarity", "curvature"]], atol=1e-4)


def test_coincident_points_are_not_valid(spark):
    got = geometry.local_geometry(cloud(spark, np.ones((64, 3))), 16, None).toPandas()
    assert not got.geom_valid.any() and np.isfinite(got.drop(columns="tile").to_numpy(float)).all()


def test_visibility_of_two_layers(spark):
    g = [(x, y) for x in range(6) for y in range(6)]
    pts = cloud(spark, [(x, y, 1) for x, y in g] + [(x, y, 0) for x, y in g])
    got = visibility.surface_visibility(pts, 1.0, 1.0, 0.1, oversample=2, adaptive=False, max_radius_cells=1, slope_degrees=None, returns=None).toPandas()
    assert got[got.z == 1].q.mean() > 0.9 and got[got.z == 0].q.mean() < 0.1


def test_threshold_region(spark):
    q = spark.createDataFrame([(v,) for v in (0.0, 0.2, 0.21, 0.59, 0.6, 1.0)], "q double")
    assert [r[0] for r in q.select(scalar.threshold_region("q")).collect()] == [0, 0, 1, 1, 2, 2]


def test_covered_finds_gaps(spark):
    tile = spark.createDataFrame([(1, 0.0, 4.0, 0.0, 4.0)], "tile int, min_x double, max_x double, min_y double, max_y double")
    rows = [(0.0, 2.0, 0.0, 4.0), (2.0, 4.0, 0.0, 2.0), (1.5, 4.5, 1.0, 4.0)]
    box = "min_x double, max_x double, min_y double, max_y double"
    assert visibility.covered(tile, spark.createDataFrame(rows, box)).first().covered
    assert not visibility.covered(tile, spark.createDataFrame(rows[:2], box)).first().covered
    assert not visibility.covered(tile, spark.createDataFrame([], box)).first().covered


def test_metrics_fixture(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 2], [0, 1, 1, 1, 2, 0], strict=True)), "target int, pred int")
    iou = {r["class"]: r.iou for r in metrics.class_metrics(metrics.iou_counts(df, 3)).collect()}
    assert np.allclose([iou[0], iou[1], iou[2]], [1 / 3, 2 / 3, 1 / 2], atol=1e-6)
    assert abs(metrics.seg_metrics(metrics.iou_counts(df, 3), 3).first().miou - 0.5) < 1e-6


def test_ignored_targets_and_stray_labels(spark):
    df = spark.createDataFrame([(-1, 0), (0, 0), (0, 7), (1, 1)], "target int, pred int")
    got = {r["class"]: (r.intersection, r.n_pred, r.n_target) for r in metrics.iou_counts(df, 2).collect()}
    assert got == {0: (1, 1, 2), 1: (1, 1, 1)}


def test_pairing_fails_on_different_rows(spark):
    a = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "point_index int, target int, pred int")
    b = spark.createDataFrame([(1, 0, 0), (3, 1, 1)], "point_index int, target int, pred int")
    with pytest.raises(Exception, match="point_index"):
        metrics.pair_predictions(a, b, ["point_index"]).collect()


def test_instance_ap_perfect_and_missed(spark):
    gt = spark.createDataFrame([("s", i, 1, i // 150) for i in range(300)], "scene string, point_id long, segment int, instance long")
    pred = gt.select("scene", F.col("instance").alias("pred_id"), F.col("segment").alias("class"), F.lit(0.9).alias("score"), "point_id")
    ap = metrics.instance_ap(pred, gt).toPandas()
    assert np.allclose(ap.ap, 1.0) and len(ap) == len(metrics.THRESHOLDS)
    half = metrics.instance_ap(pred.where("pred_id = 0"), gt).toPandas()
    assert np.allclose(half.ap, 0.5)
    summary = metrics.ap_summary(metrics.instance_ap(pred, gt)).first()
    assert summary.ap == summary.ap50 == summary.ap25 == 1.0


def test_merge_votes_and_truncated_means(spark):
    df = spark.createDataFrame([(1, 0, 2, 1), (1, 1, 1, 2), (2, 0, 3, 5)], "k int, tile int, label int, v int")
    got = {r.k: (r.label, r.v, r.overlap) for r in merge.merge_tiles(df, ["k"], "tile", ["label"], ["v"]).collect()}
    assert got == {1: (1, 1, 2), 2: (3, 5, 1)}


def test_fragments_cover_every_point(spark):
    pts = cloud(spark, np.random.default_rng(2).uniform(0, 3, (80, 3)))
    for most in (None, 3):
        frag = grid.fragments(pts, 1.0, most)
        assert frag.select("point_id").distinct().count() == 80
        per = frag.groupBy("fragment", "gx", "gy", "gz", "point_id").count().where("count > 1")
        assert per.isEmpty()


def test_split_large_and_absorb_small(spark):
    pts = cloud(spark, np.random.default_rng(3).uniform(0, 10, (100, 3))).withColumn("part", F.lit("a"))
    sizes = [r["count"] for r in grid.split_large(pts, 30).groupBy("part").count().collect()]
    assert sum(sizes) == 100 and max(sizes) <= 30
    tiles = pts.withColumn("source", F.lit("s")).withColumn("tile_no", F.when(F.col("point_id") < 5, 2).otherwise(F.col("point_id") % 2))
    left = grid.absorb_small(tiles, 20).groupBy("tile_no").count().collect()
    assert {r.tile_no for r in left} == {0, 1}


def test_label_budgets_are_nested_and_tamper_proof(spark, tmp_path):
    pts = cloud(spark, np.random.default_rng(4).uniform(0, 9, (2000, 3)), classification=np.arange(2000) % 8 + 1)
    sinks.write_label_budget(pts, [0.01, 0.1], 42, str(tmp_path))
    low, high = (sinks.apply_label_budget(pts, str(tmp_path), f).where("classification > 0") for f in (0.01, 0.1))
    assert low.join(high, ["tile", "point_id"], "left_anti").isEmpty()
    assert 0 < high.count() < 300
    with pytest.raises(ValueError, match="size"):
        sinks.apply_label_budget(pts.where("point_id > 0"), str(tmp_path), 0.1)


def test_filter_needs_one_list(spark):
    with pytest.raises(ValueError):
        labels.filter_classes(spark.range(1), [1], [2])


def test_multilabel_counts_only_free_slots(spark):
    vertices = spark.createDataFrame([("m", i, 0 if i < 6 else 1) for i in range(8)], "mesh string, vertex_id long, segment_id long")
    groups = spark.createDataFrame([("m", 0, 10, 100, [0, 1]), ("m", 1, 11, 101, [0]), ("m", 2, 12, 102, [0]), ("m", 3, 13, 103, [0, 1])], "mesh string, group_order int, label int, object_id long, segments array<long>")
    got = {r.vertex_id: (r.label_1, r.label_2, r.label_3, r.major_label) for r in labels.assign_multilabel(vertices, groups).collect()}
    assert got[0] == (10, 11, 12, 11) and got[7] == (10, 13, -1, 13)


def test_components_and_superpoints(spark):
    xyz = [(i * 0.9, 0, 0) for i in range(40)] + [(i * 0.9, 50, 0) for i in range(7)]
    pts = cloud(spark, xyz, classification=1, nx=0.0, ny=0.0, nz=1.0)
    found = neighbors.cluster(pts, 1.0, 8).toPandas()
    assert len(found) == 40 and set(found.component) == {0}
    seg = segments.superpoints(pts, neighbors.radius_edges(pts, pts, 1.0), least=5).toPandas()
    assert seg.segment.nunique() == 2


def test_fps_spreads(spark):
    got = spread.fps(cloud(spark, [(0, 0, 0), (1, 0, 0), (10, 0, 0), (5, 0, 0)]), 3).toPandas().sort_values("rank")
    assert got.point_id.tolist() == [0, 2, 3]


def test_vertex_normals(spark):
    v = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 1.0, 0.0, 0.0), ("m", 2, 0.0, 1.0, 0.0), ("m", 3, 9.0, 9.0, 9.0)], "mesh string, vertex_id long, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 1, 2)], "mesh string, a long, b long, c long")
    got = {r.vertex_id: (r.nx, r.ny, r.nz) for r in geometry.vertex_normals(v, f).collect()}
    assert got[0] == (0, 0, 1) and got[3] == (0, 0, 0)


def test_fit_affine(spark):
    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 100, (3000, 2)) + [2_615_500, 1_179_000]
    frame = pd.DataFrame({"tile": 0, "x": xy[:, 0], "y": xy[:, 1]})
    frame["col"] = 5 * (frame.x - 2_615_500) + rng.normal(0, 0.25, len(frame))
    frame["row"] = -5 * (frame.y - 1_179_000) + 500 + rng.normal(0, 0.25, len(frame))
    got = geometry.fit_affine(spark.createDataFrame(frame)).first()
    assert abs(got.col_a - 5) < 0.02 and abs(got.row_b + 5) < 0.02 and got.median_residual < 0.6


def test_pose_round_trip(spark):
    pose = np.eye(4)
    pose[:3, 3] = [1, 2, 3]
    f = spark.createDataFrame([("s", 0, np.eye(4).ravel().tolist()), ("s", 1, pose.ravel().tolist())], "seq string, frame_no long, pose array<double>")
    pts = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0, 4), ("s", 1, 1.0, 0.0, 0.0, 5)], "seq string, frame_no long, x double, y double, z double, classification int")
    got = {(r.target, r.frame_no): (r.x, r.y, r.z, r.classification) for r in frames.fuse_points(f, pts, [0, 1]).collect()}
    assert got[(0, 1)] == (2, 2, 3, -1) and got[(1, 1)] == (1, 0, 0, 5)


def test_hilbert_is_a_curve():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    codes = hilbert.hilbert_codes(cells, 3)
    assert sorted(codes) == list(range(512))
    assert np.abs(np.diff(cells[np.argsort(codes)], axis=0)).sum(1).max() == 1
    assert (hilbert.hilbert_cells(codes, 3) == cells).all()


def test_bootstrap_of_equal_methods_is_zero(spark):
    rows = spark.createDataFrame([(i % 5, i % 3, i % 3, i % 3) for i in range(60)], "block int, target int, pred_a int, pred_b int")
    got = bootstrap.block_bootstrap(rows, "block", 3, times=20).first()
    assert got.n == 20 and got.mean == 0 and got.low == got.high == 0
    assert bootstrap.draws(rows, "block", 20).groupBy("b").agg(F.sum("weight").alias("w")).where("w <> 5").isEmpty()


def test_batched_inverse(spark):
    sizes = spark.createDataFrame([(0, 3), (1, 2)], "cloud int, n long")
    starts = sampling.batch_offsets(sizes, 2)
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate([0, 1, 2, 1])] + [(1, 4 + i, v) for i, v in enumerate([0, 1, 0])], "cloud int, i int, inverse long")
    assert [r.inverse for r in sampling.shift_inverse(rows, starts).orderBy("i").collect()] == [0, 1, 2, 1, 3, 4, 3]


def test_epoch_plan(spark):
    tiles = spark.createDataFrame([(i,) for i in range(7)], "tile int")
    weights = spark.createDataFrame([(i, float(i > 3)) for i in range(7)], "tile int, weight double")
    plan = sampling.epoch_plan(tiles, weights, 4, 4, 1).toPandas()
    assert len(plan) == 28 and set(plan.tile) == set(range(7))
    counts = plan.tile.value_counts()
    assert all(counts[i] == 1 for i in range(4)) and sorted(plan["slot"]) == list(range(28))


def test_select_tiles_respects_cap(spark):
    stats = spark.createDataFrame([(i, i % 4, float(i), "a" if i % 2 else "b") for i in range(40)], "tile int, source_block int, priority double, environment string")
    got = sampling.select_tiles(stats, 10, 3).toPandas()
    assert len(got) == 10 and got.source_block.value_counts().max() <= 3


def test_select_tiles_offers_every_environment(spark):
    """A block whose best tiles are urban still offers its water tile."""
    rows = [(i, 0, 9.0 - i, "urban") for i in range(4)] + [(9, 0, 0.5, "water"), (10, 1, 1.0, "mixed")]
    got = sampling.select_tiles(spark.createDataFrame(rows, "tile int, source_block int, priority double, environment string"), 3, 3).toPandas()
    assert dict(zip(got.tile, got.reason, strict=True)) == {0: "block", 10: "block", 9: "environment"}


def test_scene_groups(spark):
    rows = [("flat", 0.8, 0.0, 0.0, 4.0, None), ("steep", 0.8, 0.0, 0.0, 9.0, None), ("dense", 0.1, 0.7, 0.0, 0.0, None), ("sparse", 0.3, 0.35, 0.0, 0.0, None), ("tall", 0.1, 0.0, 0.25, 0.0, 18.0), ("low", 0.1, 0.0, 0.25, 0.0, 9.0)]
    t = spark.createDataFrame(rows, "tile string, s2 double, s3 double, s6 double, relief double, top double")
    share = lambda c: F.col(f"s{c}") if c in (2, 3, 6) else F.lit(0.0)
    got = {r[0]: r[1] for r in t.select("tile", features.scene_group(share, F.col("relief"), F.col("top"))).collect()}
    assert got == {"flat": "Flat bare ground", "steep": "Mixed / other", "dense": "Dense canopy", "sparse": "Sparse vegetation", "tall": "Tall-building", "low": "Low-rise built"}


def test_empty_cloud(spark):
    none = cloud(spark, [[0, 0, 0]], classification=1, pred=1).where("false")
    assert neighbors.knn(none, none, 3).isEmpty()
    assert grid.fragments(none, 1.0).isEmpty() and grid.voxelize(none, 1.0).isEmpty()
    assert visibility.surface_visibility(none).isEmpty()


def test_terrain_split_rules(spark):
    g = np.random.default_rng(8)
    xyz = np.c_[g.uniform(0, 100, (3000, 2)), g.normal(0, 1, 3000)]
    pts = cloud(spark, xyz, classification=np.arange(3000) % 3).unionByName(cloud(spark, xyz[:9], tile=1, classification=2))
    got = sampling.terrain_split(pts, 5, ground=2).toPandas()
    assert len(got) == 3009 and set(got[got.tile == 1].role) == {"support"}
    assert set(got[got.role == "query"].classification) == {2}
    all_in = sampling.terrain_split(pts, 5, random=1.0, query_max=7).toPandas()
    assert (all_in.role == "query").sum() == 7
    plain = sampling.terrain_split(pts, 5, blocks=0, extreme=0.0, feature=0.0, random=0.2).toPandas()
    assert (plain.role == "query").sum() == 600
    hole = sampling.terrain_split(pts, 5, blocks=0, extreme=1.0, feature=0.0, random=0.0, most=1.0).toPandas()
    inside = hole[(hole.role == "query") & (hole.tile == 0)]
    box = hole[(hole.tile == 0) & hole.x.between(inside.x.min(), inside.x.max()) & hole.y.between(inside.y.min(), inside.y.max())]
    assert len(inside) == len(box) > 300
    none = sampling.terrain_split(pts, 5, random=0.0, feature=0.0, blocks=0, extreme=0.0).toPandas()
    assert (none.role == "query").sum() == 1


def test_elastic_is_smoothed_noise(spark):
    """Against the definition: two box averages per axis over the noise of the whole grid, zeros outside, then trilinear."""
    from cairn.operators.augment import normal_hash
    from cairn.operators import augment

    g = np.random.default_rng(2)
    xyz = g.uniform(0, 7, (40, 3))
    got = augment.elastic(cloud(spark, xyz, tile=3), 2.0, 0.5, 9).toPandas().sort_values("point_id")[["x", "y", "z"]].to_numpy()
    dim = [int(v) for v in (xyz.max(0) - xyz.min(0)) // 2.0 + 3]
    nodes = spark.createDataFrame([(3, i, j, k) for i in range(dim[0]) for j in range(dim[1]) for k in range(dim[2])], "tile int, a long, b long, c long")
    table = nodes.select("a", "b", "c", *(normal_hash(f"9/{c}", "tile", "a", "b", "c").alias(c) for c in "xyz")).toPandas().sort_values(["a", "b", "c"])
    noise = table[["x", "y", "z"]].to_numpy().reshape(*dim, 3)
    for _ in range(2):
        for axis in range(3):
            wide = np.pad(noise, [(1, 1) if i == axis else (0, 0) for i in range(4)])
            noise = sum(np.take(wide, range(o, o + dim[axis]), axis) for o in range(3)) / 3
    t = (xyz - xyz.min(0)) / 2.0 + 1
    want = xyz.copy()
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                at = np.floor(t).astype(int) + [i, j, k]
                w = np.prod([np.where(o, f, 1 - f) for o, f in zip((i, j, k), (t % 1).T, strict=True)], axis=0)
                want += 0.5 * w[:, None] * noise[at[:, 0], at[:, 1], at[:, 2]]
    assert np.allclose(got, want)


def test_geometry_variants_against_numpy(spark):
    g = np.random.default_rng(6)
    xyz = g.normal(0, 1, (60, 3)) * [3, 1, 0.2]
    pts = cloud(spark, xyz)
    two = geometry.curvature_planarity(pts, 10).toPandas().sort_values("point_id")
    four = geometry.eigen_features(pts, 10).toPandas().sort_values("point_id")
    six = geometry.local_geometry(pts, 10, None).toPandas().sort_values("point_id")
    for i, p in enumerate(xyz):
        order = np.argsort(((xyz - p) ** 2).sum(1), kind="stable")
        for near, frame in ((order[1:11], two), (order[:10], four), (order[:10], six)):
            q = xyz[near] - xyz[near].mean(0)
            (l3, l2, l1), v = np.linalg.eigh(q.T @ q / 10)
            row = frame.iloc[i]
            if frame is two:
                assert np.allclose([row.curvature, row.planarity, row.radius], [l3 / (l1 + l2 + l3), (l2 - l3) / l1, np.linalg.norm(xyz[near] - p, axis=1).max()])
            elif frame is four:
                s1, s2, s3 = np.sqrt([l1, l2, l3])
                u = np.abs(v) @ [l3, l2, l1]
                assert np.allclose([row.linearity, row.planarity, row.scattering, row.verticality], [(s1 - s2) / (s1 + 1e-3), (s2 - s3) / (s1 + 1e-3), s3 / (s1 + 1e-3), 2 * u[2] / (np.linalg.norm(u) + 1e-8)], atol=1e-6)
            else:
                assert np.allclose([row.linearity, row.planarity, row.curvature, row.verticality], [(l1 - l2) / l1, (l2 - l3) / l1, l3 / (l1 + l2 + l3), 1 - abs(v[2, 0])], atol=1e-6)
    assert not geometry.local_geometry(pts.where("point_id < 7"), 10, None).where("geom_valid").count()
    assert (geometry.eigen_features(pts.where("point_id < 4"), 10).toPandas()[["linearity", "nz"]] == 0).all().all()


def test_multi_view_rules(spark):
    g = np.random.default_rng(3)
    xyz = g.uniform(0, 10, (200, 3))
    pts = cloud(spark, xyz).withColumn("seen", F.col("point_id") < 5)
    got = sampling.multi_view(pts, 7, 3, (0.4, 1.0), 3, (0.1, 0.4)).toPandas()
    sizes = got.groupby("view").size().to_dict()
    assert set(sizes) == set(range(6)) and all(80 <= sizes[v] <= 200 for v in range(3)) and all(20 <= sizes[v] <= 80 for v in (3, 4, 5))
    assert not got.duplicated(["view", "point_id"]).any()
    shown = sampling.multi_view(pts, 7, 2, locals_=0, shared=True, seen="seen", seen_most=30).toPandas()
    center = xyz[:5].mean(0)
    want = set(np.argsort(((xyz - center) ** 2).sum(1))[:30])
    assert set(shown[shown.view == 0].point_id) == set(shown[shown.view == 1].point_id) == want
