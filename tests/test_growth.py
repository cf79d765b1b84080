"""What the tables' growth brings: longer numbers, many equal boxes, planes from few passes, pairs of views by blocks."""

from __future__ import annotations

import random

import numpy as np
import pyspark.sql.functions as F

from __spark_entry__ import queries
from cairn.functions.scalar import unit_hash
from cairn.operators import augment, features, geometry, grid, neighbors, raster, sampling, visibility


def test_names_of_five_digits_stay_whole(spark, tmp_path):
    """p28_names: numbers beyond 9,999 were cut to their first four digits."""
    columns = "7L AS l_orderkey, 11L AS l_partkey, 1 AS l_linenumber, 5.0D AS l_quantity, 100.0D AS l_extendedprice"
    spark.sql(f"SELECT id AS l_suppkey, {columns} FROM VALUES (7L), (9999L), (12345L), (1234567L) AS t(id)").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["tile"]: (r["base"], r["number"]) for r in queries()["p28_names"](spark, str(tmp_path)).collect()}
    assert got == {t: ("src_a", t) for t in (7, 9999, 12345, 1234567)}


def test_coverage_looks_up_few_rasters_of_many(spark):
    """Thousands of rasters over one another: results as by brute force, and no row per point and raster."""
    rng = random.Random(3)
    boxes = [(i, float(rng.randrange(40)), float(rng.randrange(30))) for i in range(3000)]
    rng.shuffle(boxes)
    rasters = [(i, a, a + 12, b, b + 9) for i, a, b in boxes] + [(-1, 7.3, 7.9, 2.1, 2.2)]
    places = [(rng.randrange(0, 60 * 4) / 4, rng.randrange(0, 50 * 4) / 4) for _ in range(300)] + [(7.3, 2.2), (7.9, 2.15), (7.5, 2.1), (-4.0, 3.0)]
    pts = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(places)], "id long, x double, y double")
    out = visibility.point_coverage(pts, spark.createDataFrame(rasters, "raster_order long, left double, right double, bottom double, top double"), 16.0, ["id"])
    got = {r["id"]: r["raster_order"] for r in out.collect()}
    want = {k: min((r for r, a, b, c, d in rasters if a <= x < b and c < y <= d), default=None) for k, (x, y) in enumerate(places)}
    assert got == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Aggregate")[0].count("Join") == 1 and "__rasters" in plan


def test_covered_joins_distinct_boxes(spark):
    """Many copies of rectangles and tiles: one of each is joined."""
    box = "min_x double, max_x double, min_y double, max_y double"
    rects = spark.createDataFrame([(0.0, 2.0, 0.0, 4.0), (2.0, 4.0, 0.0, 4.0), (10.0, 11.0, 0.0, 4.0)], box).crossJoin(spark.range(4000)).drop("id")
    tiles = spark.createDataFrame([(0.0, 4.0, 0.0, 4.0), (10.0, 12.0, 0.0, 4.0)], box).crossJoin(spark.range(500)).withColumn("tile", F.col("id") * 100 + F.col("min_x").cast("long"))
    out = visibility.covered(tiles, rects, size=8.0)
    got = {(r["tile"] % 100, r["covered"]): r["count"] for r in out.withColumn("tile", F.col("tile") % 100).groupBy("tile", "covered").count().collect()}
    assert got == {(0, True): 500, (10, False): 500}


def test_small_clouds_need_no_cuts(spark):
    """Clouds of at most a leaf's points are searched without percentiles or joins; mixed with a large one the results are those of brute force."""
    rng = np.random.default_rng(4)
    clouds = {"small": rng.integers(0, 9, (40, 3)).astype(float), "large": np.round(rng.uniform(0, 50, (1500, 3)), 3), "lone": np.zeros((1, 3))}
    rows = [(n, i, *map(float, p)) for n, c in clouds.items() for i, p in enumerate(c)]
    pts = spark.createDataFrame(rows, "tile string, point_id long, x double, y double, z double")
    assert neighbors._Leaves(pts.where("tile <> 'large'"), "tile", "point_id", ("x", "y", "z")).small
    got = {(r["tile"], r["src"], r["rank"]): r["dst"] for r in neighbors.knn(pts, pts, 3, exclude_self=True).collect()}
    want = {}
    for n, c in clouds.items():
        for i, p in enumerate(c):
            d2 = ((c - p) ** 2).sum(axis=1)
            want |= {(n, i, k + 1): j for k, j in enumerate([j for j in np.lexsort((np.arange(len(c)), d2)) if j != i][:3])}
    assert got == want


def test_ground_planes_are_made_from_written_candidates(spark):
    """The points are read twice at most by the last plan, not once per use of the candidates."""
    pts = spark.range(400).selectExpr("id % 2 AS tile", "id AS point_id", "CAST(id % 20 AS double) AS x", "CAST(id div 20 AS double) AS y", "CAST(id % 20 AS double) / 2 AS z")
    out = geometry.ground_elevation(pts, 2.0)
    assert out.where("abs(elevation) > 0.5").count() == 0
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_overlaps_by_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(visibility, "VIEWS", 7)
    monkeypatch.setattr(visibility, "PANEL", 5)
    rng = random.Random(8)
    held = {(s, v): set(rng.sample(range(30), rng.randrange(1, 20))) for s in (0, 1) for v in range(40)}
    rows = [(s, v, c) for (s, v), cells in held.items() for c in cells]
    views = spark.createDataFrame(rows + rows[:50], "scene long, view long, cell long")
    out = visibility.overlap_pairs(views, 0.3)
    want = {(s, a, b, len(held[s, a] & held[s, b])) for s in (0, 1) for a in range(40) for b in range(a + 1, 40) if (n := len(held[s, a] & held[s, b])) and n >= 0.3 * min(len(held[s, a]), len(held[s, b]))}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "Join Inner, (cell" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_crops_of_large_tiles_are_counted_in_parts(spark, monkeypatch):
    """The same crops with parts of about 50 points, and one shuffle of points, not one of counts per cell."""
    pts = spark.range(3000).selectExpr("id % 2 AS tile", "CAST(id * 37 % 101 AS double) AS x", "CAST(id * 53 % 97 AS double) AS y", "CAST(1 + id % 3 AS int) AS classification", "CAST(1 + id % 4 AS int) AS pred")
    told = lambda: sorted(map(tuple, features.crop_scan(pts, ["pred"], [1, 2, 3], 50.0, least=100, coverage=0.5, span=40.0).collect()))
    whole = told()
    assert len(whole) == 50 and all(r[5] > 300 for r in whole)
    monkeypatch.setattr(features, "CROP_POINTS", 50)
    assert told() == whole
    plan = features.crop_scan(pts, ["pred"], [1, 2, 3])._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_centroids_are_dealt_before_they_are_added_up(spark):
    pts = spark.range(500).selectExpr("1 AS tile", "CAST(id AS double) AS x", "0.0D AS y", "0.0D AS z")
    out = grid.voxel_centroids(pts, 2.0)
    assert {(r["gx"], r["x"], r["n"]) for r in out.collect()} == {(i, 2 * i + 0.5, 2) for i in range(250)}
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()


def test_surfaces_by_blocks_equal_one_block(spark, monkeypatch):
    """A tile over many small blocks, with disks across their edges, scores as in one block; no row per grid or disk cell."""
    rng = np.random.default_rng(6)
    rows = [("t", i, float(x), float(y), float(z), int(r)) for i, (x, y, z, r) in enumerate(zip(*rng.uniform(0, 40, (2, 900)), rng.uniform(0, 9, 900), rng.integers(1, 4, 900), strict=True))]
    pts = spark.createDataFrame(rows, "tile string, point_id long, x double, y double, z double, return_number int")
    told = lambda: {r["point_id"]: r["q"] for r in visibility.surface_visibility(pts, tolerance=2.0, slope_degrees=30.0).collect()}
    whole = told()
    monkeypatch.setattr(visibility, "BLOCK", 3)
    assert told() == whole and len(whole) == 900 and 0.2 < np.mean(list(whole.values())) < 0.9
    plan = visibility.surface_visibility(pts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(sequence") == 2 and "Generate explode([[" not in plan and "Generate explode(array(" not in plan


def test_elastic_has_no_row_per_corner_or_node(spark, monkeypatch):
    """p36_elastic: eight corners of a point and 125 nodes round each were rows; the same moves with small blocks and batches, tiles not drawn unchanged."""
    rng = np.random.default_rng(5)
    rows = [(t, i, *map(float, p)) for t in range(4) for i, p in enumerate(rng.uniform(0, 30, (200, 3)))] + [(1, 900, None, 1.0, 2.0), (7, 901, 1.0, 1.0, 2.0)]
    pts = spark.createDataFrame(rows, "tile long, point_id long, x double, y double, z double")
    told = lambda p: {(r["tile"], r["point_id"]): np.array([r["x"], r["y"], r["z"]]) for r in augment.elastic(pts, 2.0, 0.5, 9, p).collect()}
    whole = told(1.0)
    assert len(whole) == 801
    monkeypatch.setattr(augment, "NODES", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        parts, some = told(1.0), told(0.5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts.keys() == whole.keys() and max(np.abs(parts[k] - whole[k]).max() for k in whole) < 1e-12
    drawn = {t for t, i in some if any(abs(some[t, i] - whole[t, i]) < 1e-12)}
    assert 0 < len(drawn) < 5
    plan = augment.elastic(pts, 2.0, 0.5, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def _two_clouds(spark):
    """A cloud of many leaves (with LEAF at 64) beside a small one, a lone point and a point without a place."""
    rng = np.random.default_rng(7)
    rows = [(n, i, *(float(v) for v in p), int(rng.integers(1, 4)), int(rng.integers(-1, 4))) for n, m in ((1, 900), (2, 30), (3, 1)) for i, p in enumerate(np.round(rng.uniform(0, 30, (m, 3)), 1))]
    return spark.createDataFrame([*rows, (2, 77, None, 0.0, 0.0, 1, 1), (2, 78, 1.0, 1.0, 1.0, None, None)], "tile long, point_id long, x double, y double, z double, classification int, role int")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_role_context_travels_in_lists(spark, monkeypatch):
    """a36_context_scores: the same as from edges, without a join of edges with roles."""
    monkeypatch.setattr(neighbors, "LEAF", 64)
    pts = _two_clouds(spark)
    got = features.nearest_role_context(pts, pts, 8, F.col("role"))
    want = features.role_context(neighbors.knn(pts, pts, 8, exclude_self=True), pts, F.col("role"))
    told = lambda df: {r["src"] + 1000 * r["tile"]: r.asDict() for r in df.collect()}
    assert told(got) == told(want) and len(told(got)) == 931
    small = pts.where("tile <> 1")
    assert "Join" not in _plan(features.nearest_role_context(small, small, 8, F.col("role"))).split("Union")[0]


def test_grouped_neighbors_travel_in_lists(spark, monkeypatch):
    """j10_group_neighbors: the same groups as from edges joined with both ends."""
    monkeypatch.setattr(neighbors, "LEAF", 64)
    pts = _two_clouds(spark)
    got = neighbors.grouped_nearest(pts, pts, 6, ["classification"], 1)
    want = neighbors.group_neighbors(neighbors.knn(pts, pts, 6), pts, ["classification"], pts, 1)
    key = lambda r: r[:2]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_hashed_balls_are_cut_in_the_leaf(spark, monkeypatch):
    """j08_ball_query_random: the first of a ball in the hashed order, without a row or a window row per pair."""
    monkeypatch.setattr(neighbors, "LEAF", 64)
    pts = _two_clouds(spark)
    for least in (0.0, 2.0):
        got = neighbors.ball_query(pts, pts, 6.0, 4, least, order="random", seed=5)
        both = neighbors.radius_edges(pts, pts, 6.0).where(f"d2 <= 1e-5 OR d2 >= {least * least} AND d2 < 36").withColumn("u", unit_hash(5, "src", "dst"))
        want = {}
        for r in sorted(both.collect(), key=lambda r: (r["u"], r["dst"])):
            want.setdefault((r["tile"], r["src"]), []).append(r["dst"])
        found = {}
        for r in sorted(got.collect(), key=lambda r: r["rank"]):
            found.setdefault((r["tile"], r["src"]), []).append(r["dst"])
            assert r["rank"] == len(found[r["tile"], r["src"]]) - 1
        assert found == {k: v[:4] for k, v in want.items()}
    assert "Window" not in _plan(got)


def test_clusters_come_from_few_links(spark, monkeypatch):
    """a53_cluster: a leaf's task keeps a link per point at most, labels are not joined to pairs; components as from all pairs."""
    monkeypatch.setattr(neighbors, "LEAF", 64)
    pts = _two_clouds(spark)
    got = {(r["tile"], r["point_id"]): r["component"] for r in neighbors.cluster(pts, 4.0, 1).collect()}
    labels = pts.select("tile", F.col("point_id").alias("dst"), F.col("classification").alias("b"))
    edges = neighbors.radius_edges(pts, pts, 4.0).join(labels, ["tile", "dst"]).join(labels.select("tile", F.col("dst").alias("src"), F.col("b").alias("a")), ["tile", "src"]).where("a = b AND src < dst")
    want = {(r["tile"], r["point_id"]): r["component"] for r in neighbors.connected(pts, edges).collect()}
    assert got == want and 5 < len(set(want.values())) < 900
    small = pts.where("tile <> 1")
    links, whole = neighbors._label_links(small, 9.0, "classification", "tile", "point_id")
    assert whole
    assert 0 < links.count() < 30 and "Join" not in _plan(links)


def test_faces_bring_their_sides(spark):
    """j25_vertex_normals: faces with their sides give the normals of faces that look their corners up, without a join but the last."""
    pts = _two_clouds(spark).where("x IS NOT NULL")
    lists = neighbors.neighbor_lists(pts, pts, 2, exclude_self=True)
    ends = {"b": F.element_at("near", 1), "c": F.element_at("near", -1)}
    faces = lists.select(F.col("tile").alias("mesh"), F.col("src").alias("a"), *(e["dst"].alias(p) for p, e in ends.items()), *(e[f"d{c}"].alias(f"{p}{c}") for p, e in ends.items() for c in "xyz"))
    vertices = pts.select(F.col("tile").alias("mesh"), F.col("point_id").alias("vertex_id"), "x", "y", "z")
    told = lambda f: {(r["mesh"], r["vertex_id"]): np.array([r["nx"], r["ny"], r["nz"]]) for r in geometry.vertex_normals(vertices, f).collect()}
    got, want = told(faces), told(faces.select("mesh", "a", "b", "c"))
    assert got.keys() == want.keys() and len(got) == 932 and max(np.abs(got[k] - want[k]).max() for k in got) < 1e-6
    flat = faces.select(*(F.lit(0).cast(f.dataType).alias(f.name) for f in faces.schema))
    assert _plan(geometry.vertex_normals(vertices, flat)).count("Join") == 1


def test_boxes_of_a_cell_meet_in_several_tasks(spark, monkeypatch):
    """j13_bbox_join: pairs as by brute force, and those of one full cell come from several tasks."""
    monkeypatch.setattr(visibility, "BOXES", 16, raising=False)
    spread = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = np.random.default_rng(6)
        low = np.r_[np.round(rng.uniform(0, 3, (120, 2)), 2), np.round(rng.uniform(0, 40, (60, 2)), 2)]
        side = np.r_[np.full((100, 2), 6.0), np.round(rng.uniform(0, 9, (80, 2)), 2)]
        rows = [(i % 2, i, *map(float, (p[0], p[0] + s[0], p[1], p[1] + s[1]))) for i, (p, s) in enumerate(zip(low, side, strict=True))]
        rows += [(0, 900, 1.0, 1.0, 1.0, 1.0), (None, 901, 0.0, 9.0, 0.0, 9.0), (0, 902, None, 9.0, 0.0, 9.0), (0, 903, 5.0, 3.0, 2.0, 1.0)]
        a = spark.createDataFrame(rows, "block int, id int, min_x double, max_x double, min_y double, max_y double")
        out = visibility.bbox_join(a, a.withColumnRenamed("id", "other"), ["block"], 10.0)
        assert out.columns == ["block", "id", "min_x", "max_x", "min_y", "max_y", "other", "b_min_x", "b_max_x", "b_min_y", "b_max_y"]
        got = sorted((r["id"], r["other"]) for r in out.collect())
        meet = lambda p, q: p[0] == q[0] and p[2] < q[3] and q[2] < p[3] and p[4] < q[5] and q[4] < p[5]
        whole = [r for r in rows if None not in r]
        assert got == sorted((p[1], q[1]) for p in whole for q in whole if meet(p, q))
        full = a.where("id < 100 AND block = 0").where("max_x < 10 AND max_y < 10")
        made = visibility.bbox_join(full, full.withColumnRenamed("id", "other"), ["block"], 10.0).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in made) == full.count() ** 2 and len(made) > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", spread)


def test_terrain_is_split_by_keys_and_filled_in_its_block(spark, monkeypatch):
    """t13_terrain_split: sorts compare columns (a hash in a sort is computed at every comparison), and rasters of one block are filled without a search."""
    monkeypatch.setattr(raster, "nearest_filled", lambda *a, **k: (_ for _ in ()).throw(AssertionError("searched")))
    g = np.random.default_rng(3)
    rows = [(t, i, *map(float, p), 1 + i % 2) for t in (1, 2) for i, p in enumerate(np.round(np.c_[g.uniform(0, 60, (120, 2)), g.normal(0, 1, 120)], 3))]
    pts = spark.createDataFrame(rows, "tile int, point_id int, x double, y double, z double, classification int")
    out = sampling.terrain_split(pts, 4, ground=2, low=10.0)
    assert out.columns == ["tile", "point_id", "x", "y", "z", "classification", "role", "gt_low"]
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in line and "Window [" in line]
    assert windows and not any("md5" in line for line in windows)
    got = out.toPandas()
    assert len(got) == 240 and set(got.classification[got.role == "query"]) == {2} and got.gt_low.notna().equals(got.role == "query")


def _large(spark, rows, most):
    """Large and small clouds, with copies of one place, on a few heights."""
    rng = np.random.default_rng(rows)
    table = [(t, i, *map(float, p)) for t, n in ((1, rows), (2, most), (3, 1)) for i, p in enumerate(np.c_[rng.integers(0, 30, (n, 2)), rng.integers(0, 9, n) / 4])]
    return spark.createDataFrame([*table, (2, 999, None, 0.0, 0.0)], "tile long, point_id long, x double, y double, z double")


def _shuffled(df):
    """Shuffles of the whole plan that are not of a broadcast or a single row."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_heights_travel_in_lists(spark, monkeypatch):
    """a44_height_descriptor: the same as from edges; a table of small clouds moves once, each point as one row."""
    monkeypatch.setattr(neighbors, "LEAF", 64)
    pts = _large(spark, 400, 50)
    told = lambda d: {(r["tile"], r["src"]): [round(r[c], 9) for c in ("z_above_min", "z_below_max", "z_range", "z_std", "z_to_median", "log_density")] for r in d.collect()}
    got = told(geometry.nearest_height_descriptor(pts, 8))
    assert len(got) == 451 and got == told(geometry.height_descriptor(neighbors.knn(pts, pts, 8), pts))
    small = geometry.nearest_height_descriptor(pts.where("tile > 1"), 8)
    assert _shuffled(small) == 1 and "Join" not in _plan(small) and "Union" not in _plan(small) and "Generate" not in _plan(small)


def test_points_that_ask_themselves_move_once(spark):
    """A cloud is searched from one row per point where it asks itself, also by two equal plans; elsewhere from both tables."""
    pts = _large(spark, 100, 50)
    again = pts.where("tile < 9"), pts.where("tile < 9")
    assert "Union" not in _plan(neighbors.knn(*again, 3)) and "Union" in _plan(neighbors.knn(pts, pts.where("z > 0"), 3))
    rank = lambda d: sorted(map(tuple, d.select("tile", "src", "dst", "rank").collect()))
    assert rank(neighbors.knn(*again, 3)) == rank(neighbors.knn(pts, pts.withColumn("x", F.col("x") + 0), 3))
    for sums in (neighbors.neighbor_sums(pts, pts, 3), neighbors.knn(pts, pts, 3)):
        assert _shuffled(sums) == 1


def test_centroids_of_small_clouds_are_made_in_place(spark, monkeypatch):
    """a41_local_geometry: small clouds move once, and have the features of centroids that are made by a join."""
    pts = _large(spark, 400, 50)
    columns = ["linearity", "planarity", "scattering", "curvature", "verticality", "anisotropy", "geom_valid"]
    told = lambda: {(r["tile"], r["point_id"]): [round(float(r[c]), 6) for c in columns] for r in geometry.local_geometry(pts, 12, 4.0).collect()}
    alone = told()
    assert len(alone) == 451
    assert _shuffled(geometry.local_geometry(pts, 12, 4.0)) == 1
    for leaf in (64, 1):
        monkeypatch.setattr(neighbors, "LEAF", leaf)
        assert told() == alone


def test_heights_over_candidates_need_no_join_of_points(spark, monkeypatch):
    """a46_ground_idw: as by brute force in small and large clouds, with points without a place or height; points of small clouds are not joined."""
    monkeypatch.setattr(neighbors, "LEAF", 6)
    pts = _large(spark, 300, 50).unionByName(spark.createDataFrame([(3, 5, 2.0, 2.0, None)], "tile long, point_id long, x double, y double, z double"))
    got = {(r["tile"], r["point_id"]): r["elevation"] for r in geometry.ground_elevation(pts, 8.0, "idw", scale=2.0).collect()}
    want = {}
    for tile, part in pts.toPandas().groupby("tile"):
        placed = part[part.x.notna()]
        cand = placed.assign(cx=placed.x // 8, cy=placed.y // 8).sort_values(["z", "point_id"], na_position="first").groupby(["cx", "cy"]).head(1).sort_values("point_id")
        for p in part.itertuples():
            d = np.hypot(cand.x - p.x, cand.y - p.y).to_numpy()
            near = np.lexsort((cand.point_id, d))[:3]
            w, z = 1 / np.maximum(d[near], 1e-3), cand.z.to_numpy()[near]
            ground = np.nansum(z * w) / w.sum() if p.x == p.x and not np.isnan(z).all() else p.z
            want[tile, p.point_id] = (p.z - ground) / 2
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], atol=1e-9) if want[k] == want[k] else got[k] is None for k in want)
    monkeypatch.setattr(neighbors, "LEAF", 1024)
    plan = _plan(geometry.ground_elevation(pts, 8.0, "idw"))
    assert "Join" not in plan and "Generate" not in plan
