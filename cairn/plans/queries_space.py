"""Queries: neighbours, geometry, visibility, frames, sampling, features, augmentation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalar import return_role
from cairn.operators import augment, features, frames, geometry, grid, neighbors, raster, sampling, segments, spread, visibility
from cairn.plans.queries_labels import KEY, ROLE, U, r6
from cairn.plans.registry import Tables, query, rnd
from cairn.sources import sinks

D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


def _knn(k: int, where: str = "true", src: str = "pts", ref: str = "pts") -> str:
    return f"(SELECT tile, src, dst, CAST(rank AS INT) AS rank, d2 FROM (SELECT a.tile, a.point_id AS src, b.point_id AS dst, {D2} AS d2, row_number() OVER (PARTITION BY a.tile, a.point_id ORDER BY {D2}, b.point_id) AS rank FROM {src} a JOIN {ref} b USING (tile) WHERE {where}) WHERE rank <= {k})"


query("j05_knn", lambda t: r6(neighbors.knn(t.pts, t.pts, 4), "dist"), f"SELECT tile, src, dst, rank, {rnd('sqrt(d2)')} AS dist FROM {_knn(4)}")
query("j05_knn_cross", lambda t: r6(neighbors.knn(t.pts.where("classification = 1"), t.pts.where("classification = 2"), 3), "dist"), f"SELECT tile, src, dst, rank, {rnd('sqrt(d2)')} AS dist FROM {_knn(3, 'a.classification = 1 AND b.classification = 2')}")
query("j06_knn_exclude_self", lambda t: r6(neighbors.knn(t.pts, t.pts, 3, exclude_self=True), "dist"), f"SELECT tile, src, dst, rank, {rnd('sqrt(d2)')} AS dist FROM {_knn(3, 'a.point_id <> b.point_id')}")
_BALL = f"bq AS (SELECT a.tile, a.point_id AS src, b.point_id AS dst, {D2} AS d2 FROM pts a JOIN pts b USING (tile) WHERE {D2} <= 1e-5 OR {D2} >= 1 AND {D2} < 225), br AS (SELECT *, row_number() OVER (PARTITION BY tile, src ORDER BY d2, dst) - 1 AS i, count(*) OVER (PARTITION BY tile, src) AS c FROM bq)"
query("j07_ball_query", lambda t: r6(neighbors.ball_query(t.pts, t.pts, 15.0, 4, 1.0), "dist"), f"SELECT tile, src, dst, CAST(j AS INT) AS rank, {rnd('sqrt(d2)')} AS dist FROM br, range(0, 4) r(j) WHERE c <= 4 AND i = j OR c > 4 AND floor(j * c / 4) = i", _BALL)
query("j08_ball_query_random", lambda t: r6(neighbors.ball_query(t.pts, t.pts, 15.0, 4, order="random", seed=5), "dist").select("tile", "src", "dst", "rank"), f"SELECT tile, src, dst, CAST(i AS INT) AS rank FROM (SELECT tile, src, dst, row_number() OVER (PARTITION BY tile, src ORDER BY {U(5, 'src', 'dst')}, dst) - 1 AS i FROM (SELECT a.tile, a.point_id AS src, b.point_id AS dst FROM pts a JOIN pts b USING (tile) WHERE {D2} < 225)) WHERE i < 4")
query("j09_radius_csr", lambda t: neighbors.csr(neighbors.radius_edges(t.pts, t.pts, 8.0)).select("tile", "src", "degree", F.col("neighbors")[0].alias("least"), F.array_max("neighbors").alias("most")), f"SELECT a.tile, a.point_id AS src, count(*) AS degree, min(b.point_id) AS least, max(b.point_id) AS most FROM pts a JOIN pts b USING (tile) WHERE {D2} <= 64 GROUP BY 1, 2")
query("j10_group_neighbors", lambda t: neighbors.grouped_nearest(t.pts, t.pts, 6, ["intensity"], 1).select("tile", "src", F.size("group").alias("n"), F.col("group")[1]["intensity"].alias("i1"), F.col("group")[2]["dx"].alias("dx2")), f"SELECT e.tile, e.src, CAST(count(*) AS INT) AS n, max(b.intensity) FILTER (rank = 3) AS i1, max(b.x - a.x) FILTER (rank = 5) AS dx2 FROM {_knn(6)} e JOIN pts a ON e.tile = a.tile AND e.src = a.point_id JOIN pts b ON e.tile = b.tile AND e.dst = b.point_id WHERE rank % 2 = 1 GROUP BY 1, 2")
query("j11_idw", lambda t: r6(neighbors.idw(t.pts.where("classification = 1"), t.pts.where("classification > 4"), "intensity"), "intensity"), f"SELECT e.tile, src, {rnd('sum(b.intensity / (sqrt(d2) + 1e-8)) / sum(1 / (sqrt(d2) + 1e-8))')} AS intensity FROM {_knn(3, 'a.classification = 1 AND b.classification > 4')} e JOIN pts b ON e.tile = b.tile AND e.dst = b.point_id GROUP BY 1, 2")
#: Boxes of all points of a tile and a square of 20 by 20.
_BOXES = "bx AS (SELECT tile, source_block, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM (SELECT * REPLACE (tile * 100 + CAST(floor(x / 20) * 10 + floor(y / 20) AS BIGINT) AS tile) FROM pts) GROUP BY 1, 2)"
BX = lambda t: grid.core_boxes(t.pts.withColumn("tile", F.expr("tile * 100 + CAST(floor(x / 20) * 10 + floor(y / 20) AS BIGINT)")), ["tile", "source_block"])
query("j13_bbox_join", lambda t: visibility.bbox_join(BX(t), BX(t).withColumnRenamed("tile", "other").drop("n"), ["source_block"], 20.0).select("source_block", "tile", "other"), "SELECT a.source_block, a.tile, b.tile AS other FROM bx a JOIN bx b ON a.source_block = b.source_block AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1", _BOXES)


def _rasters(t: Tables) -> DataFrame:
    return t("supplier").select(F.col("s_suppkey").alias("raster_order"), ((F.col("s_suppkey") * 7) % 90).cast("double").alias("left"), ((F.col("s_suppkey") * 13) % 80).cast("double").alias("bottom")).withColumn("right", F.col("left") + 12).withColumn("top", F.col("bottom") + 9)


_RAS = "ra AS (SELECT s_suppkey AS raster_order, CAST((s_suppkey * 7) % 90 AS DOUBLE) AS l, CAST((s_suppkey * 13) % 80 AS DOUBLE) AS bo FROM supplier)"
query("j14_point_coverage", lambda t: visibility.point_coverage(t.pts.select(*KEY, "x", "y"), _rasters(t), 16.0, KEY).select(*KEY, F.coalesce("raster_order", F.lit(-1)).alias("raster_order")), "SELECT tile, point_id, coalesce(min(raster_order), -1) AS raster_order FROM pts LEFT JOIN ra ON x >= l AND x < l + 12 AND y > bo AND y <= bo + 9 GROUP BY 1, 2", _RAS)


def _cover(t: Tables) -> tuple[DataFrame, DataFrame]:
    tiles = t("supplier").select(F.col("s_suppkey").alias("tile"), ((F.col("s_suppkey") * 11) % 60).cast("double").alias("min_x"), ((F.col("s_suppkey") * 17) % 60).cast("double").alias("min_y")).withColumn("max_x", F.col("min_x") + 6).withColumn("max_y", F.col("min_y") + 4)
    rects = t("orders").select(F.col("o_orderkey").alias("rect"), (F.col("o_orderkey") % 90).cast("double").alias("min_x"), ((F.col("o_orderkey") * 3) % 70).cast("double").alias("min_y"))
    # Most orders are small squares beside the unit cells' centres, so that tiles are covered in part.
    wide = F.col("rect") % 40 < 6
    return tiles, rects.withColumn("max_x", F.col("min_x") + F.when(wide, 3 + F.col("rect") % 4).otherwise(0.25)).withColumn("max_y", F.col("min_y") + F.when(wide, 5).otherwise(0.25))


query("j15_covered", lambda t: visibility.covered(*_cover(t), size=8.0), "SELECT t.tile, bool_and(EXISTS (SELECT 1 FROM re WHERE mx + i + 0.5 > x AND mx + i + 0.5 < x + w AND my + j + 0.5 > y AND my + j + 0.5 < y + h)) AS covered FROM (SELECT s_suppkey AS tile, (s_suppkey * 11) % 60 AS mx, (s_suppkey * 17) % 60 AS my FROM supplier) t, range(0, 6) a(i), range(0, 4) b(j) GROUP BY 1", "re AS (SELECT DISTINCT o_orderkey % 90 AS x, (o_orderkey * 3) % 70 AS y, CASE WHEN o_orderkey % 40 < 6 THEN 3 + o_orderkey % 4 ELSE 0.25 END AS w, CASE WHEN o_orderkey % 40 < 6 THEN 5 ELSE 0.25 END AS h FROM orders)")
query("j26_check_catalog", lambda t: visibility.check_catalog(t("part").select(F.format_string("%08d", "p_partkey").alias("path"), F.col("p_brand").alias("dtype"), F.col("p_size").alias("bands")), ["dtype", "bands"]), "SELECT path, c AS \"column\", v AS value, e AS expected FROM (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS path, unnest([{'c': 'dtype', 'v': p_brand, 'e': b0}, {'c': 'bands', 'v': CAST(p_size AS VARCHAR), 'e': CAST(s0 AS VARCHAR)}], recursive := true) FROM part, (SELECT arg_min(p_brand, p_partkey) AS b0, arg_min(p_size, p_partkey) AS s0 FROM part)) WHERE v <> e")
query("a53_cluster", lambda t: neighbors.cluster(t.pts, 10.0, 2).select(*KEY, "component", "size"), "SELECT tile, point_id, component, count(*) OVER (PARTITION BY tile, component) AS size FROM (SELECT tile, point_id, min(r) AS component FROM rch GROUP BY 1, 2) QUALIFY count(*) OVER (PARTITION BY tile, component) >= 2", f"ed AS (SELECT a.tile, a.point_id AS a, b.point_id AS b FROM pts a JOIN pts b ON a.tile = b.tile AND a.classification = b.classification WHERE {D2} <= 100), rch AS (SELECT tile, point_id, point_id AS r FROM pts UNION SELECT rch.tile, ed.b, rch.r FROM rch JOIN ed ON rch.tile = ed.tile AND rch.point_id = ed.a)")
query("a54_superpoints", lambda t: segments.nearest_superpoints(_with_normals(t), 6, least=5, most=200))


def _far(m: int) -> str:
    """CTE ``far`` in SQL: per step the squared distance of each point to those taken (below 0: taken) and, as ``hit``, the point taken."""
    away = " + ".join(f"({c} - max({c}) FILTER (WHERE hit) OVER w) * ({c} - max({c}) FILTER (WHERE hit) OVER w)" for c in "xyz")
    step = f"SELECT tile, point_id, x, y, z, CASE WHEN hit OR d < 0 THEN -1 ELSE least(d, {away}) END AS d, step FROM far WHERE step < {m - 1} WINDOW w AS (PARTITION BY tile)"
    return f"""far AS (SELECT tile, point_id, x, y, z, CAST('inf' AS DOUBLE) AS d, point_id = min(point_id) OVER (PARTITION BY tile) AS hit, 0 AS step FROM pts
      UNION ALL SELECT tile, point_id, x, y, z, d, d >= 0 AND row_number() OVER (PARTITION BY tile ORDER BY d DESC, point_id) = 1, step + 1 FROM ({step}))"""


query("t14_fps", lambda t: spread.fps(t.pts, 16), "SELECT tile, point_id, step AS rank FROM far WHERE hit", _far(16))
query("t14_patches", lambda t: r6(spread.patches(t.pts, 4, 8), "dist"), f"SELECT tile, src, dst, CAST(rank AS INT) AS rank, {rnd('sqrt(d2)')} AS dist, patch FROM ne WHERE rank <= 8", _far(4) + """, ne AS (SELECT tile, src, dst, d2, patch, row_number() OVER (PARTITION BY tile, src ORDER BY d2, dst) AS rank FROM
      (SELECT a.tile, a.point_id AS src, b.point_id AS dst, a.step AS patch, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) AS d2 FROM far a JOIN pts b ON a.tile = b.tile WHERE a.hit))""")


def _with_normals(t: Tables) -> DataFrame:
    """Points with unit normals that follow from their ids."""
    a = (F.col("point_id") % 64) / 10.0
    return t.pts.withColumn("nx", F.sin(a)).withColumn("ny", F.lit(0.0)).withColumn("nz", F.cos(a))


# --- geometry ------------------------------------------------------------------------------------------------------
query("a35_role_context", lambda t: r6(features.nearest_role_context(t.pts, t.pts, 8, return_role("return_number", "number_of_returns")), "role_0", "role_1", "role_2", "role_3"), "SELECT tile, src, " + ", ".join(rnd(f"coalesce(count(*) FILTER (role = {k}) / nullif(count(*) FILTER (role >= 0), 0), 0)") + f" AS role_{k}" for k in range(4)) + f", count(*) FILTER (role >= 0) AS n_valid FROM {_knn(8, 'a.point_id <> b.point_id')} e JOIN (SELECT tile, point_id AS dst, {ROLE} AS role FROM pts) USING (tile, dst) GROUP BY 1, 2")


def _context(t: Tables) -> DataFrame:
    from cairn.operators import metrics

    ctx = neighbors.checkpointed(features.nearest_role_context(t.pts, t.pts, 8, return_role("return_number", "number_of_returns")))
    prior = ctx.agg(*(F.avg(f"role_{k}").alias(f"p_{k}") for k in range(4)))
    return r6(metrics.context_scores(ctx.select(*(F.col(f"role_{k}").alias(f"t_{k}") for k in range(4))).crossJoin(F.broadcast(prior)), ["0", "1", "2", "3"]), *(f"mae_{k}" for k in range(4)), "cross_entropy", "entropy", "kl")


query("a36_context_scores", _context, "SELECT " + ", ".join(rnd(f"avg(abs(t{k} - p{k}))") + f" AS mae_{k}" for k in range(4)) + ", " + rnd("avg(" + " + ".join(f"-t{k} * ln(greatest(p{k}, 1e-8))" for k in range(4)) + ")") + " AS cross_entropy, " + rnd("avg(" + " + ".join(f"-t{k} * ln(greatest(t{k}, 1e-8))" for k in range(4)) + ")") + " AS entropy, " + rnd("avg(" + " + ".join(f"-t{k} * ln(greatest(p{k}, 1e-8)) + t{k} * ln(greatest(t{k}, 1e-8))" for k in range(4)) + ")") + " AS kl FROM ct, (SELECT " + ", ".join(f"avg(t{k}) AS p{k}" for k in range(4)) + " FROM ct)", "ct AS (SELECT tile, src, " + ", ".join(f"coalesce(count(*) FILTER (role = {k}) / nullif(count(*) FILTER (role >= 0), 0), 0) AS t{k}" for k in range(4)) + f" FROM {_knn(8, 'a.point_id <> b.point_id')} e JOIN (SELECT tile, point_id AS dst, {ROLE} AS role FROM pts) USING (tile, dst) GROUP BY 1, 2)")
query("a34_instance_boxes", lambda t: r6(features.instance_boxes(t.pts.withColumn("instance", F.when(F.col("return_number") == 4, -1).otherwise(F.col("classification") * 3)).withColumn("segment", F.col("classification")), vacated=[1, 4]), "mean_x", "mean_y", "mean_z").select("tile", "instance", "class", "n", "mean_x", "box_x", "size_y", F.col("new_id").cast("long").alias("new_id")), f"SELECT tile, classification * 3 AS instance, classification - CASE WHEN classification > 4 THEN 2 WHEN classification > 1 THEN 1 ELSE 0 END AS class, count(*) AS n, {rnd('avg(x)')} AS mean_x, (min(x) + max(x)) / 2 AS box_x, max(y) - min(y) AS size_y, dense_rank() OVER (PARTITION BY tile ORDER BY classification * 3) - 1 AS new_id FROM pts WHERE return_number <> 4 GROUP BY tile, classification")
GEOM = ["linearity", "planarity", "scattering", "curvature", "verticality", "anisotropy"]
query("a41_local_geometry", lambda t: r6(geometry.local_geometry(t.pts, 12, 4.0), *GEOM).select(*KEY, *GEOM, "geom_valid"))
query("a41_curvature_planarity", lambda t: r6(geometry.curvature_planarity(t.pts, 12), "curvature", "planarity"))
query("a41_eigen_features", lambda t: geometry.eigen_features(t.pts, 12))
query("a42_normals", lambda t: geometry.normals(t.pts, 8, cls=1, toward=(50.0, 50.0, 500.0)).select(*KEY, "nx", "ny", "nz"))
query("a43_column_strata", lambda t: geometry.column_strata(t.pts, 8.0).select(*KEY, "density", "overstory", "vegetation_overstory", "multilayer", "boundary", "valid_return"), "SELECT tile, point_id, count(*) OVER w AS density, max(z) OVER w - z >= 3 AND count(*) OVER w >= 8 AS overstory, coalesce(max(CASE WHEN classification = 3 THEN z END) OVER w - z >= 3, false) AND count(*) OVER w >= 8 AS vegetation_overstory, max(z) OVER w - min(z) OVER w >= 3 AND count(*) OVER w >= 8 AS multilayer, bool_or(classification = 3) OVER w AND bool_or(classification = 6) OVER w AS boundary, return_number >= 1 AND number_of_returns >= 1 AND return_number <= number_of_returns AS valid_return FROM (SELECT *, floor((x - min(x) OVER (PARTITION BY tile)) / 8) AS cx, floor((y - min(y) OVER (PARTITION BY tile)) / 8) AS cy FROM pts) WINDOW w AS (PARTITION BY tile, cx, cy)")
query("a44_height_descriptor", lambda t: r6(geometry.nearest_height_descriptor(t.pts, 8), "z_std", "log_density", "z_to_median"), f"SELECT e.tile, src, max(a.z) - min(b.z) AS z_above_min, max(b.z) - max(a.z) AS z_below_max, max(b.z) - min(b.z) AS z_range, {rnd('stddev_pop(b.z)')} AS z_std, {rnd('max(a.z) - quantile_cont(b.z, 0.5)')} AS z_to_median, {rnd('ln(1 + count(*) / (4.0::DOUBLE / 3 * pi() * greatest(sqrt(max(d2)), 1e-3) * greatest(sqrt(max(d2)), 1e-3) * greatest(sqrt(max(d2)), 1e-3)))')} AS log_density FROM {_knn(8)} e JOIN pts a ON e.tile = a.tile AND e.src = a.point_id JOIN pts b ON e.tile = b.tile AND e.dst = b.point_id GROUP BY 1, 2")
query("a45_height_above_ground", lambda t: r6(geometry.height_above_ground(t.pts, 2, 8.0), "hag"), f"SELECT tile, point_id, {rnd('greatest(z - gz, 0)')} AS hag FROM hp JOIN hn USING (tile, cx, cy)", "hp AS (SELECT *, CAST(floor((x - min(x) OVER t) / 8) AS BIGINT) AS cx, CAST(floor((y - min(y) OVER t) / 8) AS BIGINT) AS cy FROM pts WINDOW t AS (PARTITION BY tile)), hg AS (SELECT tile, cx AS gx, cy AS gy, quantile_cont(z, 0.1) AS gz FROM hp WHERE classification = 2 GROUP BY 1, 2, 3), hn AS (SELECT tile, cx, cy, arg_min(gz, ((cx - gx) * (cx - gx) + (cy - gy) * (cy - gy)) * 100000000 + gx * 10000 + gy) AS gz FROM (SELECT DISTINCT tile, cx, cy FROM hp) JOIN hg USING (tile) GROUP BY 1, 2, 3)")
def _plane_sql(rows: str, more: str = "") -> str:
    """``(tile, n, a, b, c)``: the least-squares plane of each tile."""
    a, b = "(sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy)", "(syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy)"
    return f"(SELECT tile, n, {a} AS a, {b} AS b, mz - mx * {a} - my * {b} AS c FROM (SELECT tile, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, regr_sxx(x, x) AS sxx, regr_sxx(y, y) AS syy, regr_sxy(x, y) AS sxy, regr_sxy(x, z) AS sxz, regr_sxy(y, z) AS syz FROM {rows} {more} GROUP BY 1))"


_GC = "gc AS (SELECT tile, point_id, x, y, z FROM pts QUALIFY row_number() OVER (PARTITION BY tile, floor(x / 16), floor(y / 16) ORDER BY z, point_id) = 1)"
_GP = f"""{_GC}, g1 AS {_plane_sql('gc')}, gr AS (SELECT gc.*, abs(z - (a * x + b * y + c)) AS r, n FROM gc JOIN g1 USING (tile)),
  gt AS (SELECT *, greatest(quantile_cont(r, 0.7) OVER (PARTITION BY tile), 0.01) AS t FROM gr), g2 AS {_plane_sql('gt', 'WHERE r <= t AND n >= 6')},
  gp AS (SELECT g1.tile, CASE WHEN g2.n >= 3 THEN g2.a ELSE g1.a END AS a, CASE WHEN g2.n >= 3 THEN g2.b ELSE g1.b END AS b, CASE WHEN g2.n >= 3 THEN g2.c ELSE g1.c END AS c FROM g1 LEFT JOIN g2 USING (tile))"""
_GI = f"{_GC}, gd AS (SELECT p.tile, p.point_id, gc.z, sqrt((p.x - gc.x) * (p.x - gc.x) + (p.y - gc.y) * (p.y - gc.y)) AS d FROM pts p JOIN gc USING (tile) QUALIFY row_number() OVER (PARTITION BY p.tile, p.point_id ORDER BY d, gc.point_id) <= 3), gz AS (SELECT tile, point_id, sum(z / greatest(d, 1e-3)) / sum(1 / greatest(d, 1e-3)) AS g FROM gd GROUP BY 1, 2)"
query("a46_ground_plane", lambda t: r6(geometry.ground_elevation(t.pts, 16.0), "elevation", digits=5), f"SELECT tile, point_id, {rnd('(z - (gp.a * x + gp.b * y + gp.c)) / 3', 5)} AS elevation FROM pts JOIN gp USING (tile)", _GP)
query("a46_ground_fit", lambda t: r6(geometry.fit_plane(geometry.ground_candidates(t.pts, 16.0)), "a", "b", "c", digits=5), f"SELECT tile, {rnd('(sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy)', 5)} AS a, {rnd('(syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy)', 5)} AS b, {rnd('mz - mx * (sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy) - my * (syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy)', 5)} AS c FROM (SELECT tile, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, regr_sxx(x, x) AS sxx, regr_sxx(y, y) AS syy, regr_sxy(x, y) AS sxy, regr_sxy(x, z) AS sxz, regr_sxy(y, z) AS syz FROM (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY tile, floor(x / 16), floor(y / 16) ORDER BY z, point_id) = 1) GROUP BY 1)")
query("a46_ground_idw", lambda t: r6(geometry.ground_elevation(t.pts, 16.0, "idw", scale=2.0), "elevation"), f"SELECT tile, point_id, {rnd('(z - gz.g) / 2')} AS elevation FROM pts JOIN gz USING (tile, point_id)", _GI)
query("a47_terrain_grid", lambda t: r6(geometry.terrain_grid(t.pts, 16.0), "z_mean", "laplacian", "weight", digits=4).select("tile", "cx", "cy", "z_mean", "z_range", "laplacian", "weight", "n"), f"SELECT g.tile, g.cx, g.cy, {rnd('g.m', 4)} AS z_mean, g.hi - g.lo AS z_range, {rnd('coalesce(l.s - l.k * g.m, 0)', 4)} AS laplacian, {rnd('pow(1 + g.hi - g.lo + abs(coalesce(l.s - l.k * g.m, 0)), 2)', 4)} AS weight, g.n FROM tg g LEFT JOIN (SELECT a.tile, a.cx, a.cy, sum(b.m) AS s, count(*) AS k FROM tg a JOIN tg b ON a.tile = b.tile AND abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1 GROUP BY 1, 2, 3) l USING (tile, cx, cy)", "tg AS (SELECT tile, CAST(floor(x / 16) AS BIGINT) AS cx, CAST(floor(y / 16) AS BIGINT) AS cy, avg(z) AS m, min(z) AS lo, max(z) AS hi, count(*) AS n FROM pts GROUP BY 1, 2, 3)")


def _surface_sql(size: float, pad: int, spare: int, value: str, sigma: float, fill: str) -> str:
    """``sp`` (points in cells), ``sd`` (the whole raster, filled) and ``s2`` (smoothed along both sides, edges mirrored)."""
    weights = ", ".join(f"({k - len(w) // 2}, {x!r}::DOUBLE)" for w in [raster.gaussian(sigma).tolist()] for k, x in enumerate(w))
    nearest = "(SELECT a.tile, a.i, a.j, arg_min(o.v, CAST(((a.i - o.i) * (a.i - o.i) + (a.j - o.j) * (a.j - o.j)) * 100000000 + o.i * 10000 + o.j AS BIGINT)) AS v FROM sa a JOIN so o USING (tile) GROUP BY 1, 2, 3)"
    level = "(SELECT sa.tile, i, j, lv AS v FROM sa JOIN (SELECT tile, avg(v) AS lv FROM so GROUP BY 1) USING (tile))"
    mirror = lambda c: f"least(((a.{c} + k) % (2 * a.n{c}) + 2 * a.n{c}) % (2 * a.n{c}), 2 * a.n{c} - 1 - ((a.{c} + k) % (2 * a.n{c}) + 2 * a.n{c}) % (2 * a.n{c}))"
    return f"""sb AS (SELECT tile, min(x) - {pad} * {size} AS ox, min(y) - {pad} * {size} AS oy, CAST(ceil((max(x) - min(x)) / {size}) AS BIGINT) + {spare} AS ni, CAST(ceil((max(y) - min(y)) / {size}) AS BIGINT) + {spare} AS nj FROM pts GROUP BY 1),
su AS (SELECT p.*, ni, nj, (x - ox) / {size} AS u, (y - oy) / {size} AS v FROM pts p JOIN sb USING (tile)),
sp AS (SELECT *, least(greatest(CAST(floor(u) AS BIGINT), 0), ni - 1) AS i, least(greatest(CAST(floor(v) AS BIGINT), 0), nj - 1) AS j FROM su),
so AS MATERIALIZED (SELECT tile, i, j, {value} AS v FROM sp GROUP BY 1, 2, 3),
sa AS (SELECT tile, i, j FROM (SELECT tile, i, unnest(range(nj)) AS j FROM (SELECT tile, nj, unnest(range(ni)) AS i FROM sb)) ANTI JOIN so USING (tile, i, j)),
sd AS MATERIALIZED (SELECT tile, i, j, v, ni, nj FROM (SELECT * FROM so UNION ALL SELECT * FROM {nearest if fill == "nearest" else level}) JOIN sb USING (tile)),
sw(k, w) AS (VALUES {weights}),
s1 AS MATERIALIZED (SELECT a.tile, a.i, a.j, a.ni, a.nj, sum(w * b.v) AS v FROM sd a CROSS JOIN sw JOIN sd b ON b.tile = a.tile AND b.j = a.j AND b.i = {mirror("i")} GROUP BY 1, 2, 3, 4, 5),
s2 AS MATERIALIZED (SELECT a.tile, a.i, a.j, sum(w * b.v) AS v FROM s1 a CROSS JOIN sw JOIN s1 b ON b.tile = a.tile AND b.i = a.i AND b.j = {mirror("j")} GROUP BY 1, 2, 3)"""


query("a47_flatten_non_ground", lambda t: r6(raster.flatten_non_ground(t.pts, 2, 8.0).select(*KEY, "z"), "z"), f"SELECT tile, point_id, {rnd('CASE WHEN classification = 2 THEN z ELSE s2.v END')} AS z FROM sp JOIN s2 USING (tile, i, j)", _surface_sql(8.0, 0, 1, "max(z)", 2.0, "mean"))
_SB = """sq AS (SELECT tile, point_id, z, count(*) OVER (PARTITION BY tile) AS n, avg(z) OVER (PARTITION BY tile) AS m, ni, nj, least(greatest(u - 0.5::DOUBLE, 0), ni - 1) AS a, least(greatest(v - 0.5::DOUBLE, 0), nj - 1) AS b FROM sp),
sc AS (SELECT *, CAST(floor(a) AS BIGINT) AS i, CAST(floor(b) AS BIGINT) AS j FROM sq)"""
query("a47_low_frequency", lambda t: r6(raster.low_frequency(t.pts, 10.0), "z_low"), f"SELECT c.tile, c.point_id, {rnd('CASE WHEN n < 50 THEN m ELSE (1 - a + c.i) * ((1 - b + c.j) * p.v + (b - c.j) * q.v) + (a - c.i) * ((1 - b + c.j) * r.v + (b - c.j) * s.v) END')} AS z_low FROM sc c JOIN s2 p ON p.tile = c.tile AND p.i = c.i AND p.j = c.j JOIN s2 q ON q.tile = c.tile AND q.i = c.i AND q.j = least(c.j + 1, c.nj - 1) JOIN s2 r ON r.tile = c.tile AND r.i = least(c.i + 1, c.ni - 1) AND r.j = c.j JOIN s2 s ON s.tile = c.tile AND s.i = least(c.i + 1, c.ni - 1) AND s.j = least(c.j + 1, c.nj - 1)", _surface_sql(10.0, 2, 3, "avg(z)", 1.5, "nearest") + ", " + _SB)
_TW = """tb AS (SELECT tile, min(x) AS lx, min(y) AS ly, CAST(ceil((max(x) - min(x)) / 10) AS BIGINT) AS kx, CAST(ceil((max(y) - min(y)) / 10) AS BIGINT) AS ky FROM pts GROUP BY 1),
ta AS (SELECT p.tile, point_id, z, kx, ky, least(CAST(floor((x - lx) / 10) AS BIGINT), kx - 1) AS cx, least(CAST(floor((y - ly) / 10) AS BIGINT), ky - 1) AS cy FROM pts p JOIN tb USING (tile)),
tc AS (SELECT tile, cx, cy, avg(z) AS m, max(z) - min(z) AS rg FROM ta GROUP BY 1, 2, 3),
td AS (SELECT tile, cx, cy, coalesce(m, lv) AS m, coalesce(rg, 0) AS rg, kx, ky FROM (SELECT tile, kx, ky, unnest(range(kx)) AS cx FROM tb) JOIN (SELECT tile, unnest(range(ky)) AS cy FROM tb) USING (tile) LEFT JOIN tc USING (tile, cx, cy) JOIN (SELECT tile, avg(m) AS lv FROM tc GROUP BY 1) USING (tile)),
tl AS (SELECT a.tile, a.cx, a.cy, any_value(a.rg) AS rg, abs(sum(b.m - a.m)) AS cv FROM (SELECT td.*, i, j FROM td, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(i, j)) a JOIN td b ON b.tile = a.tile AND b.cx = least(greatest(a.cx + i, 0), a.kx - 1) AND b.cy = least(greatest(a.cy + j, 0), a.ky - 1) GROUP BY 1, 2, 3),
tw AS (SELECT *, pow(rg / (max(rg) OVER w + 1e-6::DOUBLE) + 1.5::DOUBLE * cv / (max(cv) OVER w + 1e-6::DOUBLE), 2) AS w FROM tl WINDOW w AS (PARTITION BY tile))"""
query("a47_terrain_weights", lambda t: r6(geometry.terrain_weights(t.pts, 10.0).select(*KEY, "weight"), "weight"), f"SELECT tile, point_id, {rnd('w / sum(w) OVER (PARTITION BY tile)')} AS weight FROM ta JOIN tw USING (tile, cx, cy)", _TW)
query("a51_robust_log", lambda t: r6(geometry.robust_log(t.pts).select(*KEY, "intensity"), "intensity"), f"SELECT tile, point_id, {rnd('least(greatest((l - m) / CASE WHEN q3 - q1 < 1e-6 THEN 1 ELSE q3 - q1 END, -3), 3)')} AS intensity FROM (SELECT *, ln(1 + intensity) AS l FROM pts) JOIN (SELECT tile, quantile_cont(ln(1 + intensity), 0.25) AS q1, quantile_cont(ln(1 + intensity), 0.5) AS m, quantile_cont(ln(1 + intensity), 0.75) AS q3 FROM pts GROUP BY 1) USING (tile)")
for _mode, _sql in {"min": "x - min(x) OVER w AS x, y - min(y) OVER w AS y, z - min(z) OVER w AS z", "box": "x - (min(x) OVER w + max(x) OVER w) / 2 AS x, y - (min(y) OVER w + max(y) OVER w) / 2 AS y, z - min(z) OVER w AS z", "centroid": f"{rnd('x - avg(x) OVER w')} AS x, {rnd('y - avg(y) OVER w')} AS y, {rnd('z - avg(z) OVER w')} AS z", "zpercentile": f"x - (min(x) OVER w + max(x) OVER w) / 2 AS x, y - (min(y) OVER w + max(y) OVER w) / 2 AS y, {rnd('z - quantile_cont(z, 0.01) OVER w')} AS z", "unit": f"{rnd('cx / f')} AS x, {rnd('cy / f')} AS y, {rnd('cz / f')} AS z"}.items():
    query(f"a52_recenter_{_mode}", lambda t, m=_mode: (r6(geometry.recenter(t.pts, m), "x", "y", "z") if m in ("centroid", "unit") else r6(geometry.recenter(t.pts, m), "z") if m == "zpercentile" else geometry.recenter(t.pts, m)).select(*KEY, "x", "y", "z"), f"SELECT tile, point_id, {_sql} FROM {'cn' if _mode == 'unit' else 'pts'} WINDOW w AS (PARTITION BY tile)", "cm AS (SELECT tile, point_id, x - avg(x) OVER w AS cx, y - avg(y) OVER w AS cy, z - avg(z) OVER w AS cz FROM pts WINDOW w AS (PARTITION BY tile)), cn AS (SELECT *, max(sqrt(cx * cx + cy * cy + cz * cz)) OVER (PARTITION BY tile) AS f FROM cm)")
query("a52_recenter_core", lambda t: geometry.recenter(t.pts.withColumns({"ax": F.lit(16.0), "ay": F.lit(20.0), "bx": F.lit(32.0), "by": F.lit(40.0)}), "box", core=("ax", "ay", "bx", "by")).select(*KEY, "ax", "ay", "bx", "by"), "SELECT tile, point_id, 16 - m AS ax, 20 - n AS ay, 32 - m AS bx, 40 - n AS by FROM pts JOIN (SELECT tile, (min(x) + max(x)) / 2 AS m, (min(y) + max(y)) / 2 AS n FROM pts GROUP BY 1) USING (tile)")
query("a60_fit_affine", lambda t: r6(geometry.fit_affine(t.pts.select("tile", "x", "y", (F.col("x") * 2 - F.col("y") + F.col("classification")).alias("col"), (F.col("y") * 0.5 + 3).alias("row"))), "col_a", "col_b", "row_b", digits=4).select("tile", "col_a", "col_b", "row_b"), f"SELECT tile, {rnd('(sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy)', 4)} AS col_a, {rnd('(syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy)', 4)} AS col_b, 0.5::DOUBLE AS row_b FROM (SELECT tile, regr_sxx(x, x) AS sxx, regr_sxx(y, y) AS syy, regr_sxy(x, y) AS sxy, regr_sxy(x, x * 2 - y + classification) AS sxz, regr_sxy(y, x * 2 - y + classification) AS syz FROM pts GROUP BY 1)")

# --- visibility ------------------------------------------------------------------------------------------------------
VIS = dict(tolerance=2.0, reference_resolution=4.0, oversample=1, echo_decay=0.5, bonus=0.25, slope_degrees=30.0)


def _vis(first: str, damped: str) -> str:
    """The visibility of every point, ``vv(tile, point_id, q)``; ``first``: what counts as density, ``damped``: q by returns, from ``g``."""
    slope, quarter = repr(math.tan(math.radians(30.0))), repr(math.log(0.25))
    return f"""vb AS (SELECT tile, min(x) AS x0, min(y) AS y0, max(x) - min(x) AS w, max(y) - min(y) AS h, greatest(8, least(128, floor(sqrt(count(*) / 256.0::DOUBLE)))) AS nb, bool_or({first}) AS has FROM pts GROUP BY 1),
      vp AS (SELECT p.*, x0, y0, (w / nb) * (h / nb) AS area, {first} OR NOT has AS counts, least(floor((x - x0) / (w / nb)), nb - 1) AS bc, least(floor((y - y0) / (h / nb)), nb - 1) AS br FROM pts p JOIN vb USING (tile)),
      vn AS (SELECT tile, bc, br, count(*) FILTER (counts) AS c FROM vp GROUP BY 1, 2, 3),
      vm AS (SELECT tile, quantile_cont(c, 0.5) AS m FROM vn WHERE c > 0 GROUP BY 1),
      vs AS (SELECT vp.*, sqrt(area / CASE WHEN c > 0 THEN c ELSE m END) AS spacing FROM vp JOIN vn USING (tile, bc, br) JOIN vm USING (tile)),
      vu AS (SELECT tile, quantile_cont(spacing, 0.5) AS usual FROM vs WHERE counts GROUP BY 1),
      vc AS (SELECT vs.*, greatest(4.0::DOUBLE, usual) AS cell, CAST(least(round_even(greatest(4.0::DOUBLE, usual) * spacing / usual / greatest(4.0::DOUBLE, usual), 0), 2) AS INT) AS rc FROM vs JOIN vu USING (tile)),
      vg AS (SELECT vc.*, k, floor((x - x0) / cell + i) AS cx, floor((y - y0) / cell + j) AS cy FROM vc, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.5::DOUBLE, 0.0::DOUBLE), (2, 0.0::DOUBLE, 0.5::DOUBLE), (3, 0.5::DOUBLE, 0.5::DOUBLE)) o(k, i, j)),
      vt AS (SELECT tile, k, cx, cy, rc, max(z) AS top, any_value(cell) AS cell FROM vg GROUP BY 1, 2, 3, 4, 5),
      vd AS (SELECT tile, k, cx + i AS cx, cy + j AS cy, max(top - cell * sqrt(i * i + j * j) * {slope}::DOUBLE) AS surface FROM vt, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE i * i + j * j <= rc * rc GROUP BY 1, 2, 3, 4),
      vq AS (SELECT tile, point_id, return_number, avg(exp({quarter}::DOUBLE * (greatest(surface - z, 0) / 2) * (greatest(surface - z, 0) / 2))) AS g FROM vg JOIN vd USING (tile, k, cx, cy) GROUP BY 1, 2, 3),
      vr AS (SELECT tile, point_id, return_number, {damped} AS q0 FROM vq), vv AS (SELECT tile, point_id, least(greatest(q0, 0), 1) AS q FROM vr)"""


_DAMP = "g * exp(-0.5 * greatest(return_number - 1, 0))"
_VIS = _vis("return_number = 1", f"CASE WHEN return_number = 1 THEN {_DAMP} + 0.25 * (1 - {_DAMP}) ELSE {_DAMP} END")
_QGEO = _vis("true", "g")
query("a48_surface_visibility", lambda t: r6(visibility.surface_visibility(t.pts, **VIS), "q").select(*KEY, "q", "visible"), f"SELECT tile, point_id, {rnd('q')} AS q, q >= 0.25 AS visible FROM vv", _VIS)
query("a49_q_regions", lambda t: visibility.q_regions(t.pts, **VIS).groupBy("tile", "region").agg(F.count("*").alias("n")), "SELECT tile, CASE WHEN q <= 0.2 THEN 0 WHEN q >= 0.6 THEN 2 ELSE 1 END AS region, count(*) AS n FROM vv GROUP BY 1, 2", _QGEO)
query("a49_classify_visibility", lambda t: r6(visibility.classify_visibility(t.pts, **VIS), "observability").select(*KEY, "classification", "observability"), f"SELECT tile, point_id, CASE WHEN q >= 0.25 THEN 1 ELSE 0 END AS classification, {rnd('q')} AS observability FROM vv", _VIS)


def _corr(t: Tables) -> DataFrame:
    return t.pts.select(*KEY, F.floor("y").cast("int").alias("row"), F.floor("x").cast("int").alias("col"), F.lit(True).alias("valid"), (F.floor(F.col("y") / 16) * 6 + F.floor(F.col("x") / 16)).cast("int").alias("patch_index"), F.lit(0.5).alias("observability"))


query("a50_refresh_correspondence", lambda t: r6(visibility.refresh_correspondence(visibility.point_coverage(visibility.surface_visibility(t.pts, **VIS), _rasters(t), 16.0, KEY), _corr(t), 16, 6, 6), "observability").select(*KEY, "valid", F.col("patch_index").cast("long").alias("patch_index"), "observability"), f"SELECT tile, point_id, ok AS valid, CAST(CASE WHEN ok THEN floor(y / 16) * 6 + floor(x / 16) ELSE -1 END AS BIGINT) AS patch_index, {rnd('0.5 * q')} AS observability FROM (SELECT p.tile, p.point_id, p.x, p.y, q, EXISTS (SELECT 1 FROM ra WHERE p.x >= l AND p.x < l + 12 AND p.y > bo AND p.y <= bo + 9) AND q >= 0.25 AND p.x < 96 AND p.y < 96 AS ok FROM pts p JOIN vv USING (tile, point_id))", _RAS + ", " + _VIS)
query("p21_rescale_correspondence", lambda t: visibility.rescale_correspondence(_corr(t).select("tile", "row", "col"), (10, 20, 64, 48), (32, 24)).select("tile", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")), "SELECT DISTINCT tile, CAST(floor((floor(y) - 10) * 0.5) AS BIGINT) AS row, CAST(floor((floor(x) - 20) * 0.5) AS BIGINT) AS col FROM pts WHERE floor(y) BETWEEN 10 AND 73 AND floor(x) BETWEEN 20 AND 67")
_KK, _TT = [100.0, 0, 64, 0, 100.0, 48, 0, 0, 1], [1.0, 0, 0, -50, 0, 1.0, 0, -50, 0, 0, 1.0, -20, 0, 0, 0, 1]
query("p22_project_camera", lambda t: r6(visibility.project_camera(t.pts, _KK, _TT, 96, 128), "u", "v").select(*KEY, F.coalesce("u", F.lit(-1.0)).alias("u"), F.coalesce("v", F.lit(-1.0)).alias("v"), "in_image"), f"SELECT tile, point_id, coalesce({rnd('u')}, -1) AS u, coalesce({rnd('v')}, -1) AS v, coalesce(u >= 0 AND u < 128 AND v >= 0 AND v < 96, false) AS in_image FROM (SELECT tile, point_id, CASE WHEN z > 20 THEN (100 * (x - 50) + 64 * (z - 20)) / (z - 20) END AS u, CASE WHEN z > 20 THEN (100 * (y - 50) + 48 * (z - 20)) / (z - 20) END AS v FROM pts)")
query("a37_projection_conflict", lambda t: visibility.projection_conflict(t.pts.withColumn("region", (F.col("orig_idx") % 3).cast("int")).drop("patch_index"), _corr(t), "source_block", "region", purity=0.2), "SELECT source_block, classification AS class, CAST(orig_idx % 3 AS INT) AS region, count(*) AS n, count(*) FILTER (classification <> modal) AS n_conflict FROM pp JOIN pm USING (tile, patch) GROUP BY 1, 2, 3", "pp AS (SELECT *, floor(y / 16) * 6 + floor(x / 16) AS patch FROM pts), pc AS (SELECT tile, patch, classification, count(*) AS n FROM pp GROUP BY 1, 2, 3), pm AS (SELECT tile, patch, arg_min(classification, (-n, classification)) AS modal FROM pc GROUP BY 1, 2 HAVING sum(n) >= 5 AND max(n) / sum(n) >= 0.2)")
TOK = lambda t: _corr(t).join(t.pts.select(*KEY, F.col("classification").alias("token")), KEY).withColumn("valid", F.col("col") < 80)
PF = lambda t: TOK(t).select("tile", "patch_index").distinct().withColumn("feature", F.array(F.col("patch_index").cast("double"), (F.col("patch_index") * F.col("patch_index")).cast("double")))
_TK = "tk AS (SELECT tile, classification AS token, CAST(floor(y / 16) * 6 + floor(x / 16) AS INT) AS patch_index, floor(x) < 80 AS valid FROM pts)"
query("a38_token_patch_edges", lambda t: visibility.token_patch_edges(TOK(t)), "SELECT tile, token, patch_index, count(*) AS support FROM tk WHERE valid GROUP BY 1, 2, 3", _TK)
query("a38_aggregate_edges", lambda t: r6(visibility.aggregate_edges(visibility.token_patch_edges(TOK(t)), PF(t), "token", "sqrt").select("tile", "token", F.col("feature")[0].alias("f0"), F.col("feature")[1].alias("f1")), "f0", "f1"), f"SELECT tile, token, {rnd('sum(sqrt(s) * patch_index) / sum(sqrt(s))')} AS f0, {rnd('sum(sqrt(s) * patch_index * patch_index) / sum(sqrt(s))')} AS f1 FROM (SELECT tile, token, patch_index, count(*) AS s FROM tk WHERE valid GROUP BY 1, 2, 3) GROUP BY 1, 2", _TK)
query("a38_token_visibility", lambda t: r6(visibility.token_visibility(TOK(t)), "visibility"), f"SELECT tile, token, {rnd('count(*) FILTER (valid) / count(*)')} AS visibility, count(*) AS n FROM tk GROUP BY 1, 2", _TK)
query("a38_token_teacher", lambda t: r6(visibility.token_teacher(visibility.token_patch_edges(TOK(t)), PF(t)).select("tile", "token", F.col("feature")[0].alias("f0"), "purity", "points", "patches"), "f0", "purity"), f"SELECT tile, token, {rnd('a / greatest(sqrt(a * a + b * b), 1e-12)')} AS f0, {rnd('sqrt(a * a + b * b)')} AS purity, points, patches FROM (SELECT tile, token, sum(sqrt(s) * q / greatest(sqrt(q * q + q * q * q * q), 1e-12)) / sum(sqrt(s)) AS a, sum(sqrt(s) * q * q / greatest(sqrt(q * q + q * q * q * q), 1e-12)) / sum(sqrt(s)) AS b, CAST(sum(s) AS BIGINT) AS points, count(*) AS patches FROM (SELECT tile, token, CAST(patch_index AS DOUBLE) AS q, count(*) AS s FROM tk WHERE valid GROUP BY 1, 2, 3) GROUP BY 1, 2)", _TK)
query("a38_sample_balanced_mean", lambda t: r6(visibility.sample_balanced_mean(t.pts, "z"), "mean"), f"SELECT count(*) AS samples, {rnd('avg(m)')} AS mean FROM (SELECT tile, avg(z) AS m FROM pts GROUP BY 1)")
query("j02_attach_features", lambda t: t.pts.select(*KEY, (F.col("point_id") % 500).alias("vec_id")).join(t("embeddings").select("vec_id", "label"), "vec_id").select(*KEY, "label"), "SELECT tile, point_id, label FROM pts JOIN embeddings ON point_id % 500 = vec_id")
query("j03_compact_patches", lambda t: visibility.compact_patches(TOK(t), PF(t), ("tile", "patch_index"))[0].select("tile", "patch_index", F.col("feature")[0].alias("old")).withColumn("patch_index", F.col("patch_index").cast("long")), "SELECT tile, row_number() OVER (PARTITION BY tile ORDER BY patch_index) - 1 AS patch_index, CAST(patch_index AS DOUBLE) AS old FROM (SELECT DISTINCT tile, patch_index FROM tk WHERE valid)", _TK)
query("j04_backproject", lambda t: grid.cell(t.pts, 16.0).join(grid.voxel_reduce(t.pts, 16.0, vote=["pred"]).select("tile", *grid.CELL, F.col("pred").alias("voxel_pred")), ["tile", *grid.CELL]).select(*KEY, "voxel_pred"), "SELECT tile, point_id, voxel_pred FROM vx JOIN (SELECT tile, cx, cy, cz, pred AS voxel_pred FROM (SELECT tile, cx, cy, cz, pred, row_number() OVER (PARTITION BY tile, cx, cy, cz ORDER BY count(*) DESC, pred) AS k FROM vx GROUP BY 1, 2, 3, 4, 5) WHERE k = 1) USING (tile, cx, cy, cz)", "vx AS (SELECT tile, point_id, pred, floor(x / 16) AS cx, floor(y / 16) AS cy, floor(z / 16) AS cz FROM pts)")
query("j24_images_for_view", lambda t: visibility.images_for_view(TOK(t).withColumn("image", F.col("patch_index") % 4), t.pts.where("classification = 3 AND x < 20"), image="image"), "SELECT DISTINCT tile, CAST(floor(y / 16) * 6 + floor(x / 16) AS INT) % 4 AS image FROM pts WHERE classification = 3 AND x < 20")


def _overlaps(t: Tables) -> DataFrame:
    views = t.pts.select((F.col("tile") % 10).alias("scene"), F.col("tile").alias("view"), (F.col("point_id") % 400).alias("cell")).distinct()
    return visibility.overlap_pairs(views, 0.3)


query("j23_overlap_pairs", _overlaps, "SELECT a.scene, a.v AS first, b.v AS second, count(*) AS both FROM (SELECT *, count(*) OVER (PARTITION BY scene, v) AS n FROM vi) a JOIN (SELECT *, count(*) OVER (PARTITION BY scene, v) AS n FROM vi) b ON a.scene = b.scene AND a.c = b.c AND a.v < b.v GROUP BY 1, 2, 3 HAVING count(*) >= 0.3 * least(max(a.n), max(b.n))", "vi AS (SELECT DISTINCT tile % 10 AS scene, tile AS v, point_id % 400 AS c FROM pts)")
query("j25_vertex_normals", lambda t: r6(geometry.vertex_normals(t.pts.select(F.col("tile").alias("mesh"), F.col("point_id").alias("vertex_id"), "x", "y", "z"), _faces(t)), "nx", "ny", "nz", digits=5).select("mesh", "vertex_id", "nx", "ny", "nz"), "SELECT p.tile AS mesh, point_id AS vertex_id, " + ", ".join(f"{rnd(f'CASE WHEN l > 0 THEN n{c} / l ELSE 0 END', 5)} AS n{c}" for c in "xyz") + " FROM pts p LEFT JOIN fn ON p.tile = fn.tile AND p.point_id = fn.v", f"""fc AS (SELECT tile, src AS a, max(dst) FILTER (rank = 1) AS b, max(dst) FILTER (rank = 2) AS c FROM {_knn(2, 'a.point_id <> b.point_id')} GROUP BY 1, 2),
fe AS (SELECT f.*, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz FROM fc f JOIN pts a ON a.tile = f.tile AND a.point_id = f.a JOIN pts b ON b.tile = f.tile AND b.point_id = f.b JOIN pts c ON c.tile = f.tile AND c.point_id = f.c),
fs AS (SELECT tile, v, sum(uy * vz - uz * vy) AS nx, sum(uz * vx - ux * vz) AS ny, sum(ux * vy - uy * vx) AS nz FROM (SELECT *, unnest([a, b, c]) AS v FROM fe) GROUP BY 1, 2),
fn AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM fs)""")


def _faces(t: Tables) -> DataFrame:
    near = neighbors.neighbor_lists(t.pts, t.pts, 2, exclude_self=True)
    corner = {"b": F.element_at("near", 1), "c": F.element_at("near", -1)}
    return near.select(F.col("tile").alias("mesh"), F.col("src").alias("a"), *(e["dst"].alias(p) for p, e in corner.items()), *(e[f"d{c}"].alias(f"{p}{c}") for p, e in corner.items() for c in "xyz"))


# --- frames ------------------------------------------------------------------------------------------------------------
FR = lambda t: t("orders").select((F.col("o_custkey") % 50).alias("seq"), F.col("o_orderkey").alias("frame_no"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"))
_FR = "fr AS (SELECT o_custkey % 50 AS seq, o_orderkey AS frame_no, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders)"
query("j17_fuse_frames", lambda t: frames.fuse_frames(FR(t), [-40, -7, 0, 13]), "SELECT a.seq, a.frame_no AS target, b.frame_no, o AS \"offset\" FROM fr a, (VALUES (-40), (-7), (0), (13)) x(o) JOIN fr b ON a.seq = b.seq AND b.frame_no = a.frame_no + o", _FR)
query("w13_sequence_bounds", lambda t: frames.sequence_bounds(FR(t)).select("seq", "frame_no", F.col("index").cast("long").alias("index"), "first", "last"), "SELECT seq, frame_no, row_number() OVER (PARTITION BY seq ORDER BY frame_no) - 1 AS index, min(frame_no) OVER (PARTITION BY seq) AS first, max(frame_no) OVER (PARTITION BY seq) AS last FROM fr", _FR)
query("w14_sweep_history", lambda t: frames.sweep_history(FR(t), 3).select("seq", "frame_no", *(F.col("sweeps")[k]["frame_no"].alias(f"s{k + 1}") for k in range(3)), F.col("sweeps")[2]["lag"].alias("lag3")), "SELECT seq, frame_no, coalesce(lag(frame_no, 1) OVER w, frame_no) AS s1, coalesce(lag(frame_no, 2) OVER w, lag(frame_no, 1) OVER w, frame_no) AS s2, coalesce(lag(frame_no, 3) OVER w, lag(frame_no, 2) OVER w, lag(frame_no, 1) OVER w, frame_no) AS s3, ts - coalesce(lag(ts, 3) OVER w, lag(ts, 2) OVER w, lag(ts, 1) OVER w, ts) AS lag3 FROM fr WINDOW w AS (PARTITION BY seq ORDER BY frame_no)", _FR)


def _posed(t: Tables) -> DataFrame:
    k = (F.col("frame_no") % 7).cast("double")
    rows = [F.lit(1.0), F.lit(0.0), F.lit(0.0), k, F.lit(0.0), F.lit(1.0), F.lit(0.0), k * 2, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return FR(t).withColumn("pose", F.array(*rows))


query("p23_align_pose", lambda t: r6(frames.align_poses(frames.fuse_frames(_posed(t), [-7, 3]), _posed(t)).select("seq", "target", "frame_no", F.col("matrix")[3].alias("tx"), F.col("matrix")[7].alias("ty")), "tx", "ty"), f"SELECT a.seq, a.frame_no AS target, b.frame_no, {rnd('CAST(b.frame_no % 7 - a.frame_no % 7 AS DOUBLE)')} AS tx, {rnd('CAST(2 * (b.frame_no % 7 - a.frame_no % 7) AS DOUBLE)')} AS ty FROM fr a, (VALUES (-7), (3)) x(o) JOIN fr b ON a.seq = b.seq AND b.frame_no = a.frame_no + o", _FR)

# --- sampling ------------------------------------------------------------------------------------------------------------
query("w06_nested_rank", lambda t: sampling.nested_rank(t.pts, 42).select(*KEY, "rank"), f"SELECT tile, point_id, {U(42, 'tile', 'point_id')} AS rank FROM pts")
query("a55_budget_counts", lambda t: sampling.budget_counts(sampling.nested_rank(t.pts, 42), [0.01, 0.1, 0.5]), f"SELECT classification, count(*) AS n, count(*) FILTER (u < 0.01) AS n_0, count(*) FILTER (u < 0.1) AS n_1, count(*) FILTER (u < 0.5) AS n_2 FROM (SELECT classification, {U(42, 'tile', 'point_id')} AS u FROM pts) GROUP BY 1")
query("w07_block_split", lambda t: sampling.block_split(t.pts, "tile", 0.25).groupBy("tile", "held_out").agg(F.count("*").alias("n")), "SELECT tile, i IN (SELECT CAST(round_even(j * (m - 1) / (k - 1), 0) AS BIGINT) FROM nb, range(0, 100000) r(j) WHERE j < k) AS held_out, n FROM (SELECT tile, count(*) AS n, row_number() OVER (ORDER BY tile) - 1 AS i FROM pts GROUP BY 1)", "nb AS (SELECT count(DISTINCT tile) AS m, CAST(round_even(count(DISTINCT tile) * 0.25, 0) AS BIGINT) AS k FROM pts)")
query(
    "w08_stratified_share",
    lambda t: sampling.stratified_share(t.pts, ["classification", "return_number"], 40, 5).select(*KEY, "classification"),
    "SELECT tile, point_id, classification FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY r > take, CASE WHEN r > take THEN 0 ELSE s END, u, point_id) AS p FROM pd JOIN pk USING (tile, classification, return_number)) WHERE total <= 40 OR p <= 40",
    f"""pd AS (SELECT tile, point_id, classification, return_number, u, row_number() OVER (PARTITION BY tile, classification, return_number ORDER BY u, point_id) AS r FROM (SELECT *, {U(5, 'tile', 'point_id')} AS u FROM pts)),
    pc AS (SELECT tile, classification, return_number, c, sum(c) OVER (PARTITION BY tile) AS total, row_number() OVER (PARTITION BY tile ORDER BY classification, return_number) AS s FROM (SELECT tile, classification, return_number, count(*) AS c FROM pts GROUP BY 1, 2, 3)),
    pa AS (SELECT *, CAST(greatest(1, 40 * c // total) AS BIGINT) AS share FROM pc),
    pu AS (SELECT tile, s FROM (SELECT tile, s, unnest(range(2, share + 1)) AS h FROM pa) JOIN (SELECT tile, sum(share) - 40 AS over FROM pa GROUP BY 1) USING (tile) QUALIFY row_number() OVER (PARTITION BY tile ORDER BY h DESC, s) <= over),
    pk AS (SELECT tile, classification, return_number, total, s, share - coalesce(gone, 0) AS take FROM pa LEFT JOIN (SELECT tile, s, count(*) AS gone FROM pu GROUP BY 1, 2) USING (tile, s))""",
)
query(
    "w08_stratified",
    lambda t: sampling.stratified(t.pts, ["classification", "return_number"], 40).select(*KEY, "classification"),
    "SELECT tile, point_id, classification FROM s3 WHERE last <= 40",
    """s0 AS (SELECT tile, point_id, classification, return_number, count(*) OVER (PARTITION BY tile) AS total, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY tile, classification, return_number) AS n FROM pts WINDOW w AS (PARTITION BY tile, classification, return_number ORDER BY point_id)),
    k0 AS (SELECT tile, greatest(1, 40 // count(DISTINCT (classification, return_number))) AS base FROM pts GROUP BY 1),
    b0 AS (SELECT DISTINCT tile, classification, return_number, n, least(n, base) AS take FROM s0 JOIN k0 USING (tile)),
    b1 AS (SELECT tile, classification, return_number, CAST(round_even(CASE WHEN take > 1 THEN j * ((n - 1) / (take - 1)) ELSE 0 END, 0) AS BIGINT) AS i FROM (SELECT *, unnest(range(take)) AS j FROM b0)),
    s1 AS (SELECT s0.*, s0.total <= 40 OR b1.i IS NOT NULL AS chosen FROM s0 LEFT JOIN (SELECT DISTINCT * FROM b1) b1 USING (tile, classification, return_number, i)),
    r0 AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY point_id) - 1 AS ri FROM s1 WHERE NOT chosen),
    r1 AS (SELECT tile, count(*) FILTER (NOT chosen) AS rn, least(greatest(40 - count(*) FILTER (chosen), 0), count(*) FILTER (NOT chosen)) AS take FROM s1 GROUP BY 1),
    r2 AS (SELECT DISTINCT tile, CAST(round_even(CASE WHEN take > 1 THEN j * ((rn - 1) / (take - 1)) ELSE 0 END, 0) AS BIGINT) AS ri FROM (SELECT *, unnest(range(take)) AS j FROM r1)),
    s2 AS (SELECT tile, point_id, classification, total FROM s1 WHERE chosen UNION ALL SELECT tile, point_id, classification, total FROM r0 JOIN r2 USING (tile, ri)),
    s3 AS (SELECT *, CASE WHEN total <= 40 THEN 0 ELSE row_number() OVER (PARTITION BY tile ORDER BY point_id) END AS last FROM s2)""",
)
CL = lambda t: t.pts.groupBy(F.col("tile").alias("cloud")).agg(F.count("*").alias("n"))
query("w09_batch_offsets", lambda t: sampling.batch_offsets(CL(t), 4).select("cloud", "n", "batch_id", F.col("in_batch").cast("long").alias("in_batch"), "offset", "start"), "SELECT cloud, n, i // 4 AS batch_id, i % 4 AS in_batch, CAST(sum(n) OVER w AS BIGINT) AS \"offset\", CAST(sum(n) OVER w - n AS BIGINT) AS start FROM (SELECT tile AS cloud, count(*) AS n, row_number() OVER (ORDER BY tile) - 1 AS i FROM pts GROUP BY 1) WINDOW w AS (PARTITION BY i // 4 ORDER BY i)")
query("w10_mix_pairs", lambda t: sampling.mix_pairs(t.pts.select(F.col("tile").alias("cloud"), "point_id", (F.col("orig_idx") % 9 - 1).alias("instance")), t.pts.select(F.col("tile").alias("cloud"))).select("cloud", "point_id", "mixed", "instance"), "SELECT cloud, point_id, i // 2 AS mixed, CASE WHEN ins >= 0 AND i % 2 = 1 THEN ins + greatest((SELECT max(y.ins) + 1 FROM mp y WHERE y.i = x.i - 1), 0) ELSE ins END AS instance FROM mp x", "mp AS (SELECT tile AS cloud, point_id, orig_idx % 9 - 1 AS ins, dense_rank() OVER (ORDER BY tile) - 1 AS i FROM pts)")
query("t02_sphere_crop", lambda t: sampling.sphere_crop(t.pts, 50).select(*KEY), f"SELECT tile, point_id FROM (SELECT a.tile, a.point_id, row_number() OVER (PARTITION BY a.tile ORDER BY {D2}, a.point_id) AS k FROM pts a JOIN (SELECT tile, x, y, z FROM pts QUALIFY row_number() OVER (PARTITION BY tile ORDER BY point_id) = count(*) OVER (PARTITION BY tile) // 2 + 1) b USING (tile)) WHERE k <= 50")
query("t03_contrastive_pair", lambda t: r6(sampling.contrastive_pair(t.pts.select(*KEY, "x", "y", "z"), lambda d, seed: augment.shift(d, seed), 1), "x", "y").select(*KEY, "view", "x", "y"), " UNION ALL ".join(f"SELECT tile, point_id, {v} AS view, " + ", ".join(f"{rnd(c + ' + (-0.2::DOUBLE + ' + U(f'{s}/shift{c}', 'tile') + ' * 0.4::DOUBLE)')} AS {c}" for c in "xy") + " FROM pts" for v, s in ((1, 2), (2, 3))))
query("t03_multi_view", lambda t: sampling.multi_view(t.pts.select(*KEY, "x", "y", "z"), 3, locals_=2).groupBy("tile", "view").agg(F.count("*").alias("n")))
query("t06_shuffle", lambda t: sampling.shuffled(t.pts, 4).select(*KEY), "SELECT tile, point_id FROM pts")
query("t07_downsample", lambda t: sampling.downsample(t.pts, 10, 5).select(*KEY), f"SELECT tile, point_id FROM (SELECT tile, point_id, row_number() OVER (PARTITION BY tile ORDER BY {U(5, 'tile', 'point_id')}, point_id) AS k, count(*) OVER (PARTITION BY tile) AS n FROM pts) WHERE k <= greatest(1, n // 10)")
query("t08_keep_labels", lambda t: sampling.keep_labels(t.pts, 0.25, 0, 6).select(*KEY, "classification"), f"SELECT tile, point_id, CASE WHEN k <= floor(n * 0.25) THEN classification ELSE 0 END AS classification FROM (SELECT *, row_number() OVER (PARTITION BY tile, classification ORDER BY {U(6, 'tile', 'point_id')}, point_id) AS k, count(*) OVER (PARTITION BY tile, classification) AS n FROM pts)")
query("t09_dropout", lambda t: sampling.dropout(t.pts, 0.5, 8, F.col("classification") == 1).select(*KEY), f"SELECT tile, point_id FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY {U(8, 'tile', 'point_id')}, point_id) AS k, count(*) OVER (PARTITION BY tile) AS n FROM pts) WHERE k > floor(n * 0.5) OR classification = 1")
TW = lambda t: t.pts.groupBy("tile").agg((F.count("*") % 7).cast("double").alias("weight"))
query(
    "t10_epoch_plan",
    lambda t: sampling.epoch_plan(TW(t).select("tile"), TW(t), 3, 4, 1),
    "SELECT slot, tile, slot % 4 AS rank FROM ep UNION ALL SELECT slot + n AS slot, tile, (slot + n) % 4 AS rank FROM ep WHERE slot < (4 - n % 4) % 4",
    f"""tw AS (SELECT tile, CAST(count(*) % 7 AS DOUBLE) AS w FROM pts GROUP BY 1), ts AS (SELECT tile, (sum(w) OVER o - w) / sum(w) OVER () AS lo, sum(w) OVER o / sum(w) OVER () AS hi FROM tw WINDOW o AS (ORDER BY tile)),
    dr AS (SELECT s, {U(1, 's')} AS u FROM (SELECT unnest(range(2 * count(*))) AS s FROM tw)),
    ek AS (SELECT tile, 'd' || s AS k FROM dr JOIN ts ON u >= lo AND u < hi UNION ALL SELECT tile, 'e' || tile FROM tw),
    ep AS (SELECT row_number() OVER (ORDER BY {U('1/order', 'k')}, k) - 1 AS slot, tile, count(*) OVER () AS n FROM ek)""",
)
_QUOTAS = """c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY tile) AS i, count(*) OVER () AS k FROM (SELECT tile, CAST(floor(count(*) * CAST(0.5 AS DOUBLE)) AS BIGINT) AS cap FROM pts GROUP BY 1)),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(2000 AS BIGINT) AS rest, CAST(0 AS BIGINT) AS quota UNION ALL SELECT c.i, w.rest - least(c.cap, w.rest // (c.k - w.i)), least(c.cap, w.rest // (c.k - w.i)) FROM w JOIN c ON c.i = w.i + 1)"""
query("t11_budget_sample", lambda t: sampling.budget_sample(t.pts, 2000, 0.5, 2).select(*KEY), f"SELECT tile, point_id FROM (SELECT tile, point_id, quota, row_number() OVER (PARTITION BY tile ORDER BY {U(2, 'tile', 'point_id')}, tile, point_id) AS r FROM pts JOIN c USING (tile) JOIN w USING (i)) WHERE r <= quota", _QUOTAS)
_DL = f"""dl AS (SELECT *, CASE WHEN classification IN (1, 2, 3) AND (orig_idx % 8) / 8::DOUBLE < 0.75 AND {U('3/steep', 'tile', 'point_id')} < 0.4::DOUBLE OR classification IN (4, 7) AND {U('3/rare', 'tile', 'point_id')} < 0.4::DOUBLE THEN 5 ELSE classification END AS l FROM pts),
de AS (SELECT a.tile, a.point_id FROM dl a JOIN dl b USING (tile) WHERE a.l <> 5 AND b.l <> 5 AND {D2} <= 64 GROUP BY 1, 2 HAVING min(b.l) <> max(b.l))"""
query("t12_degrade_labels", lambda t: sampling.degrade_labels(t.pts.withColumn("nz", (F.col("orig_idx") % 8) / 8), 3, (1, 2, 3), (4, 7), radius=8.0).select(*KEY, "classification"), f"SELECT tile, point_id, CASE WHEN de.point_id IS NOT NULL AND {U('3/edge', 'tile', 'point_id')} < 0.15::DOUBLE THEN 5 ELSE l END AS classification FROM dl LEFT JOIN de USING (tile, point_id)", _DL)
query("t13_terrain_split", lambda t: r6(sampling.terrain_split(t.pts, 4, resolution=10.0, ground=2, low=10.0), "gt_low").select(*KEY, "role", "gt_low"))

# --- features ---------------------------------------------------------------------------------------------------------------
EM = lambda t: t("embeddings").select("vec_id", F.col("embedding").alias("feature"), F.col("label").cast("int").alias("label"))


def _pca(t: Tables) -> DataFrame:
    mean, comps, shares = features.fit_pca(EM(t), 4)
    return r6(features.reconstruction_cosine(EM(t), mean, comps).withColumn("explained", F.lit(float(shares.sum()))), "cosine", "explained", digits=4)


query("a31_pca", _pca)
query("a31_pca_rgb", lambda t: features.pca_rgb(EM(t)).select("vec_id", "pc_r", "pc_g", "pc_b"))
query("a32_kmeans", lambda t: features.fit_kmeans(EM(t), 5)[0].select("vec_id", "cluster"))


def _probe_sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    return EM(t).where("vec_id % 4 > 0"), EM(t).where("vec_id % 4 = 0")


query("a33_linear_probe", lambda t: features.linear_probe(*_probe_sets(t)).select("vec_id", "label", "prediction"))
_E = "em AS (SELECT vec_id, label, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS v FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))"
query("a33_knn_probe", lambda t: features.knn_probe(*_probe_sets(t), k=5).select("vec_id", "prediction"), "SELECT vec_id, CAST(arg_min(label, (-w, label)) AS INT) AS prediction FROM (SELECT vec_id, label, sum(1 / (greatest(d, 0) + 1e-6)) AS w FROM (SELECT a.vec_id, b.label, 1 - list_dot_product(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_dot_product(a.v, b.v), b.vec_id) AS k FROM em a JOIN em b ON a.vec_id % 4 = 0 AND b.vec_id % 4 > 0) WHERE k <= 5 GROUP BY 1, 2) GROUP BY 1", _E)
query("a61_permute_features", lambda t: features.permute_features(EM(t), "rows", 3, ["label"]).select("vec_id", F.col("feature")[0].cast("double").alias("f0")), "SELECT a.vec_id, b.f0 FROM pa a JOIN pb b USING (label, r)", f"pa AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {U('3/a', 'vec_id')}, vec_id) AS r FROM embeddings), pb AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS f0, row_number() OVER (PARTITION BY label ORDER BY {U('3/b', 'vec_id')}, vec_id) AS r FROM embeddings)")
query("a61_permute_dims", lambda t: features.permute_features(EM(t), "dims", 3).select(F.posexplode("feature").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n")), "SELECT CAST(i AS INT) AS i, (SELECT count(*) FROM embeddings) AS n FROM range(0, (SELECT max(len(embedding)) FROM embeddings)) r(i)")
#: A third method for the scans: right for every other point.
_P3_SQL = "CASE WHEN point_id % 2 = 0 THEN classification ELSE 1 END"
_BOX = "(SELECT tile, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY 1)"
_WIN = "CAST(s AS INT) AS slab, CAST(k AS INT) AS start FROM pp p JOIN bo USING (tile), range(0, 5) a(s), range(0, 3) b(k)"
_SECTIONS = f"""pp AS (SELECT *, {_P3_SQL} AS p3 FROM pts), bo AS {_BOX},
sc AS (SELECT p.*, 'x' AS axis, x AS u, y AS v, x0 AS u0, x1 AS u1, y0 AS v0, y1 AS v1, {_WIN} UNION ALL SELECT p.*, 'y', y, x, y0, y1, x0, x1, {_WIN}),
sd AS (SELECT *, least(60, u1 - u0) AS len, u0 + (u1 - least(60, u1 - u0) - u0) / 2 * start AS beg, v0 + (v1 - v0) * (0.08::DOUBLE + slab * (0.84::DOUBLE / 4)) AS mid FROM sc),
se AS (SELECT tile, axis, slab, start, classification, z, CAST(pred = classification AS INT) AS a, CAST(pred2 = classification AS INT) AS b, CAST(p3 = classification AS INT) AS c FROM sd WHERE abs(v - mid) <= 8 AND u >= beg AND u <= beg + len),
sn AS (SELECT tile, axis, slab, start, count(*) FILTER (n >= 0.05::DOUBLE * total) AS n_classes FROM (SELECT tile, axis, slab, start, classification, count(*) AS n, sum(count(*)) OVER (PARTITION BY tile, axis, slab, start) AS total FROM se GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4),
sg AS (SELECT tile, axis, slab, start, count(*) AS n, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS relief, avg(CAST(a AS DOUBLE)) AS acc, avg(CAST(a AS DOUBLE)) - (avg(CAST(b AS DOUBLE)) + avg(CAST(c AS DOUBLE))) / 2 AS gain, count(*) FILTER (a = 1 AND b + c = 0) AS support FROM se GROUP BY 1, 2, 3, 4)"""


def _sections(t: Tables) -> DataFrame:
    return features.section_scan(t.pts.withColumn("p3", F.expr(_P3_SQL)), ["pred2", "p3", "pred"], range(1, 9), slabs=5, thickness=16.0, starts=3, length=60.0, least=20)


query("a40_section_scan", lambda t: r6(_sections(t), "relief", "acc_pred", "gain", "score").select("tile", "axis", "slab", "start", "n", "relief", "n_classes", "acc_pred", "gain", "support", "score"), f"SELECT tile, axis, slab, start, n, {rnd('relief')} AS relief, CAST(n_classes AS INT) AS n_classes, {rnd('acc')} AS acc_pred, {rnd('gain')} AS gain, support, {rnd('(gain * sqrt(n) + 0.012 * sqrt(support)) * least(relief / 10, 1)')} AS score FROM sg JOIN sn USING (tile, axis, slab, start) WHERE n >= 20 AND n_classes >= 2 AND relief >= 3", _SECTIONS)
query("a64_section_bins", lambda t: features.section_bins(t.pts.withColumn("along", F.col("x")), 1, 2, by=["tile"], size=10.0).select("tile", "mixed", "overlap", "weight"), "SELECT tile, mixed, overlap, 1 + 0.1::DOUBLE * overlap AS weight FROM (SELECT tile, count(*) FILTER (ok) AS mixed, count(*) FILTER (ok AND m0 - m1 >= 2) AS overlap FROM (SELECT tile, bin, bin < 10 AND count(*) >= 8 AND count(*) FILTER (classification = 1) >= 3 AND count(*) FILTER (classification = 2) >= 3 AS ok, quantile_cont(z, 0.5) FILTER (classification = 1) AS m0, quantile_cont(z, 0.5) FILTER (classification = 2) AS m1 FROM (SELECT *, least(10, floor(x / 10)) AS bin FROM pts) GROUP BY 1, 2) GROUP BY 1)")
query("a62_crop_scan", lambda t: r6(features.crop_scan(t.pts.withColumn("p3", F.expr(_P3_SQL)), ["pred2", "p3", "pred"], range(1, 9), 50.0, least=100, coverage=0.6, span=48.0, share=0.02, least_classes=3), "miou_pred", "gain").select("tile", "i", "j", "n", "n_classes", "coverage", "miou_pred", "gain", "best"), f"SELECT tile, CAST(i AS INT) AS i, CAST(j AS INT) AS j, n, CAST(n_classes AS INT) AS n_classes, coverage, {rnd('a')} AS miou_pred, {rnd('a - greatest(b, c)')} AS gain, row_number() OVER (PARTITION BY tile ORDER BY a - greatest(b, c) DESC, i, j) = 1 AS best FROM cu JOIN ck USING (tile, i, j) WHERE n >= 100 AND n_classes >= 3 AND coverage >= 0.6 AND least(wx, wy) >= 48", f"""cr AS (SELECT p.*, {_P3_SQL} AS p3, i, j, x0 + greatest(0, x1 - 50 - x0) / 4 * i AS ax, y0 + greatest(0, y1 - 50 - y0) / 4 * j AS ay FROM pts p JOIN {_BOX} USING (tile), range(0, 5) a(i), range(0, 5) b(j)),
ci AS (SELECT * FROM cr WHERE x >= ax AND x <= ax + 50 AND y >= ay AND y <= ay + 50),
cu AS (SELECT tile, i, j, count(*) AS n, count(DISTINCT least(9, floor((x - ax) / 50 * 10)) * 10 + least(9, floor((y - ay) / 50 * 10))) / 100::DOUBLE AS coverage, max(x) - min(x) AS wx, max(y) - min(y) AS wy FROM ci GROUP BY ALL),
cc AS (SELECT tile, i, j, k, count(*) FILTER (classification = k) AS t, {", ".join(f"count(*) FILTER (classification = k AND {m} = k) / nullif(count(*) FILTER (classification = k OR {m} = k), 0)::DOUBLE AS {n}" for n, m in zip("abc", ("pred", "pred2", "p3")))} FROM ci, range(1, 9) r(k) GROUP BY ALL),
ck AS (SELECT tile, i, j, count(*) FILTER (t >= 0.02::DOUBLE * total) AS n_classes, {", ".join(f"sum({n} ORDER BY k) / count(*) AS {n}" for n in "abc")} FROM (SELECT *, sum(t) OVER (PARTITION BY tile, i, j) AS total FROM cc) WHERE t > 0 GROUP BY ALL)""")
query("a63_structure_score", lambda t: r6(features.structure_score(t.pts, range(1, 9), [([1], 0.1), ([2], 0.08), ([3, 8], 0.3)], ([4, 5], 0.3), 120.0, 300, 8), "boundary", "relief", "entropy", "score"), f"SELECT tile, n, occupied, edges, {rnd('boundary')} AS boundary, {rnd('relief')} AS relief, {rnd('entropy')} AS entropy, {rnd('3 * least(1, p1 / 0.1::DOUBLE, p2 / 0.08::DOUBLE, (p3 + p8) / 0.3::DOUBLE) + least(1, (p4 + p5) / 0.3::DOUBLE) + 2 * boundary + least(1, relief / 120) + entropy')} AS score FROM (SELECT *, coalesce(e, 0) AS edges, coalesce(e, 0) / occupied AS boundary FROM (SELECT *, " + "(" + " + ".join(f"CASE WHEN p{c} > 0 THEN -p{c} * ln(p{c}) ELSE 0 END" for c in range(1, 9)) + ") / ln(8) AS entropy FROM mx) JOIN (SELECT tile, count(*) AS occupied FROM mj GROUP BY 1) USING (tile) LEFT JOIN (SELECT a.tile, count(*) FILTER (a.m <> b.m) AS e FROM mj a JOIN mj b ON a.tile = b.tile AND (b.cx = a.cx + 1 AND b.cy = a.cy OR b.cx = a.cx AND b.cy = a.cy + 1) GROUP BY 1) USING (tile) JOIN (SELECT tile, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS relief FROM pts GROUP BY 1) USING (tile)) WHERE n >= 300", "cg AS (SELECT tile, classification, CAST(least(7, floor((x - x0) / (x1 - x0) * 8)) AS INT) AS cx, CAST(least(7, floor((y - y0) / (y1 - y0) * 8)) AS INT) AS cy FROM pts JOIN " + _BOX + " USING (tile)), mj AS (SELECT tile, cx, cy, arg_min(classification, (-n, classification)) AS m FROM (SELECT tile, cx, cy, classification, count(*) AS n FROM cg GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3), mx AS (SELECT tile, count(*) AS n, " + ", ".join(f"count(*) FILTER (classification = {c}) / count(*)::DOUBLE AS p{c}" for c in range(1, 9)) + " FROM pts GROUP BY 1)")

# --- augmentation ------------------------------------------------------------------------------------------------------------
query("p33_augment_geom", lambda t: r6(augment.augment_geom(t.pts, 1, [("shift", {}), ("rotate", {}), ("scale", {}), ("flip", {}), ("jitter", {})]), "x", "y", "z").select(*KEY, "x", "y", "z"))
query("p33_shift", lambda t: r6(augment.shift(t.pts, 1), "x", "y").select(*KEY, "x", "y"), f"SELECT tile, point_id, {rnd('x + (-0.2::DOUBLE + ' + U('1/shiftx', 'tile') + ' * 0.4::DOUBLE)')} AS x, {rnd('y + (-0.2::DOUBLE + ' + U('1/shifty', 'tile') + ' * 0.4::DOUBLE)')} AS y FROM pts")
query("p34_augment_color", lambda t: r6(augment.augment_color(t.pts, 1, [("auto_contrast", {"p": 1.0}), ("translation", {}), ("jitter", {}), ("greyscale", {}), ("hue_saturation", {}), ("brightness_contrast", {}), ("drop", {})]), "r", "g", "b", digits=4).select(*KEY, "r", "g", "b"))
query("p35_drop_attr", lambda t: augment.drop_attr(t.pts, ["intensity"], 0.3, 5).select(*KEY, "intensity"), f"SELECT tile, point_id, CASE WHEN k <= floor(n * 0.3::DOUBLE) THEN 0 ELSE intensity END AS intensity FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY {U('5/attr', 'tile', 'point_id')}, point_id) AS k, count(*) OVER (PARTITION BY tile) AS n FROM pts)")
query("p36_elastic", lambda t: r6(augment.elastic(t.pts, 20.0, 0.5, 3), "x", "y", "z", digits=4).select(*KEY, "x", "y", "z"))


def _stored(t: Tables) -> DataFrame:
    """All points through a tile store, and of its boxes what two scans return: a box, and the tiles of one source."""
    path = neighbors.shared_path(t.spark, "tiles")
    sinks.write_tiles(t.pts, path, "source_block", "tile", rows=100_000)
    tiles = t.spark.read.parquet(f"{path}/tiles")
    read = lambda what, **of: sinks.read_tiles(t.spark, path, source="source_block", tile="tile", **of).groupBy("source_block", "tile").agg(F.count("*").alias(what))
    keys = ["source_block", "tile"]
    return tiles.join(read("in_box", box=(10.0, 20.0, 40.5, 60.0)), keys, "left").join(read("listed", tiles=tiles.where("source_block = 3")), keys, "left").fillna(0, ["in_box", "listed"])


query("s13_tile_store", _stored, "SELECT source_block, tile, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS n, any_value(c) AS source_point_count, count(*) FILTER (x BETWEEN 10 AND 40.5 AND y BETWEEN 20 AND 60) AS in_box, count(*) FILTER (source_block = 3) AS listed FROM pts JOIN (SELECT source_block, count(DISTINCT orig_idx) AS c FROM pts GROUP BY 1) USING (source_block) GROUP BY 1, 2")
