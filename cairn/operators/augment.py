"""Seeded augmentation: parameters hashed per tile, noise hashed per point; the same rows always get the same values."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalar import unit_hash


def _between(u: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + u * F.lit(float(high - low))


def normal_hash(seed: str, *keys: str) -> Column:
    """A standard normal number from two hashed uniforms (Box-Muller)."""
    u, v = unit_hash(f"{seed}/u", *keys), unit_hash(f"{seed}/v", *keys)
    return F.sqrt(-2.0 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(F.lit(2 * math.pi) * v)


def shift(pts: DataFrame, seed: int, ranges: Sequence[tuple[float, float]] = ((-0.2, 0.2), (-0.2, 0.2), (0.0, 0.0)), by: str = "tile") -> DataFrame:
    return pts.withColumns({c: F.col(c) + _between(unit_hash(f"{seed}/shift{c}", by), *r) for c, r in zip("xyz", ranges, strict=True)})


def rotate(pts: DataFrame, seed: int, axis: str = "z", angle: tuple[float, float] = (-1.0, 1.0), choices: Sequence[float] | None = None, center: bool = True, p: float = 1.0, by: str = "tile", normals: bool = False) -> DataFrame:
    """Turn a tile about an axis through its box centre (or the origin), by a free angle in units of pi or one of fixed ``choices``."""
    u = unit_hash(f"{seed}/angle{axis}", by)
    turn = F.element_at(F.array(*(F.lit(float(a)) for a in choices)), (F.floor(u * len(choices)) + 1).cast("int")) if choices else _between(u, *angle)
    turn = F.when(unit_hash(f"{seed}/p{axis}", by) < p, turn * math.pi).otherwise(0.0)
    box = pts.groupBy(by).agg(*(((F.min(c) + F.max(c)) / 2 if center else F.lit(0.0)).alias(f"__{c}") for c in "xyz"))
    rows = pts.join(box, by).withColumn("__c", F.cos(turn)).withColumn("__s", F.sin(turn))
    a, b = {"z": "xy", "x": "yz", "y": "zx"}[axis]

    def turned(rows: DataFrame, a: str, b: str, oa: Column, ob: Column) -> DataFrame:
        da, db = F.col(a) - oa, F.col(b) - ob
        return rows.withColumns({a: da * F.col("__c") - db * F.col("__s") + oa, b: da * F.col("__s") + db * F.col("__c") + ob})

    rows = turned(rows, a, b, F.col(f"__{a}"), F.col(f"__{b}"))
    if normals:
        rows = turned(rows, f"n{a}", f"n{b}", F.lit(0.0), F.lit(0.0))
    return rows.drop("__x", "__y", "__z", "__c", "__s")


def scale(pts: DataFrame, seed: int, low: float = 0.95, high: float = 1.05, anisotropic: bool = False, by: str = "tile") -> DataFrame:
    return pts.withColumns({c: F.col(c) * _between(unit_hash(f"{seed}/scale{c if anisotropic else ''}", by), low, high) for c in "xyz"})


def flip(pts: DataFrame, seed: int, p: float = 0.5, by: str = "tile", normals: bool = False) -> DataFrame:
    out = pts
    for c in "xy":
        sign = F.when(unit_hash(f"{seed}/flip{c}", by) < p, -1.0).otherwise(1.0)
        out = out.withColumns({n: F.col(n) * sign for n in ([c, f"n{c}"] if normals else [c])})
    return out


def jitter(pts: DataFrame, seed: int, sigma: float = 0.01, clip: float = 0.05, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    return pts.withColumns({c: F.col(c) + F.least(F.greatest(normal_hash(f"{seed}/jitter{c}", by, id_col) * sigma, F.lit(-float(clip))), F.lit(float(clip))) for c in "xyz"})


def augment_geom(pts: DataFrame, seed: int, spec: Sequence[tuple[str, dict]], by: str = "tile") -> DataFrame:
    """Apply named steps in order; each step's numbers are hashed from the seed and its place."""
    steps = {"shift": shift, "rotate": rotate, "scale": scale, "flip": flip, "jitter": jitter}
    for i, (name, options) in enumerate(spec):
        pts = steps[name](pts, seed * 1000 + i, by=by, **options)
    return pts


def _clip255(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))


RGB = ("r", "g", "b")


def auto_contrast(pts: DataFrame, seed: int, p: float = 0.2, blend: float | None = None, by: str = "tile") -> DataFrame:
    """Stretch each channel to 0-255 by the tile's range, blended with the original."""
    box = pts.groupBy(by).agg(*(f(c).alias(f"__{n}{c}") for c in RGB for n, f in (("lo", F.min), ("hi", F.max))))
    w = unit_hash(f"{seed}/blend", by) if blend is None else F.lit(float(blend))
    on = unit_hash(f"{seed}/contrast", by) < p
    full = lambda c: (F.col(c) - F.col(f"__lo{c}")) * 255.0 / F.greatest(F.col(f"__hi{c}") - F.col(f"__lo{c}"), F.lit(1e-9))
    return pts.join(box, by).withColumns({c: F.when(on, (1 - w) * F.col(c) + w * full(c)).otherwise(F.col(c)) for c in RGB}).drop(*(f"__{n}{c}" for c in RGB for n in ("lo", "hi")))


def color_translation(pts: DataFrame, seed: int, p: float = 0.95, ratio: float = 0.05, by: str = "tile") -> DataFrame:
    on = unit_hash(f"{seed}/translate", by) < p
    return pts.withColumns({c: F.when(on, _clip255(F.col(c) + (unit_hash(f"{seed}/t{c}", by) - 0.5) * (2 * 255 * ratio))).otherwise(F.col(c)) for c in RGB})


def color_jitter(pts: DataFrame, seed: int, p: float = 0.95, sigma: float = 0.05, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    on = unit_hash(f"{seed}/jitter", by) < p
    return pts.withColumns({c: F.when(on, _clip255(F.col(c) + normal_hash(f"{seed}/j{c}", by, id_col) * (sigma * 255))).otherwise(F.col(c)) for c in RGB})


def greyscale(pts: DataFrame, seed: int, p: float = 0.1, by: str = "tile") -> DataFrame:
    """Luma (ITU-R 601 weights) in all channels of a hashed share of the tiles."""
    grey = F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114
    on = unit_hash(f"{seed}/grey", by) < p
    return pts.withColumn("__g", grey).withColumns({c: F.when(on, F.col("__g")).otherwise(F.col(c)) for c in RGB}).drop("__g")


def _hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in [0, 1), saturation, value of channels 0-255."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = F.when(hi > lo, hi - lo)
    h = F.when(hi == r, F.pmod((g - b) / d, F.lit(6.0))).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return F.coalesce(h, F.lit(0.0)), F.when(hi > 0, (hi - lo) / F.when(hi > 0, hi)).otherwise(0.0), hi / 255.0


def _rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 6, F.lit(6.0))
        return (v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))) * 255.0

    return channel(5), channel(3), channel(1)


def hue_saturation(pts: DataFrame, seed: int, hue: float = 0.5, saturation: float = 0.2, by: str = "tile") -> DataFrame:
    """Shift hue (turning) and scale saturation (clipped) by one hashed amount per tile."""
    h, s, v = _hsv(*(F.col(c).cast("double") for c in RGB))
    rows = pts.withColumns({"__h": F.pmod(h + (unit_hash(f"{seed}/hue", by) - 0.5) * (2 * hue), F.lit(1.0)), "__s": F.least(F.lit(1.0), s * _between(unit_hash(f"{seed}/sat", by), 1 - saturation, 1 + saturation)), "__v": v})
    return rows.withColumns(dict(zip(RGB, _rgb(F.col("__h"), F.col("__s"), F.col("__v")), strict=True))).drop("__h", "__s", "__v")


def brightness_contrast(pts: DataFrame, seed: int, brightness: float = 0.2, contrast: float = 0.2, by: str = "tile") -> DataFrame:
    """Scale all channels, then their distance from the tile's mean grey, each by one hashed factor per tile."""
    b, c = (_between(unit_hash(f"{seed}/{n}", by), 1 - x, 1 + x) for n, x in (("bright", brightness), ("contr", contrast)))
    mean = pts.groupBy(by).agg(F.avg(F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114).alias("__m"))
    return pts.join(mean, by).withColumns({k: _clip255((F.col(k) * b - F.col("__m") * b) * c + F.col("__m") * b) for k in RGB}).drop("__m")


def drop_color(pts: DataFrame, seed: int, p: float = 0.2, by: str = "tile") -> DataFrame:
    on = unit_hash(f"{seed}/drop", by) < p
    return pts.withColumns({c: F.when(on, 0.0).otherwise(F.col(c)) for c in RGB})


def augment_color(pts: DataFrame, seed: int, spec: Sequence[tuple[str, dict]], by: str = "tile") -> DataFrame:
    steps = {"auto_contrast": auto_contrast, "translation": color_translation, "jitter": color_jitter, "greyscale": greyscale, "hue_saturation": hue_saturation, "brightness_contrast": brightness_contrast, "drop": drop_color}
    for i, (name, options) in enumerate(spec):
        pts = steps[name](pts, seed * 1000 + i, by=by, **options)
    return pts


def drop_attr(pts: DataFrame, cols: Sequence[str], ratio: float, seed: int, p: float = 1.0, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    """Zero an attribute on an exact share of the points of a hashed share of the tiles."""
    per = Window.partitionBy(by)
    rank = F.row_number().over(per.orderBy(unit_hash(f"{seed}/attr", by, id_col), F.col(id_col)))
    gone = (rank <= F.floor(F.count("*").over(per) * F.lit(float(ratio)))) & (unit_hash(f"{seed}/p", by) < p)
    return pts.withColumn("__gone", gone).withColumns({c: F.when(F.col("__gone"), 0).otherwise(F.col(c)) for c in cols}).drop("__gone")


#: Nodes along a block's side.
NODES = 8


def _node_moves(seed: int, name: str, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Noise of a tile's nodes after both averages, at the nodes ``low`` to ``high`` of a grid of ``size`` nodes: axes x, y, z first."""
    first, last = np.maximum(low - 2, 0), np.minimum(high + 2, size - 1)
    spans = [range(a, b + 1) for a, b in zip(first, last, strict=True)]
    tails = [f":{name}:{i}:{j}:{k}".encode() for i in spans[0] for j in spans[1] for k in spans[2]]
    told = lambda lead: np.frombuffer(b"".join([hashlib.md5(lead + tail).digest()[:4] for tail in tails]), ">u4") / 2.0**32
    noise = np.stack([np.sqrt(-2.0 * np.log(np.maximum(told(f"{seed}/{c}/u".encode()), 1e-12))) * np.cos(2 * math.pi * told(f"{seed}/{c}/v".encode())) for c in "xyz"])
    noise = noise.reshape(3, *(len(span) for span in spans))
    for axis, span in enumerate(spans):
        here, to = np.array(span), np.arange(low[axis], high[axis] + 1)[:, None]
        weight = np.minimum(np.minimum(here, to) + 1, size[axis] - 1) - np.maximum(np.maximum(here, to) - 1, 0) + 1
        noise = np.moveaxis(np.tensordot(np.where(abs(here - to) <= 2, weight, 0) / 9, noise, (1, axis + 1)), 0, axis + 1)
    return noise


def elastic(pts: DataFrame, granularity: float, magnitude: float, seed: int, p: float = 1.0, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    """Elastic distortion of a hashed share ``p`` of the tiles: normal noise at the nodes of a grid (from one node below the tile's minimum), averaged twice over boxes
    of 3 x 3 x 3 nodes with zeros outside, added trilinearly. Points without a place are left out.

    Node noise is hashed from the node (``normal_hash``), so the task that holds a block's points makes it anew where it needs it. Both averages together are a product of
    weights per axis: of a noise node and a result, the number of nodes of the grid next to both, over 9. Points are dealt by block and read a batch at a time; no
    corner of a point and no node is a row.
    """
    step = F.lit(float(granularity))
    placed = pts.dropna(subset=list("xyz")).withColumns({c: F.col(c).cast("double") for c in "xyz"})
    kinds, columns = placed.schema, placed.columns
    box = pts.groupBy(by).agg(*(e for c in "xyz" for e in (F.min(c).alias(f"__lo{c}"), (F.floor((F.max(c) - F.min(c)) / step) + 3).alias(f"__k{c}"))))
    at = placed.join(box, by).withColumns({f"__t{c}": (F.col(c) - F.col(f"__lo{c}")) / step + 1 for c in "xyz"}).withColumns({f"__b{c}": F.floor(F.col(f"__t{c}") / NODES) for c in "xyz"})
    at = at.withColumns({"__name": F.col(by).cast("string"), "__told": unit_hash(f"{seed}/elastic", by) < p}).drop(*(f"__lo{c}" for c in "xyz"))
    key = [by, *(f"__b{c}" for c in "xyz")]

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = None, None
        for batch in batches:
            name, told = (batch[c].to_numpy(zero_copy_only=False) for c in ("__name", "__told"))
            t, size, block = (np.stack([batch[f"__{n}{c}"].to_numpy() for c in "xyz"]) for n in "tkb")
            new = (name[1:] != name[:-1]) | (block[:, 1:] != block[:, :-1]).any(axis=0)
            starts = [0, *(np.flatnonzero(new) + 1), len(name)]
            away = np.zeros(t.shape)
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b or not told[a]:
                    continue
                cell = np.floor(t[:, a:b]).astype(np.int64)
                low, high = cell.min(axis=1), cell.max(axis=1) + 1
                this = (name[a], *block[:, a])
                if kept is not None and kept[0] == this:
                    low, high = np.minimum(low, kept[1]), np.maximum(high, kept[2])
                if kept is None or kept[0] != this or (low != kept[1]).any() or (high != kept[2]).any():
                    kept, held = (this, low, high), _node_moves(seed, name[a], low, high, size[:, a])
                share, (i, j, k) = t[:, a:b] - cell, cell - low[:, None]
                for o in np.ndindex(2, 2, 2):
                    weight = np.prod([s if one else 1 - s for s, one in zip(share, o, strict=True)], axis=0)
                    away[:, a:b] += weight * held[:, i + o[0], j + o[1], k + o[2]]
            out = {c: batch[c] for c in columns}
            out |= {c: pa.array(batch[c].to_numpy() + magnitude * away[axis]) for axis, c in enumerate("xyz")}
            yield pa.RecordBatch.from_pydict(out)

    return at.repartition(*key).sortWithinPartitions(*key).mapInArrow(moved, kinds)
