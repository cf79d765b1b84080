"""Column functions: labels, returns, colours, pixels, vectors, curves, hashed random numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unit_hash(seed: int | str, *keys: ColumnLike) -> Column:
    """A number in [0, 1) from the MD5 of ``seed:key:...``: the same for a row however the table is partitioned."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(col(k).cast("string") for k in keys)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def map_values(c: ColumnLike, mapping: Mapping, default: Column | None = None) -> Column:
    """A value's image under a small fixed mapping; others become ``default`` (unchanged if not given)."""
    value = col(c)
    if not mapping:
        return value if default is None else default
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(F.try_element_at(table, value), value if default is None else default)


def clamp_label(c: ColumnLike, classes: int, other: int = -1) -> Column:
    """Labels outside ``[0, classes)``, and nulls, become ``other``."""
    return F.when((col(c) >= 0) & (col(c) < classes), col(c)).otherwise(F.lit(other))


def return_role(r: ColumnLike, n: ColumnLike) -> Column:
    """0 single, 1 first, 2 middle, 3 last return; -1 if not ``1 <= r <= n``."""
    r, n = col(r), col(n)
    return F.when(n.isNull() | r.isNull() | (r < 1) | (r > n), -1).when(n == 1, 0).when(r == 1, 1).when(r == n, 3).otherwise(2)


def echo(r: ColumnLike, n: ColumnLike) -> tuple[Column, Column]:
    """(is first, is last) as 1 or -1."""
    return F.when(col(r) == 1, 1).otherwise(-1), F.when(col(r) == col(n), 1).otherwise(-1)


def valid_return(r: ColumnLike, n: ColumnLike) -> Column:
    return F.coalesce((col(r) >= 1) & (col(r) <= col(n)), F.lit(False))


def scale_color(c: ColumnLike, divisor: float) -> Column:
    return col(c).cast("double") / F.lit(float(divisor))


def threshold_region(c: ColumnLike, low: float = 0.2, high: float = 0.6) -> Column:
    """0 for ``<= low``, 2 for ``>= high``, 1 between."""
    return F.when(col(c) <= low, 0).when(col(c) >= high, 2).otherwise(1)


def digitize(c: ColumnLike, edges: Sequence[float]) -> Column:
    """How many of the ascending ``edges`` are not above the value."""
    return sum((F.when(col(c) >= e, 1).otherwise(0) for e in edges), F.lit(0))


def clip(c: ColumnLike, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def gaussian_kernel(d2: ColumnLike, amplitude: float = 1.0, bandwidth: float = 1.0) -> Column:
    """``amplitude * exp(-d2 / (2 * bandwidth^2))``."""
    return F.lit(float(amplitude)) * F.exp(-col(d2) / F.lit(2.0 * bandwidth * bandwidth))


def to_pixel(x: ColumnLike, y: ColumnLike, affine: Sequence[float]) -> tuple[Column, Column]:
    """Row and column (floored) of a world position; ``affine`` is ``(a, b, c, d, e, f)`` of ``x = a*col + b*row + c``,
    ``y = d*col + e*row + f``."""
    a, b, c, d, e, f = map(float, affine)
    det = a * e - b * d
    if det == 0:
        raise ValueError("the affine transform has no inverse")
    dx, dy = col(x) - c, col(y) - f
    return F.floor((dy * a - dx * d) / det), F.floor((dx * e - dy * b) / det)


def inside(row: ColumnLike, column: ColumnLike, height: int, width: int) -> Column:
    return (col(row) >= 0) & (col(row) < height) & (col(column) >= 0) & (col(column) < width)


def to_patch(row: ColumnLike, column: ColumnLike, patch: int, grid_width: int, grid_height: int) -> Column:
    """Index of the square patch of a pixel, row by row; -1 outside the patch grid."""
    r, c = F.floor(col(row) / F.lit(patch)), F.floor(col(column) / F.lit(patch))
    return F.when((r >= 0) & (r < grid_height) & (c >= 0) & (c < grid_width), r * grid_width + c).otherwise(F.lit(-1))


def l2norm(v: ColumnLike, least: float = 1e-12) -> Column:
    """A vector divided by its length (at least ``least``)."""
    norm = F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(col(v), lambda x: x.cast("double") / F.greatest(norm, F.lit(least)))


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: ColumnLike, b: ColumnLike, least: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(least)) * F.greatest(F.sqrt(dot(b, b)), F.lit(least)))


def spread_bits(c: ColumnLike) -> Column:
    """Bits 0..20 of a value moved to every third place, by five mask steps."""
    v = col(c).cast("long").bitwiseAND(F.lit((1 << 21) - 1))
    for shift in (32, 16, 8, 4, 2):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(_every_third(shift)))
    return v


def gather_bits(c: ColumnLike) -> Column:
    """The inverse of ``spread_bits``."""
    v = col(c).bitwiseAND(F.lit(_every_third(2)))
    for shift in (2, 4, 8, 16, 32):
        v = v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(_every_third(shift * 2) if shift < 32 else (1 << 21) - 1))
    return v


def _every_third(shift: int) -> int:
    """The mask after moving halves by ``shift``: groups of ``shift / 2`` bits, three groups' room apart."""
    group = shift // 2
    return sum(((1 << group) - 1) << (3 * group * k) for k in range(-(-21 // group))) & ((1 << 63) - 1)


def zorder(gx: ColumnLike, gy: ColumnLike, gz: ColumnLike, batch: ColumnLike | None = None, depth: int = 16, swapped: bool = False) -> Column:
    """Morton code of a grid cell (x in the highest bit of a triple; ``swapped`` puts y first), the batch number on top."""
    first, second = (gy, gx) if swapped else (gx, gy)
    code = F.shiftleft(spread_bits(first), 2).bitwiseOR(F.shiftleft(spread_bits(second), 1)).bitwiseOR(spread_bits(gz))
    return code if batch is None else F.shiftleft(col(batch).cast("long"), 3 * depth).bitwiseOR(code)


def zorder_cell(code: ColumnLike, depth: int = 16) -> tuple[Column, Column, Column]:
    """The cell of a Morton code without its batch bits."""
    low = col(code).bitwiseAND(F.lit((1 << (3 * depth)) - 1))
    return tuple(gather_bits(F.shiftrightunsigned(low, k)) for k in (2, 1, 0))


def tile_name_parts(c: ColumnLike) -> tuple[Column, Column]:
    """``(base, number)`` of ``{base}_{NNNN}``; the whole name and null without a number."""
    name = col(c)
    number = F.regexp_extract(name, r"^(.*)_(\d+)$", 2)
    return F.when(number == "", name).otherwise(F.regexp_extract(name, r"^(.*)_(\d+)$", 1)), F.when(number != "", number.cast("int"))


def stem(path: ColumnLike) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", "")
