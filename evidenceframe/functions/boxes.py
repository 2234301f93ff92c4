"""Box geometry as closed-form Column expressions.

A box is a struct of x1, y1, x2, y2. Areas and overlaps take x2 and y2 as exclusive; ``bounds="inclusive"`` counts the
last row and column too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coerce import safe_div

#: Orientations of a transformed box: axes swapped or not, then either axis flipped.
MODES = ("identity", "flip_x", "flip_y", "flip_xy", "swap_xy", "swap_xy_flip_x", "swap_xy_flip_y", "swap_xy_flip_xy")


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(F.lit(v).alias(n) if not isinstance(v, (Column, str)) else (F.col(v) if isinstance(v, str) else v).alias(n) for v, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))))


def _sides(b: Column) -> tuple[Column, Column, Column, Column]:
    return b["x1"], b["y1"], b["x2"], b["y2"]


def _span(low: Column, high: Column, extra: int = 0) -> Column:
    """high - low, 0 at least; NULL if either is (``greatest`` would pass over a NULL)."""
    d = high - low + extra
    return F.when(d.isNotNull(), F.greatest(d, F.lit(0)))


# Each names its arguments as seldom as it can: expressions in them are written out once more for every time, and code of some size isn't compiled.


def _low(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def _high(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def area(b: Column, bounds: str = "exclusive") -> Column:
    x1, y1, x2, y2 = _sides(b)
    extra = 1 if bounds == "inclusive" else 0
    return _span(x1, x2, extra) * _span(y1, y2, extra)


def intersection(a: Column, b: Column) -> Column:
    return _span(_high(a["x1"], b["x1"]), _low(a["x2"], b["x2"])) * _span(_high(a["y1"], b["y1"]), _low(a["y2"], b["y2"]))


def iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    return safe_div(inter, area(a) + area(b) - inter)


def iou3d(a: Column, b: Column) -> Column:
    """Boxes with z1 and z2 as well."""
    depth = lambda x: _span(x["z1"], x["z2"])
    inter = intersection(a, b) * _span(_high(a["z1"], b["z1"]), _low(a["z2"], b["z2"]))
    return safe_div(inter, area(a) * depth(a) + area(b) * depth(b) - inter)


def iom(a: Column, b: Column) -> Column:
    """Overlap by the smaller area."""
    return safe_div(intersection(a, b), _low(area(a), area(b)))


def coverage(pred: Column, truth: Column) -> Column:
    """Share of the truth that the prediction covers."""
    return safe_div(intersection(pred, truth), area(truth))


def precision(pred: Column, truth: Column) -> Column:
    """Share of the prediction inside the truth."""
    return safe_div(intersection(pred, truth), area(pred))


def center(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2.0).alias("x"), ((b["y1"] + b["y2"]) / 2.0).alias("y"))


def center_hit(pred: Column, truth: Column) -> Column:
    c = center(pred)
    return c["x"].between(truth["x1"], truth["x2"]) & c["y"].between(truth["y1"], truth["y2"])


def strict_hit(pred: Column, truth: Column) -> Column:
    return iou(pred, truth) >= 0.5


def relaxed_hit(pred: Column, truth: Column) -> Column:
    covered = coverage(pred, truth)
    return (iou(pred, truth) >= 0.3) | (iom(pred, truth) >= 0.5) | (covered >= 0.7) | (center_hit(pred, truth) & (covered >= 0.5))


def _inside(b: Column, width, height) -> tuple[Column, Column, Column, Column]:
    w, h = _number(width), _number(height)
    inside = lambda v, top: F.when(v.isNotNull() & top.isNotNull(), F.greatest(F.lit(0), F.least(v, top - 1)))
    return inside(b["x1"], w), inside(b["y1"], h), inside(b["x2"], w), inside(b["y2"], h)


def empty_inside(b: Column, width, height) -> Column:
    """Whether ``clamp`` leaves a box without width or height."""
    x1, y1, x2, y2 = _inside(b, width, height)
    return (x1 == x2) | (y1 == y2)


def clamp(b: Column, width, height) -> Column:
    """Corners moved into the image (to width - 1 and height - 1) and put in order."""
    x1, y1, x2, y2 = _inside(b, width, height)
    return box(_low(x1, x2), _low(y1, y2), _high(x1, x2), _high(y1, y2))


def non_empty(b: Column, width, height) -> Column:
    """Clamped; an empty side grows one to the right or down, at the edge to the left or up."""
    w, h = _number(width), _number(height)
    c = clamp(b, w, h)

    def grow(low: Column, high: Column, top: Column) -> tuple[Column, Column]:
        empty, room = high <= low, low < top - 1
        return F.when(empty & ~room, _high(F.lit(0), low - 1)).otherwise(low), F.when(empty & room, low + 1).otherwise(high)

    (x1, x2), (y1, y2) = grow(c["x1"], c["x2"], w), grow(c["y1"], c["y2"], h)
    return box(x1, y1, x2, y2)


def expand(b: Column, width, height, ratio: float, edge: str = "exclusive") -> Column:
    """Padded by a ratio of each side, rounded half to even.

    ``exclusive`` stops at width and height and leaves empty boxes alone; ``inclusive`` counts a side as one at least
    and forces the result into the image, not empty.
    """
    if edge == "inclusive":
        side = lambda low, high: _high(F.lit(1), high - low)
    else:
        side = lambda low, high: high - low
    px = F.rint(side(b["x1"], b["x2"]) * F.lit(float(ratio))).cast("int")
    py = F.rint(side(b["y1"], b["y2"]) * F.lit(float(ratio))).cast("int")
    if edge == "inclusive":
        return non_empty(box(b["x1"] - px, b["y1"] - py, b["x2"] + px, b["y2"] + py), width, height)
    if ratio <= 0:
        return b
    grown = box(_high(F.lit(0), b["x1"] - px), _high(F.lit(0), b["y1"] - py), _low(_number(width), b["x2"] + px), _low(_number(height), b["y2"] + py))
    names = ("x1", "y1", "x2", "y2")
    return box(*(F.when(area(b) <= 0, b[n]).otherwise(grown[n]) for n in names))


def union_of(boxes: Column) -> Column:
    """The box around an array of boxes; empty ones don't count; all zero if none is left."""
    real = F.filter(boxes, lambda b: area(b) > 0)
    edge = lambda f, n: F.coalesce(f(F.transform(real, lambda b: b[n])), F.lit(0))
    return box(edge(F.array_min, "x1"), edge(F.array_min, "y1"), edge(F.array_max, "x2"), edge(F.array_max, "y2"))


def union_agg(b: Column) -> Column:
    """Aggregate of union_of over a group."""
    real = area(b) > 0
    edge = lambda f, n: F.coalesce(f(F.when(real, b[n])), F.lit(0))
    return box(edge(F.min, "x1"), edge(F.min, "y1"), edge(F.max, "x2"), edge(F.max, "y2"))


def to_relative(b: Column, width, height) -> Column:
    """Centre and size as shares of the image: struct of cx, cy, w, h."""
    w, h = _number(width), _number(height)
    bw, bh = _high(F.lit(1), b["x2"] - b["x1"]), _high(F.lit(1), b["y2"] - b["y1"])
    return F.struct(((b["x1"] + bw / 2.0) / w).alias("cx"), ((b["y1"] + bh / 2.0) / h).alias("cy"), (bw / w).alias("w"), (bh / h).alias("h"))


def from_relative(r: Column, width, height) -> Column:
    w, h = _number(width), _number(height)
    near = lambda c, side, size, sign: F.rint(c * size + sign * (side * size) / 2.0).cast("int")
    return clamp(box(near(r["cx"], r["w"], w, -1), near(r["cy"], r["h"], h, -1), near(r["cx"], r["w"], w, 1), near(r["cy"], r["h"], h, 1)), w, h)


def _number(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(v)


def transform(b: Column, width, height, mode: str) -> Column:
    """The box after swapping the axes and flipping either; a flip exchanges a side's ends."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    w, h = _number(width), _number(height)
    xs, ys = (b["x1"], b["x2"]), (b["y1"], b["y2"])
    if mode.startswith("swap_xy"):
        xs, ys, w, h = ys, xs, h, w
    turn = mode.rsplit("flip_", 1)[1] if "flip_" in mode else ""
    if "x" in turn:
        xs = (w - xs[0], w - xs[1])
    if "y" in turn:
        ys = (h - ys[0], h - ys[1])
    return box(_low(*xs), _low(*ys), _high(*xs), _high(*ys))


def rescale(b: Column, width, height, to_width, to_height, mode: str = "identity") -> Column:
    """Transformed, then scaled from the (transformed) source frame to another, rounded half to even."""
    t = transform(b, width, height, mode)
    w, h = _number(width), _number(height)
    if mode.startswith("swap_xy"):
        w, h = h, w
    sx, sy = _number(to_width) / F.greatest(w.cast("double"), F.lit(1.0)), _number(to_height) / F.greatest(h.cast("double"), F.lit(1.0))
    return box(*(F.rint(t[n] * s).cast("int") for n, s in (("x1", sx), ("y1", sy), ("x2", sx), ("y2", sy))))


def rescaled(rows: DataFrame, b: Column, width, height, to_width, to_height, modes: tuple[str, ...] = MODES) -> DataFrame:
    """rows with mode and x1, y1, x2, y2, once for each mode: the box as ``rescale`` makes it.

    Modes become rows first, so that what a row computes is short and the same for all.
    """
    turns = {m: m.rsplit("flip_", 1)[1] if "flip_" in m else "" for m in modes}
    if unknown := set(modes) - set(MODES):
        raise ValueError(f"unknown modes {sorted(unknown)}")
    ways = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(m.startswith("swap_xy")).alias("_swap"), F.lit("x" in t).alias("_fx"), F.lit("y" in t).alias("_fy")) for m, t in turns.items()))
    w, h, c = _number(width), _number(height), F.col
    swapped = lambda a, o: F.when(c("_swap"), a).otherwise(o)
    sides = {"_x1": swapped(b["y1"], b["x1"]), "_x2": swapped(b["y2"], b["x2"]), "_y1": swapped(b["x1"], b["y1"]), "_y2": swapped(b["x2"], b["y2"]), "_w": swapped(h, w), "_h": swapped(w, h)}
    out = rows.select("*", F.inline(ways)).withColumns(sides)
    out = out.withColumns({f"_{a}{i}": F.when(c(f"_f{a}"), c(size) - c(f"_{a}{i}")).otherwise(c(f"_{a}{i}")) for a, size in (("x", "_w"), ("y", "_h")) for i in (1, 2)})
    scale = lambda size, to: _number(to) / F.greatest(c(size).cast("double"), F.lit(1.0))
    ends = {f"{a}{i}": F.rint(f(c(f"_{a}1"), c(f"_{a}2")) * scale(size, to)).cast("int") for i, f in ((1, _low), (2, _high)) for a, size, to in (("x", "_w", to_width), ("y", "_h", to_height))}
    return out.select(*rows.columns, "mode", *(v.alias(n) for n, v in ends.items()))
