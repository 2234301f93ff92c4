"""Masks as pixel tables (case_id, z, y, x, value): areas, boxes, overlap, components, neighbours.

All reductions are aggregations by slice. Connected components are found within a slice by a small flood fill on
the slice's set pixels; a slice is one image, so a group is bounded by its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import MODES
from ..functions.coerce import safe_div

SLICE = ["case_id", "z"]


def _set(value: str) -> Column:
    return F.col(value) > 0


def binarise(pixels: DataFrame, value: str, name: str = "pred") -> DataFrame:
    return pixels.withColumn(name, _set(value).cast("int"))


def areas(pixels: DataFrame, value: str = "pred", keys: list[str] | None = None) -> DataFrame:
    return pixels.groupBy(*(keys or SLICE)).agg(F.count_if(_set(value)).alias("area"))


def boxes(pixels: DataFrame, value: str = "pred", keys: list[str] | None = None, inclusive: bool = False) -> DataFrame:
    """Tight box of the set pixels of each group; the far side exclusive unless said; all zero without any."""
    more = 0 if inclusive else 1
    edge = lambda f, c, d=0: F.coalesce(f(F.when(_set(value), F.col(c))) + d, F.lit(0))
    return pixels.groupBy(*(keys or SLICE)).agg(edge(F.min, "x").alias("x1"), edge(F.min, "y").alias("y1"), edge(F.max, "x", more).alias("x2"), edge(F.max, "y", more).alias("y2"))


def boxes3d(pixels: DataFrame, value: str = "pred") -> DataFrame:
    edge = lambda f, c, d=0: F.coalesce(f(F.when(_set(value), F.col(c))) + d, F.lit(0))
    return pixels.groupBy("case_id").agg(*(edge(F.min, c).alias(f"{c}1") for c in "xyz"), *(edge(F.max, c, 1).alias(f"{c}2") for c in "xyz"))


def dice(pixels: DataFrame, a: str = "pred", b: str = "gt", keys: list[str] | None = None) -> DataFrame:
    """Twice the overlap by the sum of areas; 1 where both are empty."""
    both, x, y = F.count_if(_set(a) & _set(b)), F.count_if(_set(a)), F.count_if(_set(b))
    return pixels.groupBy(*(keys or ["case_id"])).agg(F.when(x + y == 0, 1.0).otherwise(2.0 * both / (x + y)).alias("dice"))


def largest_slice(pixels: DataFrame, value: str = "pred") -> DataFrame:
    """case_id, z and area of the largest slice, the first of equal ones."""
    a = areas(pixels, value)
    best = F.max_by(F.struct("z", "area"), F.struct("area", -F.col("z")))
    return a.groupBy("case_id").agg(best.alias("b")).select("case_id", "b.z", "b.area")


def _slice_starts(table: pa.Table) -> np.ndarray:
    """Whether a row begins a slice; slices stand together."""
    starts = np.ones(table.num_rows, bool)
    same = np.ones(max(table.num_rows - 1, 0), bool)
    for name in SLICE:
        c = table[name].combine_chunks()
        same &= pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
    starts[1:] = ~same
    return starts


def numbered_components(table: pa.Table) -> pa.RecordBatch:
    """4-connected components of whole slices, whose pixels come row by row, numbered from 1 in the order of their first pixel.

    Pixels beside each other in a row are a run; runs that touch across rows are joined, the earlier standing for both.
    """
    starts = _slice_starts(table)
    own = np.cumsum(starts) - 1
    y, x = table["y"].to_numpy(), table["x"].to_numpy()
    width = int(x.max()) + 2
    code = (own * (int(y.max()) + 2) + y) * width + x
    begins = np.concatenate([[True], code[1:] != code[:-1] + 1])
    run = np.cumsum(begins) - 1
    below = np.searchsorted(code, code + width)
    touching = np.flatnonzero(code[np.minimum(below, len(code) - 1)] == code + width)
    one, two = run[touching], run[below[touching]]
    head = np.arange(int(run[-1]) + 1)
    while len(one):
        a, b = head[one], head[two]
        apart = a != b
        if not apart.any():
            break
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        np.minimum.at(head, np.maximum(a, b), np.minimum(a, b))
        while (head[head] != head).any():
            head = head[head]
    count = np.cumsum(head == np.arange(len(head)))
    first = run[starts]  # first run of each slice
    number = count[head[run]] - (count[first] - 1)[own]
    return pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in ("case_id", "z", "y", "x")), pa.array(number, pa.int64())], ["case_id", "z", "y", "x", "component"])


def components(pixels: DataFrame, value: str = "pred") -> DataFrame:
    """(case_id, z, y, x, component) for every set pixel. Slices are packed: a task labels all of a batch's at once."""
    kind = pixels.schema["case_id"].dataType.simpleString()

    def label(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            begins = np.flatnonzero(_slice_starts(table))
            last = int(begins[-1]) if len(begins) else 0
            if last:
                yield numbered_components(table.slice(0, last).combine_chunks())
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield numbered_components(held.combine_chunks())

    rows = pixels.where(_set(value)).select("case_id", *(F.col(c).cast("long").alias(c) for c in ("z", "y", "x")))
    return rows.repartition(*SLICE).sortWithinPartitions(*SLICE, "y", "x").mapInArrow(label, f"case_id {kind}, z long, y long, x long, component long")


def component_stats(found: DataFrame, width: int, height: int, border_penalty: float = 0.15) -> DataFrame:
    """Per component: area, box, share of the slice's largest, border contact and quality score.

    score = 1.35 area share + 0.45 fill + 0.35 nearness to the centre - 0.35 elongation - penalty at the border.
    """
    g = found.groupBy(*SLICE, "component").agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"),
        F.max((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)).alias("touches_border"),
    )
    g = g.withColumn("area_ratio", F.col("area") / F.max("area").over(Window.partitionBy(*SLICE)))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    dx = ((F.col("x1") + F.col("x2")) / 2.0 - width / 2.0) / max(width / 2.0, 1.0)
    dy = ((F.col("y1") + F.col("y2")) / 2.0 - height / 2.0) / max(height / 2.0, 1.0)
    near = F.greatest(F.lit(0.0), 1 - F.least(F.sqrt(dx * dx + dy * dy), F.lit(1.0)))
    long = F.least(F.greatest(F.greatest(w / h, h / w) - 3.0, F.lit(0.0)) / 5.0, F.lit(1.0))
    score = 1.35 * F.col("area_ratio") + 0.45 * F.col("area") / (w * h) + 0.35 * near - 0.35 * long - F.when(F.col("touches_border"), border_penalty).otherwise(0.0)
    return g.withColumn("score", F.round(score, 9))


def transform(pixels: DataFrame, width: int, height: int, mode: str) -> DataFrame:
    """Pixels moved by one of the orientations; width and height are those before."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    x, y, w, h = F.col("x"), F.col("y"), width, height
    if mode.startswith("swap_xy"):
        x, y, w, h = y, x, h, w
    turn = mode.rsplit("flip_", 1)[1] if "flip_" in mode else ""
    return pixels.withColumns({"x": w - 1 - x if "x" in turn else x, "y": h - 1 - y if "y" in turn else y})


def resize(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Nearest neighbour: every new pixel takes the source pixel its centre falls in. Source pixels name their targets."""
    def targets(c: Column, size: int, to: int) -> Column:
        first, last = F.ceil(c * F.lit(to) / size - 0.5), F.ceil((c + 1) * F.lit(to) / size - 0.5) - 1
        return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))

    out = pixels.withColumn("_ys", targets(F.col("y"), height, to_height)).withColumn("_xs", targets(F.col("x"), width, to_width))
    return out.withColumn("y", F.explode("_ys")).withColumn("x", F.explode("_xs")).drop("_ys", "_xs")


def to_bytes(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Intensities scaled to 0..255 within each slice; not finite or constant gives 0."""
    w = Window.partitionBy(*SLICE)
    v = F.col(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(0.0)
    low, high = F.min(finite).over(w), F.max(finite).over(w)
    return pixels.withColumn("byte", F.when(high > low, ((finite - low) / (high - low) * 255.0).cast("int")).otherwise(0))


def transpose(pixels: DataFrame) -> DataFrame:
    """(z, y, x) volumes to (x, y, z) ones."""
    return pixels.withColumns({"z": F.col("x"), "x": F.col("z")})


def segmentation_metrics(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean dice and the share of cases whose 3-D boxes overlap by a threshold at least."""
    from ..functions.boxes import iou3d

    p, g = boxes3d(pixels, "pred"), boxes3d(pixels, "gt")
    named = lambda t, n: t.select("case_id", F.struct("x1", "y1", "z1", "x2", "y2", "z2").alias(n))
    rows = named(p, "p").join(named(g, "g"), "case_id").join(dice(pixels), "case_id").withColumn("iou3d", iou3d(F.col("p"), F.col("g")))
    return rows.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("dice"), 9).alias("mean_dice"), safe_div(F.count_if(F.col("iou3d") >= threshold), F.count(F.lit(1))).alias("recall_3d"))
