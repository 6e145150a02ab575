"""Screen geometry: action points, boxes, crops, overlays.  Boxes are struct<x1,y1,x2,y2:double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.functions.bind import let

# Fixed values of the grounding rules.
MAX_AREA_RATIO = 0.20
MAX_SIDE_RATIO = 0.85
BOX_PADDING = 24
MIN_CROP = (320, 220)
FALLBACK_CROP = (640, 420)
POINT_HALF_SIZE = 18
POINT_SCREEN_RATIO = 0.035
DRAG_MIN_PADDING = 20
DRAG_SCREEN_RATIO = 0.025
RELATIVE_LIMIT = 1.5

NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
PAIR = rf"\(\s*({NUMBER})\s*,\s*({NUMBER})\s*\)"
CLICK = rf"(?:click(?:_(?:left|right|middle))?|double_click|right_click|middle_click|triple_click){PAIR}"
MOVE = rf"(?:move_to|move|mouse_move|mousemove|move_mouse){PAIR}"

POINT = "struct<label:string,x:double,y:double>"


def _point(label: str, x: Column, y: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def action_points(action: Column) -> Column:
    """Labelled points of a drag (two), click or move (one); empty for other actions."""
    none = F.array().cast(f"array<{POINT}>")
    lower = F.lower(action)
    extract = lambda pattern, group: F.regexp_extract(action, pattern, group).try_cast("double")
    ends = F.array(*[extract(rf"{key}\s*=\s*({NUMBER})", 1) for key in ("start_x", "start_y", "end_x", "end_y")])
    numbers = F.transform(F.regexp_extract_all(action, F.lit(f"({NUMBER})"), F.lit(1)), lambda n: n.cast("double"))

    def two_points(n: Column) -> Column:
        return F.array(_point("drag start", F.get(n, 0), F.get(n, 1)), _point("drag end", F.get(n, 2), F.get(n, 3)))

    by_place = let(
        numbers,
        lambda n: F.when(F.size(n) >= 4, two_points(n)).when(F.size(n) >= 2, F.array(_point("drag", F.get(n, 0), F.get(n, 1)))).otherwise(none),
    )
    by_name = let(ends, lambda n: F.when(F.forall(n, lambda v: v.isNotNull()), two_points(n)))
    click = F.when(action.rlike(CLICK), F.array(_point("click", extract(CLICK, 1), extract(CLICK, 2)))).otherwise(none)
    xs, ys = (F.regexp_extract_all(action, F.lit(MOVE), F.lit(i)) for i in (1, 2))
    move = F.when(action.rlike(MOVE), F.array(_point("move", F.try_element_at(xs, F.lit(-1)), F.try_element_at(ys, F.lit(-1))))).otherwise(none)
    return (
        F.when(lower.contains("drag"), F.when(action.contains("start_x"), F.coalesce(by_name, by_place)).otherwise(by_place))
        .when(lower.contains("click"), click)
        .when(lower.contains("move_to(") | lower.rlike(r"\bmove\("), move)
        .otherwise(none)
    )


def box_struct(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def box_from_json(text: Column) -> Column:
    """Box from JSON text: a list of four numbers or an object with x1, y1, x2, y2."""
    listed = F.from_json(text, "array<double>")
    keyed = F.from_json(text, "x1 double, y1 double, x2 double, y2 double")
    at = lambda i: F.element_at(listed, i)
    return F.when(text.rlike(r"^\s*\["), F.when(F.size(listed) == 4, box_struct(at(1), at(2), at(3), at(4)))).when(
        text.rlike(r"^\s*\{"), box_struct(*[keyed[k] for k in ("x1", "y1", "x2", "y2")])
    )


def box_area(box: Column) -> Column:
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def is_reasonable(box: Column, width: Column, height: Column) -> Column:
    """Not a container of the whole screen: at most a fifth of the area and 85 % of each side."""
    return (
        (box_area(box) / F.greatest(F.lit(1), width * height).cast("double") <= MAX_AREA_RATIO)
        & (box["x2"] - box["x1"] <= MAX_SIDE_RATIO * width)
        & (box["y2"] - box["y1"] <= MAX_SIDE_RATIO * height)
    )


def contains_point(box: Column, x: Column, y: Column) -> Column:
    return x.between(box["x1"], box["x2"]) & y.between(box["y1"], box["y2"])


def to_image(value: Column, screen: Column, image: Column) -> Column:
    """Screen coordinate to image pixel, clamped inside the image."""
    scale = F.when(F.coalesce(screen, F.lit(0)) == 0, F.lit(1.0)).otherwise(image / screen.cast("double"))
    return F.greatest(F.lit(0.0), F.least(value * scale, F.greatest(F.lit(0), image - 1).cast("double")))


def centered_rect(cx: Column, cy: Column, crop_w: Column, crop_h: Column, img_w: Column, img_h: Column) -> Column:
    """Integer rectangle around a point, shifted to lie inside the image."""
    side = lambda size, image: F.greatest(F.lit(1), F.least(F.bround(size).cast("int"), image))
    start = lambda center, size, image: F.greatest(F.lit(0), F.least(F.bround(center - size / 2).cast("int"), image - size))
    size = F.struct(side(crop_w, img_w).alias("w"), side(crop_h, img_h).alias("h"))
    corner = lambda s: F.struct(
        start(cx, s["w"], img_w).alias("x1"), start(cy, s["h"], img_h).alias("y1"), s["w"].alias("w"), s["h"].alias("h")
    )
    whole = lambda r: F.struct(r["x1"], r["y1"], (r["x1"] + r["w"]).alias("x2"), (r["y1"] + r["h"]).alias("y2"))
    return let(let(size, corner), whole)


def crop_rect(x: Column, y: Column, box: Column, img_w: Column, img_h: Column) -> Column:
    """Zoom rectangle: around the padded box when one was hit, else around the point."""
    padded = lambda low, high, least: F.greatest(F.lit(least), F.bround(box[high] - box[low] + 2 * BOX_PADDING).cast("int"))
    around_box = centered_rect(
        (box["x1"] + box["x2"]) / 2, (box["y1"] + box["y2"]) / 2, padded("x1", "x2", MIN_CROP[0]), padded("y1", "y2", MIN_CROP[1]), img_w, img_h
    )
    around_point = centered_rect(x, y, F.lit(FALLBACK_CROP[0]), F.lit(FALLBACK_CROP[1]), img_w, img_h)
    return F.when(box.isNotNull(), around_box).otherwise(around_point)


def _overlay(x_low: Column, y_low: Column, x_high: Column, y_high: Column, w: Column, h: Column) -> Column:
    edge = lambda v, size: F.bround(F.greatest(F.lit(0.0), F.least(v.cast("double"), (size - 1).cast("double")))).cast("int")
    box = box_struct(edge(x_low, w), edge(y_low, h), edge(x_high, w), edge(y_high, h))
    return let(box, lambda b: F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), b))


def point_overlay(x: Column, y: Column, w: Column, h: Column) -> Column:
    half = F.greatest(F.lit(POINT_HALF_SIZE), F.bround(F.least(w, h) * POINT_SCREEN_RATIO).cast("int"))
    return _overlay(x - half, y - half, x + half, y + half, w, h)


def drag_overlay(sx: Column, sy: Column, ex: Column, ey: Column, w: Column, h: Column) -> Column:
    pad = F.greatest(F.lit(DRAG_MIN_PADDING), F.bround(F.least(w, h) * DRAG_SCREEN_RATIO).cast("int"))
    return _overlay(F.least(sx, ex) - pad, F.least(sy, ey) - pad, F.greatest(sx, ex) + pad, F.greatest(sy, ey) + pad, w, h)


def capture_box(x: Column, y: Column, frame_w: Column, frame_h: Column) -> Column:
    """Box stored with a captured frame: 30 pixels to each side, 20 up and down."""
    low = lambda v, by: F.greatest(F.lit(0.0), v - by).cast("double")
    high = lambda v, by, top: F.least(top.cast("double"), v + by).cast("double")
    return box_struct(low(x, 30), low(y, 20), high(x, 30, frame_w), high(y, 20, frame_h))


def monitor_of_point(x: Column, y: Column, monitors: Column) -> Column:
    """1-based number of the first monitor holding the point; right and lower edges are outside.

    ``monitors`` is the session's array<struct<left,top,width,height>>.
    """
    inside = F.transform(
        monitors,
        lambda m: (x >= m["left"]) & (x < m["left"] + m["width"]) & (y >= m["top"]) & (y < m["top"] + m["height"]),
    )
    return F.nullif(F.array_position(inside, F.lit(True)), F.lit(0))
