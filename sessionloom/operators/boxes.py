"""Detected boxes: normalization, and which box an action points at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import geometry


def normalize_boxes(df: DataFrame, raw: Column, width: int, height: int, name: str = "box") -> DataFrame:
    """Add a pixel box: fractions scaled, corners sorted, clamped to the image; null when empty or incomplete.

    Written as a chain of projections, so that every intermediate value is computed once in generated code.
    """
    corners = ("x1", "y1", "x2", "y2")
    df = df.withColumns({f"_{c}": raw[c].cast("double") for c in corners})
    relative = F.greatest(*[F.abs(f"_{c}") for c in corners]) <= geometry.RELATIVE_LIMIT
    df = df.withColumns(
        {"_sx": F.when(relative, float(width)).otherwise(1.0), "_sy": F.when(relative, float(height)).otherwise(1.0)}
    )
    df = df.withColumns({f"_{c}": F.col(f"_{c}") * F.col("_sx" if c[0] == "x" else "_sy") for c in corners})
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(v, F.lit(float(top))))
    df = df.withColumns(
        {
            "_left": clamp(F.least("_x1", "_x2"), width),
            "_right": clamp(F.greatest("_x1", "_x2"), width),
            "_top": clamp(F.least("_y1", "_y2"), height),
            "_bottom": clamp(F.greatest("_y1", "_y2"), height),
        }
    )
    complete = F.lit(True)
    for c in corners:
        complete = complete & F.col(f"_{c}").isNotNull()
    box = geometry.box_struct(F.col("_left"), F.col("_top"), F.col("_right"), F.col("_bottom"))
    usable = complete & (F.col("_right") > F.col("_left")) & (F.col("_bottom") > F.col("_top"))
    return df.withColumn(name, F.when(usable, box)).drop(*[f"_{c}" for c in corners], "_sx", "_sy", "_left", "_right", "_top", "_bottom")


def layout_items(answers: DataFrame, width: int, height: int) -> DataFrame:
    """Items of a layout recogniser's answers: index, label, box, content, native_label; items that are no objects or have no usable box are left out.

    answers: any columns and `value`, a JSON object with the list parsed_content. Content that is no text stays as JSON; anything but text is an image.
    """
    rest = [c for c in answers.columns if c != "value"]
    items = F.try_variant_get(F.try_parse_json("value"), "$.parsed_content", "array<variant>")
    rows = answers.select(*rest, F.posexplode(items).alias("index", "_v")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    part = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind)
    content = part("content", "variant")
    kind = F.schema_of_variant(content)
    native = F.coalesce(part("type", "string"), F.lit("unknown"))
    rows = rows.withColumns({
        "native_label": native, "label": F.when(native == "text", "text").otherwise("image"), "_raw": geometry.box_from_json(F.to_json(part("bbox", "variant"))),
        "content": F.when(kind == "VOID", F.lit(None)).when(kind == "STRING", part("content", "string")).otherwise(F.to_json(content)),
    })
    return normalize_boxes(rows, F.col("_raw"), width, height).where(F.col("box").isNotNull()).drop("_v", "_raw")


def smallest_box(points: DataFrame, candidates: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """Each point with the smallest sensible box of its image that contains it, or null.

    points: key, px, py.  candidates: key, box (pixels), entry (order of detection; breaks ties).
    One equi-join and one aggregate on the same key: no pair survives past the partial aggregate.
    """
    box = F.col("box")
    hit = geometry.is_reasonable(box, F.lit(width), F.lit(height)) & geometry.contains_point(box, F.col("px"), F.col("py"))
    rank = F.when(hit, F.struct(geometry.box_area(box), "entry"))
    return points.join(candidates, key, "left").groupBy(*points.columns).agg(F.min_by("box", rank).alias("box"))
