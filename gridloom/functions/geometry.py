"""Boxes as column expressions: geometry, size classes, conversions, overlap. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.schemas import CLASSES, FIRST_CLASS, TOLERANCE

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The columns xmin, ymin, xmax, ymax, perhaps of an alias."""
    x0, y0, x1, y1 = (F.col(f"{prefix}{c}") for c in ("xmin", "ymin", "xmax", "ymax"))
    return x0, y0, x1, y1


def relative_area(b: Box, width: Column, height: Column) -> Column:
    x0, y0, x1, y1 = b
    return ((x1 - x0) * (y1 - y0)).cast("double") / (width * height).cast("double")


def size_class(area: Column) -> Column:
    """Below a hundredth of the image small, up to a twentieth medium, else large."""
    return F.when(area < 0.01, "small").when(area <= 0.05, "medium").otherwise("large")


def size_class_cut(area: Column) -> Column:
    """The same bounds, each closed on the right and null outside (0, 1]: a hundredth exactly is small here."""
    return F.when((area > 0) & (area <= 0.01), "small").when((area > 0.01) & (area <= 0.05), "medium").when((area > 0.05) & (area <= 1), "large")


def is_valid(b: Box, width: Column, height: Column) -> Column:
    """Has an area and lies inside the image."""
    x0, y0, x1, y1 = b
    return (x0 >= 0) & (x0 < x1) & (x1 <= width) & (y0 >= 0) & (y0 < y1) & (y1 <= height)


def known_class(class_id: Column) -> Column:
    return class_id.between(FIRST_CLASS, FIRST_CLASS + CLASSES - 1)


def to_normalised(b: Box, width: Column, height: Column) -> dict[str, Column]:
    """Centre and size as shares of the image."""
    x0, y0, x1, y1 = b
    w, h = width.cast("double"), height.cast("double")
    return {"x_center": (x0 + x1).cast("double") / 2 / w, "y_center": (y0 + y1).cast("double") / 2 / h, "width": (x1 - x0).cast("double") / w, "height": (y1 - y0).cast("double") / h}


def to_normalised_strict(b: Box, class_id: Column, width: Column, height: Column) -> dict[str, Column]:
    """As to_normalised, with the class counted from 0; boxes and classes that don't fit raise an error."""
    fits = (width > 0) & (height > 0) & is_valid(b, width, height) & known_class(class_id)
    said = F.concat_ws(" ", F.lit("box or class outside its range:"), *(c.cast("string") for c in (class_id, *b, width, height)))
    guard = F.when(~F.coalesce(fits, F.lit(False)), F.raise_error(said).cast("long")).otherwise(class_id - FIRST_CLASS)
    return {"class_id": guard} | to_normalised(b, width, height)


def label_line(class_id: Column, b: dict[str, Column]) -> Column:
    """A line of a label file: class, then four shares with eight decimals."""
    return F.format_string("%d %.8f %.8f %.8f %.8f", class_id, b["x_center"], b["y_center"], b["width"], b["height"])


def from_normalised(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Corners in pixels, clamped into the image."""
    inside = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return {"xmin": inside(x - w / 2) * width, "ymin": inside(y - h / 2) * height, "xmax": inside(x + w / 2) * width, "ymax": inside(y + h / 2) * height}


def in_unit_square(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The box ends inside the image, but for rounding."""
    return (x - w / 2 >= -TOLERANCE) & (y - h / 2 >= -TOLERANCE) & (x + w / 2 <= 1 + TOLERANCE) & (y + h / 2 <= 1 + TOLERANCE)


def clamped(b: Box, width: Column, height: Column) -> dict[str, Column]:
    """Corners moved into the image."""
    return {c: F.least(F.greatest(v.cast("double"), F.lit(0.0)), edge.cast("double")) for c, v, edge in zip(("xmin", "ymin", "xmax", "ymax"), b, (width, height, width, height), strict=True)}


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where there is no union."""
    ax0, ay0, ax1, ay1 = (c.cast("double") for c in a)
    bx0, by0, bx1, by1 = (c.cast("double") for c in b)
    zero = F.lit(0.0)
    both = F.greatest(zero, F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(zero, F.least(ay1, by1) - F.greatest(ay0, by0))
    area = lambda x0, y0, x1, y1: F.greatest(zero, x1 - x0) * F.greatest(zero, y1 - y0)
    union = area(ax0, ay0, ax1, ay1) + area(bx0, by0, bx1, by1) - both
    return F.when(union > 0, both / union).otherwise(zero)
