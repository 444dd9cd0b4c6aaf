"""Rectangle algebra.  A rectangle is a struct column with x, y, width, height; its origin is the top left corner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x, y, width, height) -> Column:
    names = ("x", "y", "width", "height")
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in zip(names, (x, y, width, height), strict=True)])


def right(r: Column) -> Column:
    return r["x"] + r["width"]


def bottom(r: Column) -> Column:
    return r["y"] + r["height"]


def area(r: Column) -> Column:
    return r["width"] * r["height"]


def half_up(v: Column) -> Column:
    """Rounding of browsers: halves go up, also below zero."""
    return F.floor(v + 0.5).cast("int")


def rounded(r: Column) -> Column:
    return rect(*[half_up(r[k]) for k in ("x", "y", "width", "height")])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is not positive."""
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def overlap(element: Column, visual: Column) -> Column:
    """Share of the visual rectangle that lies in the element."""
    common = intersection(element, visual)
    return F.when((common > 0) & (area(visual) > 0), common / area(visual)).otherwise(F.lit(0.0))


def containment(inner: Column, outer: Column) -> Column:
    return F.when(area(inner) == 0, F.lit(0.0)).otherwise(intersection(inner, outer) / area(inner))


def gap_x(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), b["x"] - right(a), a["x"] - right(b))


def gap_y(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), b["y"] - bottom(a), a["y"] - bottom(b))


def centre_x(r: Column) -> Column:
    return r["x"] + r["width"] / 2


def centre_y(r: Column) -> Column:
    return r["y"] + r["height"] / 2


def bounding(rects: Column) -> Column:
    """Smallest rectangle around an array of rectangles."""
    x, y = F.array_min(rects["x"]), F.array_min(rects["y"])
    return rect(x, y, F.array_max(F.transform(rects, right)) - x, F.array_max(F.transform(rects, bottom)) - y)


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corners, each cut to an integer, as x, y, width, height."""
    a, b = x1.cast("int"), y1.cast("int")
    return rect(a, b, x2.cast("int") - a, y2.cast("int") - b)


def normalised(r: Column, width, height) -> Column:
    """Shares of the image, to four digits, halves to even."""
    return rect(*[F.bround(r[k] / F.lit(n), 4) for k, n in (("x", width), ("y", height), ("width", width), ("height", height))])


def scaled(r: Column, sx, sy) -> Column:
    """Scaled and rounded; sides are at least 1."""
    return rect(half_up(r["x"] * F.lit(sx)), half_up(r["y"] * F.lit(sy)), F.greatest(F.lit(1), half_up(r["width"] * F.lit(sx))), F.greatest(F.lit(1), half_up(r["height"] * F.lit(sy))))


def padded(left: Column, top: Column, r: Column, b: Column, pad_x: Column, pad_y: Column, width: int, height: int) -> Column:
    """A box with padding, clamped to the image."""
    x, y = F.greatest(F.lit(0), F.floor(left - pad_x)).cast("int"), F.greatest(F.lit(0), F.floor(top - pad_y)).cast("int")
    ex, ey = F.least(F.lit(width), F.ceil(r + pad_x)).cast("int"), F.least(F.lit(height), F.ceil(b + pad_y)).cast("int")
    return rect(x, y, F.greatest(F.lit(0), ex - x), F.greatest(F.lit(0), ey - y))


def landmarks_box(xs: Column, ys: Column, width: int, height: int) -> Column:
    """Padded box of a face's landmarks (shares of the image)."""
    left, top, r, b = F.array_min(xs) * width, F.array_min(ys) * height, F.array_max(xs) * width, F.array_max(ys) * height
    return padded(left, top, r, b, F.greatest(F.lit(5.0), (r - left) * 0.16), F.greatest(F.lit(5.0), (b - top) * 0.22), width, height)


def face_box(r: Column, width: int, height: int) -> Column:
    """Padded box of a face detection; null if it is too small, too large or not shaped like a face."""
    aspect = r["width"] / F.greatest(F.lit(1), r["height"])
    bad = (r["width"] < 24) | (r["height"] < 24) | (aspect < 0.48) | (aspect > 1.45) | (r["width"] > width * 0.68) | (r["height"] > height * 0.76)
    box = padded(r["x"], r["y"], right(r), bottom(r), F.greatest(F.lit(4.0), r["width"] * 0.13), F.greatest(F.lit(4.0), r["height"] * 0.18), width, height)
    return F.when(~bad, box)


def line_box(x0: Column, y0: Column, x1: Column, y1: Column, scale: float, off_x: int, off_y: int, width: int, height: int) -> Column:
    """Box of a recognised line in the image, padded by 4 and 3; null if nothing is left of it."""
    x, y = F.greatest(F.lit(0), F.floor(x0 / scale + off_x - 4)).cast("int"), F.greatest(F.lit(0), F.floor(y0 / scale + off_y - 3)).cast("int")
    r, b = F.least(F.lit(width), F.ceil(x1 / scale + off_x + 4)).cast("int"), F.least(F.lit(height), F.ceil(y1 / scale + off_y + 3)).cast("int")
    return F.when((r > x) & (b > y), rect(x, y, r - x, b - y))


#: Pixels of a character where no font is known, and of a font whose size is not.
CHARACTER, FONT_SIZE = 8, 16


def _line(r: Column, style: Column) -> tuple[Column, Column]:
    """Width that a line of an input has, and its height; ``style`` is a struct of left, right, top, bottom, indent, line_height and font_size in pixels, null where unset."""
    part = lambda name: F.coalesce(style[name], F.lit(0.0))
    room = F.greatest(F.lit(1.0), r["width"] - part("left") - part("right") - part("indent") - 4)
    height = F.least(r["height"] - 2.0, F.greatest(F.lit(10.0), F.coalesce(style["line_height"], F.coalesce(style["font_size"], F.lit(FONT_SIZE)) * 1.25)))
    return room, height


def value_box(r: Column, value: Column, multiline: Column, style: Column) -> Column:
    """Box of an input's whole value: the inside of a field of several lines, else its line of text.  A password shows a character for each of its own, so it is as wide as any value of its length."""
    part = lambda name: F.coalesce(style[name], F.lit(0.0))
    room, height = _line(r, style)
    text_width = F.least(room, F.greatest(F.lit(8.0), F.ceil(CHARACTER * F.length(F.coalesce(value, F.lit("")))) + 4.0))
    least_1 = lambda c: F.greatest(F.lit(1), half_up(c))
    inside = rect(half_up(r["x"] + part("left")), half_up(r["y"] + part("top")), least_1(r["width"] - part("left") - part("right")), least_1(r["height"] - part("top") - part("bottom")))
    line = rect(half_up(r["x"] + part("left") + part("indent")), half_up(r["y"] + (r["height"] - height) / 2), least_1(text_width), least_1(height))
    return F.when(multiline, inside).otherwise(line)


def match_box(r: Column, start: Column, end: Column, style: Column) -> Column:
    """Box of the characters from ``start`` (0 first) up to ``end`` of an input's value, within its line."""
    part = lambda name: F.coalesce(style[name], F.lit(0.0))
    room, height = _line(r, style)
    x = r["x"] + part("left") + part("indent") + F.least(CHARACTER * start, room)
    return rect(half_up(x), half_up(r["y"] + (r["height"] - height) / 2), F.greatest(F.lit(1), half_up(F.least(CHARACTER * (end - start) + 4.0, room))), half_up(height))


def zone(target: Column, x: float, y: float, width: float, height: float) -> Column:
    """A fixed share of a target rectangle."""
    return rect(F.greatest(F.lit(0), half_up(target["x"] + target["width"] * x)), F.greatest(F.lit(0), half_up(target["y"] + target["height"] * y)), half_up(target["width"] * width), half_up(target["height"] * height))


def redaction_margin(r: Column) -> Column:
    return F.least(F.lit(8), F.greatest(F.lit(2), half_up(F.least(r["width"], r["height"]) * 0.08)))


def blur_radius(r: Column) -> Column:
    return F.least(F.lit(18), F.greatest(F.lit(4), half_up(F.greatest(r["width"], r["height"]) * 0.08)))


def same_place(a: Column, b: Column, slack: int = 3) -> Column:
    """All four sides within ``slack`` pixels, or b inside a."""
    near = (F.abs(a["x"] - b["x"]) < slack) & (F.abs(a["y"] - b["y"]) < slack) & (F.abs(a["width"] - b["width"]) < slack) & (F.abs(a["height"] - b["height"]) < slack)
    inside = (b["x"] >= a["x"]) & (b["y"] >= a["y"]) & (right(b) <= right(a)) & (bottom(b) <= bottom(a))
    return near | inside


def suppressed(boxes: Column, clash) -> Column:
    """Greedy suppression over an ordered array of structs: a box stays if ``clash(kept, box)`` holds for no kept one."""
    empty = F.slice(boxes, F.lit(1), F.lit(0))
    return F.aggregate(boxes, empty, lambda kept, b: F.when(F.exists(kept, lambda k: clash(k, b)), kept).otherwise(F.array_append(kept, b)))


def any_rect(item: Column, keys=("bounding_box", "boundingBox", "box", "rect")) -> Column:
    """First known shape of a rectangle under the first of the names that is there, from JSON text."""
    shapes = []
    for k in keys:
        v = lambda name, key=k: F.get_json_object(item, f"$.{key}.{name}").try_cast("double")
        shapes += [
            F.when(v("width").isNotNull() & v("height").isNotNull(), rect(v("x"), v("y"), v("width"), v("height"))),
            F.when(v("x2").isNotNull() & v("x").isNotNull(), rect(v("x"), v("y"), v("x2") - v("x"), v("y2") - v("y"))),
            F.when(v("x2").isNotNull() & v("x1").isNotNull(), rect(v("x1"), v("y1"), v("x2") - v("x1"), v("y2") - v("y1"))),
        ]
    return F.coalesce(*shapes)
