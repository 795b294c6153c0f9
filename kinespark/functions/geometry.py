"""Boxes, intervals, bins and frame arithmetic as column expressions.

A box is an array of four doubles x1, y1, x2, y2. Null, short and malformed boxes give the defined result of each
function rather than an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Compass bins, counter-clockwise from east; ordinal scales. Fixed values.
COMPASS = ("E", "NE", "N", "NW", "W", "SW", "S", "SE")
SPEEDS = ("stationary", "slow", "moderate", "fast")
SCALES = ("receding", "stable", "approaching")
IMAGE_FACTOR, MIN_PIXELS, MAX_PIXELS, MAX_RATIO = 28, 4 * 28 * 28, 256 * 28 * 28, 200
FRAME_FACTOR, FPS, FPS_MIN_FRAMES, FPS_MAX_FRAMES = 2, 2.0, 4, 16


def at(box: Column, k: int) -> Column:
    return F.get(box, F.lit(k))


def is_box(box: Column) -> Column:
    return F.coalesce((F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull()), F.lit(False))


def _overlap(a: Column, b: Column) -> tuple[Column, Column]:
    return (F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0)), F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1)))


def signed_area(box: Column) -> Column:
    return (at(box, 2) - at(box, 0)) * (at(box, 3) - at(box, 1))


def area(box: Column) -> Column:
    """Area with negative sides as zero."""
    return F.greatest(F.lit(0.0), at(box, 2) - at(box, 0)) * F.greatest(F.lit(0.0), at(box, 3) - at(box, 1))


def diagonal(box: Column) -> Column:
    return F.sqrt(F.pow(at(box, 2) - at(box, 0), F.lit(2)) + F.pow(at(box, 3) - at(box, 1), F.lit(2)))


def centroid(box: Column) -> Column:
    """(x, y); a box that isn't four numbers has its centroid at the origin."""
    mid = lambda i, j: F.when(is_box(box), (at(box, i) + at(box, j)) / 2).otherwise(F.lit(0.0))
    return F.struct(mid(0, 2).alias("x"), mid(1, 3).alias("y"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without four numbers in both, without a positive overlap, or for an empty union."""
    w, h = _overlap(a, b)
    inter = w * h
    union = signed_area(a) + signed_area(b) - inter
    return F.when(is_box(a) & is_box(b) & (w > 0) & (h > 0) & (union != 0), inter / union).otherwise(F.lit(0.0))


def iou_clamped(a: Column, b: Column) -> Column:
    """Intersection over union with the overlap clamped at 0; 0 unless the union is positive."""
    w, h = _overlap(a, b)
    inter = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    union = signed_area(a) + signed_area(b) - inter
    return F.when(is_box(a) & is_box(b) & (union > 0), inter / union).otherwise(F.lit(0.0))


def best_iou(box: Column, others: Column) -> Column:
    """The largest overlap of a box with an array of boxes; 0 for none."""
    return F.coalesce(F.array_max(F.transform(others, lambda o: iou_clamped(box, o))), F.lit(0.0))


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals over their hull; 0 without overlap."""
    inter = F.least(a1, b1) - F.greatest(a0, b0)
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when((inter > 0) & (hull > 0), inter / hull).otherwise(F.lit(0.0))


def proximity(distance: Column, progress: Column) -> Column:
    """Gaussian closeness whose width narrows from 4 to 1 as progress goes from 0 to three quarters."""
    sigma = F.when(progress < 0.75, 4 * (1 - progress)).otherwise(F.lit(1.0))
    return F.exp(-distance * distance / (2 * sigma * sigma))


def to_pixels(box: Column, width: Column, height: Column) -> Column:
    """A box in 0 to 1 in pixels."""
    return F.array(at(box, 0) * width, at(box, 1) * height, at(box, 2) * width, at(box, 3) * height)


def rescale(box: Column, old: tuple[Column, Column], new: tuple[Column, Column]) -> Column:
    """A box in an image of one size in one of another."""
    return F.array(*[at(box, k) * new[k % 2] / old[k % 2] for k in range(4)])


def from_centre(box: Column, width: Column, height: Column) -> Column:
    """A box of centre and size in thousandths as corners in pixels, truncated and kept within the image."""
    corner = lambda c, s, sign, size: F.greatest(F.lit(0), F.least(((at(box, c) + sign * at(box, s) / 2) / 1000 * size).cast("int"), size.cast("int")))
    return F.array(corner(0, 2, -1, width), corner(1, 3, -1, height), corner(0, 2, 1, width), corner(1, 3, 1, height))


def crop(box: Column, width: Column, height: Column) -> Column:
    """A box truncated to whole pixels within a frame; null if nothing is left."""
    whole = lambda k, size: F.greatest(F.lit(0), F.least(at(box, k).cast("int"), size.cast("int")))
    x1, y1, x2, y2 = whole(0, width), whole(1, height), whole(2, width), whole(3, height)
    return F.when((x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))


def compass(dx: Column, dy: Column) -> Column:
    """The compass bin of a displacement on screen, where y grows downwards."""
    degrees = F.pmod(F.degrees(F.atan2(-dy, dx)), F.lit(360.0))
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.pmod(F.floor((degrees + 22.5) / 45.0), F.lit(8)) + 1).cast("int"))


def speed_bin(speed: Column) -> Column:
    """A speed in object diagonals a second as one of SPEEDS."""
    return F.when(speed < 0.02, "stationary").when(speed < 0.10, "slow").when(speed < 0.30, "moderate").otherwise("fast")


def scale_bin(first: Column, last: Column) -> Column:
    """The change of area as one of SCALES; stable if either area is nothing."""
    change = F.ln(last / first)
    return F.when((first < 1e-9) | (last < 1e-9), "stable").when(change > 0.15, "approaching").when(change < -0.15, "receding").otherwise("stable")


def step_direction(a: Column, b: Column) -> Column:
    """The compass bin between two boxes in pixels; STAT below 2 % of their mean diagonal or 3 pixels."""
    p, q = centroid(a), centroid(b)
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    least = F.greatest(0.02 * (diagonal(a) + diagonal(b)) / 2, F.lit(3.0))
    return F.when(F.sqrt(dx * dx + dy * dy) < least, "STAT").otherwise(compass(dx, dy))


def step_speed(a: Column, b: Column, dt: Column) -> Column:
    """The speed bin between two boxes; stationary without time or size."""
    p, q = centroid(a), centroid(b)
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    size = (diagonal(a) + diagonal(b)) / 2
    return F.when((dt <= 0) | (size < 1e-9), "stationary").otherwise(speed_bin(F.sqrt(dx * dx + dy * dy) / dt / size))


def word_direction(dx: Column, dy: Column) -> Column:
    """A displacement in pixels in words: under 5 both ways is stationary, one axis leads by half, else a diagonal."""
    x, y = F.abs(dx), F.abs(dy)
    side, up = F.when(dx > 0, "right").otherwise("left"), F.when(dy > 0, "down").otherwise("up")
    return F.when((x < 5) & (y < 5), "stationary").when(x > 1.5 * y, side).when(y > 1.5 * x, up).otherwise(F.concat(up, F.lit("-"), side))


def text_direction(dx: Column, dy: Column) -> Column:
    """A mean displacement in image widths in words."""
    x, y = F.abs(dx), F.abs(dy)
    side, up = F.when(dx < 0, "left").otherwise("right"), F.when(dy < 0, "up").otherwise("down")
    both = F.when((x > 0.02) & (y > 0.02), F.concat(up, F.lit("-"), side))
    one = F.when(x > y, F.concat(side, F.lit("ward"))).otherwise(F.concat(up, F.lit("ward")))
    return F.when(F.sqrt(dx * dx + dy * dy) < 0.01, "stationary").otherwise(F.coalesce(both, one))


def direction_score(a: Column, b: Column) -> Column:
    """1 for equal bins, a half for neighbours on the compass, else 0; STAT matches itself only."""
    order = F.array(*map(F.lit, COMPASS))
    i, j = F.array_position(order, a), F.array_position(order, b)
    apart = F.least(F.abs(i - j), 8 - F.abs(i - j))
    return F.when(a == b, 1.0).when((i > 0) & (j > 0) & (apart == 1), 0.5).otherwise(0.0)


def ordinal_score(a: Column, b: Column, order: tuple[str, ...]) -> Column:
    """1 for equal values (known or not), a half for neighbours in `order`, else 0."""
    scale = F.array(*map(F.lit, order))
    i, j = F.array_position(scale, a), F.array_position(scale, b)
    return F.when(a == b, 1.0).when((i > 0) & (j > 0) & (F.abs(i - j) == 1), 0.5).otherwise(0.0)


def relevance(grade: Column) -> Column:
    return F.when(grade == 2, 1.0).when(grade == 1, 0.6).otherwise(0.2)


def quality_word(penalty: Column) -> Column:
    return F.when(penalty < 0.1, "smooth").when(penalty < 0.3, "jerky").otherwise("erratic")


def duration_bucket(frames: Column, fps: Column) -> Column:
    seconds = F.bround(frames / fps, 2)
    return F.when(seconds < 60, "Short").when(seconds < 180, "Medium").otherwise("Long")


def by_factor(value: Column, factor: int, how: str = "round") -> Column:
    """The multiple of a factor that is nearest (half to even), next above or next below."""
    pick = {"round": lambda x: F.bround(x, 0), "ceil": F.ceil, "floor": F.floor}[how]
    return (pick(value / factor) * factor).cast("bigint")


def smart_resize(height: Column, width: Column, factor: int = IMAGE_FACTOR, least: int = MIN_PIXELS, most: int = MAX_PIXELS) -> Column:
    """(h, w), both multiples of `factor`, with as many pixels as allowed; an error for sides over 200 to 1."""
    h = F.greatest(F.lit(factor), by_factor(height, factor))
    w = F.greatest(F.lit(factor), by_factor(width, factor))
    down, up = F.sqrt(height * width / most), F.sqrt(least / (height * width))
    side = lambda plain, x: F.when(h * w > most, by_factor(x / down, factor, "floor")).when(h * w < least, by_factor(x * up, factor, "ceil")).otherwise(plain)
    steep = F.greatest(height, width) / F.least(height, width) > MAX_RATIO
    made = F.struct(side(h, height).alias("h"), side(w, width).alias("w"))
    return F.when(steep, F.raise_error(F.lit("sides differ by more than 200 to 1")).cast("struct<h:bigint,w:bigint>")).otherwise(made)


def smart_frames(total: Column, video_fps: Column, fps: float = FPS, least: int = FPS_MIN_FRAMES, most: int = FPS_MAX_FRAMES) -> Column:
    """The even number of frames to sample at `fps`; an error outside 2 to all frames."""
    low = by_factor(F.lit(least), FRAME_FACTOR, "ceil")
    high = by_factor(F.least(F.lit(most), total), FRAME_FACTOR, "floor")
    n = by_factor(F.least(F.least(F.greatest(total / video_fps * fps, low), high), total), FRAME_FACTOR, "floor")
    return F.when((n >= FRAME_FACTOR) & (n <= total), n).otherwise(F.raise_error(F.lit("too few frames")).cast("bigint"))


def frame_indices(total: Column, video_fps: Column, fps: float = 1.0, most: int = 16) -> Column:
    """The frames to sample: evenly spread ones if there are too many at `fps`, else each interval's first."""
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (total - 1) / (most - 1)).cast("int"))
    step = F.greatest(F.lit(1), (video_fps / fps).cast("int"))
    stride = F.slice(F.sequence(F.lit(0), (total - 1).cast("int"), step), 1, most)
    return F.when((total / video_fps * fps).cast("int") > most, even).otherwise(stride)


def nearest(values: Column, value: Column) -> Column:
    """The smallest distance of a value to those of an array; null for none."""
    return F.array_min(F.transform(values, lambda v: F.abs(v - value)))


def mean(values: Column) -> Column:
    """The mean of an array of doubles, 0 for none."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(F.lit(0.0))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
