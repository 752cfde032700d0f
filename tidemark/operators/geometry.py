"""Face geometry from landmark arrays: boxes, eye-centred coordinates, apertures, gaze, pose, movement.

A landmark column is array<struct<x, y: double>>, normalised to the frame, from index 0; width and height
are the frame's pixels. All functions give columns, null where a point that they need is missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Landmark indices, left and right as the person's own.
LANDMARKS = {
    "left_eye": {"canthi": (362, 263), "lids": ((385, 380), (387, 373))},
    "right_eye": {"canthi": (33, 133), "lids": ((160, 144), (158, 153))},
    "left_brow": (300, 293, 334),
    "right_brow": (70, 63, 105),
    "left_corner": 291,
    "right_corner": 61,
    "upper_lip": 13,
    "lower_lip": 14,
    "left_iris": {"centre": 473, "ring": (474, 475, 476, 477)},
    "right_iris": {"centre": 468, "ring": (469, 470, 471, 472)},
    "movement": (33, 133, 362, 263, 61, 291, 13, 14, 70, 300),
}


class Face:
    """The geometry of one landmark column; the layout of its points can be another than LANDMARKS."""

    def __init__(self, points: Column | str, width: Column | str, height: Column | str, layout: dict = LANDMARKS):
        self.points, self.width, self.height, self.layout = S.col(points), S.col(width), S.col(height), layout

    def pixel(self, index: int) -> tuple[Column, Column]:
        p = F.get(self.points, F.lit(index))
        return p["x"] * self.width, p["y"] * self.height

    def distance(self, a: int, b: int) -> Column:
        (ax, ay), (bx, by) = self.pixel(a), self.pixel(b)
        return F.hypot(bx - ax, by - ay)

    def bounding_box(self) -> Column:
        """struct of the normalised and pixel box and its margin to the frame's edge; null unless every point lies within the frame."""
        xs, ys = F.transform(self.points, lambda p: p["x"]), F.transform(self.points, lambda p: p["y"])
        inside = F.forall(self.points, lambda p: F.coalesce(p["x"].between(0, 1) & p["y"].between(0, 1) & ~F.isnan(p["x"]) & ~F.isnan(p["y"]), F.lit(False)))
        sound = (F.size(self.points) > 0) & inside & (self.width > 0) & (self.height > 0)
        left, right, top, bottom = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
        box = F.struct(
            left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height"), ((right - left) * self.width).alias("width_pixels"), ((bottom - top) * self.height).alias("height_pixels"),
            F.least(left, top, 1 - right, 1 - bottom).alias("edge_margin_fraction"),
        )
        return F.when(sound, box)

    def _middle(self, pair: tuple[int, int]) -> tuple[Column, Column]:
        (ax, ay), (bx, by) = self.pixel(pair[0]), self.pixel(pair[1])
        return (ax + bx) / 2, (ay + by) / 2

    def system(self) -> Column:
        """struct(x, y, scale, angle): the middle between the eyes, their distance in pixels, and the tilt of the line between them."""
        (lx, ly), (rx, ry) = self._middle(self.layout["left_eye"]["canthi"]), self._middle(self.layout["right_eye"]["canthi"])
        scale = F.hypot(lx - rx, ly - ry)
        return F.when(S.finite(scale) & (scale > 0), F.struct(((lx + rx) / 2).alias("x"), ((ly + ry) / 2).alias("y"), scale.alias("scale"), F.atan2(ly - ry, lx - rx).alias("angle")))

    def normalised(self, index: int, system: Column) -> tuple[Column, Column]:
        """A point moved to the middle of the eyes, turned level and scaled by their distance."""
        px, py = self.pixel(index)
        dx, dy, c, s = px - system["x"], py - system["y"], F.cos(system["angle"]), F.sin(system["angle"])
        return (c * dx + s * dy) / system["scale"], (c * dy - s * dx) / system["scale"]

    def _lid_gap(self, eye: str) -> Column:
        pairs = self.layout[eye]["lids"]
        total = F.lit(0.0)
        for upper, lower in pairs:
            total = total + self.distance(upper, lower)
        return total / len(pairs)

    def eye_aperture(self, eye: str) -> Column:
        """Mean lid gap over the eye's own width."""
        width = self.distance(*self.layout[eye]["canthi"])
        return F.when(width > 0, self._lid_gap(eye) / width)

    def fissure(self, eye: str, system: Column) -> Column:
        """struct(width, height) of the opening, in distances between the eyes."""
        width, height = self.distance(*self.layout[eye]["canthi"]) / system["scale"], self._lid_gap(eye) / system["scale"]
        return F.when(S.finite(width) & S.finite(height), F.struct(width.alias("width"), height.alias("height")))

    def mouth_midline_offset(self, system: Column) -> Column:
        return (self.normalised(self.layout["left_corner"], system)[0] + self.normalised(self.layout["right_corner"], system)[0]) / 2

    def mouth_aperture(self) -> Column:
        width = self.distance(self.layout["left_corner"], self.layout["right_corner"])
        return F.when(width > 0, self.distance(self.layout["upper_lip"], self.layout["lower_lip"]) / width)

    def brow_height(self, brow: str, system: Column) -> Column:
        """Mean height of the brow's points over the line of the eyes."""
        points = self.layout[brow]
        total = F.lit(0.0)
        for index in points:
            total = total - self.normalised(index, system)[1]
        return total / len(points)

    def iris(self, side: str, system: Column) -> Column:
        """struct(gaze_x, gaze_y, diameter): the iris centre from the middle of the canthi; null without iris points or with a collapsed ring."""
        centre, ring = self.layout[f"{side}_iris"]["centre"], self.layout[f"{side}_iris"]["ring"]
        (cx, cy), (ax, ay), (bx, by) = (self.normalised(k, system) for k in (centre, *self.layout[f"{side}_eye"]["canthi"]))
        total = F.lit(0.0)
        for index in ring:
            total = total + self.distance(centre, index)
        diameter = 2 * total / len(ring) / system["scale"]
        return F.when(S.finite(diameter) & (diameter > 0), F.struct((cx - (ax + bx) / 2).alias("gaze_x"), (cy - (ay + by) / 2).alias("gaze_y"), diameter.alias("diameter")))

    def movement_points(self, system: Column) -> Column:
        """The points whose movement is followed, normalised; null if one is missing."""
        points = [self.normalised(k, system) for k in self.layout["movement"]]
        known = F.lit(True)
        for x, y in points:
            known = known & x.isNotNull() & y.isNotNull()
        return F.when(known, F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points]))


def pose(matrix: Column | str, rows: int = 4) -> Column:
    """struct(yaw_degrees, pitch_degrees, roll_degrees) of a column-major transform (array<double>), its scale taken out; at a gimbal lock pitch is 0."""
    m = S.col(matrix)
    at = lambda r, c: F.get(m, F.lit(c * rows + r))

    def unit(c: int) -> list[Column]:
        length = F.sqrt(at(0, c) * at(0, c) + at(1, c) * at(1, c) + at(2, c) * at(2, c))
        return [F.when(length > 0, at(r, c) / length).otherwise(at(r, c)) for r in range(3)]

    x, y, z = unit(0), unit(1), unit(2)
    yaw = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -x[2])))
    free = F.abs(F.cos(yaw)) > 1e-6
    pitch, roll = F.when(free, F.atan2(y[2], z[2])).otherwise(0.0), F.when(free, F.atan2(x[1], x[0])).otherwise(F.atan2(-y[0], y[1]))
    known = S.finite(x[0]) & S.finite(x[1]) & S.finite(x[2]) & S.finite(y[2]) & S.finite(z[2])
    return F.when(known, F.struct(F.degrees(yaw).alias("yaw_degrees"), F.degrees(pitch).alias("pitch_degrees"), F.degrees(roll).alias("roll_degrees")))


def movement_speed(df: DataFrame, keys: list[str], order: list[str], points: str, at_ms: str, name: str = "regional_movement_speed") -> DataFrame:
    """Mean displacement of the points since the row before, per second; null for the first, for missing points and where time does not ascend."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, elapsed = F.lag(points).over(w), (F.col(at_ms) - F.lag(at_ms).over(w)) / 1000
    marked = df.withColumns({"points_before": before, "elapsed_s": elapsed})
    moved = F.aggregate(F.zip_with(F.col(points), F.col("points_before"), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])), F.lit(0.0), lambda s, d: s + d)
    sound = (F.col("elapsed_s") > 0) & (F.size("points_before") == F.size(points)) & (F.size(points) > 0)
    return marked.withColumn(name, F.when(sound, moved / F.size(points) / F.col("elapsed_s"))).drop("points_before", "elapsed_s")


def rotation(yaw: float, pitch: float, roll: float) -> list[float]:
    """The column-major transform of a pose in degrees; the inverse of pose(), for fixtures."""
    a, b, c = (math.radians(v) for v in (pitch, yaw, roll))
    m = [
        [math.cos(c) * math.cos(b), math.cos(c) * math.sin(b) * math.sin(a) - math.sin(c) * math.cos(a), math.cos(c) * math.sin(b) * math.cos(a) + math.sin(c) * math.sin(a), 0.0],
        [math.sin(c) * math.cos(b), math.sin(c) * math.sin(b) * math.sin(a) + math.cos(c) * math.cos(a), math.sin(c) * math.sin(b) * math.cos(a) - math.cos(c) * math.sin(a), 0.0],
        [-math.sin(b), math.cos(b) * math.sin(a), math.cos(b) * math.cos(a), 0.0],
        [0.0, 0.0, 0.0, 1.0],
    ]
    return [m[r][k] for k in range(4) for r in range(4)]
