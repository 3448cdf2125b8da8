"""Colour spaces and differences as column expressions, from the published closed forms (sRGB, CIELAB under D65, CIEDE2000)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The sRGB matrix and the D65 white of the 2 degree observer.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.95047, 1.0, 1.08883)


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) of 8-bit sRGB."""
    linear = []
    for c in (r, g, b):
        x = c / 255.0
        linear.append(F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, F.lit(2.4))).otherwise(x / 12.92))
    f = []
    for row, white in zip(TO_XYZ, WHITE, strict=True):
        t = (linear[0] * row[0] + linear[1] * row[1] + linear[2] * row[2]) / white
        f.append(F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116))
    return F.struct((116 * f[1] - 16).alias("l"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b"))


def bound(then: Callable[[Column], Column], **values: Column) -> Column:
    """then(v) with each value as a field of v, computed once however often it is used: without this an expression of
    expressions grows with every step, and so does the code that is generated for it."""
    return F.transform(F.array(F.struct(*(x.alias(k) for k, x in values.items()))), then)[0]


def difference(l1: Column, a1: Column, b1: Column, l2: Column, a2: Column, b2: Column) -> Column:
    """CIEDE2000 with unit weights."""
    p7 = float(25**7)
    cos = lambda x: F.cos(F.radians(x))
    hue = lambda x, y: F.when((x == 0) & (y == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)))

    def stretched(v: Column) -> Column:
        mean_c = F.pow((F.sqrt(v.a1 * v.a1 + v.b1 * v.b1) + F.sqrt(v.a2 * v.a2 + v.b2 * v.b2)) / 2, 7)
        return bound(polar, l1=v.l1, b1=v.b1, l2=v.l2, b2=v.b2, a1=v.a1, a2=v.a2, g=1.5 - 0.5 * F.sqrt(mean_c / (mean_c + p7)))

    def polar(v: Column) -> Column:
        return bound(angles, l1=v.l1, l2=v.l2, b1=v.b1, b2=v.b2, x1=v.g * v.a1, x2=v.g * v.a2)

    def angles(v: Column) -> Column:
        return bound(turned, l1=v.l1, l2=v.l2, c1=F.sqrt(v.x1 * v.x1 + v.b1 * v.b1), c2=F.sqrt(v.x2 * v.x2 + v.b2 * v.b2), h1=hue(v.x1, v.b1), h2=hue(v.x2, v.b2))

    def turned(v: Column) -> Column:
        grey, turn, total = v.c1 * v.c2 == 0, v.h2 - v.h1, v.h1 + v.h2
        dh = F.when(grey, 0.0).when(F.abs(turn) <= 180, turn).when(turn > 180, turn - 360).otherwise(turn + 360)
        mh = F.when(grey, total).when(F.abs(turn) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
        return bound(weighed, dl=v.l2 - v.l1, dc=v.c2 - v.c1, dh=2 * F.sqrt(v.c1 * v.c2) * F.sin(F.radians(dh / 2)), ml=(v.l1 + v.l2) / 2, mc=(v.c1 + v.c2) / 2, mh=mh)

    def weighed(v: Column) -> Column:
        t = 1 - 0.17 * cos(v.mh - 30) + 0.24 * cos(2 * v.mh) + 0.32 * cos(3 * v.mh + 6) - 0.20 * cos(4 * v.mh - 63)
        low, c7 = (v.ml - 50) * (v.ml - 50), F.pow(v.mc, 7)
        twist = -2 * F.sqrt(c7 / (c7 + p7)) * F.sin(F.radians(60 * F.exp(-F.pow((v.mh - 275) / 25, 2))))
        return bound(summed, l=v.dl / (1 + 0.015 * low / F.sqrt(20 + low)), c=v.dc / (1 + 0.045 * v.mc), h=v.dh / (1 + 0.015 * v.mc * t), twist=twist)

    def summed(v: Column) -> Column:
        return F.sqrt(F.greatest(v.l * v.l + v.c * v.c + v.h * v.h + v.twist * v.c * v.h, F.lit(0.0)))

    return bound(stretched, l1=l1, a1=a1, b1=b1, l2=l2, a2=a2, b2=b2)


def lab_sql(r: str, g: str, b: str) -> list[str]:
    """The three parts of lab() for DuckDB."""
    linear = [f"(CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END)" for c in (r, g, b)]
    f = []
    for row, white in zip(TO_XYZ, WHITE, strict=True):
        t = "((" + " + ".join(f"{x} * {m}::DOUBLE" for x, m in zip(linear, row, strict=True)) + f") / {white}::DOUBLE)"
        f.append(f"(CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0::DOUBLE / 3) ELSE 7.787::DOUBLE * {t} + 16.0::DOUBLE / 116 END)")
    return [f"(116 * {f[1]} - 16)", f"(500 * ({f[0]} - {f[1]}))", f"(200 * ({f[1]} - {f[2]}))"]


def difference_steps_sql(source: str, keep: str) -> str:
    """A SELECT for DuckDB that adds de to source(l1, a1, b1, l2, a2, b2, ...), keeping the columns ``keep``."""
    p7 = float(25**7)
    return f"""
SELECT {keep}, sqrt(greatest(pow(dl / sl, 2) + pow(dc / sc, 2) + pow(dhue / sh, 2) + rt * (dc / sc) * (dhue / sh), 0)) AS de FROM (
SELECT *, 1 + 0.015 * pow(ml - 50, 2) / sqrt(20 + pow(ml - 50, 2)) AS sl, 1 + 0.045 * mc AS sc, 1 + 0.015 * mc * (1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) - 0.20 * cos(radians(4 * mh - 63))) AS sh,
 -sin(radians(60 * exp(-pow((mh - 275) / 25, 2)))) * 2 * sqrt(pow(mc, 7) / (pow(mc, 7) + {p7})) AS rt FROM (
SELECT *, l2 - l1 AS dl, c2 - c1 AS dc, (l1 + l2) / 2 AS ml, (c1 + c2) / 2 AS mc,
 2 * sqrt(c1 * c2) * sin(radians((CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END) / 2)) AS dhue,
 CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh FROM (
SELECT *, sqrt(x1 * x1 + b1 * b1) AS c1, sqrt(x2 * x2 + b2 * b2) AS c2,
 CASE WHEN x1 = 0 AND b1 = 0 THEN 0 ELSE (degrees(atan2(b1, x1)) + 360) % 360 END AS h1, CASE WHEN x2 = 0 AND b2 = 0 THEN 0 ELSE (degrees(atan2(b2, x2)) + 360) % 360 END AS h2 FROM (
SELECT *, (1 + g) * a1 AS x1, (1 + g) * a2 AS x2 FROM (
SELECT *, 0.5 * (1 - sqrt(pow(m, 7) / (pow(m, 7) + {p7}))) AS g FROM (
SELECT *, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS m FROM {source}))))))"""


def difference_of(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """CIEDE2000 of Lab colours in the last axis, for steps that run inside a task."""
    l1, a1, b1 = np.moveaxis(np.asarray(one, float), -1, 0)
    l2, a2, b2 = np.moveaxis(np.asarray(other, float), -1, 0)
    mean7 = ((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2) ** 7
    stretch = 1.5 - 0.5 * np.sqrt(mean7 / (mean7 + 25.0**7))
    x1, x2 = a1 * stretch, a2 * stretch
    c1, c2 = np.hypot(x1, b1), np.hypot(x2, b2)
    h1, h2 = (np.degrees(np.arctan2(y, x)) % 360 for x, y in ((x1, b1), (x2, b2)))
    grey = c1 * c2 == 0
    turn = np.where(grey, 0.0, (h2 - h1 + 180) % 360 - 180)
    turn = np.where(~grey & (h2 - h1 == 180), 180.0, turn)
    dh = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn / 2))
    far, total = np.abs(h1 - h2) > 180, h1 + h2
    mean_h = np.where(grey, total, np.where(far, np.where(total < 360, total + 360, total - 360), total) / 2)
    mean_l, mean_c = (l1 + l2) / 2, (c1 + c2) / 2
    wave = 1 - 0.17 * np.cos(np.radians(mean_h - 30)) + 0.24 * np.cos(np.radians(2 * mean_h)) + 0.32 * np.cos(np.radians(3 * mean_h + 6)) - 0.20 * np.cos(np.radians(4 * mean_h - 63))
    low = (mean_l - 50) ** 2
    dl, dc, dh = (l2 - l1) / (1 + 0.015 * low / np.sqrt(20 + low)), (c2 - c1) / (1 + 0.045 * mean_c), dh / (1 + 0.015 * mean_c * wave)
    twist = -2 * np.sqrt(mean_c**7 / (mean_c**7 + 25.0**7)) * np.sin(np.radians(60 * np.exp(-(((mean_h - 275) / 25) ** 2))))
    return np.sqrt(np.maximum(dl**2 + dc**2 + dh**2 + twist * dc * dh, 0))
