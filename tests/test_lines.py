"""Boundary lines and their simplification against walks along the sides, one by one."""

import random

import numpy as np
import pytest
from test_shapes import image_rows

from brindle.operators import lines


def walked(a):
    """Lines as lists of corners, walked from every junction and then around loops."""
    near = {}
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            for other, p, q in (((y, x + 1), (y, x + 1), (y + 1, x + 1)), ((y + 1, x), (y + 1, x), (y + 1, x + 1))):
                if other[0] < a.shape[0] and other[1] < a.shape[1] and a[y, x] != a[other]:
                    near.setdefault(p, set()).add(q)
                    near.setdefault(q, set()).add(p)
    seen, out = set(), []

    def walk(p, q):
        line = [p, q]
        seen.update({(p, q), (q, p)})
        while line[-1] != p and len(near[line[-1]]) == 2:
            line.append(next(iter(near[line[-1]] - {line[-2]})))
            seen.update({(line[-2], line[-1]), (line[-1], line[-2])})
        out.append((line[0] == line[-1], line[:-1] if line[0] == line[-1] else line))

    for only_junctions in (True, False):
        for p in sorted(near):
            for q in sorted(near[p]):
                if (p, q) not in seen and (len(near[p]) != 2 or not only_junctions):
                    walk(p, q)
    return sorted(out)


def as_lists(df):
    found = {}
    for r in df.collect():
        found.setdefault((r.image_id, r.line, r.closed), {})[r.at] = (r.y, r.x)
    return found


def cut(points, tolerance):
    (ay, ax), (by, bx) = points[0], points[-1]
    dy, dx = by - ay, bx - ax
    chord = dy * dy + dx * dx
    off = [abs(dy * (x - ax) - dx * (y - ay)) if chord else (y - ay) ** 2 + (x - ax) ** 2 for y, x in points]
    inner = range(1, len(points) - 1)
    k = max(inner, key=lambda i: (off[i], -i), default=None)
    if k is None or off[k] <= (tolerance * np.sqrt(float(chord)) if chord else tolerance**2):
        return [points[0], points[-1]]
    return cut(points[: k + 1], tolerance)[:-1] + cut(points[k:], tolerance)


def fewer(closed, line, tolerance):
    if not closed:
        return cut(line, tolerance)
    k = max(range(1, len(line)), key=lambda i: ((line[i][0] - line[0][0]) ** 2 + (line[i][1] - line[0][1]) ** 2, -i))
    return cut(line[: k + 1], tolerance)[:-1] + cut(line[k:] + line[:1], tolerance)[:-1]


@pytest.fixture(scope="module")
def maps():
    r = random.Random(5)
    noise = np.array([[r.randrange(2) for _ in range(13)] for _ in range(11)])
    yy, xx = np.mgrid[:20, :24]
    rings = ((yy - 9) ** 2 + (xx - 11) ** 2) // 30
    spiral = np.zeros((15, 15), int)
    y, x, d = 1, 0, 0
    for n in (13, 12, 12, 10, 10, 8, 8, 6, 6, 4, 4, 2):
        for _ in range(n):
            y, x = y + (0, 1, 0, -1)[d], x + (1, 0, -1, 0)[d]
            spiral[y, x] = 1
        d = (d + 1) % 4
    island = np.zeros((9, 9), int)
    island[2:7, 2:7] = 4
    touching = np.zeros((8, 8), int)
    touching[1:3, 1:3] = touching[3:6, 3:6] = 1
    return {"noise": noise, "rings": rings, "spiral": spiral, "island": island, "touching": touching, "plain": np.ones((3, 4), int), "one": np.ones((1, 1), int)}


@pytest.mark.parametrize("side", [4, 256])
def test_lines_as_walked(spark, maps, side):
    found = as_lists(lines.boundary_lines(image_rows(spark, maps), side))
    for name, a in maps.items():
        ours = sorted((closed, [v[i] for i in range(len(v))]) for (image, _, closed), v in found.items() if image == name)
        assert ours == walked(a), name


def test_each_side_once(spark, maps):
    df = image_rows(spark, maps)
    steps = [(k[0], frozenset(p)) for k, v in as_lists(lines.boundary_lines(df, 3)).items() for p in zip([v[i] for i in range(len(v))], [v[i] for i in range(1, len(v))] + ([v[0]] if k[2] else []), strict=False)]
    assert len(steps) == len(set(steps)) == lines.sides(df).count()


@pytest.mark.parametrize("tolerance", [0.0, 0.9, 2.5])
def test_simplified_as_one_by_one(spark, maps, tolerance):
    drawn = lines.boundary_lines(image_rows(spark, maps))
    found = as_lists(lines.simplified(drawn, tolerance))
    for name, a in maps.items():
        ours = sorted((closed, [v[i] for i in sorted(v)]) for (image, _, closed), v in found.items() if image == name)
        assert ours == sorted((c, fewer(c, p, tolerance)) for c, p in walked(a)), name


def test_no_pixels(spark):
    none = spark.createDataFrame([], "image_id string, y long, x long, region_id long")
    assert lines.simplified(lines.boundary_lines(none), 1.0).count() == 0
