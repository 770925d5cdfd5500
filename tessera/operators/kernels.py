"""Geometry that needs a whole point set at once: hull, line simplification, triangulation and its dual."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import TILE
from .overlay import LINES, POINT, POLYGONS, RULES, overlay

POINT_ROWS = "z int, x int, y int, {}"


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(vertices: DataFrame) -> DataFrame:
    """Hull (i, vx, vy) of a tile's vertices, counted with repeats: fewer than three give nothing.

    Spark first keeps, per tile and column of equal vx, only the lowest and highest vertex: no other can be on the hull.
    """
    ends = vertices.groupBy(*TILE, "vx").agg(F.min("vy").alias("lo"), F.max("vy").alias("hi"), F.count(F.lit(1)).alias("n"))

    def hull(key, pdf):
        if pdf.n.sum() < 3:
            return pd.DataFrame(columns=[*TILE, "i", "vx", "vy"])
        pts = sorted({(a, b) for a, lo, hi in zip(pdf.vx, pdf.lo, pdf.hi) for b in (lo, hi)})
        sides = []
        for run in (pts, pts[::-1]):
            side: list = []
            for p in run:
                while len(side) >= 2 and _cross(side[-2], side[-1], p) <= 0:
                    side.pop()
                side.append(p)
            sides += side[:-1] or side
        return pd.DataFrame([(*key, i, *p) for i, p in enumerate(dict.fromkeys(sides))], columns=[*TILE, "i", "vx", "vy"])

    return ends.groupBy(*TILE).applyInPandas(hull, POINT_ROWS.format("i int, vx double, vy double"))


def simplify(df: DataFrame, epsilon: float) -> DataFrame:
    """Lines without the vertices that lie within ``epsilon`` of the chord that replaces them."""

    @F.arrow_udf("array<array<struct<x:double,y:double>>>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([[_thinned([(p["x"], p["y"]) for p in line], epsilon) for line in lines or []] for lines in column.to_pylist()], LINES)

    return df.withColumn("lines", run("lines"))


def _thinned(line: list, epsilon: float) -> list:
    keep, spans = {0, len(line) - 1}, [(0, len(line) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        (ax, ay), (bx, by) = line[a], line[b]
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        far = [(abs(_cross(line[a], line[b], p)) / length if length else ((p[0] - ax) ** 2 + (p[1] - ay) ** 2) ** 0.5) for p in line[a + 1 : b]]
        k = max(range(len(far)), key=far.__getitem__)
        if far[k] > epsilon:
            keep.add(a + 1 + k)
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return [{"x": p[0], "y": p[1]} for i, p in enumerate(line) if i in keep]


def _circle(a, b, c):
    d = 2 * _cross(a, b, c)
    if d == 0:
        return None
    (bx, by), (cx, cy) = (b[0] - a[0], b[1] - a[1]), (c[0] - a[0], c[1] - a[1])
    ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return a[0] + ux, a[1] + uy, ux * ux + uy * uy


def delaunay(points: list) -> list:
    """Triangles (three places) of the different places, by adding them one at a time."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return []
    span = max(max(p[i] for p in pts) - min(p[i] for p in pts) for i in (0, 1)) + 1
    mx, my = pts[len(pts) // 2]
    outer = [(mx - 40 * span, my - 20 * span), (mx + 40 * span, my - 20 * span), (mx, my + 40 * span)]
    cells = {tuple(outer): _circle(*outer)}
    for p in pts:
        bad = [t for t, c in cells.items() if c and (p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2 < c[2] * (1 + 1e-12)]
        edges: dict = {}
        for t in bad:
            del cells[t]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                k = tuple(sorted(e))
                edges[k] = edges.get(k, 0) + 1
        for (a, b), n in edges.items():
            if n == 1 and _cross(a, b, p) != 0:
                cells[(a, b, p)] = _circle(a, b, p)
    return [t for t in cells if not set(t) & set(outer)]


def triangulate(sites: DataFrame) -> DataFrame:
    """Triangles (tri, x0 .. y2) of a tile's sites (vx, vy), corners in order; fewer than three sites give none."""

    def run(key, pdf):
        tris = sorted(tuple(sorted(t)) for t in delaunay(list(zip(pdf.vx.astype(float), pdf.vy.astype(float)))))
        return pd.DataFrame([(*key, i, *(c for p in t for c in p)) for i, t in enumerate(tris)], columns=[*TILE, "tri", "x0", "y0", "x1", "y1", "x2", "y2"])

    return sites.groupBy(*TILE).applyInPandas(run, POINT_ROWS.format("tri int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double"))


def voronoi_cells(sites: list, box: tuple[float, float, float, float]) -> dict:
    """Site -> ring of its cell within ``box`` (x0, y0, x1, y1). Sites are different places.

    A cell starts as the box and is cut by the middle lines to other sites, the nearer first, until none left can reach it:
    that are those further away than twice its farthest corner. Near sites are looked up in squares around it.
    """
    x0, y0, x1, y1 = box
    xs, ys = [p[0] for p in sites], [p[1] for p in sites]
    side = max(max(xs) - min(xs), max(ys) - min(ys), 1e-9) / max(1.0, len(sites) ** 0.5)
    squares: dict = {}
    for p in sites:
        squares.setdefault((int(p[0] // side), int(p[1] // side)), []).append(p)
    widest = int(max(x1 - x0, y1 - y0, max(xs) - min(xs), max(ys) - min(ys)) // side) + 2
    out = {}
    for p in sites:
        ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        cx, cy = int(p[0] // side), int(p[1] // side)
        for k in range(widest + 1):
            # What lies k squares away is further than k - 1 sides.
            if k > 1 and ring and 2 * max(((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2) ** 0.5 for q in ring) < (k - 1) * side:
                break
            edge = [(cx + i, cy + j) for i in range(-k, k + 1) for j in range(-k, k + 1) if max(abs(i), abs(j)) == k]
            near = [q for at in edge for q in squares.get(at, ()) if q != p]
            for q in sorted(near, key=lambda q: (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2):
                ring = _nearer(ring, p, q)
        if len(ring) >= 3:
            out[p] = ring
    return out


def _nearer(ring: list, p, q) -> list:
    """The part of a convex ring that is nearer to ``p`` than to ``q``."""
    nx, ny = q[0] - p[0], q[1] - p[1]
    c = (q[0] ** 2 + q[1] ** 2 - p[0] ** 2 - p[1] ** 2) / 2
    far = [nx * x + ny * y - c for x, y in ring]
    out = []
    for i, (a, fa) in enumerate(zip(ring, far)):
        b, fb = ring[(i + 1) % len(ring)], far[(i + 1) % len(ring)]
        if fa <= 0:
            out.append(a)
        if (fa < 0 < fb) or (fb < 0 < fa):
            t = fa / (fa - fb)
            out.append((a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
    return out


def _half_up(v: float) -> float:
    return math.copysign(math.floor(abs(v) + 0.5), v) if abs(v) >= 0.5 else 0.0


def _place(q: tuple) -> tuple:
    """Rounded to a millionth. The nudge keeps what lies between two, such as 128ths, from going either way by its last bits."""
    return round(q[0] + 3e-9, 6), round(q[1] + 3e-9, 6)


def _sides(cells: dict) -> list:
    """The different edges of cells, as pairs of places rounded to a millionth."""
    found = set()
    for ring in cells.values():
        whole = [_place(q) for q in ring]
        found.update((min(a, b), max(a, b)) for a, b in zip(whole, whole[1:] + whole[:1]) if a != b)
    return sorted(found)


def voronoi(sites: DataFrame, expand: float = 1.0) -> DataFrame:
    """Edges (x0, y0, x1, y1) of the cells of a tile's sites, within the sites' box grown by ``expand``; whole coordinates.

    Cells at the rim are closed along the box. Fewer than three different sites give nothing.
    """

    def run(key, pdf):
        pts = sorted(set(zip(pdf.vx.astype(float), pdf.vy.astype(float))))
        rows = []
        if len(pts) >= 3:
            xs, ys = [p[0] for p in pts], [p[1] for p in pts]
            box = min(xs) - expand, min(ys) - expand, max(xs) + expand, max(ys) + expand
            rows = [tuple(_half_up(c) for p in side for c in p) for side in _sides(voronoi_cells(pts, box))]
        return pd.DataFrame([(*key, *r) for r in sorted(set(rows)) if r[:2] != r[2:]], columns=[*TILE, "x0", "y0", "x1", "y1"])

    return sites.groupBy(*TILE).applyInPandas(run, POINT_ROWS.format("x0 double, y0 double, x1 double, y1 double"))


#: Most shapes a task remembers.
REMEMBERED = 20_000


def _by_shape(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose polygons (and points) are the same but for their place go to one task, which works each shape out once.

    What is filtered by the outcome must not be worked out before the shuffle too: such functions are called nondeterministic.
    """
    from .geometry import SHAPES

    p = F.coalesce(F.col(columns[0]), F.array().cast(SHAPES["polygons"]))
    first = p[0][0][0]
    rings = F.transform(p, lambda q: F.transform(q, lambda r: F.transform(r, lambda v: F.struct(v["x"] - first["x"], v["y"] - first["y"]))))
    rest = [F.transform(F.col(c), lambda v: F.struct(v["x"] - first["x"], v["y"] - first["y"])) for c in columns[1:]]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(rings, *rest))


class _Remembered:
    """``kernel(polygons, points)`` of shapes moved to the corner of their box, once for each of the last shapes.

    Polygons (and points) are arrays of rings; whole distances keep what is rounded as it is. Shapes with a coordinate
    below zero, where halves are rounded the other way, stay where they are.
    """

    def __init__(self, kernel):
        self.kernel, self.known = kernel, {}

    def __call__(self, polygons: list, points: list = ()) -> tuple:
        """What the kernel finds, and how far it is to be moved."""
        own = [[[(p["x"], p["y"]) for p in ring] for ring in polygon] for polygon in polygons or []]
        more = [(p["x"], p["y"]) for p in points or []]
        places = [p for polygon in own for ring in polygon for p in ring] + more
        if not places:
            return self.kernel(own, more), 0.0, 0.0
        dx, dy = (float(max(0, math.floor(min(p[k] for p in places)))) for k in (0, 1))
        move = lambda ring: tuple((x - dx, y - dy) for x, y in ring)
        key = tuple(tuple(map(move, polygon)) for polygon in own), move(more)
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                del self.known[next(iter(self.known))]
            self.known[key] = self.kernel([list(map(list, polygon)) for polygon in key[0]], list(key[1]))
        return self.known[key], dx, dy


def _moved(ring: list, dx: float, dy: float) -> list:
    return [{"x": x + dx, "y": y + dy} for x, y in ring]


def voronoi_fracture(df: DataFrame, seeds: str = "seeds", aspect: float = 1.0) -> DataFrame:
    """(other columns, site, polygons): each feature's polygons cut into the cells of its ``seeds`` (array of points).

    Vertical distance counts ``aspect`` times. A cell that a polygon cuts in several pieces holds them all. Polygons of
    features with fewer than three different seeds give nothing.
    """
    if not aspect > 0:
        return df.where(F.lit(False)).withColumn("site", F.lit(None).cast("struct<x:double,y:double>")).drop(seeds)

    def pieces(polygons, own) -> list:
        up = {(x, _half_up(y * aspect)): (x, y) for x, y in reversed(own)}
        if len(up) < 3:
            return []
        out: dict = {}
        for polygon in polygons:
            tall = [np.array(r, float).reshape(-1, 2) * [1.0, aspect] for r in polygon]
            low, high = tall[0].min(0) - 2, tall[0].max(0) + 2
            for site, ring in sorted(voronoi_cells(sorted(up), (*low, *high)).items()):
                found = overlay([tall], [[np.array(ring)]], RULES["intersection"])
                flat = [[[(x, _half_up(y / aspect)) for x, y in r.tolist()] for r in piece] for piece in found]
                if flat:
                    out.setdefault(up[site], []).extend(flat)
        return sorted(out.items())

    place = "struct<x:double,y:double>"
    kind = pa.list_(pa.struct([("site", POINT), ("polygons", POLYGONS)]))
    # Only undistorted shapes may be moved: else heights are rounded where they are.
    known = _Remembered(pieces) if aspect == 1 else lambda polygons, own: (pieces(_pairs(polygons or []), [(p["x"], p["y"]) for p in own or []]), 0.0, 0.0)

    def placed(found: list, dx: float, dy: float) -> list:
        return [{"site": {"x": x + dx, "y": y + dy}, "polygons": [[_moved(r, dx, dy) for r in polygon] for polygon in polygons]} for (x, y), polygons in found]

    @F.arrow_udf(f"array<struct<site:{place},polygons:array<array<array<{place}>>>>>")
    def cut(polygons: pa.Array, own: pa.Array) -> pa.Array:
        return pa.array([placed(*known(p, s)) for p, s in zip(polygons.to_pylist(), own.to_pylist())], kind)

    rest = [c for c in df.columns if c not in ("points", "lines", "polygons", seeds)]
    df = _by_shape(df, "polygons", seeds)
    return df.select(*rest, F.explode(cut("polygons", seeds)).alias("piece")).select(*rest, "piece.site", "piece.polygons")


def _densified(ring: list, step: float) -> list:
    out = []
    for a, b in zip(ring, ring[1:] + ring[:1]):
        n = max(1, math.ceil(math.dist(a, b) / step))
        out += [(a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n) for k in range(n)]
    return out


def _axis(rings: list, step: float, shortest: float) -> list:
    """Polylines in the middle of a polygon."""
    sites = sorted({(_half_up(x), _half_up(y)) for r in rings for x, y in _densified(r, step)})
    if len(sites) < 4:
        return []
    xs, ys = [p[0] for p in sites], [p[1] for p in sites]
    cells = voronoi_cells(sites, (min(xs) - 4 * step, min(ys) - 4 * step, max(xs) + 4 * step, max(ys) + 4 * step))
    # A corner of a cell is as far from its own site as from any.
    radius: dict = {}
    for site, ring in cells.items():
        for q in ring:
            k = _place(q)
            radius[k] = min(radius.get(k, math.inf), math.dist(q, site))
    inside = {q for q, r in radius.items() if r >= 0.9 * step and _within(rings, q)}
    near: dict = {}
    for a, b in _sides(cells):
        if a in inside and b in inside:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    used, out = set(), []
    for start in sorted(near, key=lambda q: (len(near[q]) == 2, q)):
        for b in sorted(near[start]):
            if (start, b) in used:
                continue
            path = [start, b]
            used |= {(start, b), (b, start)}
            while len(near[path[-1]]) == 2 and path[-1] != start:
                follow = [q for q in near[path[-1]] if (path[-1], q) not in used]
                if not follow:
                    break
                used |= {(path[-1], follow[0]), (follow[0], path[-1])}
                path.append(follow[0])
            if sum(map(math.dist, path, path[1:])) >= shortest:
                whole = [(_half_up(x), _half_up(y)) for x, y in path]
                out.append([p for i, p in enumerate(whole) if i == 0 or p != whole[i - 1]])
    return [line for line in out if len(line) > 1]


def _within(rings: list, q) -> bool:
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > q[1]) != (by > q[1]) and q[0] < ax + (q[1] - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def _pairs(polygons) -> list:
    return [[[(float(p["x"]), float(p["y"])) for p in ring] for ring in polygon] for polygon in polygons]


def medial_axis(df: DataFrame, densify: float = 6.0, shortest: float = 0.0) -> DataFrame:
    """Lines in the middle of each feature's polygons, in place of these: cell edges of points along the outline.

    Only edges well inside count, with both ends at least 0.9 of a step from the outline; they are chained between places
    where more than two meet, and chains below ``shortest`` dropped. Features without any line go.
    """

    known = _Remembered(lambda polygons, _: [line for rings in polygons if rings and len(rings[0]) >= 3 for line in _axis(rings, densify, shortest)])

    def placed(lines: list, dx: float, dy: float) -> list:
        return [_moved(line, dx, dy) for line in lines]

    @F.arrow_udf("array<array<struct<x:double,y:double>>>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([placed(*known(p)) for p in column.to_pylist()], LINES)

    if densify <= 0:
        return df.where(F.lit(False)).withColumn("lines", F.array().cast("array<array<struct<x:double,y:double>>>")).drop("polygons", "points")
    return _by_shape(df, "polygons").withColumn("lines", run.asNondeterministic()("polygons")).drop("polygons", "points").where(F.size("lines") > 0)


def _outline_distance(rings: list, x: float, y: float) -> float:
    """Distance to the outline, below zero outside."""
    best = math.inf
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            dx, dy = bx - ax, by - ay
            t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            best = min(best, math.hypot(x - ax - dx * t, y - ay - dy * t))
    return best if _within(rings, (x, y)) else -best


def _pole(rings: list, precision: float) -> tuple | None:
    """Squares that may still hold a better place than the best so far by ``precision`` are split, the most promising first."""
    if not rings or not rings[0]:
        return None
    ox, oy = rings[0][0]
    rings = [[(x - ox, y - oy) for x, y in r] for r in rings]
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    side = min(max(xs) - min(xs), max(ys) - min(ys))
    if side == 0:
        return _half_up(min(xs) + ox), _half_up(min(ys) + oy)
    queue: list = []

    def push(x: float, y: float, h: float) -> tuple:
        d = _outline_distance(rings, x, y)
        heapq.heappush(queue, (-(d + h * math.sqrt(2)), x, y, h, d))
        return d, x, y

    twice = sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(rings[0], rings[0][1:] + rings[0][:1]))
    best = (-math.inf, 0.0, 0.0)
    if twice:
        mid = [sum((a[k] + b[k]) * (a[0] * b[1] - b[0] * a[1]) for a, b in zip(rings[0], rings[0][1:] + rings[0][:1])) / (3 * twice) for k in (0, 1)]
        best = (_outline_distance(rings, *mid), *mid)
    h = side / 2
    for i in range(math.ceil((max(xs) - min(xs)) / side)):
        for j in range(math.ceil((max(ys) - min(ys)) / side)):
            push(min(xs) + i * side + h, min(ys) + j * side + h, h)
    while queue:
        most, x, y, h, d = heapq.heappop(queue)
        if d > best[0]:
            best = (d, x, y)
        if -most - best[0] <= precision:
            break
        for sx in (-h / 2, h / 2):
            for sy in (-h / 2, h / 2):
                push(x + sx, y + sy, h / 2)
    return _half_up(best[1] + ox), _half_up(best[2] + oy)


def polylabel(df: DataFrame, precision: float = 1.0) -> DataFrame:
    """Points inside each polygon furthest from its outline, holes included, found to within ``precision``."""

    known = _Remembered(lambda polygons, _: [p for rings in polygons if (p := _pole(rings, precision))])

    @F.arrow_udf("array<struct<x:double,y:double>>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([_moved(*known(polygons)) for polygons in column.to_pylist()], pa.list_(POINT))

    return _by_shape(df, "polygons").withColumn("points", run.asNondeterministic()("polygons")).drop("polygons", "lines").where(F.size("points") > 0)
