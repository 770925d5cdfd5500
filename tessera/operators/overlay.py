"""Set operations on polygons, buffers and stitching.

Spark deals polygons by tile (or by feature) and a small kernel overlays each group: all edges are split where they meet,
and a piece of an edge belongs to the result's outline if the place just left of it is inside and that just right is not.
Where all edges are parallel to the axes, places are counted on the grid of their coordinates instead, which is linear in it.
Polygons that are the same in a tile are first made one by Spark (by parity those that are there twice are none).
With ``cells`` > 1 a tile is cut into that many squares a side first, which bounds a group; the result is the same area, cut
along the squares' sides. Whole coordinates are rounded half away from zero; rings that lose their area are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clipping import clip_polygons, tidy_polygons
from .geometry import EXTENT, SHAPES, _segments, disc, point, shape, stitched
from .grid import TILE, tasks

#: Arrow's names for shapes. Nested arrays go to Python as Arrow: their way to pandas breaks where a batch has only empty ones.
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
LINES = pa.list_(pa.list_(POINT))
POLYGONS = pa.list_(LINES)
#: How far beside an edge a place is tested, and how near two places count as one.
BESIDE, SAME = 1e-4, 1e-7
#: Most cells of a grid of coordinates.
GRID = 1 << 24
RULES = {
    "union": lambda a, b: a | b,
    "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "symmetric-difference": lambda a, b: a ^ b,
    "xor": lambda a, b: a ^ b,
}


def area2(ring: np.ndarray) -> float:
    """Twice the signed area."""
    x, y = ring[:, 0], ring[:, 1]
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1))


def _edges(polygons: list[list[np.ndarray]], wound: bool) -> np.ndarray:
    """(n, 4) edges; ``wound``: exteriors one way, holes the other."""
    out = []
    for rings in polygons:
        for i, ring in enumerate(rings):
            if len(ring) >= 3:
                r = ring[::-1] if wound and (area2(ring) > 0) != (i == 0) else ring
                out.append(np.hstack([r, np.roll(r, -1, axis=0)]))
    return np.concatenate(out) if out else np.empty((0, 4))


def _winding(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How often the edges go around each place, with sign."""
    out = np.zeros(len(x), int)
    for s in range(0, len(x), 2048):
        px, py = x[s : s + 2048, None], y[s : s + 2048, None]
        up = (edges[:, 1] <= py) & (edges[:, 3] > py)
        down = (edges[:, 3] <= py) & (edges[:, 1] > py)
        side = (edges[:, 2] - edges[:, 0]) * (py - edges[:, 1]) - (px - edges[:, 0]) * (edges[:, 3] - edges[:, 1])
        out[s : s + 2048] = (up & (side > 0)).sum(1) - (down & (side < 0)).sum(1)
    return out


def _split(edges: np.ndarray) -> np.ndarray:
    """The edges cut where they meet, each piece once and without direction.

    A crossing is computed once for both edges, so that their pieces end at the same place.
    """
    d = edges[:, 2:] - edges[:, :2]
    cuts: list[list[tuple]] = [[(0.0, *e[:2]), (1.0, *e[2:])] for e in edges.tolist()]
    for s in range(0, len(edges), 512):
        a, u = edges[s : s + 512, None, :2], d[s : s + 512, None, :]
        gap = edges[None, :, :2] - a
        cross = u[..., 0] * d[None, :, 1] - u[..., 1] * d[None, :, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[..., 0] * d[None, :, 1] - gap[..., 1] * d[None, :, 0]) / cross
            v = (gap[..., 0] * u[..., 1] - gap[..., 1] * u[..., 0]) / cross
        later = np.arange(len(edges))[None, :] > np.arange(s, s + len(a))[:, None]
        for i, j in zip(*np.nonzero(later & (cross != 0) & (t > 0) & (t < 1) & (v > 0) & (v < 1))):
            place = np.round(edges[s + i, :2] + d[s + i] * t[i, j], 6).tolist()
            cuts[s + i].append((t[i, j], *place))
            cuts[j].append((v[i, j], *place))
        # Ends of other edges that lie on an edge.
        size = (u * u).sum(-1)
        off = np.abs(gap[..., 0] * u[..., 1] - gap[..., 1] * u[..., 0])
        along = (gap * u).sum(-1) / size
        for i, j in zip(*np.nonzero((off <= SAME * np.sqrt(size)) & (along > 0) & (along < 1))):
            cuts[s + i].append((along[i, j], *edges[j, :2].tolist()))
    pieces = set()
    for ts in cuts:
        places = [(round(x, 6), round(y, 6)) for _, x, y in sorted(ts)]
        pieces.update((min(p, q), max(p, q)) for p, q in zip(places[:-1], places[1:]) if p != q)
    return np.array([(*p, *q) for p, q in sorted(pieces)]).reshape(-1, 4)


def _rings(edges: np.ndarray) -> list[np.ndarray]:
    """Directed edges, the inside on their left, chained to rings that touch themselves nowhere."""
    leaving: dict[tuple, list[tuple]] = {}
    for x0, y0, x1, y1 in edges.tolist():
        leaving.setdefault((x0, y0), []).append((x1, y1))
    out = []
    for start in sorted(leaving):
        while leaving[start]:
            path, at = [start], leaving[start].pop()
            while at != start and leaving.get(at):
                back = math.atan2(path[-1][1] - at[1], path[-1][0] - at[0])
                turn = lambda q, p=at, b=back: (b - math.atan2(q[1] - p[1], q[0] - p[0])) % (2 * math.pi) or 2 * math.pi
                here = leaving[at]
                follow = min(here, key=turn)
                here.remove(follow)
                path.append(at)
                at = follow
            if at == start:
                out += _simple(path)
    return out


def _parted(path: list) -> list[list]:
    """A ring as rings without repeated places."""
    if len(set(path)) == len(path):
        return [path]
    seen, out, stack = {}, [], []
    for p in path:
        if p in seen:
            k = seen[p]
            out.append(stack[k:])
            for q in stack[k + 1 :]:
                del seen[q]
            del stack[k + 1 :]
        else:
            seen[p] = len(stack)
            stack.append(p)
    return [*out, stack]


def _simple(path: list[tuple]) -> list[np.ndarray]:
    """A ring as rings without repeated places, without places on straight stretches."""
    found = []
    for ring in _parted(path):
        r = np.array(ring)
        if len(r) >= 3:
            before, after = r - np.roll(r, 1, axis=0), np.roll(r, -1, axis=0) - r
            bend = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0])
            found.append(r[bend > 1e-6 * np.hypot(*before.T) * np.hypot(*after.T)])
    return [r for r in found if len(r) >= 3]


def overlay(a: list[list[np.ndarray]], b: list[list[np.ndarray]], rule, wound: bool = False) -> list[list[np.ndarray]]:
    """Polygons (exterior, holes ...) of the places where ``rule(in a, in b)``, with whole coordinates.

    Places are inside by even and odd crossings, or with ``wound`` if any polygon's interior covers them.
    """
    return _overlaid(_edges(a, wound), _edges(b, wound), rule, wound)


def _overlaid(ea: np.ndarray, eb: np.ndarray, rule, wound: bool) -> list[list[np.ndarray]]:
    every = np.concatenate([ea, eb])
    # Edges outside of which the rule gives nothing.
    bounds = [k for k, alone in enumerate((rule(np.False_, np.True_), rule(np.True_, np.False_))) if not alone]
    if not len(every) or any(not len((ea, eb)[k]) for k in bounds):
        return []
    if ((every[:, 0] == every[:, 2]) | (every[:, 1] == every[:, 3])).all():
        for k in bounds:
            places = (ea, eb)[k].reshape(-1, 2)
            low, high = np.tile(places.min(0), 2), np.tile(places.max(0), 2)
            ea, eb = np.clip(ea, low, high), np.clip(eb, low, high)  # what is beyond counts as on the side
        every = np.concatenate([ea, eb])
        grid = [np.unique(np.round(every[:, k::2], 6)) for k in (0, 1)]
        if len(grid[0]) * len(grid[1]) <= GRID:
            return _assembled(*_gridded(ea, eb, rule, wound, *grid))
    pieces = _split(every)
    mid, along = (pieces[:, :2] + pieces[:, 2:]) / 2, pieces[:, 2:] - pieces[:, :2]
    normal = np.column_stack([-along[:, 1], along[:, 0]]) / np.hypot(*along.T)[:, None] * BESIDE
    inside = []
    for p in (mid + normal, mid - normal):
        w = [_winding(e, p[:, 0], p[:, 1]) for e in (ea, eb)]
        inside.append(rule(*[(x != 0) if wound else (x % 2 == 1) for x in w]))
    left, right = inside
    turned = pieces[:, [2, 3, 0, 1]]
    return _assembled(_rings(np.concatenate([pieces[left & ~right], turned[right & ~left]])))


def _twice_areas(rings: list[np.ndarray]) -> np.ndarray:
    """``area2`` of each ring, all in one go."""
    if not rings:
        return np.empty(0)
    n = np.array([len(r) for r in rings])
    first = n.cumsum() - n
    follow = np.arange(1, n.sum() + 1)
    follow[first + n - 1] = first
    x, y = np.concatenate(rings).T
    return np.add.reduceat(x * y[follow] - y * x[follow], first)


def _assembled(rings: list[np.ndarray], regions: list[int] | None = None) -> list[list[np.ndarray]]:
    """Rings as polygons with whole coordinates: a hole goes to the exterior of its region, or if these are not known to the least around it."""
    whole = [np.sign(r) * np.floor(np.abs(r) + 0.5) for r in rings]
    kept = [(w, r, g, a) for w, r, g, a, b in zip(whole, rings, regions or [None] * len(rings), _twice_areas(rings).tolist(), _twice_areas(whole).tolist()) if b != 0]
    outer = sorted(([w, r, g, a] for w, r, g, a in kept if a > 0), key=lambda o: (o[3], o[0].tolist()))
    out = [[o[0]] for o in outer]
    if regions is None and outer:
        low, high = (np.array([f(o[1], axis=0) for o in outer]) for f in (np.min, np.max))
    known = {o[2]: k for k, o in enumerate(outer)}
    for w, r, g, a in kept:
        if a < 0:
            if regions is not None:
                if g in known:
                    out[known[g]].append(w)
                continue
            at = (r[:1] + r[1:2]) / 2
            for k in np.nonzero(((low <= at) & (at <= high)).all(1))[0] if outer else ():
                big = outer[k][1]
                if outer[k][3] > -a and _winding(np.hstack([big, np.roll(big, -1, axis=0)]), at[:, 0], at[:, 1])[0]:
                    out[k].append(w)
                    break
    return sorted(out, key=lambda p: min(p[0].tolist()))


def _gridded(ea: np.ndarray, eb: np.ndarray, rule, wound: bool, xs: np.ndarray, ys: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Rings of what ``rule`` leaves of edges parallel to the axes, each with the number of its region.

    An edge counts for the cells of the grid that lie left of it: differences are put down at its ends and summed up.
    """
    nx, ny = len(xs), len(ys)
    masks = []
    for e in (ea, eb):
        e = np.round(e[e[:, 1] != e[:, 3]], 6)
        i, low, high = np.searchsorted(xs, e[:, 0]), np.searchsorted(ys, e[:, 1::2].min(1)), np.searchsorted(ys, e[:, 1::2].max(1))
        sign = np.where(e[:, 3] > e[:, 1], 1, -1)
        turns = np.bincount(low * nx + i, sign, nx * ny) - np.bincount(high * nx + i, sign, nx * ny)
        turns = turns.astype(np.int32).reshape(ny, nx).cumsum(0, dtype=np.int32)[:-1, :0:-1].cumsum(1, dtype=np.int32)[:, ::-1]
        masks.append(turns != 0 if wound else turns % 2 == 1)
    inside = np.zeros((ny + 1, nx + 1), bool)
    inside[1:-1, 1:-1] = rule(*masks)
    region = _regions(inside)
    # Sides of cells between inside and outside: 1 up or right, -1 down or left, the inside on their left.
    up = inside[1:-1, :-1].astype(np.int8) - inside[1:-1, 1:]
    right = inside[1:, 1:-1].astype(np.int8) - inside[:-1, 1:-1]
    # Stretches end where a side of the other kind meets them.
    edges = []
    for code, other, flip in ((up.T, right.T, True), (right, up, False)):
        padded, beside = np.pad(code, ((0, 0), (1, 1))), np.pad(other, ((1, 1), (0, 0)))
        ends = (beside[:-1] != 0) | (beside[1:] != 0)
        before, after = padded[:, :-1], padded[:, 1:]
        first = (after != 0) & ((before != after) | ends)
        last = (before != 0) & ((before != after) | ends)
        line, a = np.nonzero(first)
        b = np.nonzero(last)[1]
        way = after[line, a]
        edges.append((line, np.where(way > 0, a, b), np.where(way > 0, b, a), way, a, flip))
    place = lambda line, at, flip: at * nx + line if flip else line * nx + at
    start = np.concatenate([place(g[0], g[1], g[5]) for g in edges])
    end = np.concatenate([place(g[0], g[2], g[5]) for g in edges])
    heading = np.concatenate([np.where(g[3] > 0, 1, 3) if g[5] else np.where(g[3] > 0, 0, 2) for g in edges])
    (v, _, _, vw, va, _), (h, _, _, hw, ha, _) = edges
    cell = np.concatenate([region[va + 1, np.where(vw > 0, v, v + 1)], region[np.where(hw > 0, h + 1, h), ha + 1]])
    if not len(start):
        return [], []
    # Where two stretches leave a place, the one to the left follows.
    order = np.lexsort((heading, start))
    slot = np.searchsorted(start[order], end)
    two = (slot + 1 < len(order)) & (start[order][np.minimum(slot + 1, len(order) - 1)] == end)
    second = np.where(two, slot + 1, slot)
    follow = np.where(two & (heading[order[second]] == (heading + 1) % 4), order[second], order[slot]).tolist()
    # Starts by place; of two that leave one, the one that comes last by the other kernel's order.
    px, py = start % nx, start // nx
    turned = heading >= 2
    begin = np.lexsort((-end, ~turned, py, px)).tolist()
    used, froms, cells = bytearray(len(start)), start.tolist(), cell.tolist()
    paths, regions = [], []
    for k in begin:
        if used[k]:
            continue
        path, region_of = [], cells[k]
        while not used[k]:
            used[k] = 1
            path.append(froms[k])
            k = follow[k]
        for ring in _parted(path):
            paths.append(ring)
            regions.append(region_of)
    # Places on straight stretches are left out, of all rings in one go.
    n = np.array([len(p) for p in paths])
    first, at = n.cumsum() - n, np.array([q for p in paths for q in p])
    after, before = np.arange(1, len(at) + 1), np.arange(-1, len(at) - 1)
    after[first + n - 1], before[first] = first, first + n - 1
    r = np.column_stack([xs[at % nx], ys[at // nx]])
    u, v = r - r[before], r[after] - r
    bends = u[:, 0] * v[:, 1] != v[:, 0] * u[:, 1]
    ends = np.add.reduceat(bends, first).cumsum().tolist()
    r = r[bends]
    found = [(r[a:b], g) for a, b, g in zip([0, *ends], ends, regions) if b - a >= 3]
    return [f[0] for f in found], [f[1] for f in found]


def _regions(inside: np.ndarray) -> np.ndarray:
    """A number for each set of inside cells that hang together by their sides."""
    first = inside & ~np.pad(inside, ((0, 0), (1, 0)))[:, :-1]
    run = np.where(inside, first.ravel().cumsum().reshape(inside.shape) - 1, -1)
    both = inside[:-1] & inside[1:]
    a, b = np.unique(np.column_stack([run[:-1][both], run[1:][both]]), axis=0).T if both.any() else (np.empty(0, int),) * 2
    number = np.arange(int(run.max()) + 1)
    while len(a):
        a, b = number[a], number[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(number, np.maximum(a, b), np.minimum(a, b))
        while (number[number] != number).any():
            number = number[number]
    return np.where(inside, number[run] if len(number) else -1, -1)


def _arrays(polygons) -> list[list[np.ndarray]]:
    return [[np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) for ring in polygon] for polygon in polygons]


def _structs(polygons: list[list[np.ndarray]]) -> list:
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in polygon] for polygon in polygons]


def _copies(rows: DataFrame) -> DataFrame:
    """Distinct rows (tile, by ..., p) with their number ``n``.

    Dealt out before they are counted: a map of a whole split's polygons would grow with the split, and what is made of a few
    bytes of polygons is much work.
    """
    return rows.repartition(tasks(rows), *rows.columns).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def _in_cells(rows: DataFrame, cells: int, low: float, high: float) -> DataFrame:
    """(tile, by ..., p) with cx, cy: each polygon in the squares of [low, high] that it meets, clipped to them if there are several."""
    keys = [c for c in rows.columns if c != "p"]
    if cells <= 1:
        return rows.select(*keys, F.lit(0).alias("cx"), F.lit(0).alias("cy"), "p")
    side, last = (high - low) / cells, cells - 1
    place = lambda v: F.least(F.greatest(F.floor((v - low) / side), F.lit(0)), F.lit(last)).cast("int")
    along = lambda k: F.transform(F.col("p")[0], lambda q: q[k])
    span = lambda k: F.sequence(place(F.array_min(along(k))), place(F.array_max(along(k))))
    rows = rows.withColumns({"across": span("x"), "down": span("y")})
    alone = (F.size("across") == 1) & (F.size("down") == 1) & (F.size("p") == 1)  # holes may reach further
    parallel = lambda s: (s["a"]["x"] == s["b"]["x"]) | (s["a"]["y"] == s["b"]["y"])
    upright = F.forall("p", lambda r: F.forall(_segments(r, True), parallel))
    rows = rows.withColumns({"alone": alone, "upright": ~alone & upright}).withColumn("cx", F.explode("across")).withColumn("cy", F.explode("down"))
    # The outer squares take what lies beyond.
    first = lambda c: F.when(F.col(c) == 0, F.lit(-1e9)).otherwise(F.col(c) * side + low)
    end = lambda c: F.when(F.col(c) == last, F.lit(1e9)).otherwise((F.col(c) + 1) * side + low)
    # Sides parallel to the axes are only moved in, which is far less work and encloses the same.
    moved = lambda v, c: F.least(F.greatest(v, first(c)), end(c))
    inside = F.transform("p", lambda r: F.transform(r, lambda q: point(moved(q["x"], "cx"), moved(q["y"], "cy"))))
    clipped = clip_polygons(F.array("p"), first("cx"), first("cy"), end("cx"), end("cy"))
    clipped = F.when(F.col("alone"), tidy_polygons(F.array("p"))).when(F.col("upright"), tidy_polygons(F.array(inside))).otherwise(clipped)
    return rows.withColumn("p", F.explode(clipped)).select(*keys, "cx", "cy", "p")


def _edges_of(polygons: pa.Array, wound: bool) -> np.ndarray:
    """``_edges`` of a column of polygons."""
    rings = polygons.flatten()
    n, places = np.asarray(rings.value_lengths()), rings.flatten()
    x, y = (np.asarray(c) for c in places.flatten())
    if not len(x):
        return np.empty((0, 4))
    first = np.repeat(n.cumsum() - n, n)
    follow = np.arange(1, len(x) + 1)
    last = n.cumsum()[n > 0] - 1
    follow[last] = first[last]
    edges = np.column_stack([x, y, x[follow], y[follow]])
    if wound:
        twice = np.bincount(np.repeat(np.arange(len(n)), n), x * y[follow] - x[follow] * y, len(n))
        per = np.asarray(polygons.value_lengths())
        exterior = np.zeros(len(n), bool)
        exterior[(per.cumsum() - per)[per > 0]] = True
        turned = np.repeat((twice > 0) != exterior, n)
        edges[turned] = edges[turned][:, [2, 3, 0, 1]]
    return edges[np.repeat(n >= 3, n)]


def _ends(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def _nested(xy: np.ndarray, *sizes) -> pa.Array:
    """Places as lists of the first ``sizes``, these as lists of the second, and so on."""
    out = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k]), pa.float64()) for k in (0, 1)], ["x", "y"])
    for n in sizes:
        out = pa.ListArray.from_arrays(pa.array(_ends(n)), out)
    return out


def _one_row(key: tuple, columns: list[str], polygons: list[list[np.ndarray]]) -> pa.Table:
    """The group's key and its polygons as one row, or no row."""
    rings = [r for p in polygons for r in p]
    xy = np.concatenate(rings) if rings else np.empty((0, 2))
    nested = _nested(xy, [len(r) for r in rings], [len(p) for p in polygons], [len(polygons)])
    out = pa.table([pa.array([k.as_py()], k.type) for k in key] + [nested], [*columns, "polygons"])
    return out if polygons else out.slice(0, 0)


def _per_square(rows: DataFrame, keys: list[str], kernel, types: str) -> DataFrame:
    """``kernel(first column, second column of polygons)`` on each square, in as many tasks as shuffles have: few bytes are much work."""
    squares = [*keys, "cx", "cy"]

    def run(key, table):
        own = table.combine_chunks()
        parts = [own.filter(own["second"] if k else pc.invert(own["second"]))["p"].combine_chunks() for k in (False, True)]
        parts = [c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], LINES) for c in parts]
        return _one_row(key, squares, kernel(*parts))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *squares).groupBy(*squares).applyInArrow(run, f"{types}, cx int, cy int, polygons {SHAPES['polygons']}")


def feature_boolean(a: DataFrame, b: DataFrame, mode: str = "union", cells: int = 1, extent: int = EXTENT) -> DataFrame:
    """(z, x, y, cx, cy, polygons): set operation between all polygons of ``a`` and of ``b`` in each tile, without properties.

    Insides are by even and odd crossings over an input's rings. Points and lines are dropped; nothing gives no row.
    """
    rule = RULES[mode]
    first, second = (df.select(*TILE, F.lit(k).alias("second"), F.explode(shape(df, "polygons")).alias("p")) for df, k in ((a, False), (b, True)))
    odd = _in_cells(_copies(first.unionByName(second)).where("n % 2 = 1").drop("n"), cells, 0, extent)
    return _per_square(odd, [*TILE], lambda p, q: _overlaid(_edges_of(p, False), _edges_of(q, False), rule, False), "z int, x int, y int")


def dissolve(df: DataFrame, *by: str, cells: int = 1, low: float = 0, high: float = EXTENT) -> DataFrame:
    """(z, x, y, by ..., cx, cy, polygons): the union of a tile's polygons with equal ``by``, whichever way rings are wound.

    ``low`` and ``high`` say where the squares lie.
    """
    keys = [*TILE, *by]
    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)
    every = df.select(*keys, F.explode(shape(df, "polygons")).alias("p"))
    rows = _in_cells(_copies(every).drop("n"), cells, low, high).withColumn("second", F.lit(False))
    return _per_square(rows, keys, lambda p, _: _overlaid(_edges_of(p, True), np.empty((0, 4)), lambda a, b: a, True), types)


def stitch(df: DataFrame, *by: str, cells: int = 1, extent: int = EXTENT) -> DataFrame:
    """Features cut at tile borders put together: each tile gets the union of what it and its eight neighbours hold.

    Pieces with equal ``by`` are one feature. A piece is first clipped to its own tile, so that buffers around tiles do not
    count twice, then moved into the frame of the tile that asks. Tiles without own pieces of a feature do not get it.
    """
    own = df.withColumn("polygons", clip_polygons(F.col("polygons"), F.lit(0.0), F.lit(0.0), F.lit(float(extent)), F.lit(float(extent))))
    own = own.where(F.size("polygons") > 0)
    once = own.select(*TILE, *by, F.explode("polygons").alias("p")).distinct().select(*TILE, *by, F.array("p").alias("polygons"))
    around = stitched(once, extent)
    asked = own.select(*TILE, *by).distinct()
    around = around.join(asked, [*TILE, *by], "left_semi")
    # Squares' sides lie beside those of tiles, where pieces meet.
    half = extent / cells / 2
    return dissolve(around, *by, cells=3 * cells + 1 if cells > 1 else 1, low=-extent - half, high=2 * extent + half)


# Buffers


def _disc(p: np.ndarray, r: float, n: int) -> list[np.ndarray]:
    t = np.arange(n) * (2 * math.pi / n)
    return [np.column_stack([p[0] + r * np.cos(t), p[1] + r * np.sin(t)])]


def _corner(p: np.ndarray, u: np.ndarray, v: np.ndarray, r: float, join: str, n: int, min_angle: float) -> list[list[np.ndarray]]:
    """What joins the strips of two segments with directions u and v at p, on the outer side."""
    turn = u[0] * v[1] - u[1] * v[0]
    if join == "round":
        return [_disc(p, r, n)]
    if abs(turn) < 1e-12:
        return []
    side = -1.0 if turn > 0 else 1.0
    a, b = p + side * r * np.array([-u[1], u[0]]), p + side * r * np.array([-v[1], v[0]])
    inner = math.pi - math.acos(max(-1.0, min(1.0, float(u @ v))))
    if join == "bevel" or inner < min_angle:
        return [[np.array([p, a, b])]]
    middle = (a - p) + (b - p)
    tip = p + middle / np.linalg.norm(middle) * (r / math.sin(inner / 2))
    return [[np.array([p, a, tip, b])]]


def _strips(path: np.ndarray, closed: bool, r: float, join: str, min_angle: float) -> list[list[np.ndarray]]:
    """Convex pieces that together cover all within ``r`` of a path."""
    n = max(8, math.ceil(2 * math.pi / 0.25))
    steps = np.vstack([path, path[:1]]) if closed else path
    steps = steps[np.r_[True, (np.diff(steps, axis=0) != 0).any(1)]]
    if len(steps) < 2:
        return [] if closed else [_disc(path[0], r, n)]
    d = np.diff(steps, axis=0)
    u = d / np.hypot(*d.T)[:, None]
    normal = np.column_stack([-u[:, 1], u[:, 0]]) * r
    out = [[np.array([p - m, q - m, q + m, p + m])] for p, q, m in zip(steps[:-1], steps[1:], normal)]
    corners = [(steps[i + 1], u[i], u[i + 1]) for i in range(len(u) - 1)] + ([(steps[0], u[-1], u[0])] if closed else [])
    for p, a, b in corners:
        out += _corner(p, a, b, r, join, n, min_angle)
    return out if closed else [*out, _disc(steps[0], r, n), _disc(steps[-1], r, n)]


def _convex(rings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings (m, n, 2) in the direction of positive area, and which of them are convex."""
    x, y = rings[..., 0], rings[..., 1]
    up = (x * np.roll(y, -1, 1) - y * np.roll(x, -1, 1)).sum(1) > 0
    r = np.where(up[:, None, None], rings, rings[:, ::-1])
    step = np.roll(r, -1, 1) - r
    far = np.roll(step, -1, 1)
    bend = step[..., 0] * far[..., 1] - step[..., 1] * far[..., 0]
    around = np.arctan2(bend, (step * far).sum(2)).sum(1)
    return r, (bend > 0).all(1) & (np.abs(around - 2 * math.pi) < 1e-6)


def _moved_sides(r: np.ndarray, distance: float, join: str, min_angle: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Convex rings (m, n, 2) with their sides moved outward, or inward below 0: all places, how many each ring has, and
    whether it keeps all its sides."""
    step = np.roll(r, -1, 1) - r
    u = step / np.hypot(step[..., 0], step[..., 1])[..., None]
    n = np.stack([u[..., 1], -u[..., 0]], 2)
    m = np.roll(n, 1, 1)
    cos = np.clip((m * n).sum(2), -1.0, 1.0)
    tip = r + distance * ((m + n) / np.maximum(1 + cos, 1e-300)[..., None])
    if distance < 0:
        whole = ((np.roll(tip, -1, 1) - tip) * step).sum(2) > 0
        return tip.reshape(-1, 2), np.full(len(r), r.shape[1]), whole.all(1)
    turn = np.arccos(cos)
    parts = np.maximum(np.ceil(turn / 0.25), 1).astype(int)
    sizes = parts + 1 if join == "round" else np.where((join == "bevel") | (math.pi - turn < min_angle), 2, 1)
    at = np.repeat(np.arange(sizes.size), sizes.ravel())
    i = np.arange(len(at)) - _ends(sizes.ravel())[at]
    if join == "round":
        t = np.arctan2(m[..., 1], m[..., 0]).ravel()[at] + turn.ravel()[at] * i / parts.ravel()[at]
        out = r.reshape(-1, 2)[at] + distance * np.column_stack([np.cos(t), np.sin(t)])
    else:
        beside = r.reshape(-1, 2)[at] + distance * np.where((i == 0)[:, None], m.reshape(-1, 2)[at], n.reshape(-1, 2)[at])
        out = np.where((sizes.ravel()[at] == 1)[:, None], tip.reshape(-1, 2)[at], beside)
    return out, sizes.sum(1), np.ones(len(r), bool)


def _shrunk(r: np.ndarray, distance: float) -> np.ndarray:
    """What a convex ring's sides, moved inward, leave of it; an empty ring where nothing is left."""
    step = np.roll(r, -1, axis=0) - r
    u = step / np.hypot(*step.T)[:, None]
    ring = [tuple(p) for p in r.tolist()]
    for (px, py), (nx, ny) in zip(r.tolist(), np.column_stack([u[:, 1], -u[:, 0]]).tolist()):
        far = [nx * (x - px) + ny * (y - py) - distance for x, y in ring]
        cut = []
        for i, (a, fa) in enumerate(zip(ring, far)):
            b, fb = ring[(i + 1) % len(ring)], far[(i + 1) % len(ring)]
            if fa <= 0:
                cut.append(a)
            if fa * fb < 0:
                t = fa / (fa - fb)
                cut.append((a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
        ring = cut
    return np.array(ring, float).reshape(-1, 2)


def _whole(xy: np.ndarray) -> np.ndarray:
    return np.sign(xy) * np.floor(np.abs(xy) + 0.5)


def _buffered(polygon: list[np.ndarray], distance: float, join: str, min_angle: float) -> list[list[np.ndarray]]:
    """One polygon that does not keep its sides, or is not one convex ring."""
    if distance < 0 and len(polygon) == 1 and len(polygon[0]) >= 3:
        (plain,), (convex,) = _convex(polygon[0][None])
        if convex:
            left = _whole(_shrunk(plain, distance))
            return [[left]] if len(left) >= 3 and area2(left) != 0 else []
    strips = [s for ring in polygon if len(ring) >= 3 for s in _strips(ring, True, abs(distance), join, min_angle)]
    # A hole's strips and the exterior's alike; growing adds them, shrinking takes them away.
    return overlay([polygon], strips, RULES["union" if distance > 0 else "difference"], wound=True)


def _buffered_polygons(polygons: pa.Array, distance: float, join: str, min_angle: float) -> pa.Array:
    """Each row's polygons, buffered; all that are one convex ring of as many corners in one go."""
    each = polygons.flatten()
    rings = each.flatten() if len(each) else each
    if not len(rings):  # Spark's empty lists have no ends to read
        return pa.array([[]] * len(polygons), POLYGONS)
    xy = np.column_stack([c.to_numpy(zero_copy_only=False) for c in rings.flatten().flatten()])
    start = _ends(pc.list_value_length(rings))
    ring, size = _ends(pc.list_value_length(each))[:-1], np.zeros(len(each), int)
    one = pc.list_value_length(each).to_numpy(zero_copy_only=False) == 1
    size[one] = np.diff(start)[ring[one]]
    ids, found = [], []
    for n in np.unique(size[size >= 3]).tolist():
        of = np.nonzero(size == n)[0]
        r, plain = _convex(xy[start[ring[of]][:, None] + np.arange(n)])
        of, r = of[plain], r[plain]
        moved, sizes, kept = _moved_sides(r, distance, join, min_angle)
        if not len(of) or not kept.any():
            continue
        moved, sizes, of = _whole(moved[np.repeat(kept, sizes)]), sizes[kept], of[kept]
        ends = _ends(sizes)
        after = np.arange(1, len(moved) + 1)
        after[ends[1:] - 1] = ends[:-1]
        areas = np.add.reduceat(moved[:, 0] * moved[after, 1] - moved[after, 0] * moved[:, 1], ends[:-1])
        has = areas != 0
        ids.append(of)
        found.append(_nested(moved[np.repeat(has, sizes)], sizes[has], np.ones(has.sum(), int), has.astype(int)))
    rest = np.setdiff1d(np.arange(len(each)), np.concatenate(ids)) if ids else np.arange(len(each))
    others = _arrays(each.take(pa.array(rest)).to_pylist())
    found.append(pa.array([_structs(_buffered(p, distance, join, min_angle)) for p in others], POLYGONS))
    per = pa.concat_arrays([f.cast(POLYGONS) for f in found]).take(pa.array(np.argsort(np.concatenate([*ids, rest]), kind="stable")))
    ends = _ends(pc.list_value_length(per))[_ends(pc.list_value_length(polygons))]
    return pa.ListArray.from_arrays(pa.array(ends), per.flatten())


def buffer(df: DataFrame, distance: float, join: str = "miter", min_angle_deg: float = 5.0) -> DataFrame:
    """Polygons around each feature's points, lines (both by the size of ``distance``) and polygons (grown, or shrunk below 0).

    ``join``: round, bevel, or miter down to corners of ``min_angle_deg``. Ends of lines are round. A distance of 0 keeps
    polygons and gives nothing for the rest. Properties stay; features that vanish go.
    """
    if distance == 0:
        return df.withColumn("polygons", shape(df, "polygons")).drop("points", "lines").where(F.size("polygons") > 0)
    angle = math.radians(min_angle_deg)

    def of_polygons(polygons: pa.Array) -> pa.Array:
        return _buffered_polygons(polygons, distance, join, angle)

    def of_lines(lines: pa.Array) -> pa.Array:
        out = []
        for paths in lines.to_pylist():
            own = [np.array([(p["x"], p["y"]) for p in line], float) for line in paths if line]
            out.append(_structs([p for line in own for p in overlay(_strips(line, False, abs(distance), join, angle), [], lambda a, b: a, wound=True)]))
        return pa.array(out, POLYGONS)

    # As functions without a fixed result they are not worked out once more for the filter.
    run = lambda f, name: F.arrow_udf(f, SHAPES["polygons"]).asNondeterministic()(shape(df, name))
    made = {"points": lambda: F.transform(shape(df, "points"), lambda p: disc(p, distance, join)), "polygons": lambda: run(of_polygons, "polygons"), "lines": lambda: run(of_lines, "lines")}
    parts = [f() for name, f in made.items() if name in df.columns]
    out = df.withColumn("polygons", F.concat(*parts) if parts else shape(df, "polygons"))
    return out.drop("points", "lines").where(F.size("polygons") > 0)
