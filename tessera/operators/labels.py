"""Label candidates, ordered conflict resolution, boxes, and the page's feature collector.

A candidate has its tile, ``layer_ix`` (later layers place first), ``sort_key`` (lower first), ``cand_ix``, text, anchor
(wax, way) and half sizes of its box. Boxes that only touch do not collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import TILE

V = F.col


def _order() -> list[Column]:
    return [F.desc("layer_ix"), F.asc("sort_key"), F.asc("cand_ix")]


def text_labels(features: DataFrame, text: Column, sort_key: Column, size: float = 16.0, advance: float = 0.5, padding: float = 2.0) -> DataFrame:
    """Candidates of point features (vx, vy): a fixed advance per character gives the box. Empty texts give none."""
    half = F.length(text) * (size * advance / 2) + padding
    rows = features.withColumns({"text": text, "sort_key": sort_key, "half_w": half, "half_h": F.lit(size / 2 + padding)})
    return rows.where(F.length("text") > 0).withColumns({"wax": V("vx"), "way": V("vy")})


def identical_once(candidates: DataFrame) -> DataFrame:
    """Of candidates with the same tile, text and anchor, the first in placement order."""
    w = Window.partitionBy(*TILE, "text", "wax", "way").orderBy(*_order())
    return candidates.withColumn("copy", F.row_number().over(w)).where("copy = 1").drop("copy")


def label_placement(candidates: DataFrame, dedupe_distance: float = 0.0) -> DataFrame:
    """(tile, layer_ix, cand_ix, placed, variant, drop_reason): greedy in placement order, tile by tile.

    Each decision depends on all before it, so a tile's candidates are placed by one task; tiles are independent. With a
    ``dedupe_distance`` a text is not placed again within that distance of itself. Columns that candidates may have:

    * ``variants`` array<struct<dx, dy>>: shifts of the box to try in turn; the first that fits is taken.
    * ``overlap``: never (as where it is null); always placed; cooperative, which collides only with labels that never overlap.
    * ``ignored`` boolean: what is placed stands in nobody's way.
    """
    import pandas as pd

    extra = {"variants": "array<struct<dx:double,dy:double>>", "overlap": "string", "ignored": "boolean"}

    def place(key, pdf):
        pdf = pdf.sort_values(["layer_ix", "sort_key", "cand_ix"], ascending=[False, True, True], kind="stable")
        cells, by_text, rows = {}, {}, []
        size = max(1.0, float(2 * max(pdf.half_w.max(), pdf.half_h.max())))

        def collides(r, cx, cy) -> bool:
            near = (b for i in (-1, 0, 1) for j in (-1, 0, 1) for b in cells.get((int(cx // size) + i, int(cy // size) + j), ()))
            met = (mode for x, y, w, h, mode in near if abs(cx - x) < r.half_w + w and abs(cy - y) < r.half_h + h)
            return any(mode == "never" for mode in met) if r.overlap == "cooperative" else any(True for _ in met)

        for r in pdf.itertuples():
            shifts = [(0.0, 0.0)] if r.variants is None or not len(r.variants) else [(v["dx"], v["dy"]) for v in r.variants]
            fits = [k for k, (dx, dy) in enumerate(shifts) if r.overlap == "always" or not collides(r, r.wax + dx, r.way + dy)]
            chosen, reason = (fits[0], None) if fits else (None, "collision")
            if fits and dedupe_distance > 0 and any((r.wax - x) ** 2 + (r.way - y) ** 2 < dedupe_distance**2 for x, y in by_text.get(r.text, ())):
                chosen, reason = None, "duplicate"
            if reason is None:
                x, y = r.wax + shifts[chosen][0], r.way + shifts[chosen][1]
                if not r.ignored:
                    cells.setdefault((int(x // size), int(y // size)), []).append((x, y, r.half_w, r.half_h, r.overlap or "never"))
                by_text.setdefault(r.text, []).append((r.wax, r.way))
            rows.append((*key, r.layer_ix, r.cand_ix, reason is None, chosen, reason))
        out = pd.DataFrame(rows, columns=[*TILE, "layer_ix", "cand_ix", "placed", "variant", "drop_reason"])
        return out.astype({"variant": "Int32"})

    columns = [*TILE, "layer_ix", "cand_ix", "sort_key", "text", "wax", "way", "half_w", "half_h"]
    full = candidates.select(*columns, *[V(c) if c in candidates.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()])
    full = full.withColumns({"overlap": F.coalesce("overlap", F.lit("never")), "ignored": F.coalesce("ignored", F.lit(False))})
    # Null arrays break the way to pandas where a batch has no other.
    full = full.withColumn("variants", F.coalesce("variants", F.array(F.struct(F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")))))
    return full.groupBy(*TILE).applyInPandas(place, "z int, x int, y int, layer_ix int, cand_ix long, placed boolean, variant int, drop_reason string")


def label_boxes(candidates: DataFrame, placements: DataFrame, include: str = "placed") -> DataFrame:
    """A rectangle per candidate box with its outcome; ``all`` keeps what was dropped."""
    out = candidates.join(placements, [*TILE, "layer_ix", "cand_ix"], "left").withColumn("placed", F.coalesce("placed", F.lit(False)))
    out = out if include == "all" else out.where("placed")
    return out.select(*TILE, "layer_ix", "cand_ix", "text", "placed", "drop_reason", (V("wax") - V("half_w")).alias("x0"), (V("way") - V("half_h")).alias("y0"), (V("wax") + V("half_w")).alias("x1"), (V("way") + V("half_h")).alias("y1"))


def text_draw(candidates: DataFrame, placements: DataFrame, layer_ix: int) -> DataFrame:
    """The winners of one layer."""
    return candidates.where(V("layer_ix") == layer_ix).join(placements.where("placed").select(*TILE, "layer_ix", "cand_ix"), [*TILE, "layer_ix", "cand_ix"])


def frame_features(features: DataFrame, keys: list[str], box: tuple[float, float, float, float], present: dict[str, str] | None = None) -> DataFrame:
    """Rows whose box (x0, y0, x1, y1) meets the page, the first per key in reading order (tile y, x, feature), sorted by key.

    A key that a feature lacks and one that is null are two keys: ``present`` names, for keys that may be lacking, the
    boolean columns that say whether it is there. Keys sort missing, null, then by value as typed columns do.
    """
    lacking = {k: ~V(c) for k, c in (present or {}).items()}
    rank = lambda k: F.when(lacking.get(k, F.lit(False)), 0).when(V(k).isNull(), 1).otherwise(2)
    meets = (V("x1") >= box[0]) & (V("x0") <= box[2]) & (V("y1") >= box[1]) & (V("y0") <= box[3])
    ranks = {f"__rank{i}": rank(k) for i, k in enumerate(keys)}
    values = {f"__key{i}": F.when(rank(k) == 2, V(k)) for i, k in enumerate(keys)}
    first = Window.partitionBy(*ranks, *values).orderBy("y", "x", "feature_ix")
    out = features.where(meets).withColumns(ranks | values).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return out.orderBy(*[c for pair in zip(ranks, values) for c in pair]).drop("__n", *ranks, *values)
