"""Soft morphology: cross erosion and the iterated soft skeleton."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.operators import grid as G


def erode_cross(cells: DataFrame, meta: DataFrame, value: str, out: str) -> DataFrame:
    """Minimum over the 3x1 and 1x3 neighbours of dense cells, border truncated."""
    d = G.haloed(cells, meta, [value], 1, 1, "truncate", fill=False)
    d = d.withColumns({"_a": F.min(value).over(G.across(1, 1)), "_b": F.min(value).over(G.down(1, 1))})
    return d.where("home").select("tile", "row", "col", F.least("_a", "_b").alias(out))


def soft_skeleton(cells: DataFrame, meta: DataFrame, bands: dict[str, str], iters: int = 8,
                  keep: tuple[str, ...] = (), block: int = G.BLOCK) -> DataFrame:
    """Iterated erosion minus opening; missing cells read as 0.

    Each pass depends on the one before over one more ring of neighbours, so a
    chain of window passes would reshuffle the raster per iteration. A block
    with a halo of ``2 * (iters + 1)`` holds everything its own cells need, and
    is worked through as one small array.
    """
    import numpy as np
    import pandas as pd

    halo = 2 * (iters + 1)
    src = sorted({*bands.values(), *keep})
    d = G.haloed(cells, meta, src, halo, halo, "truncate", block, fill=True)
    schema = T.StructType([d.schema[c] for c in ("tile", "row", "col", *keep)]
                          + [T.StructField(o, T.DoubleType()) for o in bands])

    def stack(x, offsets, fill):
        p = np.pad(x, 1, constant_values=fill)
        h, w = x.shape
        return [p[1 + a:1 + a + h, 1 + b:1 + b + w] for a, b in offsets]

    cross = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
    square = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]

    def erode(x):
        return np.minimum.reduce(stack(x, cross, np.inf))

    def opened(e, inside):
        # cells outside the raster never win a maximum
        return np.maximum.reduce(stack(np.where(inside, e, -np.inf), square, -np.inf))

    def skeleton(x, inside):
        e = np.where(inside, erode(x), np.inf)
        skel = np.maximum(np.where(inside, x - opened(e, inside), 0.0), 0.0)
        for _ in range(iters):
            x = e
            e = np.where(inside, erode(x), np.inf)
            delta = np.maximum(np.where(inside, np.where(inside, x, 0.0) - opened(e, inside), 0.0), 0.0)
            skel = skel + np.maximum(delta - skel * delta, 0.0)
        return skel

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["row"].min(), pdf["col"].min()
        shape = (pdf["row"].max() - r0 + 1, pdf["col"].max() - c0 + 1)
        at = (pdf["row"] - r0, pdf["col"] - c0)
        inside = np.zeros(shape, dtype=bool)
        inside[at] = True
        mine = pdf[pdf["home"]]
        res = mine[["tile", "row", "col", *keep]].copy()
        for o, i in bands.items():
            x = np.full(shape, np.inf)
            x[at] = pdf[i].fillna(0.0)
            res[o] = skeleton(x, inside)[mine["row"] - r0, mine["col"] - c0]
        return res

    return d.groupBy(*G.KEY).applyInPandas(one, schema)
