"""Chart areas of pictures from pixel tables (image_id, px, py, r, g, b): colour counts of blocks, hot cells, joined areas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.geometry import BOX
from maskwright.operators.pixels import colour_key, far_from

# Cells a side of a block; shares of coloured and of far pixels that make a cell hot; the distance that is far.
BLOCK, COLOURED, FAR_SHARE, FAR = 8, 0.12, 0.45, 150
# Cells over which hot ones join; the least chart as share of the picture and in pixels; its cells and its fill.
REACH, LEAST, LEAST_CELLS, LEAST_FILL = 2, ((0.05, 48), (0.04, 32)), 6, 0.25


def cell_size(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(4), F.floor(F.least(width, height) / 120 + 0.5)).cast("int")


def _panels(pixels: DataFrame) -> DataFrame:
    """(image_id, bx, by, panel): the commonest colour of a block of cells and its eight neighbours, the darkest of equals.

    Every second pixel of a cell counts, and colours are counted per block before blocks meet their neighbours.
    """
    side, step = F.col("cell") * BLOCK, F.greatest(F.lit(1), F.floor(F.col("cell") / 2))
    some = pixels.filter((F.col("px") % side % step == 0) & (F.col("py") % side % step == 0))
    counts = some.groupBy("image_id", "bx", "by", colour_key().alias("colour")).agg(F.count("*").alias("n"))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    near = counts.withColumn("o", around).groupBy("image_id", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"), "colour").agg(F.sum("n").alias("n"))
    return near.groupBy("image_id", "bx", "by").agg(F.max_by("colour", F.struct("n", -F.col("colour"))).alias("panel"))


def hot_cells(pixels: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, cx, cy, hot): cells that may belong to a chart; hot is 1 for coloured ones, 2 for grey ones unlike their panel.

    ``sizes``: image_id, width, height. Words with two pixels around them do not count. A pixel meets its cell once, which
    brings the panel's colour and the boxes of the words that touch it; cells are sums of their pixels.
    """
    size = sizes.select("image_id", "width", "height", cell_size(F.col("width"), F.col("height")).alias("cell"))
    at = lambda c, by: F.floor(F.col(c) / (F.col("cell") * by)).cast("int")
    placed = pixels.join(size, "image_id").withColumns({"cx": at("px", 1), "cy": at("py", 1), "bx": at("px", BLOCK), "by": at("py", BLOCK)})
    each = F.explode(F.sequence(F.lit(0), F.lit(BLOCK * BLOCK - 1)))
    cells = _panels(placed).withColumn("i", each).select("image_id", (F.col("bx") * BLOCK + F.col("i") % BLOCK).cast("int").alias("cx"), (F.col("by") * BLOCK + F.floor(F.col("i") / BLOCK)).cast("int").alias("cy"), "panel")
    x, y, w, h = (F.col(c) for c in BOX)
    box = F.struct(F.floor(x - 2).alias("x0"), F.ceil(x + w + 2).alias("x1"), F.floor(y - 2).alias("y0"), F.ceil(y + h + 2).alias("y1"))
    span = lambda a, z: F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col(f"b.{a}")) / F.col("cell")).cast("int"), F.floor(F.greatest(F.lit(0), F.col(f"b.{z}")) / F.col("cell")).cast("int")))
    text = words.join(size, "image_id").select("image_id", "cell", box.alias("b")).withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    text = text.groupBy("image_id", "cx", "cy").agg(F.collect_set("b").alias("boxes"))
    known = cells.join(text, ["image_id", "cx", "cy"], "left")
    both = placed.select("image_id", "cx", "cy", "px", "py", "r", "g", "b").join(known, ["image_id", "cx", "cy"])
    inside = F.exists(F.coalesce("boxes", F.array().cast("array<struct<x0:bigint,x1:bigint,y0:bigint,y1:bigint>>")), lambda t: (F.col("px") >= t["x0"]) & (F.col("px") < t["x1"]) & (F.col("py") >= t["y0"]) & (F.col("py") < t["y1"]))
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    coloured = (most > 40) & ((most - least) / most > 0.28) & (most - least > 40)
    far = ~coloured & (far_from(F.col("panel")) > FAR)
    share = lambda cond: F.count(F.when(~inside & cond, 1))
    sums = both.groupBy("image_id", "cx", "cy").agg(F.count("*").alias("all"), share(coloured).alias("coloured"), share(far).alias("far"))
    hot = F.when(F.col("coloured") > F.col("all") * COLOURED, 1).when(F.col("far") > F.col("all") * FAR_SHARE, 2)
    return sums.select("image_id", "cx", "cy", hot.alias("hot")).filter("hot is not null")


def label_parts(hot: np.ndarray, corners: bool) -> np.ndarray:
    """Numbers of the connected parts of a boolean picture (0: none), by their first cell's place plus 1; with or without
    connection over corners.

    Union-find over the runs of rows: a run meets the runs of the next row that it touches, roots are hooked to the least,
    and paths are halved until nothing changes, so that long parts take few rounds.
    """
    height, width = hot.shape
    edge = np.diff(np.pad(hot.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]  # exclusive
    label = np.zeros((height, width), np.int64)
    if not len(row):
        return label
    span, slack = width + 2, int(corners)
    first = np.searchsorted(row * span + end, (row + 1) * span + begin + 1 - slack)
    last = np.searchsorted(row * span + begin, (row + 1) * span + end - 1 + slack, "right")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    root = np.arange(len(row))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    name = (row * width + begin + 1)[root]
    size = end - begin
    label[np.repeat(row, size), np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(name, size)
    return label


AREA = "image_id string, area_id long, x double, y double, w double, h double, cells long"


def chart_areas(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, area_id, box, cells): hot cells up to two cells apart joined, where they are large enough for a chart.

    Areas found mostly by grey must fill a quarter of their box. A picture has at most some ten thousand cells, by the size
    of a cell; its cell table is one task's work.
    """
    own = cells.join(sizes.select("image_id", "width", "height", cell_size(F.col("width"), F.col("height")).alias("cell")), "image_id")

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        width, height, cell = (int(pdf[c].iloc[0]) for c in ("width", "height", "cell"))
        cw, ch = -(-width // cell), -(-height // cell)
        cx, cy = pdf.cx.to_numpy(), pdf.cy.to_numpy()
        grown = np.zeros((ch + 2 * REACH, cw + 2 * REACH), bool)
        for i in range(2 * REACH + 1):
            for j in range(2 * REACH + 1):
                grown[cy + i, cx + j] = True
        label = label_parts(grown[REACH : REACH + ch, REACH : REACH + cw], corners=False)
        own = pdf.assign(area=label[cy, cx], coloured=(pdf.hot == 1).astype(int))
        g = own.groupby("area").agg(x0=("cx", "min"), y0=("cy", "min"), x1=("cx", "max"), y1=("cy", "max"), cells=("cx", "size"), coloured=("coloured", "sum")).reset_index()
        bw, bh = (g.x1 - g.x0 + 1), (g.y1 - g.y0 + 1)
        least = [max(most, side * share) for (share, most), side in zip(LEAST, (width, height), strict=True)]
        ok = (bw * cell >= least[0]) & (bh * cell >= least[1]) & (g.cells >= LEAST_CELLS) & ~((g.coloured < g.cells / 2) & (g.cells < bw * bh * LEAST_FILL))
        g = g[ok]
        pad = int(cell / 2 + 0.5)
        x, y = np.maximum(0, g.x0 * cell - pad), np.maximum(0, g.y0 * cell - pad)
        x1, y1 = np.minimum(width, (g.x1 + 1) * cell + pad), np.minimum(height, (g.y1 + 1) * cell + pad)
        return pd.DataFrame({"image_id": pdf.image_id.iloc[0], "area_id": g.area.astype(int), "x": x.astype(float), "y": y.astype(float), "w": (x1 - x).astype(float), "h": (y1 - y).astype(float), "cells": g.cells.astype(int)})

    return own.groupBy("image_id").applyInPandas(go, AREA)
