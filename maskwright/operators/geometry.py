"""Boxes: overlap measures and spatial joins inside one picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.plans.store import written

BOX = ("x", "y", "w", "h")


def _b(prefix: str) -> list[Column]:
    return [F.col(prefix + n) for n in BOX]


def shared(a: str, b: str) -> tuple[Column, Column]:
    """Width and height of the common part of boxes with column prefixes ``a`` and ``b`` (0 where they are apart)."""
    ax, ay, aw, ah = _b(a)
    bx, by, bw, bh = _b(b)
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx)), F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))


def overlap(a: str, b: str) -> Column:
    """Common area as a share of the smaller box; a box without area counts as one pixel."""
    w, h = shared(a, b)
    area = lambda p: F.when(F.col(p + "w") * F.col(p + "h") == 0, 1.0).otherwise(F.col(p + "w") * F.col(p + "h"))
    return w * h / F.least(area(a), area(b))


def centre_in(a: str, b: str, strict: bool = False) -> Column:
    """Whether the centre of box ``a`` lies in box ``b``; ``strict``: not on its edge."""
    ax, ay, aw, ah = _b(a)
    bx, by, bw, bh = _b(b)
    cx, cy = ax + aw / 2, ay + ah / 2
    if strict:
        return (cx > bx) & (cx < bx + bw) & (cy > by) & (cy < by + bh)
    return (cx >= bx) & (cx <= bx + bw) & (cy >= by) & (cy <= by + bh)


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return df.select(*keep, *(F.col(c).alias(prefix + c) for c in df.columns if c not in keep))


def near_pairs(a: DataFrame, b: DataFrame, bucket: float = 48.0, reach: float = 0.0, reach_x: Column | float = 0.0, cell: float = 192.0, reach_y: Column | float = 0.0) -> DataFrame:
    """Pairs of boxes of one picture that share a cell of ``cell`` × ``bucket`` pixels; once each.

    ``a`` and ``b`` have ``image_id`` and prefixed columns (``a_x`` …, ``b_x`` …). Rows of ``b`` are widened by ``reach``,
    ``a`` on both sides by ``reach_x`` and ``reach_y``. Candidates of a box grow with the boxes near it, not with its line.
    """
    wide, high = (r if isinstance(r, Column) else F.lit(float(r)) for r in (reach_x, reach_y))

    def dealt(df: DataFrame, p: str, dx: Column, dy: Column) -> DataFrame:
        first = lambda at, size: F.floor(at / size)
        x, y, w, h = _b(p)
        span = df.withColumns({
            f"_u{p}": first(x - dx, cell), f"_v{p}": first(x + F.greatest(w, F.lit(0.0)) + dx, cell),
            f"_s{p}": first(y - dy, bucket), f"_t{p}": first(y + F.greatest(h, F.lit(0.0)) + dy, bucket),
        })
        return span.withColumn("_row", F.explode(F.sequence(f"_s{p}", f"_t{p}"))).withColumn("_col", F.explode(F.sequence(f"_u{p}", f"_v{p}"))).drop(f"_v{p}", f"_t{p}")

    both = dealt(a, "a_", wide, high).join(dealt(b, "b_", F.lit(0.0), F.lit(float(reach))), ["image_id", "_row", "_col"])
    once = (F.col("_row") == F.greatest("_sa_", "_sb_")) & (F.col("_col") == F.greatest("_ua_", "_ub_"))
    return both.filter(once).drop("_row", "_col", "_sa_", "_sb_", "_ua_", "_ub_")


def overlap_join(a: DataFrame, b: DataFrame, threshold: float = 0.3, bucket: float = 48.0) -> DataFrame:
    """Pairs (``a_*``, ``b_*``) whose overlap exceeds ``threshold``."""
    pairs = near_pairs(prefixed(a, "a_"), prefixed(b, "b_"), bucket)
    return pairs.withColumn("ov", overlap("a_", "b_")).filter(F.col("ov") > threshold)


def inside_join(a: DataFrame, b: DataFrame, bucket: float = 48.0) -> DataFrame:
    """Pairs whose ``a`` box has its centre in the ``b`` box."""
    return near_pairs(prefixed(a, "a_"), prefixed(b, "b_"), bucket).filter(centre_in("a_", "b_"))


def except_contained(a: DataFrame, b: DataFrame, key: str, slack: float = 1.0, bucket: float = 48.0) -> DataFrame:
    """Boxes of ``a`` that no box of ``b`` contains, with ``slack`` pixels."""
    pairs = near_pairs(prefixed(a, "a_"), prefixed(b, "b_"), bucket, reach=slack, reach_x=slack)
    ax, ay, aw, ah = _b("a_")
    bx, by, bw, bh = _b("b_")
    held = pairs.filter((bx <= ax + slack) & (by <= ay + slack) & (bx + bw >= ax + aw - slack) & (by + bh >= ay + ah - slack))
    return a.join(held.select("image_id", F.col(f"a_{key}").alias(key)).distinct(), ["image_id", key], "left_anti")


def coverage(words: DataFrame, boxes: DataFrame, key: str = "word_id", nx: int = 16, ny: int = 6, bucket: float = 48.0) -> DataFrame:
    """``words`` with ``covered``: the share of an nx × ny grid of sample points that lie in any box.

    The points that a box covers are bits of a few longs (a row of the grid has nx of them); boxes are joined by OR.
    """
    ax, ay, aw, ah = _b("a_")
    bx, by, bw, bh = _b("b_")
    pairs = near_pairs(prefixed(words.select("image_id", key, *BOX), "a_"), prefixed(boxes.select("image_id", *BOX), "b_"), bucket)
    near = pairs.filter((bx < ax + aw) & (bx + bw > ax) & (by < ay + ah) & (by + bh > ay))
    bit = lambda on, k: F.when(on, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    columns = F.lit(0).cast("bigint")
    for i in range(nx):
        px = ax + F.lit((i + 0.5) / nx) * aw
        columns = columns.bitwiseOR(bit((px >= bx) & (px <= bx + bw), i))
    near = near.withColumn("_columns", columns)
    per, longs = 62 // nx, []
    for first in range(0, ny, per):
        value = F.lit(0).cast("bigint")
        for j in range(first, min(first + per, ny)):
            py = ay + F.lit((j + 0.5) / ny) * ah
            value = value.bitwiseOR(F.when((py >= by) & (py <= by + bh), F.shiftleft("_columns", nx * (j - first))).otherwise(F.lit(0).cast("bigint")))
        longs.append(value)
    hit = near.groupBy("image_id", F.col(f"a_{key}").alias(key)).agg(*(F.bit_or(v).alias(f"_l{i}") for i, v in enumerate(longs)))
    points = sum((F.bit_count(f"_l{i}") for i in range(1, len(longs))), F.bit_count("_l0"))
    seen = hit.select("image_id", key, (points / (nx * ny)).alias("covered"))
    return words.join(seen, ["image_id", key], "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def greedy(rows: DataFrame, pairs: DataFrame, key: str = "word_id") -> DataFrame:
    """``rows`` gone through in order, each kept unless an earlier kept one drops it; ``pairs`` has (earlier ``a_``, later ``b_``).

    Rounds: what no undecided row comes before is kept and drops those after it; only pairs that are still open go into the
    next round, so that each costs what is left. Chains of overlaps are short, and so are the rounds few.
    """
    open_ = written(pairs.select("image_id", F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b")), "open")
    gone = []
    while not open_.isEmpty():
        later = open_.select("image_id", F.col("b").alias("a")).distinct()
        kept = open_.select("image_id", "a").distinct().join(later, ["image_id", "a"], "left_anti")
        dropped = written(open_.join(kept, ["image_id", "a"], "left_semi").select("image_id", "b").distinct(), "dropped")
        gone.append(dropped)
        left = open_.join(dropped, ["image_id", "b"], "left_anti").join(dropped.select("image_id", F.col("b").alias("a")), ["image_id", "a"], "left_anti")
        open_ = written(left.select("image_id", "a", "b"), "open")
    for dropped in gone:
        rows = rows.join(dropped.select("image_id", F.col("b").alias(key)), ["image_id", key], "left_anti")
    return rows
