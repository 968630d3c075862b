"""Measures on pixel tables (image_id, px, py, r, g, b): ink in the open, changed pixels, what a picture gives away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.geometry import BOX, near_pairs, prefixed

# Distance of ink from its background; share of open ink that exposes a word.
INK, EXPOSED = 90, 0.15
# Top corners and header band as shares of the picture, with their most pixels.
CORNER, BAND = ((0.18, 260), (0.12, 110)), (0.1, 90)


def colour_key(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """The colour in four bits a channel."""
    return F.floor(F.col(r) / 16) * 256 + F.floor(F.col(g) / 16) * 16 + F.floor(F.col(b) / 16)


def far_from(key: Column, r: str = "r", g: str = "g", b: str = "b") -> Column:
    """Distance of a pixel from the middle of the colour ``key`` (sum over channels)."""
    middle = lambda k: F.floor(k) % 16 * 16 + 8
    return F.abs(F.col(r) - middle(key / 256)) + F.abs(F.col(g) - middle(key / 16)) + F.abs(F.col(b) - middle(key))


def commonest(df: DataFrame, keys: list[str], name: str = "paper") -> DataFrame:
    """Per ``keys`` the commonest colour; the darkest of equals. Counted per colour before any group is formed."""
    counts = df.groupBy(*keys, "colour").agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by("colour", F.struct("_n", -F.col("colour"))).alias(name))


def _at_pixels(pixels: DataFrame, boxes: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pixels with the boxes that are near them (``a_*``: boxes)."""
    points = pixels.select("image_id", F.col("px").cast("double").alias("b_x"), F.col("py").cast("double").alias("b_y"), F.lit(0.0).alias("b_w"), F.lit(0.0).alias("b_h"), *(F.col(c).alias(f"b_{c}") for c in ("px", "py", *keep)))
    return near_pairs(prefixed(boxes.select("image_id", key, *BOX), "a_"), points, reach=4.0, reach_x=4.0)


def ink_exposure(words: DataFrame, boxes: DataFrame, pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, word_id, ink, open, exposed): pixels of a word unlike its background, and those of them in no box.

    The background is the commonest colour of the frame two pixels around the word, kept inside the picture (``sizes``:
    image_id, width, height). Corners of the frame count once a side, as sides are walked one by one.
    """
    rgb = ("r", "g", "b")
    a = lambda c: F.col(f"a_{c}")
    near = _at_pixels(pixels, words, "word_id", rgb).join(sizes.select("image_id", "width", "height"), "image_id")
    near = near.withColumns({
        "x0": F.greatest(F.lit(0), F.floor(a("x"))), "x1": F.least(F.col("width") - 1, F.ceil(a("x") + a("w"))),
        "y0": F.greatest(F.lit(0), F.floor(a("y"))), "y1": F.least(F.col("height") - 1, F.ceil(a("y") + a("h"))),
    })
    px, py = F.col("b_px"), F.col("b_py")
    within_x, within_y = px.between(F.col("x0"), F.col("x1")), py.between(F.col("y0"), F.col("y1"))
    side = lambda at, on, where: F.when(where & (at == on), 1).otherwise(0)
    times = (
        side(py, F.greatest(F.lit(0), F.col("y0") - 2), within_x) + side(py, F.least(F.col("height") - 1, F.col("y1") + 2), within_x)
        + side(px, F.greatest(F.lit(0), F.col("x0") - 2), within_y) + side(px, F.least(F.col("width") - 1, F.col("x1") + 2), within_y)
    )
    colour = colour_key("b_r", "b_g", "b_b")
    frame = near.withColumn("times", times).filter("times > 0").groupBy("image_id", F.col("a_word_id").alias("word_id"), colour.alias("colour")).agg(F.sum("times").alias("n"))
    paper = frame.groupBy("image_id", "word_id").agg(F.max_by("colour", F.struct("n", -F.col("colour"))).alias("paper"))
    own = near.filter(within_x & within_y).select("image_id", F.col("a_word_id").alias("word_id"), px.alias("px"), py.alias("py"), "b_r", "b_g", "b_b")
    ink = own.join(paper, ["image_id", "word_id"]).filter(far_from(F.col("paper"), "b_r", "b_g", "b_b") > INK)
    closed = covered_pixels(pixels, boxes, 0.5).withColumn("closed", F.lit(True))
    counts = ink.join(closed, ["image_id", "px", "py"], "left").groupBy("image_id", "word_id").agg(F.count("*").alias("ink"), (F.count("*") - F.count("closed")).alias("open"))
    out = words.select("image_id", "word_id").join(counts, ["image_id", "word_id"], "left").na.fill(0, ["ink", "open"])
    return out.withColumn("exposed", (F.col("ink") > 0) & (F.col("open") > F.col("ink") * EXPOSED))


def covered_pixels(pixels: DataFrame, boxes: DataFrame, centre: float = 0.5) -> DataFrame:
    """(image_id, px, py) of pixels whose centre lies in a box, edges included."""
    a = lambda c: F.col(f"a_{c}")
    near = _at_pixels(pixels, boxes.withColumn("_box", F.lit(0)), "_box")
    x, y = F.col("b_px") + centre, F.col("b_py") + centre
    return near.filter(x.between(a("x"), a("x") + a("w")) & y.between(a("y"), a("y") + a("h"))).select("image_id", F.col("b_px").alias("px"), F.col("b_py").alias("py")).distinct()


def distortion(before: DataFrame, after: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, changed): pixels that differ outside all replaced boxes, taken to whole pixels outward."""
    new = after.select("image_id", "px", "py", *(F.col(c).alias(f"new_{c}") for c in "rgb"))
    # pictures are small tables made large: Spark may take their pixels for few and send them whole through the driver
    moved = before.join(new.hint("merge"), ["image_id", "px", "py"]).filter("r != new_r or g != new_g or b != new_b")
    x, y = F.floor("x"), F.floor("y")
    whole = boxes.select("image_id", x.cast("double").alias("x"), y.cast("double").alias("y"), (F.ceil(F.col("x") + F.col("w")) - x).cast("double").alias("w"), (F.ceil(F.col("y") + F.col("h")) - y).cast("double").alias("h"))
    outside = moved.join(covered_pixels(moved.select("image_id", "px", "py"), whole).hint("merge"), ["image_id", "px", "py"], "left_anti")
    counts = outside.groupBy("image_id").agg(F.count("*").alias("changed"))
    return before.select("image_id").distinct().join(counts.hint("merge"), "image_id", "left").na.fill(0, ["changed"])


def fingerprint(pixels: DataFrame, boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, corner, header): whether a top corner holds a picture, and whether the header is in strong colours.

    Corners: 6 to 85 % of the pixels outside text are unlike the corner's commonest colour. Header: that colour is
    saturated over 0.45, or over 35 % of the pixels outside text are over 0.5 and not dark. Areas under eight pixels a side
    are passed over; large ones are walked in steps, to about 6,000 pixels.
    """
    upto = lambda side, share, most: F.least(F.floor(F.col(side) * share + 0.5), F.lit(most))
    cw, ch, bh = upto("width", *CORNER[0]), upto("height", *CORNER[1]), upto("height", *BAND)
    area = lambda name, x, w, h: F.struct(F.lit(name).alias("area"), x.cast("double").alias("x"), w.cast("double").alias("w"), h.cast("double").alias("h"))
    areas = sizes.select("image_id", F.explode(F.array(area("left", F.lit(0), cw, ch), area("right", F.col("width") - cw, cw, ch), area("band", F.lit(0), F.col("width"), bh))).alias("a")).select("image_id", "a.*")
    areas = areas.filter("w >= 8 and h >= 8").withColumn("step", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("w") * F.col("h") / 6000) + 0.5)))
    top = pixels.filter(F.col("py") < max(CORNER[1][1], BAND[1]))
    inside = (F.col("px") >= F.col("x")) & (F.col("px") < F.col("x") + F.col("w")) & (F.col("py") < F.col("h")) & ((F.col("px") - F.col("x")) % F.col("step") == 0) & (F.col("py") % F.col("step") == 0)
    seen = top.join(areas, "image_id").filter(inside).withColumn("colour", colour_key())
    text = covered_pixels(top.select("image_id", "px", "py"), boxes.select("image_id", *(F.col(c) - 2 if c in "xy" else F.col(c) + 4 for c in BOX)).toDF("image_id", *BOX), 0.0).withColumn("text", F.lit(True))
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    saturation = F.when(most > 0, (most - least) / most).otherwise(0.0)
    both = seen.join(commonest(seen, ["image_id", "area"]), ["image_id", "area"]).join(text, ["image_id", "px", "py"], "left").filter("text is null")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    found = both.groupBy("image_id", "area").agg(share(far_from(F.col("paper")) > INK).alias("ink"), share((saturation > 0.5) & (most > 40)).alias("strong"))
    papers = commonest(seen, ["image_id", "area"])
    m = [F.floor(F.col("paper") / d) % 16 * 16 + 8 for d in (256, 16, 1)]
    papers = papers.withColumn("deep", (F.greatest(*m) - F.least(*m)) / F.greatest(*m) > 0.45)
    all_ = papers.join(found, ["image_id", "area"], "left").groupBy("image_id").agg(
        F.max((F.col("area") != "band") & F.coalesce((F.col("ink") > 0.06) & (F.col("ink") < 0.85), F.lit(False))).alias("corner"),
        F.max((F.col("area") == "band") & (F.col("deep") | F.coalesce(F.col("strong") > 0.35, F.lit(False)))).alias("header"),
    )
    return sizes.select("image_id").join(all_, "image_id", "left").na.fill(False, ["corner", "header"])
