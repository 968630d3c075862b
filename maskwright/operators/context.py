"""What stands around a box: context, labels, months; second readings of regions; made-up values that clash with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.columns import once
from maskwright.functions.dates import MONTHS, parse_date
from maskwright.functions.fakes import ID_SHAPE, fake_id_digits
from maskwright.functions.labels import role_of
from maskwright.functions.text import classify
from maskwright.operators.geometry import BOX, near_pairs
from maskwright.operators.masks import band
from maskwright.plans.store import written

# Reach of a context in heights, its words and characters; reach of a label; reach of neighbours.
SAME_LINE, BESIDE, ABOVE, ASIDE, MOST_WORDS, MOST_CHARS = 0.6, 8, 3.5, 4, 6, 120
LEFT, LEFT_WORDS, HEADER = 6, 3, 24
# Confidence of a safe second reading, of a date in it, of a weak number.
LOOK_CONF, DATE_CONF, WEAK_CONF = 70, 60, 85


def around(boxes: DataFrame, words: DataFrame, key: str, dx: float, up: float, down: float) -> DataFrame:
    """Pairs of boxes (``m_*``) and words (``w_*``) of a picture, all that are within ``dx`` heights of the box to the
    sides, ``up`` above and ``down`` below, and more; heights are those of the taller of both."""
    own = lambda p, names: [F.col(n).alias(f"{p}_{n}") for n in names]
    x, y, w, h = (F.col(n) for n in BOX)
    a = boxes.select("image_id", *own("m", (key, *BOX)), (x - dx * h).alias("a_x"), (y - up * h).alias("a_y"), (w + 2 * dx * h).alias("a_w"), (h * (1 + up + down)).alias("a_h"))
    b = words.select("image_id", *own("w", ("word_id", "text", *BOX)), (x - down * h).alias("b_x"), (y - down * h).alias("b_y"), (w + 2 * down * h).alias("b_w"), (h * (1 + up + down)).alias("b_h"))
    return near_pairs(a, b).drop("a_x", "a_y", "a_w", "a_h", "b_x", "b_y", "b_w", "b_h")


def _m(c: str) -> Column:
    return F.col(f"m_{c}")


def _w(c: str) -> Column:
    return F.col(f"w_{c}")


def _same_line() -> Column:
    return F.abs(_w("y") + _w("h") / 2 - (_m("y") + _m("h") / 2)) < F.greatest(_m("h"), _w("h")) * SAME_LINE


def context_for(masks: DataFrame, visible: DataFrame, key: str = "mask_id") -> DataFrame:
    """(image_id, key, context): up to six visible words nearest to each box, in reading order, 120 characters at most.

    Near are words of its line within eight heights and words above within three and a half lines, not far aside; those
    above count from two heights on. Equals go by word id; a box without such words has an empty context.
    """
    cy, wy, tall = _m("y") + _m("h") / 2, _w("y") + _w("h") / 2, F.greatest(_m("h"), _w("h"))
    right, mright = _w("x") + _w("w"), _m("x") + _m("w")
    dx = F.when(right < _m("x"), _m("x") - right).when(_w("x") > mright, _w("x") - mright).otherwise(0.0)
    above = (wy < cy) & (cy - wy < tall * ABOVE) & (_w("x") < mright + _m("h") * ASIDE) & (right > _m("x") - _m("h") * ASIDE)
    far = F.when(_same_line() & (dx < _m("h") * BESIDE), dx).when(above, _m("h") * 2 + (cy - wy) + dx * 0.5)
    near = around(masks, visible, key, BESIDE, ABOVE, 1).withColumn("far", far).filter("far is not null")
    nearest = near.withColumn("nr", F.row_number().over(Window.partitionBy("image_id", f"m_{key}").orderBy("far", "w_word_id"))).filter(F.col("nr") <= MOST_WORDS)
    words = F.sort_array(F.collect_list(F.struct(band("w_y").alias("b"), _w("x").alias("x"), _w("word_id").alias("i"), _w("text").alias("t"))))
    texts = nearest.groupBy("image_id", _m(key).alias(key)).agg(F.substring(F.array_join(F.transform(words, lambda s: s["t"]), " "), 1, MOST_CHARS).alias("context"))
    return masks.select("image_id", key).join(texts, ["image_id", key], "left").na.fill("", ["context"])


def label_for(masks: DataFrame, visible: DataFrame, key: str = "mask_id", role: Callable[[Column], Column] = role_of) -> DataFrame:
    """(image_id, key, label): the up to three words just left of a box if they name a role; else the nearest line above in
    its columns that names one; else the words to the left, or nothing."""
    pairs = around(masks, visible, key, LEFT, HEADER, 1)
    right = _w("x") + _w("w")
    at = ["image_id", F.col(f"m_{key}").alias(key)]
    beside = pairs.filter(_same_line() & (right <= _m("x") + 2) & (_m("x") - right < _m("h") * LEFT))
    closest = beside.withColumn("nr", F.row_number().over(Window.partitionBy("image_id", f"m_{key}").orderBy(_w("x").desc(), "w_word_id"))).filter(F.col("nr") <= LEFT_WORDS)
    texts = lambda *order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, _w("text").alias("t")))), lambda s: s["t"]), " ")
    left = closest.groupBy(*at).agg(texts((-F.col("nr")).alias("o")).alias("left"))
    over = pairs.filter((_w("y") + _w("h") <= _m("y") + 2) & (_m("y") - _w("y") < _m("h") * HEADER) & (_w("x") < _m("x") + _m("w") + _m("h")) & (right > _m("x") - _m("h")))
    line = F.floor((_w("y") + _w("h") / 2) / F.greatest(F.lit(4.0), _m("h") * 0.6) + 0.5)
    lines = over.groupBy(*at, line.alias("line")).agg(texts(_w("x").alias("x"), _w("word_id").alias("i")).alias("t"))
    header = lines.filter(role(F.col("t")).isNotNull()).groupBy("image_id", key).agg(F.max_by("t", "line").alias("header"))
    all_ = masks.select("image_id", key).join(left, ["image_id", key], "left").join(header, ["image_id", key], "left")
    return all_.select("image_id", key, F.coalesce(F.when(role(F.col("left")).isNotNull(), F.col("left")), "header", "left", F.lit("")).alias("label"))


def after_month(tokens: DataFrame, visible: DataFrame, key: str = "mask_id") -> DataFrame:
    """(image_id, key) of boxes right after or before a readable month name on their line."""
    name = F.lower(F.regexp_replace(F.regexp_replace("text", r"[.,]\z", ""), r"\.\z", ""))
    months = visible.filter((F.length(name) >= 3) & F.exists(F.array(*map(F.lit, MONTHS)), lambda m: F.startswith(m, name)) & name.rlike(r"\A[a-z]+\z"))
    reach = F.greatest(_m("h"), _w("h")) * 1.2
    right, mright = _w("x") + _w("w"), _m("x") + _m("w")
    before = (right <= _m("x") + 2) & (_m("x") - right < reach)
    after = (_w("x") >= mright - 2) & (_w("x") - mright < reach)
    return around(tokens, months, key, 2, 1, 2).filter(_same_line() & (before | after)).select("image_id", _m(key).alias(key)).distinct()


def second_look(regions: DataFrame, readings: DataFrame) -> DataFrame:
    """What a second reading makes of each region.

    ``regions``: image_id, region_id, slanted, glyph (as small as one character). ``readings``: image_id, region_id, nr,
    words (array of text, conf). A reading is as sure as its least sure word. The first that is sure to 70 counts, else the
    surest. Returns image_id, region_id, conf, reading, read (what a made-up value replaces), weak (a small number), date (of
    slanted ones), safe (may stay readable): all words safe and one with a letter, one mark repeated, or glyph-sized without
    any character in any reading. Regions without readings are not safe, unless glyph-sized.
    """
    sure = F.coalesce(F.array_min(F.transform("words", lambda w: w["conf"])), F.lit(0.0)).cast("double")
    seen = readings.select("image_id", "region_id", "nr", "words", sure.alias("conf"), F.exists("words", lambda w: w["text"].rlike(r"[\p{L}\p{N}]")).alias("characters"))
    rank = F.struct((F.col("conf") >= LOOK_CONF).alias("enough"), F.when(F.col("conf") >= LOOK_CONF, 0.0).otherwise(F.col("conf")).alias("c"), (-F.col("nr")).alias("n"))
    # with a sure reading the later ones are not made: their characters do not count
    best = seen.groupBy("image_id", "region_id").agg(F.max_by(F.struct("words", "conf"), rank).alias("best"), F.max("characters").alias("characters"))
    both = regions.join(best, ["image_id", "region_id"], "left").withColumns({"conf": F.coalesce("best.conf", F.lit(0.0)), "characters": F.coalesce("characters", F.lit(False))})
    texts = F.when(F.col("conf") > 0, F.transform("best.words", lambda w: w["text"])).otherwise(F.array().cast("array<string>"))
    both = both.withColumn("texts", texts)
    joined = F.trim(F.array_join("texts", " "))
    both = both.withColumn("reading", F.regexp_replace(joined, r"\A[^\p{L}\p{N}(]+|[^\p{L}\p{N}.)%]+\z", ""))
    level, ok = ~F.col("slanted"), F.col("conf") >= LOOK_CONF
    full = ok & level & ~F.col("glyph") & (F.length(F.regexp_replace("reading", r"[^\p{L}\p{N}]", "")) >= 2)
    weak = ~full & level & (F.col("conf") >= WEAK_CONF) & F.col("reading").rlike(r"\A[0-9]{1,2}\z")
    words_ok = F.exists("texts", lambda t: t.rlike(r"\p{L}")) & F.forall("texts", lambda t: classify(t).isNull())
    marks = ~F.col("reading").rlike("[0-9]") & F.regexp_replace("reading", r"\s", "").rlike(r"\A(\S)\1{2,}\z")
    slant = F.when(~level & (F.col("conf") >= DATE_CONF), F.col("reading"))
    date = F.when(parse_date(slant).isNotNull(), slant)
    safe = date.isNull() & ((ok & words_ok) | (F.col("glyph") & ~F.col("characters")) | (ok & marks))
    return both.select("image_id", "region_id", "conf", "reading", F.when(full | weak, F.col("reading")).alias("read"), weak.alias("weak"), slant.alias("slant_read"), date.alias("date"), safe.alias("safe"))


def complete_years(looked: DataFrame) -> DataFrame:
    """Dates of slanted labels whose year was cut short, completed with the commonest year of the page's whole dates (two
    at least; the earliest of equals)."""
    year = F.regexp_extract("date", "(?:19|20)[0-9]{2}", 0)
    counts = looked.filter(F.col("date").isNotNull() & (year != "")).groupBy("image_id", year.alias("y")).agg(F.count("*").alias("n"), F.min("region_id").alias("first"))
    years = counts.groupBy("image_id").agg(F.max_by("y", F.struct("n", -F.col("first"))).alias("year"), F.sum("n").alias("all")).filter("all >= 2").select("image_id", "year")
    cut = F.regexp_extract("slant_read", r"(?:^|[\s,])((?:19|20)[0-9]?)\z", 1)
    both = looked.join(years, "image_id", "left")
    whole = F.concat(F.col("slant_read").substr(F.lit(1), F.length("slant_read") - F.length(cut)), F.col("year"))
    mended = F.when(F.col("date").isNull() & (cut != "") & F.startswith(F.col("year"), cut), whole)
    mended = F.when(parse_date(mended).isNotNull(), mended)
    return both.withColumns({"safe": F.col("safe") & mended.isNull(), "date": F.coalesce("date", mended)}).drop("year")


def redraw_clashes(values: DataFrame, visible: DataFrame, key: str = "mask_id") -> DataFrame:
    """(image_id, key, made): of each value's ``draws`` the first that shares no word of three letters with a readable word
    or another made-up value right beside it; the first draw if all do, or if the value is a number or a date.

    ``values``: image_id, key, kind, box, draws (array). Beside are boxes of one line less than one and a half heights away.
    Readable words count exactly; of made-up neighbours those before in the order of ``key``, as chosen by readable words.
    """
    words_of = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)
    reach = F.greatest(_m("h"), F.lit(8.0)) * 1.5
    beside = _same_line() & ((F.abs(_m("x") - (_w("x") + _w("w"))) < reach) | (F.abs(_w("x") - (_m("x") + _m("w"))) < reach))

    def taboo(words: DataFrame, cond: Column) -> DataFrame:
        near = around(values, words, key, 2, 1, 2).filter(beside & cond)
        return near.groupBy("image_id", _m(key).alias(key)).agg(F.array_distinct(F.flatten(F.collect_list(words_of(_w("text"))))).alias("taboo"))

    def choose(sets: Column) -> Column:
        free = F.get(F.filter("draws", lambda d: ~F.arrays_overlap(words_of(d), sets)), F.lit(0))
        first = F.get("draws", F.lit(0))
        return F.when(F.col("kind").isin("number", "date"), first).otherwise(F.coalesce(free, first))

    none = F.array().cast("array<string>")
    own = values.select("image_id", key, "kind", "draws", *BOX)
    # what readable words forbid is found once, for both choices
    first = own.join(taboo(visible, F.lit(True)), ["image_id", key], "left").withColumn("taboo", F.coalesce("taboo", none))
    first = written(once(first, _once=choose(F.col("taboo"))), "once")
    made = first.select("image_id", F.col(key).alias("word_id"), F.col("_once").alias("text"), *BOX)
    later = taboo(made, _w("word_id") < _m(key)).withColumnRenamed("taboo", "_made")
    both = first.join(later, ["image_id", key], "left")
    return both.select("image_id", key, choose(F.array_union("taboo", F.coalesce("_made", none))).alias("made"))


def fake_ids(tokens: DataFrame, seed: int, key: str = "mask_id", least: int = 3) -> DataFrame:
    """(image_id, key, made): ids whose prefix ``least`` ids of the page share keep it and get other digits; for others null."""
    prefix = F.regexp_extract(F.trim("text"), ID_SHAPE, 1)
    own = tokens.select("image_id", key, "text", F.when(prefix != "", prefix).alias("prefix"))
    counts = own.filter("prefix is not null").groupBy("image_id", "prefix").agg(F.count("*").alias("n"))
    both = own.join(counts, ["image_id", "prefix"], "left")
    made = fake_id_digits(F.col("text"), F.concat_ws("|", F.col(key).cast("string"), "text"), seed)
    return both.select("image_id", key, F.when(F.col("n") >= least, made).alias("made"))
