"""From classified words to masks: reading order, merging, padding, unions, counts; and the page-wise word filters."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.columns import once
from maskwright.functions.text import NEUTRAL, NUMBER, classify, core, with_type
from maskwright.operators.blocks import by_page, numbers
from maskwright.operators.geometry import centre_in, greedy, near_pairs, overlap, overlap_join, prefixed
from maskwright.plans.store import written

#: Pixels of a reading-order band.
BAND = 8

# Words beside which a small number is a label.
RANK_WORDS = "top bottom first last best worst leading lowest highest next past previous prior rolling trailing latest recent".split()
SEQUENCE_WORDS = "week wk step phase tier level stage wave page round sprint version release grade rank no number".split()


def band(y: Column | str = "y") -> Column:
    c = F.col(y) if isinstance(y, str) else y
    return F.floor(c / BAND + 0.5)


def reading_order(df: DataFrame, name: str = "rank") -> DataFrame:
    w = Window.partitionBy("image_id").orderBy(band(), "x", "word_id")
    return df.withColumn(name, F.row_number().over(w).cast("long"))


def typed(words: DataFrame, allow: Sequence[str] = NEUTRAL, clients: Sequence[str] = ()) -> DataFrame:
    return with_type(words, "text", "type", allow, clients)


_ORDER = ["x", "word_id"]
_MASK = "mask_id long, type string, text string, x double, y double, w double, h double, conf double, n_words long"


def build_masks(words: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Flagged words (``type`` not null) in reading order, merged with the previous word's group on one line.

    The previous word stands for its group's box, which is exact where words of a line share one height, as on the grid of
    ``words_from_text``; ``build_masks_exact`` keeps the running box.
    """

    def go(t: pa.Table, begins: np.ndarray) -> pa.Table:
        x, y, w, h, conf = numbers(t, *"xywh", "conf")
        kind = t["type"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore"):  # a missing box joins nothing
            level = np.abs(y[:-1] + h[:-1] / 2 - (y[1:] + h[1:] / 2)) < np.maximum(h[:-1], h[1:]) * 0.6
            joins = (kind[1:] == kind[:-1]) & level & (x[1:] - (x[:-1] + w[:-1]) < np.maximum(14.0, h[1:] * 1.2)) & (x[1:] >= x[:-1])
        new = np.append(True, ~joins)
        new[begins] = True
        starts, run = np.flatnonzero(new), np.cumsum(new)
        first = np.repeat(run[begins], np.diff(np.append(begins, len(x))))
        place = np.lexsort((t["word_id"].to_numpy(), x, run))  # words of one place may be of two bands
        text = t["text"].combine_chunks().take(pa.array(place))
        held = np.append(0, np.cumsum(text.is_valid().to_numpy(zero_copy_only=False)))
        texts = pa.ListArray.from_arrays(pa.array(held[np.append(starts, len(x))], pa.int32()), text.drop_null())
        left, top = np.fmin.reduceat(x, starts), np.fmin.reduceat(y, starts)
        made = {
            "mask_id": pa.array((run - first + 1)[starts]), "text": pc.binary_join(texts, " "), "x": left, "y": top,
            "w": np.fmax.reduceat(x + w, starts) - left, "h": np.fmax.reduceat(y + h, starts) - top,
            "conf": np.fmin.reduceat(conf, starts), "n_words": np.diff(np.append(starts, len(x))),
        }
        out = t.select(["image_id", *carry, "type"]).take(pa.array(starts))
        for name, values in made.items():
            out = out.append_column(name, values if isinstance(values, pa.Array) else pa.array(values, from_pandas=True))
        return out

    flagged = words.filter("type is not null").select("image_id", *carry, "word_id", "type", "text", "x", "y", "w", "h", "conf")
    shape = ", ".join(f"{c} {flagged.schema[c].dataType.simpleString()}" for c in ("image_id", *carry))
    return by_page(flagged, [band(), *_ORDER], go, f"{shape}, {_MASK}")


MASK_SHAPE = f"image_id string, {_MASK}"


def build_masks_exact(words: DataFrame) -> DataFrame:
    """``build_masks`` with the running box of a group, for words of mixed heights; one picture at a time."""

    def go(t: pa.Table, begins: np.ndarray) -> pa.Table:
        out: list[list] = []
        starts, g, nr = set(begins.tolist()), None, 0
        rows = zip(*(t[c].to_pylist() for c in ("image_id", "type", "text", "x", "y", "w", "h", "conf")), strict=True)
        for i, (image, kind, text, x, y, w, h, conf) in enumerate(rows):
            if i in starts:
                g, nr = None, 0
            if g and g[2] == kind and abs(g[5] + g[7] / 2 - (y + h / 2)) < max(g[7], h) * 0.6 and x - (g[4] + g[6]) < max(14, h * 1.2) and x >= g[4]:
                right, top, bottom = max(g[4] + g[6], x + w), min(g[5], y), max(g[5] + g[7], y + h)
                g[3].append(text)
                g[6], g[5], g[7], g[8], g[9] = right - g[4], top, bottom - top, min(g[8], conf), g[9] + 1
            else:
                nr += 1
                g = [image, nr, kind, [text], x, y, w, h, conf, 1]
                out.append(g)
        for g in out:
            g[3] = " ".join(g[3])
        return pa.Table.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[c.split()[0] for c in MASK_SHAPE.split(", ")])

    flagged = words.filter("type is not null").select("image_id", "word_id", "type", "text", "x", "y", "w", "h", "conf")
    return by_page(flagged, [band(), *_ORDER], go, MASK_SHAPE)


def pad_masks(masks: DataFrame) -> DataFrame:
    """Boxes grown on each side by 0.18 of their height, at least 3 pixels; the old box stays as ``core``."""
    p = F.greatest(F.lit(3.0), F.col("h") * 0.18)
    return masks.withColumn("core", F.struct("x", "y", "w", "h")).withColumns({"x": F.col("x") - p, "y": F.col("y") - p, "w": F.col("w") + 2 * p, "h": F.col("h") + 2 * p})


def all_masks(*layers: DataFrame) -> DataFrame:
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


def mask_counts(masks: DataFrame, *dims: str) -> DataFrame:
    """Active masks per type and per ``dims``, with totals over each (null names the total)."""
    return (masks.filter("on") if "on" in masks.columns else masks).cube(*dims, "type").agg(F.count("*").alias("n_masks"))


def without_ghosts(words: DataFrame) -> DataFrame:
    return words.filter(~F.col("ghost")) if "ghost" in words.columns else words


def tally(words: DataFrame, masks: DataFrame, session: Sequence[str] = ()) -> DataFrame:
    """Per picture: words hidden (centre in an active mask), words kept, and decisions of the user; ghosts do not count."""
    words = without_ghosts(words)
    active = masks.filter("on")
    pairs = near_pairs(prefixed(words.select("image_id", "word_id", "x", "y", "w", "h"), "a_"), prefixed(active.select("image_id", "x", "y", "w", "h"), "b_"))
    hidden = pairs.filter(centre_in("a_", "b_")).select("image_id", F.col("a_word_id").alias("word_id")).distinct().withColumn("hidden", F.lit(1))
    counts = words.join(hidden, ["image_id", "word_id"], "left").groupBy("image_id").agg(F.count("hidden").alias("hidden"), (F.count("*") - F.count("hidden")).alias("kept"))
    user = masks.groupBy("image_id").agg(F.count(F.when(F.col("user_off") | F.col("src").isin("manual", "check", "user"), 1)).alias("yours"))
    return counts.join(user, "image_id", "left").select("image_id", "hidden", "kept", (F.coalesce("yours", F.lit(0)) + len(session)).cast("long").alias("yours"))


def published_words(words: DataFrame, masks: DataFrame) -> DataFrame:
    """The view that may leave: text is emptied where a word's centre is in an active mask; ghosts are left out."""
    words = without_ghosts(words)
    pairs = near_pairs(prefixed(words.select("image_id", "word_id", "x", "y", "w", "h"), "a_"), prefixed(masks.filter("on").select("image_id", "x", "y", "w", "h"), "b_"))
    hidden = pairs.filter(centre_in("a_", "b_")).select("image_id", F.col("a_word_id").alias("word_id")).distinct().withColumn("hidden", F.lit(True))
    both = words.join(hidden, ["image_id", "word_id"], "left")
    return both.select("image_id", "word_id", F.when(F.col("hidden"), "").otherwise(F.col("text")).alias("text"), "x", "y", "w", "h", F.col("hidden").isNull().alias("kept"))


def kept_words(words: DataFrame, allow: Sequence[str] = NEUTRAL) -> DataFrame:
    """Distinct safe words of a page for review: three letters or more, no digit, not flagged; the first spelling stays."""
    bare = core("text")
    ok = words.withColumn("bare", bare).filter((F.length(F.regexp_replace("bare", r"[^\p{L}]", "")) >= 3) & ~F.col("text").rlike("[0-9]") & classify("text", allow).isNull())
    return ok.groupBy("image_id", F.lower("bare").alias("word")).agg(F.min_by("bare", "word_id").alias("spelling"), F.count("*").alias("n"))


def upper_median(df: DataFrame, value: str, key: str = "image_id", name: str = "median") -> DataFrame:
    """Per key the upper median of its values. For groups as large as a page; see ``large_upper_median``."""
    ordered = F.sort_array(F.collect_list(value))
    return df.groupBy(key).agg(F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")).alias(name))


def large_upper_median(df: DataFrame, value: str, key: str, name: str = "median") -> DataFrame:
    """``upper_median`` for groups of any size: a sketch bounds where the median lies, and only what lies there is ordered.

    The sketch's ranks are right within a ten-thousandth of the group, so that its 49.9th and 50.1st percent enclose the
    median; values between them are counted per value before their order is summed up.
    """
    own = df.filter(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    bounds = own.groupBy("_key").agg(F.percentile_approx("_value", [0.499, 0.501], 10_000).alias("_b"), F.count("*").alias("_n"))
    both = own.join(bounds, "_key")
    low = F.col("_value") < F.get("_b", F.lit(0))
    near = both.filter(F.col("_value") <= F.get("_b", F.lit(1))).groupBy("_key", F.when(~low, F.col("_value")).alias("_v")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    up_to = F.sum("_c").over(Window.partitionBy("_key").orderBy(F.col("_v").asc_nulls_first()))
    found = near.withColumn("_up", up_to).filter(F.col("_v").isNotNull() & (F.col("_up") > F.floor(F.col("_n") / 2)))
    return found.groupBy(F.col("_key").alias(key)).agg(F.min("_v").alias(name))


def plausible(words: DataFrame) -> DataFrame:
    """Without readings that cannot be text, judged against the page's median height."""
    both = words.join(upper_median(words, "h", name="med"), "image_id")
    bare = F.regexp_replace("text", r"\s", "")
    tall, digit = F.col("h") / F.col("med"), F.col("text").rlike("[0-9]")
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    chars = F.greatest(F.lit(1), F.length(bare))
    bad = (
        bare.rlike(r"\A[1Il|!\[\]{}()]{3,}\z")
        | ((F.col("w") < 2) & (F.col("h") <= F.col("med") * 0.5) & (F.col("conf") < 80))
        | ((tall > 8) & ~(digit & (F.col("conf") >= 90)))
        | ((tall > 15) & (F.col("w") > F.col("med") * 15))
        | ((tall > 3) & ~digit & ((F.col("conf") < 80) | (letters < 3)))
        | ((tall > 4) & (F.col("conf") < 70))
        | ((F.col("w") > F.col("h") * chars * 2.5) & (F.col("w") > F.col("med") * 12) & (F.col("conf") < 85))
    )
    return both.filter(~bad).drop("med")


def n_letters(c: str) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def flag_ghosts(words: DataFrame) -> DataFrame:
    """``words`` with ``ghost``: a reading with digits and under three letters on top of a sure word without digits."""
    maybe = words.filter(F.col("text").rlike("[0-9]") & (n_letters("text") < 3)).select("image_id", "word_id", "x", "y", "w", "h")
    sure = words.filter((F.col("conf") >= 85) & ~F.col("text").rlike("[0-9]") & (n_letters("text") >= 1)).select("image_id", "word_id", "x", "y", "w", "h")
    hit = overlap_join(maybe, sure, 0.3).select("image_id", F.col("a_word_id").alias("word_id")).distinct().withColumn("ghost", F.lit(True))
    return words.join(hit, ["image_id", "word_id"], "left").withColumn("ghost", F.coalesce("ghost", F.lit(False)))


def mark_only(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Unsure scraps of at most three letters where no text region overlaps by more than 0.2."""
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    scraps = words.filter(~F.col("text").rlike("[0-9]") & (F.col("conf") < 60) & (letters <= 3) & (F.length(F.regexp_replace("text", r"\s", "")) <= 4))
    seen = overlap_join(scraps.select("image_id", "word_id", "x", "y", "w", "h"), regions.select("image_id", "region_id", "x", "y", "w", "h"), 0.2)
    return scraps.join(seen.select("image_id", F.col("a_word_id").alias("word_id")).distinct(), ["image_id", "word_id"], "left_anti")


def merge_passes(words: DataFrame, passes: Sequence[str]) -> DataFrame:
    """Words of several readings, pass by pass: a later word stays where no earlier one overlaps it by more than 0.3, or
    where it has a digit and none of those has."""
    out = words.filter(F.col("pass") == passes[0])
    for p in passes[1:]:
        new = words.filter(F.col("pass") == p)
        slim = lambda d: d.select("image_id", "word_id", "text", "x", "y", "w", "h")
        hits = overlap_join(slim(new), slim(out), 0.3).groupBy("image_id", F.col("a_word_id").alias("word_id")).agg(F.max(F.col("b_text").rlike("[0-9]")).alias("digit"))
        both = new.join(hits, ["image_id", "word_id"], "left")
        kept = both.filter(F.col("digit").isNull() | (F.col("text").rlike("[0-9]") & ~F.col("digit"))).drop("digit")
        out = out.unionByName(kept)
    return out


def merge_passes_strict(words: DataFrame, passes: Sequence[str], threshold: float = 0.3) -> DataFrame:
    """Words of several readings in order, pass by pass and by ``word_id``: one stays where no kept one overlaps it by more,
    of its own pass or another; digits give no right of way. ``word_id`` is unique in a picture."""
    place = F.struct(F.array_position(F.array(*map(F.lit, passes)), F.col("pass")).alias("nr"), F.col("word_id").alias("id"))
    own = words.filter(F.col("pass").isin(*passes)).withColumn("_place", place)
    slim = own.select("image_id", "word_id", "_place", "x", "y", "w", "h")
    return greedy(own, overlap_join(slim, slim, threshold).filter(F.col("a__place") < F.col("b__place"))).drop("_place")


def label_text(c: str) -> Column:
    trimmed = F.regexp_replace(F.col(c), r"\A\s+|\s+\z", "")
    return F.lower(F.regexp_replace(trimmed, r"\A[^\p{L}\p{N}_]+|[^\p{L}\p{N}_%]+\z", ""))


def beside(words: DataFrame, direction: int = -1, of: DataFrame | None = None) -> DataFrame:
    """Per word (``of``: of these words only) its nearest neighbour to the left (-1) or right (1) on the line: image_id,
    word_id, n_word_id, n_text, gap."""
    slim = lambda d: d.select("image_id", "word_id", "text", "x", "y", "w", "h")
    reach = F.greatest(F.col("a_h"), F.lit(8.0)) * 3
    pairs = near_pairs(prefixed(slim(words if of is None else of), "a_"), prefixed(slim(words), "b_"), reach_x=reach).filter("a_word_id != b_word_id")
    a, b = (lambda n: F.col("a_" + n)), (lambda n: F.col("b_" + n))
    level = F.abs(b("y") + b("h") / 2 - a("y") - a("h") / 2) <= F.greatest(a("h"), b("h")) * 0.6
    apart = F.least(a("x") + a("w"), b("x") + b("w")) - F.greatest(a("x"), b("x")) <= F.least(a("w"), b("w")) * 0.3
    gap = (a("x") - (b("x") + b("w"))) if direction < 0 else (b("x") - (a("x") + a("w")))
    ok = pairs.withColumn("gap", gap).filter(level & apart & (F.col("gap") >= -2) & (F.col("gap") <= F.greatest(a("h"), F.lit(8.0)) * 3))
    best = F.min_by(F.struct("b_word_id", "b_text"), F.struct("gap", "b_word_id"))
    return ok.groupBy("image_id", F.col("a_word_id").alias("word_id")).agg(best.alias("n"), F.min("gap").alias("gap")).select("image_id", "word_id", F.col("n.b_word_id").alias("n_word_id"), F.col("n.b_text").alias("n_text"), "gap")


def count_labels(words: DataFrame) -> DataFrame:
    """Small numbers that label a visual ("Top 5", "Week 34", "Page 1 of 3"): image_id, word_id."""
    wide = once(words, low=label_text("text"))
    glued = F.col("low").rlike(r"\A(top|bottom)[-_]?[0-9]{1,3}%?\z")
    small = F.col("low").rlike(r"\A[0-9]{1,3}%?\z") & F.expr("try_cast(replace(low, '%', '') as int) between 1 and 500")
    own = once(wide, _small=small, _glued=glued).filter(F.col("_small") | F.col("_glued") | (F.col("low") == "of"))
    near = beside(words, -1, own).withColumn("n_low", label_text("n_text"))
    # few words are numbers or "of": they and their neighbours are found once
    label = F.col("_glued") | (F.col("_small") & F.coalesce(F.col("n_low").isin(*RANK_WORDS, *SEQUENCE_WORDS), F.lit(False)))
    slim = own.select("image_id", "word_id", "low", "_small", "_glued")
    found = written(slim.join(near, ["image_id", "word_id"], "left").select("image_id", "word_id", "n_word_id", label.alias("label"), (F.col("low") == "of").alias("of"), (F.col("_small") & (F.col("n_low") == "of")).alias("after")), "labels")
    safe = found.filter("label").select("image_id", "word_id")
    first = found.filter("of").join(safe.withColumnRenamed("word_id", "n_word_id"), ["image_id", "n_word_id"], "left_semi").select("image_id", F.col("word_id").alias("n_word_id"))
    return safe.union(found.filter("after").join(first, ["image_id", "n_word_id"], "left_semi").select("image_id", "word_id")).distinct()


def column_fill(masks: DataFrame) -> DataFrame:
    """Stacks of three or more number masks in one column with a steady row step become one "(table column)" mask."""

    def stacks(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> list[tuple]:
        used, fills = np.zeros(len(x), bool), []
        for a in range(len(x)):
            if used[a]:
                continue
            shared = np.minimum(x[a] + w[a], x + w) - np.maximum(x[a], x)
            col = np.flatnonzero((shared > 0.5 * np.minimum(w[a], w)) & (np.abs(h - h[a]) < np.maximum(h, h[a]) * 0.35))
            col = col[np.argsort(y[col], kind="stable")]
            if len(col) < 3:
                continue
            row, runs, run, step = h[col].min(), [], [col[0]], 0.0
            for i, j in zip(col[:-1], col[1:], strict=True):
                gap = y[j] - y[i]
                if gap <= 0:
                    continue
                if (gap <= step * 2.2 and gap * 2.2 >= step) if step else gap <= row * 4:
                    step = gap if not step else min(step, gap)
                    run.append(j)
                else:
                    runs.append(run)
                    run, step = [j], 0.0
            for r in [*runs, run]:
                if len(r) < 3:
                    continue
                left, right = x[r].min(), (x[r] + w[r]).max()
                if right - left <= w[r].max() * 1.4 + row:
                    used[r] = True
                    fills.append((left, y[r[0]], right - left, y[r[-1]] + h[r[-1]] - y[r[0]], len(r)))
        return fills

    def go(t: pa.Table, begins: np.ndarray) -> pa.Table:
        box = numbers(t, *"xywh")
        found = [(a, f) for a, b in pairwise([*begins.tolist(), t.num_rows]) if b - a >= 3 for f in stacks(*(c[a:b] for c in box))]
        made = list(zip(*(f for _, f in found), strict=True)) or [()] * 5
        own = t.select(["image_id", "type"]).take(pa.array([a for a, _ in found], pa.int64()))
        own = own.append_column("text", pa.array(["(table column)"] * len(found), pa.string()))
        for name, values in zip((*"xywh", "n_rows"), made, strict=True):
            own = own.append_column(name, pa.array(values, pa.int64() if name == "n_rows" else pa.float64()))
        return own

    slim = masks.filter((F.col("type") == NUMBER) & (F.col("w") < 260)).select("image_id", "mask_id", "type", "x", "y", "w", "h")
    # equal numbers go by their boxes, so that the order rows arrive in decides nothing
    return by_page(slim, ["mask_id", "x", "y", "w", "h"], go, "image_id string, type string, text string, x double, y double, w double, h double, n_rows long")
