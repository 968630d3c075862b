"""Rules over whole pages: releases, names, decisions, emails, columns, scores, regions, unread parts, lines, numbers."""

import re

from pyspark.sql import functions as F

from maskwright.functions.numbers import fake_value
from maskwright.functions.text import scrub
from maskwright.operators import geometry as G
from maskwright.operators import lines as L
from maskwright.operators import masks as M
from maskwright.operators import models as N
from maskwright.operators import replace as X
from maskwright.operators import score as S
from maskwright.operators import verify as V

BOXES = "x double, y double, w double, h double"


def test_release_holds_a_file_only_if_no_page_passed(spark):
    pages = [("a", "a1", 1, False, "pass"), ("a", "a2", 2, False, "blocked"), ("b", "b1", 1, False, "review"), ("c", "c1", 1, True, "pass"), ("c", "c2", 2, False, "pass"), ("d", "d1", 1, False, "pass")]
    pages += [("e", f"e{i:02}", i, False, "pass") for i in range(40)]
    df = spark.createDataFrame(pages, "file string, image_id string, page int, failed boolean, gate string")
    got = {r["file"]: (r["status"], r["note"]) for r in V.release_notes(V.release(df.drop("gate"), df.select("image_id", "gate"))).collect()}
    assert got == {"a": ("done", "2 pages, 1 held back"), "b": ("held", ""), "c": ("error", ""), "d": ("done", ""), "e": ("done", "first 30 of 40 pages")}


def test_names_take_the_first_free_number(spark):
    names = ["a.png", "a.png", "a-2.png", "a.png", "b.png", "b-2.png", "b.png", "c.png", "c.png", "plain", "plain", "x-2-2.png", "x-2.png", "x.png", "x.png", "x-2.png"]
    got = {r["id"]: r["out"] for r in V.dedupe_names(spark.createDataFrame(list(enumerate(names)), "id long, name string")).collect()}
    want, used = {}, set()
    for i, n in enumerate(names):
        out, k = n, 2
        while out in used and "." in n:
            out, k = re.sub(r"(\.[^.]+)$", rf"-{k}\1", n), k + 1
        used.add(out)
        want[i] = out
    assert got == want and got[2] == "a-2-2.png"


def test_decisions_are_carried_over(spark):
    shape = f"image_id string, mask_id long, type string, {BOXES}, src string, user_off boolean, `on` boolean"
    old = spark.createDataFrame([("i", 1, "t", 0.0, 0.0, 50.0, 12.0, "auto", True, False), ("i", 2, "t", 100.0, 0.0, 50.0, 12.0, "check", False, True), ("i", 3, "t", 200.0, 0.0, 50.0, 12.0, "user", True, False), ("i", 4, "t", 300.0, 0.0, 50.0, 12.0, "manual", False, True)], shape)
    new = spark.createDataFrame([("i", 11, "t", 3.0, 3.0, 45.0, 12.0, "auto"), ("i", 12, "t", 4.0, 0.0, 50.0, 12.0, "auto"), ("i", 13, "t", 200.0, 0.0, 50.0, 12.0, "auto")], f"image_id string, mask_id long, type string, {BOXES}, src string")
    got = {(r["mask_id"], r["src"]): r["on"] for r in V.carry_decisions(new, old).collect()}
    assert got == {(11, "auto"): False, (12, "auto"): True, (13, "auto"): True, (2, "check"): True, (3, "user"): False, (4, "manual"): True}


def test_emails_in_pieces(spark):
    rows = [("i", 1, "t", "aurelie", 0.0, 0.0, 49.0, 12.0), ("i", 2, "t", "@example.co", 52.0, 1.0, 77.0, 12.0), ("i", 3, "t", "m", 131.0, 0.0, 7.0, 12.0), ("i", 4, "t", "b", 300.0, 0.0, 7.0, 12.0), ("i", 5, "t", "@example.com", 315.0, 0.0, 77.0, 12.0)]
    got = {r["mask_id"]: (r["text"], r["type"], r["w"], r["n_pieces"]) for r in X.join_emails(spark.createDataFrame(rows, f"image_id string, mask_id long, type string, text string, {BOXES}")).collect()}
    assert got == {1: ("aurelie@example.com", "Email", 138.0, 3), 4: ("b", "t", 7.0, 1), 5: ("@example.com", "t", 77.0, 1)}


def test_masks_split_at_columns(spark):
    masks = spark.createDataFrame([("i", 1, "t", "m", -3.0, -3.0, 206.0, 18.0), ("i", 2, "t", "(table column)", -3.0, 37.0, 206.0, 18.0), ("i", 3, "t", "alone", 400.0, -3.0, 50.0, 18.0)], f"image_id string, mask_id long, type string, text string, {BOXES}")
    words = [("i", 1, "wide", 0.0, 0.0, 90.0, 12.0), ("i", 2, "in", 20.0, 0.0, 14.0, 12.0), ("i", 3, "in", 95.0, 0.0, 14.0, 12.0), ("i", 4, "far", 130.0, 0.0, 21.0, 12.0)]
    got = sorted((r["mask_id"], r["part"], r["text"], r["x"], r["w"]) for r in X.split_at_columns(masks, spark.createDataFrame(words, f"image_id string, word_id long, text string, {BOXES}")).collect())
    assert got == [(1, 0, "wide in", -3.0, 114.0), (1, 1, "far", 128.0, 75.0), (2, 0, "(table column)", -3.0, 206.0), (3, 0, "alone", 400.0, 50.0)]


def test_replacement_score(spark):
    truth = spark.createDataFrame([("i", k, x, 0.0, 10.0, 10.0, True) for k, x in enumerate((0.0, 20.0, 40.0, 60.0))] + [("j", 9, 0.0, 0.0, 1.0, 1.0, False)], f"image_id string, word_id long, {BOXES}, sensitive boolean")
    boxes = [("i", 5.0, 0.0, 10.0, 10.0, "a", "b", False, False), ("i", 19.0, 0.0, 12.0, 10.0, "", "", False, False), ("i", 39.0, 0.0, 12.0, 10.0, "c", "d", True, False), ("i", 59.0, 0.0, 12.0, 10.0, "0", "0", True, True)]
    got = {r["image_id"]: (r["words"], r["exposed"], r["boxes"], r["unchanged"], r["exposed_pct"]) for r in S.replica_score(spark.createDataFrame(boxes, f"image_id string, {BOXES}, original string, synthetic string, keep boolean, same boolean"), truth).collect()}
    assert got == {"i": (4, 2, 4, 1, 50.0), None: (4, 2, 4, 1, 50.0)}


def test_regions_have_the_sides_of_their_moments(spark):
    probs = [0.9 if 2 <= y < 5 and 1 <= x < 9 else 0.0 for y in range(8) for x in range(10)]
    r = N.regions_from_map(spark.createDataFrame([("i", 10, 8, probs)], "image_id string, width int, height int, probs array<double>")).first()
    d = 8 * 3 * 1.5 / (2 * 11)
    assert (r["core_x"], r["core_y"], r["core_w"], r["core_h"]) == (1, 2, 8, 3) and abs(r["angle"]) < 1e-9
    assert (r["x"], r["w"]) == (0.0, 10.0) and abs(r["y"] - (2 - d)) < 1e-9 and abs(r["len"] - (8 + 2 * d)) < 1e-6 and abs(r["thick"] - (3 + 2 * d)) < 1e-6


def test_text_is_scrubbed(spark):
    text = "sk-abcdefgh1 me@x.org see (https://evil.example/a) and http://localhost:80/x " + "y" * 500
    got = spark.createDataFrame([(text,), (None,)], "t string").select(scrub("t").alias("s")).collect()
    assert got[0]["s"].startswith("[key removed] [email removed] see ([link removed]) and http://localhost:80/x y") and len(got[0]["s"]) == 400 and got[1]["s"] == ""


def test_unread_parts(spark):
    line, wide = (0.0, 0.0, 200.0, 10.0), (-5.0, -3.0, 210.0, 16.0)
    covers = {"full": [(0.0, 0.0, 200.0, 10.0)], "half": [(0.0, 0.0, 100.0, 10.0)], "space": [(0.0, 0.0, 95.0, 10.0), (105.0, 0.0, 95.0, 10.0)], "above": [(0.0, -9.0, 200.0, 11.0)], "none": []}
    shape = f"image_id string, region_id long, {BOXES}, core struct<x:double,y:double,w:double,h:double>"
    regions = spark.createDataFrame([(k, 1, *wide, line) for k in covers] + [(k, 2, 298.0, 0.0, 24.0, 24.0, (300.0, 2.0, 20.0, 20.0)) for k in ("full", "none")], shape)
    cover = [(k, *b) for k, v in covers.items() for b in v] + [("full", 300.0, 2.0, 18.0, 20.0)]
    got = sorted((r["image_id"], r["region_id"], r["x"], r["w"]) for r in L.unread_parts(regions, spark.createDataFrame(cover, f"image_id string, {BOXES}")).collect())
    assert got == [("above", 1, -5.0, 210.0), ("half", 1, 103.5, 101.5), ("none", 1, -5.0, 210.0), ("none", 2, 298.0, 24.0)]


def test_lines_and_row_numbers(spark):
    words = [("i", 1, 0.0, 0.0, 30.0, 12.0), ("i", 2, 35.0, 2.0, 30.0, 12.0), ("i", 3, 100.0, 0.0, 30.0, 12.0), ("i", 4, 0.0, 9.0, 30.0, 12.0)]
    got = {r["word_id"]: r["line_no"] for r in L.text_lines(spark.createDataFrame(words, f"image_id string, word_id long, {BOXES}")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2}
    cells = [("i", k, str(v), 0.0, 30.0 * k, 14.0, 12.0, 90.0) for k, v in enumerate([1, 2, 3, 4, 5, 9])] + [("i", 20 + k, str(v), 200.0, 30.0 * k, 14.0, 12.0, 90.0) for k, v in enumerate([7, 3, 5, 1, 9])]
    got = {r["word_id"] for r in L.index_columns(spark.createDataFrame(cells, f"image_id string, word_id long, text string, {BOXES}, conf double")).collect()}
    assert got == {0, 1, 2, 3, 4}


def test_pairs_of_a_long_line_grow_with_its_words(spark):
    words = spark.range(2000).select(F.lit("i").alias("image_id"), F.col("id").alias("word_id"), (F.col("id") * 30.0).alias("x"), F.lit(0.0).alias("y"), F.lit(25.0).alias("w"), F.lit(12.0).alias("h"))
    assert G.near_pairs(G.prefixed(words, "a_"), G.prefixed(words, "b_")).count() < 2000 * 20
    whole = spark.createDataFrame([("i", -5.0, -5.0, 70000.0, 30.0)], f"image_id string, {BOXES}")
    assert G.coverage(words, whole).filter("covered = 1").count() == 2000 and G.inside_join(words, whole).count() == 2000


def test_large_medians(spark):
    rows = [("a", float(i % 977)) for i in range(5001)] + [("b", 3.0), ("b", 1.0), ("c", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["median"] for r in M.large_upper_median(df, "v", "k").collect()}
    assert got == {k: v for k, v in ((r["k"], r["median"]) for r in M.upper_median(df, "v", "k").collect()) if v is not None}


SHAPES = ["€48.6M", "62.4%", "312", "+11.2%", "-0.9", "21 °C", "1,284", "$4,210,000", "4.5 / 5", "100%", "8%", "£0.75", "98.6°F", "7"]


def test_invented_numbers(spark):
    df = spark.createDataFrame([(s, k) for s in [*SHAPES, "2026", "FY 2026", "12:45"] for k in range(40)], "t string, k int")
    for real, fake in df.select("t", fake_value(F.col("t"), F.col("k"))).collect():
        if real in ("2026", "FY 2026"):
            assert fake == real
        elif real == "12:45":
            assert re.fullmatch(r"([01][0-9]|2[0-3]):[0-5][0-9]", fake)
        else:
            assert fake != real and (real == "100%" or re.sub("[0-9]", "9", fake) == re.sub("[0-9]", "9", real)), (real, fake)
            number = float(re.sub(r"[^0-9.]", "", fake.split("/")[0]))
            assert "%" not in real or number <= 100
            assert real != "4.5 / 5" or (number <= 5 and fake.endswith(" / 5"))
