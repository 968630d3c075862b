"""Made-up values, what stands around boxes, second readings, comments, scales, slanted labels."""

import re

from pyspark.sql import functions as F

from maskwright.functions import fakes as K
from maskwright.functions.numbers import fake_ticks
from maskwright.operators import comments as Q
from maskwright.operators import context as C
from maskwright.operators import scales as Z

BOX = "x double, y double, w double, h double"


def test_ticks_stay_an_even_scale(spark):
    texts = ["0 20 40 60", "1,000 2,000 3,000 4,000", "1.5 2.0 2.5", "60 40 20 0", "1 2 5", "1 2", "a b c", "", None]
    got = {r["t"]: r["f"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", fake_ticks(F.col("t"), 3).alias("f")).collect()}
    for t in texts[:4]:
        if got[t] is None:
            continue
        new = [float(v.replace(",", "")) for v in got[t].split()]
        steps = {round(b - a, 6) for a, b in zip(new, new[1:], strict=False)}
        assert got[t] != t and len(new) == len(t.split()) and len(steps) == 1 and min(new) >= 0 and ("," in t) >= ("," in got[t])
    assert got["0 20 40 60"].startswith("0 ") and got["1.5 2.0 2.5"].count(".") == 3
    assert all(got[t] is None for t in texts[4:])


def test_entities_avoid_brands_and_fit(spark):
    df = spark.range(300).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    r = df.select(K.fake_entity("company", F.col("k"), 1, brands=("hale", "rusk")).alias("c"), K.fake_entity("email", F.col("k"), 1).alias("e"), K.fake_entity("phone", F.col("k"), 1).alias("p"), K.fitted("person", F.lit("Alma Hale"), F.col("k"), 1).alias("f")).collect()
    assert not any(re.search("hale|rusk", x["c"].lower()) for x in r) and len({x["c"] for x in r}) > 20
    assert all(re.fullmatch(r"[a-z]+\.[a-z]+@example\.(com|org|net)", x["e"]) and re.fullmatch(r"\([0-9]{3}\) 555-01[0-9]{2}", x["p"]) for x in r)
    assert all(x["f"] is None or (len(x["f"]) <= 9 * 1.15 + 1 and not {"alma", "hale"} & set(x["f"].lower().split())) for x in r)


def test_titles_and_ids(spark):
    df = spark.createDataFrame([("Ms.",), ("jr",), ("Alma",), (None,)], "t string")
    got = {r["t"]: r["f"] for r in df.select("t", K.fake_title(F.col("t"), 1).alias("f")).collect()}
    assert got["Ms."] in {"Mr.", "Mrs.", "Dr."} and got["jr"] in {"Sr", "II", "IV", "MD", "III", "PhD", "DDS", "DVM"} and got["Alma"] is None and got[None] is None
    ids = spark.createDataFrame([("a", i, f"INV-{i:05}") for i in range(3)] + [("a", 9, "EMP-00001"), ("b", 1, "INV-00001"), ("b", 2, "total"), ("b", 3, None)], "image_id string, mask_id long, text string")
    made = {(r["image_id"], r["mask_id"]): r["made"] for r in C.fake_ids(ids, 5).collect()}
    assert all(re.fullmatch("INV-[1-9][0-9]{4}", made["a", i]) for i in range(3)) and made["a", 9] is None and made["b", 1] is None and len(made) == 7


def test_labels_name_a_role_or_come_from_the_header(spark):
    words = [("a", 1, "Owner", 0.0, 0.0, 40.0, 12.0), ("a", 2, "Amount", 100.0, 0.0, 40.0, 12.0), ("a", 3, "Manager", 0.0, 60.0, 50.0, 12.0), ("b", 1, "plain", 0.0, 0.0, 30.0, 12.0)]
    masks = [("a", 1, 2.0, 30.0, 40.0, 12.0), ("a", 2, 60.0, 60.0, 40.0, 12.0), ("b", 1, 40.0, 0.0, 40.0, 12.0), ("c", 1, 0.0, 0.0, 9.0, 9.0)]
    role = lambda c: F.when(c.rlike("Owner|Manager"), "person")
    got = {(r["image_id"], r["mask_id"]): r["label"] for r in C.label_for(spark.createDataFrame(masks, f"image_id string, mask_id long, {BOX}"), spark.createDataFrame(words, f"image_id string, word_id long, text string, {BOX}"), role=role).collect()}
    assert got == {("a", 1): "Owner", ("a", 2): "Manager", ("b", 1): "plain", ("c", 1): ""}


def test_second_look_and_cut_years(spark):
    regions = spark.createDataFrame([("a", 1, False, False), ("a", 2, True, False), ("a", 3, True, False), ("a", 4, False, True), ("a", 5, True, False), ("a", 6, False, False), ("a", 7, False, False), ("a", 8, False, False)], "image_id string, region_id long, slanted boolean, glyph boolean")
    words = [("a", 1, 1, [("Total", 80.0)]), ("a", 2, 1, [("Oct 3, 2025", 65.0)]), ("a", 3, 1, [("Oct 4, 2025", 65.0)]), ("a", 5, 1, [("Oct 5, 202", 65.0)]), ("a", 6, 1, [("Berta", 50.0)]), ("a", 6, 2, [("Berta", 72.0), ("Total", 90.0)]), ("a", 7, 1, [("kkkkk", 75.0)]), ("a", 7, 2, [("x", 99.0)]), ("a", 8, 1, [])]
    readings = spark.createDataFrame(words, "image_id string, region_id long, nr int, words array<struct<text:string,conf:double>>")
    got = {r["region_id"]: r for r in C.complete_years(C.second_look(regions, readings)).collect()}
    assert [got[i]["safe"] for i in range(1, 9)] == [True, False, False, True, False, False, True, False]
    assert got[5]["date"] == "Oct 5, 2025" and got[2]["date"] == "Oct 3, 2025" and got[1]["date"] is None
    assert got[6]["read"] == "Berta Total" and got[6]["conf"] == 72.0 and got[8]["conf"] == 0.0


def test_comments_go_on_and_end(spark):
    lines = ["“We met Berta on", "the way home and", "Great day”", "so it was fine", "Total Sales Region", "it is a long way to go, my Friend there"]
    rows = [("a", i * 20 + j, w, j * 50.0, i * 20.0, 45.0, 12.0, 95.0) for i, line in enumerate(lines) for j, w in enumerate(line.split())]
    words = spark.createDataFrame(rows, f"image_id string, word_id long, text string, {BOX}, conf double")
    got = {r["word_id"]: r for r in Q.comment_types(Q.find_comments(words)).collect()}
    line_in = [got[i * 20]["in_comment"] for i in range(len(lines))]
    assert line_in == [True, True, True, False, False, True]  # the third line closes the quotation
    assert got[2]["type"] == "Name in comment" and got[0]["type"] is None and got[0]["cm_start"] and not got[1]["cm_start"] and got[108]["type"] == "Name in comment"


def test_axes_get_another_even_scale(spark):
    col = lambda image, values, y=30.0: [(image, i, str(v), 10.0, i * y, 28.0, 12.0) for i, v in enumerate(values)]
    rows = col("a", [400, 300, 200, 100, 0]) + col("b", [12, 95, 31, 7]) + col("c", ["9,000", "6,000", "3,000", "0"]) + col("d", [50, 40]) + col("e", ["50%", "none", "30%", "20%", "10%"])
    got: dict = {}
    for r in Z.axis_scales(spark.createDataFrame(rows, f"image_id string, mask_id long, text string, {BOX}"), 3).collect():
        got.setdefault(r["image_id"], {})[r["mask_id"]] = r["made"]
    assert set(got) == {"a", "c", "e"} and got["a"][4] == 0 and got["c"][3] == 0
    a = [got["a"][i] for i in range(5)]
    assert len({round(x - y, 6) for x, y in zip(a, a[1:], strict=False)}) == 1 and all(len(str(int(v))) == 3 and v != o for v, o in zip(a[:4], [400, 300, 200, 100], strict=True))
    e = got["e"]  # the unread tick leaves its gap
    assert round(e[0] - e[2], 6) == round(2 * (e[2] - e[3]), 6)


def test_shares_become_a_whole_and_totals_the_sum(spark):
    row = lambda image, texts: [(image, i, t, i * 40.0, 0.0, 20.0, 12.0) for i, t in enumerate(texts)]
    rows = row("a", ["40%", "35%", "30%"]) + row("b", ["60", "40", "100 EUR"]) + row("c", ["10%", "20%"]) + row("d", ["60", "40", "150"]) + row("e", ["100"])
    df = spark.createDataFrame(rows, f"image_id string, mask_id long, text string, {BOX}")
    got = {(r["image_id"], r["mask_id"]): r["text"] for r in Z.total_links(df, made=F.concat(F.lit("€"), (F.regexp_extract("text", "([0-9]+)", 1).cast("int") * 3).cast("string"))).collect()}
    assert got == {("a", 0): "38%", ("a", 1): "33%", ("a", 2): "29%", ("b", 2): "300 EUR"}


def test_slanted_pieces_join_until_none_is_left(spark):
    piece = lambda i, at, angle=45.0: ("a", i, at, at, 20.0, 20.0, angle, 28.0, 8.0)
    rows = [piece(1, 0.0), piece(2, 21.0, 47.0), piece(3, 42.0, 44.0), piece(4, 100.0), piece(5, 121.0, -45.0)]
    got = {r["region_id"]: (r["n_pieces"], r["w"]) for r in Z.join_slanted(spark.createDataFrame(rows, f"image_id string, region_id long, {BOX}, angle double, len double, thick double")).collect()}
    assert got == {1: (3, 62.0), 4: (1, 20.0), 5: (1, 20.0)}
