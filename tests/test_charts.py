"""Chart areas, connected parts, unread masks, strict merging, invented letters, axes in long columns, the check's rules."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from maskwright.functions.fakes import fake_letters
from maskwright.functions.numbers import fake_text, fake_value
from maskwright.operators import charts as C
from maskwright.operators import lines as L
from maskwright.operators import masks as M
from maskwright.operators import scales as A
from maskwright.operators import verify as V

BOX = "x double, y double, w double, h double"
WORD = f"image_id string, word_id long, text string, conf double, {BOX}"


def flood(hot, corners):
    """Labels by flood fill."""
    h, w = hot.shape
    label = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            if not hot[y, x] or label[y, x]:
                continue
            stack, label[y, x] = [(y, x)], y * w + x + 1
            while stack:
                a, b = stack.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        c, d = a + dy, b + dx
                        if (corners or not (dy and dx)) and 0 <= c < h and 0 <= d < w and hot[c, d] and not label[c, d]:
                            label[c, d] = y * w + x + 1
                            stack.append((c, d))
    return label


def test_connected_parts_against_flood_fill():
    r = np.random.default_rng(3)
    for k in range(120):
        hot = r.random((r.integers(1, 12), r.integers(1, 12))) < r.choice([0.2, 0.5, 0.7])
        for corners in (True, False):
            assert (C.label_parts(hot, corners) == flood(hot, corners)).all()
    spiral = np.zeros((201, 201), bool)
    spiral[::2] = True
    spiral[1::4, -1] = spiral[3::4, 0] = True
    assert set(np.unique(C.label_parts(spiral, False))) == {0, 1}


def picture(seed):
    """A page of 480 x 320 with coloured bars, a grey block, a badge and text, and its words."""
    r = random.Random(seed)
    p = np.full((320, 480, 3), 250, int)
    for i in range(5):
        x, h = 40 + i * 22, r.randint(40, 120)
        p[200 - h : 200, x : x + 12] = (30, 90, 220)
    p[60:140, 300:400] = 120
    p[10:20, 440:450] = (220, 30, 30)
    p[250:262, 50:120] = 20
    for _ in range(300):
        p[r.randrange(320), r.randrange(480)] = (r.randrange(256), r.randrange(256), r.randrange(256))
    return p, [(50.0, 250.0, 70.0, 12.0), (300.0, 100.0, 40.0, 10.0)]


def plain_areas(p, boxes):
    """The rule of chart areas, pixel by pixel."""
    h, w, _ = p.shape
    cell = max(4, int(min(w, h) / 120 + 0.5))
    cw, ch, step = -(-w // cell), -(-h // cell), max(1, cell // 2)
    text = np.zeros((h, w), bool)
    for x, y, bw, bh in boxes:
        text[max(0, int(np.floor(y - 2))) : int(np.ceil(y + bh + 2)), max(0, int(np.floor(x - 2))) : int(np.ceil(x + bw + 2))] = True
    key = (p[..., 0] // 16) * 256 + (p[..., 1] // 16) * 16 + p[..., 2] // 16
    hot = np.zeros((ch, cw), int)
    for cy in range(ch):
        for cx in range(cw):
            by, bx, side = cy // 8, cx // 8, 8 * cell
            found = {}
            for j in range(max(0, by - 1), by + 2):
                for i in range(max(0, bx - 1), bx + 2):
                    for k in key[j * side : (j + 1) * side : step, i * side : (i + 1) * side : step].ravel().tolist():
                        found[k] = found.get(k, 0) + 1
            k = max(found, key=lambda c: (found[c], -c))
            panel = np.array([k // 256 * 16 + 8, k // 16 % 16 * 16 + 8, k % 16 * 16 + 8])
            own, t = p[cy * cell : (cy + 1) * cell, cx * cell : (cx + 1) * cell].reshape(-1, 3), text[cy * cell : (cy + 1) * cell, cx * cell : (cx + 1) * cell].ravel()
            mx, mn = own.max(1), own.min(1)
            colour = (mx > 40) & ((mx - mn) / np.maximum(mx, 1) > 0.28) & (mx - mn > 40)
            far = ~colour & (abs(own - panel).sum(1) > 150)
            hot[cy, cx] = 1 if (colour & ~t).sum() > len(own) * 0.12 else 2 if (far & ~t).sum() > len(own) * 0.45 else 0
    grown = np.zeros((ch, cw), bool)
    for y, x in zip(*np.nonzero(hot), strict=True):
        grown[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3] = True
    label, out = flood(grown, False), []
    for name in set(label[hot > 0].tolist()):
        y, x = np.nonzero((label == name) & (hot > 0))
        bw, bh, core = (x.max() - x.min() + 1) * cell, (y.max() - y.min() + 1) * cell, len(x)
        coloured = (hot[y, x] == 1).sum()
        if bw < max(48, w * 0.05) or bh < max(32, h * 0.04) or core < 6 or (coloured < core / 2 and core < bw * bh / cell**2 * 0.25):
            continue
        pad = int(cell / 2 + 0.5)
        x0, y0 = max(0, x.min() * cell - pad), max(0, y.min() * cell - pad)
        out.append((x0, y0, min(w, (x.max() + 1) * cell + pad) - x0, min(h, (y.max() + 1) * cell + pad) - y0))
    return sorted(out), {(int(x), int(y)): int(hot[y, x]) for y, x in zip(*np.nonzero(hot), strict=True)}


def test_chart_areas_against_brute_force(spark):
    p, boxes = picture(1)
    rows = [("a", x, y, *map(int, p[y, x])) for y in range(p.shape[0]) for x in range(p.shape[1])]
    pixels = spark.createDataFrame(rows, "image_id string, px int, py int, r int, g int, b int")
    words = spark.createDataFrame([("a", *b) for b in boxes], f"image_id string, {BOX}")
    sizes = spark.createDataFrame([("a", 480, 320)], "image_id string, width int, height int")
    areas, hot = plain_areas(p, boxes)
    cells = C.hot_cells(pixels, words, sizes)
    assert {(x["cx"], x["cy"]): x["hot"] for x in cells.collect()} == hot
    assert sorted((x["x"], x["y"], x["w"], x["h"]) for x in C.chart_areas(cells, sizes).collect()) == areas and len(areas) == 2
    assert C.chart_areas(cells.limit(0), sizes).count() == 0


def test_unread_masks_of_every_kind(spark):
    core = "core struct<x:double,y:double,w:double,h:double>"
    row = lambda i, x, y, w, **v: ("p", i, x - 2.5, y - 2.0, w + 5.0, 16.0, (x, y, w, 12.0), 0.0, w, 12.0, v.get("safe"), v.get("blob"), v.get("date"), v.get("read"), v.get("weak"))
    regions = spark.createDataFrame(
        [row(1, 10.0, 0.0, 100.0, read="Acme", weak=True), row(2, 10.0, 30.0, 100.0, safe=True), row(3, 10.0, 60.0, 100.0, date="Oct 1"), row(4, 10.0, 90.0, 100.0, blob=True), row(5, 10.0, 120.0, 100.0, read="half"), row(6, 10.0, 150.0, 100.0, read="two")],
        f"image_id string, region_id long, {BOX}, {core}, angle double, len double, thick double, safe boolean, blob boolean, date string, read string, weak boolean",
    )
    cover = spark.createDataFrame([("p", 10.0, 120.0, 60.0, 12.0), ("p", 50.0, 150.0, 20.0, 12.0)], f"image_id string, {BOX}")
    unsafe = spark.createDataFrame([("p", 4, 20.2, 91.0, 30.5, 10.0), ("p", 2, 0.0, 0.0, 9.0, 9.0)], f"image_id string, region_id long, {BOX}")
    got = sorted(((r["region_id"], r["x"], r["w"], r["read"], r["weak"], r["slant"] is not None) for r in L.unread_masks(regions, cover, unsafe).collect()))
    assert got == [(1, 7.0, 106.0, "Acme", True, False), (3, 7.0, 106.0, "Oct 1", False, True), (4, 20.0, 31.0, None, False, False), (5, 74.0, 39.0, None, False, False), (6, 7.0, 39.0, None, False, False), (6, 74.0, 39.0, None, False, False)]
    assert all(r["type"] == "Unread text" and r["on"] and r["y"] == int(r["y"]) for r in L.unread_masks(regions, cover, unsafe).collect())


def test_strict_merging_goes_in_order(spark):
    r = random.Random(4)
    rows = [("p", i, "x", r.choice(["b", "a"]), r.randint(0, 60) * 1.0, r.randint(0, 20) * 1.0, 12.0, 10.0) for i in range(150)]
    words = spark.createDataFrame(rows, f"image_id string, word_id long, text string, pass string, {BOX}")
    kept = []
    for w in sorted(rows, key=lambda w: (w[3], w[1])):
        over = lambda v: max(0, min(w[4], v[4]) + 12 - max(w[4], v[4])) * max(0, min(w[5], v[5]) + 10 - max(w[5], v[5])) / 120  # noqa: B023, E731
        if not any(over(v) > 0.3 for v in kept):
            kept.append(w)
    assert sorted(x["word_id"] for x in M.merge_passes_strict(words, ["a", "b"]).collect()) == sorted(w[1] for w in kept)


def test_letters_in_codes_are_made_up_alike(spark):
    texts = ["bf_koelpin_50", "/customers/Koelpin/case-STUDY", "KOELPIN ab 12", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fake_letters(F.col("t"), 5, ["customers", "case"]).alias("f"))
    got = {r["t"]: r["f"] for r in df.collect()}
    name = got["bf_koelpin_50"][3:-3]
    assert len(name) == 7 and name != "koelpin" and got["bf_koelpin_50"] == f"bf_{name}_50"
    path = got["/customers/Koelpin/case-STUDY"].split("/")
    assert path[1] == "customers" and path[2] == name.capitalize() and path[3].startswith("case-") and path[3][5:].isupper() and path[3][5:] != "STUDY"
    assert got["KOELPIN ab 12"] == f"{name.upper()} ab 12" and got[""] == "" and got[None] is None


def test_axes_of_long_columns():
    def plain(p, v):
        for size in range(len(p), 2, -1):
            for a in range(len(p) - size + 1):
                found = A._axis_within(p[a : a + size], v[a : a + size], size)
                if found:
                    return a, a + size, found[2].tolist()

    r = random.Random(1)
    for _ in range(400):
        p = np.cumsum([r.choice([10, 10, 10, 11, 9, 20, 30, 13, 15, 0, 5]) for _ in range(r.randint(1, 14))]).astype(float)
        k = np.concatenate([[0], np.round(np.diff(p) / 10)]).cumsum()
        v = 100 + r.choice([1, 2, -3, 5]) * k * np.array([r.choice([1, 1, 1, 1.02, 0.98, 1.3]) for _ in p]) if r.random() < 0.6 else np.array([r.choice([1, 2, 3, 4, 5, 6, 100]) for _ in p], float)
        found = A.longest_axis(p, v)
        assert (found and (found[0], found[1], found[2].tolist())) == plain(p, v)
    at = np.arange(20_000) * 15.0
    assert A.longest_axis(at, at)[:2] == (0, 20_000)
    A.longest_axis(at, np.random.default_rng(0).integers(1, 10**5, 20_000).astype(float))


def test_a_safe_word_under_a_mask_does_not_vouch(spark):
    box = (10.0, 0.0, 49.0, 12.0)
    words = spark.createDataFrame([("p", 1, "Revenue", 95.0, *box), ("q", 1, "Revenue", 95.0, *box)], WORD)
    reread = spark.createDataFrame([("p", 9, "Revenus", 80.0, 12.0, 1.0, 49.0, 12.0), ("q", 9, "Revenus", 80.0, 12.0, 1.0, 49.0, 12.0)], WORD)
    masks = spark.createDataFrame([("q", 5.0, 0.0, 36.0, 12.0, True, False)], f"image_id string, {BOX}, on boolean, user_off boolean")
    found = V.verify(reread, words, masks, allow=["revenue"]).collect()
    # on p the reading is of the safe word; on q a mask lies over most of that word, its centre beside the reading's
    centre = 12 + 49 / 2
    assert centre <= 5 + 36 and [f["image_id"] for f in found] == []
    masks = spark.createDataFrame([("q", 5.0, 0.0, 31.0, 12.0, True, False)], f"image_id string, {BOX}, on boolean, user_off boolean")
    assert [f["image_id"] for f in V.verify(reread, words, masks, allow=["revenue"]).collect()] == ["q"]


def test_readings_in_part_and_vouched_for(spark):
    words = spark.createDataFrame([("p", 1, "internal", 90.0, 0.0, 0.0, 80.0, 12.0), ("p", 2, "pts", 90.0, 100.0, 0.0, 21.0, 12.0)], WORD)
    rows = [(11, "teal", 20.0), (12, "ots", 100.0), (13, "xyz", 30.0), (14, "V1", 200.0), (15, "Vabc", 200.0)]
    reread = spark.createDataFrame([("p", i, t, 90.0, x, 1.0, 7.0 * len(t), 11.0) for i, t, x in rows], WORD)
    masks = spark.createDataFrame([], f"image_id string, {BOX}, on boolean, user_off boolean")
    core = "core struct<x:double,y:double,w:double,h:double>"
    regions = spark.createDataFrame([("p", 1, 195.0, 0.0, 40.0, 12.0, (198.0, 0.0, 35.0, 12.0), "UK")], f"image_id string, region_id long, {BOX}, {core}, look string")
    safe = V.safe_seen(words, masks, ["internal", "pts"])
    assert sorted(r["word_id"] for r in V.rereads_safe(reread, safe, regions).collect()) == [11, 12, 14]


def test_chart_marks_are_set_aside_and_chains_of_overlaps(spark):
    words = spark.createDataFrame([("p", 1, "Sales", 95.0, 0.0, 0.0, 40.0, 12.0)], WORD)
    rows = [(11, "4", 300.0, 300.0, 8.0, 8.0), (12, "4", 112.0, 100.0, 8.0, 8.0), (13, "|", 400.0, 300.0, 3.0, 8.0), (21, "Acme", 500.0, 0.0, 30.0, 12.0), (22, "Acmes", 512.0, 0.0, 30.0, 12.0), (23, "Acmess", 530.0, 0.0, 30.0, 12.0)]
    reread = spark.createDataFrame([("p", i, t, 90.0, x, y, w, h) for i, t, x, y, w, h in rows], WORD)
    masks = spark.createDataFrame([("p", 60.0, 98.0, 50.0, 12.0, True, False)], f"image_id string, {BOX}, on boolean, user_off boolean")
    core = "core struct<x:double,y:double,w:double,h:double>"
    regions = spark.createDataFrame([("p", 1, 495.0, 0.0, 80.0, 12.0, (495.0, 0.0, 80.0, 12.0), None)], f"image_id string, region_id long, {BOX}, {core}, look string")
    got = {r["word_id"]: (r["likely_mark"], r["aside"]) for r in V.verify(reread, words, masks, regions=regions).collect()}
    assert got == {11: (True, True), 12: (True, False), 21: (False, False), 23: (False, False)}


SHAPES = ["€48.6M", "62.4%", "312", "+11.2%", "-0.9", "21 °C", "1,284", "$4,210,000", "4.5 / 5", "100%", "8%", "£0.75", "98.6°F", "7"]


def test_made_up_values_of_every_shape(spark):
    rows = [(t, str(k)) for t in SHAPES for k in range(40)]
    digits = lambda x: [len(d) for d in re.findall(r"\d+", x)]
    for t, _, v in spark.createDataFrame(rows, "t string, k string").select("t", "k", fake_value(F.col("t"), F.col("k"))).collect():
        assert v != t and re.sub(r"[\d,]", "", v) == re.sub(r"[\d,]", "", t), (t, v)
        assert t == "100%" or digits(v) == digits(t), (t, v)
        assert not t.endswith("%") or abs(float(v.strip("+%"))) <= 100, (t, v)
        assert not t.endswith("/ 5") or (float(v.split(" / ")[0]) <= 5 and v.endswith(" / 5")), (t, v)


def test_dates_and_numbers_of_one_text(spark):
    texts = ["Oct 30, 2026", "$48,626 7/22/2026", "0 20 40 60", "2026", "FY 2026", "12:45", "4:30 PM", "30/10/2026"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for seed in (0, 7):
        got = {r["t"]: r["v"] for r in df.select("t", fake_text(F.col("t"), seed)["made"].alias("v")).collect()}
        assert re.fullmatch(r"(May|Jun|Jul|Aug|Sep) 30, 2026", got["Oct 30, 2026"])
        money, date = got["$48,626 7/22/2026"].split(" ")
        assert re.fullmatch(r"\$\d\d,\d{3}", money) and money != "$48,626" and re.fullmatch(r"[2-6]/22/2026", date)
        ticks = list(map(float, got["0 20 40 60"].split(" ")))
        assert ticks[0] == 0 and len(set(np.diff(ticks))) == 1 and ticks != [0, 20, 40, 60]
        assert got["2026"] == "2026" and got["FY 2026"] == "FY 2026" and re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d", got["12:45"]) and re.fullmatch(r"([1-9]|1[0-2]):[0-5]\d PM", got["4:30 PM"])
        assert re.fullmatch(r"30/0?[5-9]/2026", got["30/10/2026"])


def test_exact_values_and_years_that_are_values(spark):
    row = lambda t, exact: (t, exact, ["2000"])
    df = spark.createDataFrame([row("$8M", 6.0), row("1,200 (3)", 3400.0), row("0.0", 0.0), row("2000", None), row("2024", None)], "t string, e double, y array<string>")
    got = {r["t"]: (r["v"]["made"], r["v"]["how"]) for r in df.select("t", fake_text(F.col("t"), 1, "mdy", F.col("e"), F.col("y")).alias("v")).collect()}
    assert got["$8M"] == ("$6M", "axis") and got["1,200 (3)"][0].startswith("3,400 (") and got["0.0"] == ("0.0", "axis")
    assert got["2000"][0] != "2000" and len(got["2000"][0]) == 4 and got["2024"] == ("2024", "value")


def test_a_page_of_values_is_planned_in_one_go(spark):
    rows = [("p", i, f"€{8 - i}M", 0.0, 30.0 * i) for i in range(5)] + [("p", 10 + i, t, 100.0 + 60 * i, 300.0) for i, t in enumerate(["60%", "30%", "10%"])]
    rows += [("p", 20 + i, t, 100.0 + 60 * i, 400.0) for i, t in enumerate(["900", "500", "400"])] + [("p", 30, "30/10/2026", 0.0, 500.0), ("p", 31, "$9 05/10/2026", 0.0, 530.0), ("p", 32, "0 20 40 60", 0.0, 560.0)]
    masks = spark.createDataFrame([(*r, 7.0 * len(r[2]), 12.0) for r in rows], "image_id string, mask_id long, text string, x double, y double, w double, h double")
    got = {r["mask_id"]: (r["made"], r["how"]) for r in A.plan_values(masks, 4).collect()}
    axis = [float(got[i][0].strip("€M")) for i in range(5)]
    assert [got[i][1] for i in range(5)] == ["axis"] * 5 and axis == sorted(axis, reverse=True) and len(set(np.diff(axis))) == 1 and all(a != 8 - i for i, a in enumerate(axis))
    assert sum(int(got[10 + i][0].strip("%")) for i in range(3)) == 100 and got[10][1] == "total"
    assert int(got[20][0]) == int(got[21][0]) + int(got[22][0]) and got[20][1] == "total"
    assert got[30][1] == "date" and got[30][0].startswith("30/") and got[31][1] == "parts" and re.fullmatch(r"\$[1-8] 05/0[5-9]/2026", got[31][0]) and got[32][1] == "ticks"
