"""Token, label, date and score rules on small cases."""

import random
import re

from pyspark.sql import functions as F

from maskwright.functions import dates as D
from maskwright.functions import labels as L
from maskwright.functions import text as T
from maskwright.operators import geometry as G
from maskwright.operators import masks as M
from maskwright.operators import models as N
from maskwright.operators import score as S
from maskwright.sources.words import read_ocr_tsv, words_from_text

ALLOW = ["revenue", "sales", "north", "south", "region", "total", "q", "jan", "feb", "orders", "acme widgets"]
CLIENTS = ["acme corp", "globex"]
JS = "[\t\n\x0b\f\r \xa0  -     　﻿]"


def plain_classify(text):
    """The rule list once more, in plain Python."""
    letter = r"[^\W\d_]"
    raw = re.sub(f"^{JS}+|{JS}+\\Z", "", text)
    ok = lambda c, more: c.isalpha() or c.isnumeric() or c in more
    a, z = 0, len(raw)
    while a < z and not ok(raw[a], "_€$£¥₹%#@"):
        a += 1
    while z > a and not ok(raw[z - 1], "_€$£¥₹%"):
        z -= 1
    clean = raw[a:z]
    if not clean:
        return None
    low = clean.lower()
    if any(n in low or low in n.split() for n in CLIENTS):
        return T.CLIENT
    if re.search(r"[A-Za-z0-9_]@[A-Za-z0-9_]", raw) or ("@" in raw and "." in raw):
        return T.EMAIL
    for p in (T.YEAR, T.PERIOD, T.WINDOW, T.QUARTERS, T.FISCAL, T.YEARS, T.RANK):
        if re.search(p.replace(r"\z", r"\Z"), clean):
            return None
    if re.search(T.CODE, clean):
        return T.IDENTIFIER
    if not re.search(letter + r"|\d", clean):
        return None
    if re.search("[0-9€$£¥₹%]", clean):
        return T.NUMBER
    if len(clean) <= 1 or low in ALLOW:
        return None
    parts = [p for p in re.split("[-/&']", low.replace("’", "'")) if p]
    if len(parts) > 1 and any(len(p) > 1 for p in parts) and all(len(p) <= 1 or p in ALLOW for p in parts):
        return None
    return T.TEXT


def test_classify_agrees_with_plain_rules(spark):
    r = random.Random(42)
    alphabet = "abcXYZ019 -_/&@.#$€%()é,\x85﻿\xa0"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 12))) for _ in range(4000)]
    texts += ["Revenue", "acme", "North/South", "Q1-Q3", "FY25-26", "2025-26", "#1", "L12M", "AB-123", "", "%%%%"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(x) for x in df.select("t", T.classify("t", ALLOW, CLIENTS)).collect()]
    assert [(t, plain_classify(t)) for t in texts] == got


def test_roles(spark):
    names = ["Facilities", "Branches", "Status", "Attending Physician", "Order ID", "Invoice #", "Ticket", "Leads By Region"]
    c = F.col("n")
    got = {r["n"]: r for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", L.singular(c).alias("s"), L.entity_of(c).alias("e"), L.column_role(c).alias("r"), L.id_prefix(c).alias("p"), L.role_of(c).alias("b")).collect()}
    assert got["Facilities"]["s"] == "facility" and got["Branches"]["s"] == "branch" and got["Status"]["s"] == "status"
    assert got["Attending Physician"]["e"] is None and got["Attending Physician"]["r"] == "person"
    assert [got[n]["p"] for n in ("Order ID", "Invoice #", "Ticket")] == ["ORD", "INV", "TCK"]
    assert got["Leads By Region"]["b"] == "city"


def test_dates_keep_their_format(spark):
    dates = ["Nov 2025", "2026-05-01", "10-30-2026", "07-04-2026", "30/10/2026", "11-25", "11/2025", "Oct 1, 2026", "30-Sep-2026", "SEP 2026", "September 2026", "Nov '25", "(0ct 1, 2026)"]
    others = ["10.25", "2026", "12:45", "4.5 / 5", "Q3 2026", "", None]
    df = spark.createDataFrame([(d,) for d in dates + others], "d string")
    for seed in range(5):
        got = {r[0]: r[1] for r in df.select("d", D.shift_date(F.col("d"), seed)).collect()}
        assert all(got[o] is None for o in others)
        for d in dates:
            form = lambda s: re.sub("[0-9]+", "9", re.sub("[A-Z][a-z]{2,}", "Aaa", re.sub("[A-Z]{3,}", "AAA", s)))
            assert got[d] != d and form(got[d]) == form(d.replace("0ct", "Oct")), (d, got[d])
    two = spark.createDataFrame([("May 31, 2026",)], "d string").select(D.shift_date(F.col("d"), 1)).first()[0]
    assert D.months_back(1) == 2 and two == "Mar 31, 2026"
    pages = spark.createDataFrame([("a", "30/10/2026"), ("a", "05/10/2026"), ("b", "10/30/2026")], "image_id string, text string")
    assert {r["image_id"]: r["date_order"] for r in D.date_order(pages).collect()} == {"a": "dmy", "b": "mdy"}


def test_wilson(spark):
    df = spark.createDataFrame([(10, 100), (0, 50), (50, 50), (0, 0)], "k long, n long")
    v = [r["v"] for r in df.select(S.wilson(F.col("k"), F.col("n")).alias("v")).collect()]
    assert v[0].pct == 10 and abs(v[0].lo - 5.52) < 0.01 and abs(v[0].hi - 17.44) < 0.01
    assert v[1].lo == 0 and v[2].hi == 100 and v[3].pct is None


def test_coverage(spark):
    words = spark.createDataFrame([("i", 1, 0.0, 0.0, 100.0, 10.0)], "image_id string, word_id long, x double, y double, w double, h double")
    cover = lambda *boxes: G.coverage(words, spark.createDataFrame([("i", *map(float, b)) for b in boxes] or [], "image_id string, x double, y double, w double, h double")).first()["covered"]
    assert cover() == 0 and cover((0, 0, 100, 10)) == 1 and cover((0, 0, 50, 10)) == 0.5 and cover((0, 0, 50, 10), (0, 0, 50, 10)) == 0.5


def test_merging_matches_the_running_box(spark):
    r = random.Random(3)
    rows = [("p%d" % (i % 3), i, "w%d" % i, 90.0, float(r.randint(0, 40) * 20), float(r.randint(0, 5) * 30), 15.0, 12.0, r.choice(["a", "b", None])) for i in range(200)]
    words = spark.createDataFrame(rows, "image_id string, word_id long, text string, conf double, x double, y double, w double, h double, type string")
    key = lambda df: sorted(tuple(x) for x in df.select("image_id", "type", "x", "y", "n_words").collect())
    assert key(M.build_masks(words)) == key(M.build_masks_exact(words))
    one = spark.createDataFrame([("p", 1, 80.0, 0.0, 60.0, 20.0)], "image_id string, mask_id long, x double, y double, w double, h double")
    assert [round(v, 1) for v in M.pad_masks(one).select("x", "y", "w", "h").first()] == [76.4, -3.6, 67.2, 27.2]


def test_count_labels(spark):
    def safe(text):
        words = words_from_text(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t")
        ids = {x["word_id"] for x in M.count_labels(words).collect()}
        return [w["text"] for w in words.orderBy("word_id").collect() if w["word_id"] in ids]

    assert safe("Top 5 performers") == ["5"] and safe("Page 1 of 3") == ["1", "3"] and safe("Top-10 stores") == ["Top-10"]
    assert safe("Revenue 5") == [] and safe("Top 12500") == [] and safe("Top 5 $1.2M") == ["5"]


def test_ocr_lines(spark):
    line = lambda conf, text: "\t".join(["5", "1", "1", "1", "1", "1", "10", "20", "30", "12", str(conf), text])
    df = spark.createDataFrame([("i", line(15, "1,204")), ("i", line(25, "Globex")), ("i", line(35, "Initech")), ("i", "4\tx"), ("i", None)], "image_id string, value string")
    got = {r["text"]: (r["x"], r["h"]) for r in read_ocr_tsv(df, 2.0).collect()}
    assert got == {"1,204": (5.0, 6.0), "Initech": (5.0, 6.0)}


def test_model_tables(spark):
    import math

    logits = [math.log(v) for v in (1, 2, 2, 3, 1, 4)]
    p = spark.createDataFrame([(logits,)], "l array<double>").select(N.person_org(F.col("l"), [1, 2], [3, 4]).alias("p")).first()["p"]
    assert abs(p.per - 4 / 13) < 1e-9 and abs(p.org - 4 / 13) < 1e-9
    step = lambda c: [0.9 if i == c else 0.05 for i in range(3)]
    probs = [[step(c) for c in (1, 1, 0, 1, 2, 2)], [step(0)] * 3]
    got = [x["r"] for x in spark.createDataFrame([(q,) for q in probs], "p array<array<double>>").select(N.ctc_decode(F.col("p"), "ab").alias("r")).collect()]
    assert got[0].text == "aab" and abs(got[0].conf - 0.9) < 1e-9 and (got[1].text, got[1].conf) == ("", 0)
    words = spark.createDataFrame([("i", 0, k, 2) for k in range(10)], "image_id string, line_no long, pos long, n_tokens long")
    rows = [x["row"] for x in N.pack_lines(words, 8).orderBy("pos").collect()]
    assert [rows.count(k) for k in range(4)] == [3, 3, 3, 1]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_boxes_and_regions_of_all_words(spark, tmp_path):
    from maskwright.plans import masking, replacing

    spark.createDataFrame([(1, "total 123 total 456 total 789", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    outside = masking.QUERIES["u2_except_contained"](spark, str(tmp_path)).collect()
    assert sorted((x["image_id"], x["word_id"]) for x in outside) == [("1", 1), ("1", 3), ("1", 5)]
    inside = replacing.QUERIES["j5_words_in_regions"](spark, str(tmp_path)).collect()
    assert sorted((x["region_id"], x["word_id"]) for x in inside) == [(1, 2), (2, 4), (3, 6)]
