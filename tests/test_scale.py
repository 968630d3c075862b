"""What the plans of queries must not hold, and pages that helpers see in pieces."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.functions.columns import once
from maskwright.operators import blocks as B
from maskwright.operators import lines as L
from maskwright.operators import masks as M
from maskwright.operators import pixels as I
from maskwright.operators import replace as X
from maskwright.plans import checking, inventing, masking, reading, replacing
from maskwright.sources.words import words_from_text

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(spark, *texts):
    return words_from_text(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string"), "id", "text")


@pytest.mark.parametrize("query", [masking.a2_tally, masking.s9_published, masking.f2_ghosts, reading.j6_cover, replacing.j5_regions, replacing.g12_split, inventing.j10_context])
def test_words_are_dealt_by_page_alone(spark, query):
    """Every shuffle is by page: none by page and cell, page and word."""
    dealt = [x for x in plan(query(spark, SF)).split("\n") if "Exchange hashpartitioning" in x]
    assert dealt and all("hashpartitioning(image_id#" in x and x.split("hashpartitioning(")[1].split(")")[0].count("#") == 1 for x in dealt)


@pytest.mark.parametrize("query", [masking.g2_masks_exact, masking.g4_columns, reading.g1_lines, reading.g5_index, reading.g6_years])
def test_no_function_per_page(spark, query):
    assert "FlatMapGroups" not in plan(query(spark, SF))


def test_type_is_worked_out_once(spark):
    """The filter on the type does not repeat the rules."""
    df = M.typed(words(spark, "a b")).filter("type is not null")
    assert "Filter isnotnull(type#" in plan(df)


def test_once_keeps_rows_and_columns(spark):
    df = once(spark.createDataFrame([(1, None), (2, "b")], "k long, t string"), u=F.upper("t"), k=F.col("k") + 1)
    assert df.columns == ["t", "u", "k"] and sorted(df.collect(), key=lambda r: r.k) == [(None, None, 2), ("b", "B", 3)]


def test_types_are_those_of_classify(spark):
    tokens = ["Alma", "the", "THE", "É", "éa", "x", "a-b", "Top-10", "", "...", "(12)", "2024", "Q3", "a@b", "@x.y", "EMP00123", "#7", "ß", "ﬁ", "one-two", "sales/cost", "x1", "€", "中文", "áb", None]
    df = spark.createDataFrame([(t,) for t in tokens], "text string")
    for allow, clients in ((T.NEUTRAL, ()), (("alma",), ("two bank",)), ((), ())):
        rows = T.with_type(df, "text", "type", allow, clients).withColumn("plain", T.classify("text", allow, clients)).collect()
        assert len(rows) == len(tokens) and all(r.type == r.plain for r in rows)


def test_pages_stay_whole(spark, monkeypatch):
    """Pages of many batches and batches of many pages come whole, in order."""
    monkeypatch.setattr(B, "LEAST", 5)
    df = spark.range(0, 300).selectExpr("cast(floor(sqrt(id)) as string) as image_id", "id")

    def go(t: pa.Table, begins: np.ndarray) -> pa.Table:
        ids = t["id"].to_numpy()
        n = np.diff(np.append(begins, len(ids)))
        down = np.append(True, np.diff(ids) < 0)
        down[begins] = True
        return t.select(["image_id"]).take(pa.array(begins)).append_column("n", pa.array(n)).append_column("ok", pa.array([bool(down.all())] * len(n)))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = {r.image_id: (r.n, r.ok) for r in B.by_page(df, [F.col("id").desc()], go, "image_id string, n long, ok boolean").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out == {str(k): (min(300, (k + 1) ** 2) - k * k, True) for k in range(18)}


def test_masks_of_many_pages(spark):
    """Runs end with their page; a missing text is left out; words of one place go by their number."""
    rows = [("1", 1, "a", "T", 0.0, 7.0, 10.0, 12.0), ("1", 2, "b", "T", 12.0, 9.0, 10.0, 12.0), ("1", 3, None, "T", 24.0, 9.0, 10.0, 12.0), ("2", 1, "c", "T", 0.0, 9.0, 5.0, 12.0), ("2", 2, "d", "U", 6.0, 9.0, 5.0, 12.0)]
    df = spark.createDataFrame(rows, "image_id string, word_id long, text string, type string, x double, y double, w double, h double").withColumn("conf", F.col("x") + 1)
    out = sorted((r.image_id, r.mask_id, r.text, r.x, r.y, r.w, r.h, r.conf, r.n_words) for r in M.build_masks(df).collect())
    assert out == [("1", 1, "a b", 0.0, 7.0, 34.0, 14.0, 1.0, 3), ("2", 1, "c", 0.0, 9.0, 5.0, 12.0, 1.0, 1), ("2", 2, "d", 6.0, 9.0, 5.0, 12.0, 7.0, 1)]
    assert M.build_masks(df.filter("false")).count() == 0 and L.text_lines(df.filter("false")).count() == 0
    assert M.build_masks_exact(df.filter("false")).count() == 0 and M.column_fill(df.withColumn("mask_id", F.col("word_id"))).count() == 0


def test_pixels_are_not_broadcast(spark):
    """Pixels made of a small table, which Spark takes for few."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    rows = spark.range(0, 50).selectExpr("cast(id as string) as image_id").withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumns({"py": F.lit(0), "r": F.lit(1), "g": F.lit(1), "b": F.lit(1)})
    boxes = rows.filter("px = 0").select("image_id", *(F.lit(1.0).alias(c) for c in "xywh"))
    df = I.distortion(rows, rows.withColumn("g", F.when(F.col("px") % 3 == 0, 2).otherwise(F.col("g"))), boxes)
    assert "BroadcastHashJoin" not in plan(df)
    assert {r.changed for r in df.collect()} == {7}


def test_split_reads_its_pairs_once(spark):
    """The words under the masks are found once, not once for each figure on them."""
    assert plan(X.split_at_columns(*_lines(spark))).count("sequence(_s") <= 2


def _lines(spark):
    own = words(spark, "a b c")
    return own.select("image_id", F.lit(1).cast("long").alias("mask_id"), F.lit("T").alias("type"), "text", "x", "y", "w", "h"), own


def test_labels_in_one_search(spark):
    """One search for neighbours, whose result is read again."""
    df = words(spark, "Page 1 of 3", "Top-5 of 7 3%", "Week 34")
    assert "_row" not in plan(M.count_labels(df))
    out = sorted((r.image_id, r.word_id) for r in M.count_labels(df).collect())
    assert out == [("0", 2), ("0", 4), ("1", 1), ("1", 3), ("2", 2)]


def test_coverage_is_worked_out_once_each(spark):
    """Two coverages are two searches for boxes, each with two sides."""
    assert plan(checking.a7_score(spark, SF)).count("explode(sequence(_s") == 4


def test_gate_reads_written_images(spark):
    """The gate's two sides read one table; nothing is searched again."""
    assert "sequence(_s" not in plan(checking.a10_gate(spark, SF))


def test_equal_numbers_in_any_order(spark):
    """Masks with one number go by their boxes, not by the order they arrive in."""
    rows = [("1", 1, 0.0, y, w) for y, w in ((0.0, 50.0), (0.0, 56.0), (30.0, 63.0), (60.0, 50.0), (60.0, 42.0))]
    made = [M.column_fill(spark.createDataFrame(r, "image_id string, mask_id long, x double, y double, w double").coalesce(1).withColumns({"type": F.lit(T.NUMBER), "h": F.lit(12.0)})).collect() for r in (rows, rows[::-1])]
    assert made[0] and made[0] == made[1]
