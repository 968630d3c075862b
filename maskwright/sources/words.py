"""Word tables: from plain text, from OCR output in TSV lines, and from strips of tall pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.columns import once
from maskwright.functions.text import JS_WS

#: Layout of plain text: pixels a character, a line, and the height of a word.
CHAR_W, LINE_H, WORD_H, SURE = 7, 30, 12, 95.0


def words_from_text(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per non-blank run on a character grid; rows are dealt by ``image_id`` once, for all page-wise steps.

    Null and empty texts give no words.
    """
    # what is dealt by page is joined by page and box as it lies
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    lines = df.select(F.col(id_col).cast("string").alias("image_id"), *carry, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line_text"))
    cut = lines.repartition("image_id").select("image_id", *carry, "line_no", F.posexplode(F.split("line_text", f"[{JS_WS}]")).alias("piece", "text"))
    before = Window.partitionBy("image_id", "line_no").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    placed = cut.withColumn("at", at).filter("text != ''")
    order = Window.partitionBy("image_id").orderBy("line_no", "piece")
    return placed.select(
        "image_id", *carry, F.row_number().over(order).cast("long").alias("word_id"), "text", F.lit(SURE).alias("conf"),
        (F.col("at") * CHAR_W).cast("double").alias("x"), (F.col("line_no") * LINE_H).cast("double").alias("y"),
        (F.length("text") * CHAR_W).cast("double").alias("w"), F.lit(float(WORD_H)).alias("h"),
        F.concat(F.lit("0-0-0-"), F.col("line_no")).alias("line"), F.lit("text").alias("pass"),
    )


def read_ocr_tsv(lines: DataFrame, scale: float = 1.0, value: str = "value", keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Words of level 5 with a readable confidence: at least 12 where the text has a digit, else 30; boxes ÷ ``scale``."""
    text = F.regexp_replace(F.array_join(F.slice(F.col("p"), F.lit(12), F.greatest(F.size("p") - 11, F.lit(1))), "\t"), f"\\A[{JS_WS}]+|[{JS_WS}]+\\z", "")
    num = lambda i: F.expr(f"try_cast(p[{i}] as double)")
    # cut once a line, and its text trimmed once
    rows = once(lines.select(*keep, F.col(value).alias("_line")), p=F.split("_line", "\t")).filter((F.size("p") >= 12) & (F.col("p")[0] == "5"))
    out = once(rows, text=text, conf=num(10)).select(
        *keep, "text", "conf", *((num(6 + i) / scale).alias(n) for i, n in enumerate("xywh")),
        F.array_join(F.slice("p", 3, 3), "-").alias("line"),
    )
    return out.filter((F.col("text") != "") & (F.col("conf") >= F.when(F.col("text").rlike("[0-9]"), 12).otherwise(30)))


def stitch_strips(words: DataFrame, strips: DataFrame) -> DataFrame:
    """Words of overlapping strips on their picture: moved down by ``y0``, kept where the strip owns their middle.

    ``strips``: strip_id, y0, own0, own1 (one row per strip of a plan, hence small).
    """
    both = words.join(strips, "strip_id").withColumn("y", F.col("y") + F.col("y0"))
    mid = F.col("y") + F.col("h") / 2
    return both.filter((mid >= F.col("own0")) & (mid < F.col("own1"))).drop("y0", "own0", "own1")
