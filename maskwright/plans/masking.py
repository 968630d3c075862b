"""Registered queries: words, classification, masks, page filters, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.functions.columns import once
from maskwright.operators import geometry as G
from maskwright.operators import masks as M
from maskwright.plans import base as P
from maskwright.sources.words import read_ocr_tsv, stitch_strips

W, MASKS = P.words_sql(), f"{P.words_sql()}, {P.typed_sql()}, {P.RUNS_SQL}"


def _masks(spark, sf_dir, *carry) -> DataFrame:
    return M.build_masks(M.typed(P.document_words(spark, sf_dir, *carry)), carry)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = _masks(spark, sf_dir, "lang", "source")
    return masks.groupBy("source", "lang", "type").agg(F.count("*").alias("n_masks"), F.sum("n_words").alias("n_words"))


FLAGSHIP_SQL = f"WITH {MASKS} SELECT source, lang, type, count(*) AS n_masks, sum(n_words)::BIGINT AS n_words FROM (SELECT masks.*, d.source, d.lang FROM masks JOIN documents d ON CAST(d.doc_id AS VARCHAR) = masks.image_id) GROUP BY source, lang, type"


def s5_words(spark, sf_dir):
    return P.document_words(spark, sf_dir).select("image_id", "word_id", "text", "x", "y", "w", "h")


def t1_tokens(spark, sf_dir):
    t = P.document_words(spark, sf_dir).select("text").distinct()
    return t.select("text", T.clean_token("text").alias("clean"), T.core("text").alias("core"), T.norm_word("text").alias("norm"), T.session_key("text").alias("session_key"))


T1_SQL = rf"""WITH {W} SELECT text, {P.clean_sql('text')} AS clean, {P.core_sql('text')} AS core, replace(lower({P.core_sql('text')}), '’', '''') AS norm,
 regexp_replace(regexp_replace(replace(text, '’', ''''), '[^\p{{L}}\p{{N}}_''-]', '', 'g'), '\A''+|''+\z', '', 'g') AS session_key FROM (SELECT DISTINCT text FROM words)"""


def t2_classify(spark, sf_dir):
    """Tokens are counted first: each distinct one is classified once."""
    return M.typed(P.document_words(spark, sf_dir).groupBy("text").agg(F.count("*").alias("n"))).select("text", "type", "n")


def _policies(spark, sf_dir) -> DataFrame:
    """Five policies from the benchmark: first words are client names, the next three are allowed."""
    w = F.split(F.lower(F.col("text")), r"\s+")
    item = P.read(spark, sf_dir, "benchmark").filter("text is not null").select((F.col("item_id") % 5).alias("policy"), F.slice(w, 1, 1).alias("c"), F.slice(w, 2, 3).alias("a"))
    return item.groupBy("policy").agg(F.array_distinct(F.flatten(F.collect_list("c"))).alias("client_names"), F.array_distinct(F.flatten(F.collect_list("a"))).alias("allow_words"))


def t3_policy(spark, sf_dir):
    words = P.document_words(spark, sf_dir).withColumn("policy", F.col("image_id").cast("long") % 5)
    # a policy table is small by nature (five rows here); Spark broadcasts it below its size limit
    both = words.join(_policies(spark, sf_dir), "policy")
    kind = T.classify("text", F.concat(T.words_array(T.NEUTRAL), "allow_words"), F.col("client_names"))
    return both.withColumn("type", kind).groupBy("policy", "type").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"))


T3_SQL = rf"""WITH {W}, b AS (SELECT item_id % 5 AS policy, regexp_split_to_array(lower(text), '\s+') AS w FROM benchmark WHERE text IS NOT NULL),
pol AS (SELECT policy, list_distinct(flatten(list(w[1:1]))) AS client_names, list_distinct(flatten(list(w[2:4]))) AS allow_words FROM b GROUP BY policy),
u AS (SELECT CAST(image_id AS BIGINT) % 5 AS policy, text, count(*) AS n FROM words GROUP BY 1, 2),
k AS (SELECT u.policy, text, n, {P.classify_sql('text', f"list_concat({P.list_sql(T.NEUTRAL)}, allow_words)", 'client_names')} AS type FROM u JOIN pol USING (policy))
SELECT policy, type, sum(n)::BIGINT AS n, count(DISTINCT text) AS n_texts FROM k GROUP BY policy, type"""


def g2_masks(spark, sf_dir):
    return _masks(spark, sf_dir)


def g2_masks_exact(spark, sf_dir):
    return M.build_masks_exact(M.typed(P.document_words(spark, sf_dir)))


def g3_padded(spark, sf_dir):
    return M.pad_masks(_masks(spark, sf_dir)).select("image_id", "mask_id", "type", "x", "y", "w", "h", F.col("core.x").alias("core_x"))


G3_SQL = f"WITH {MASKS} SELECT image_id, mask_id, type, x - greatest(3, h * 0.18) AS x, y - greatest(3, h * 0.18) AS y, w + 2 * greatest(3, h * 0.18) AS w, h + 2 * greatest(3, h * 0.18) AS h, x AS core_x FROM masks"


def a1_counts(spark, sf_dir):
    return M.mask_counts(_active(_masks(spark, sf_dir)), "image_id")




def _active(masks: DataFrame) -> DataFrame:
    """A user's decisions, drawn by hash: one mask in eleven is switched off; some were drawn by hand or added later."""
    d = F.col("_d")
    drawn = once(masks, _d=P.draw(F.col("image_id"), F.col("mask_id").cast("string"), "user"))
    return drawn.withColumn("user_off", d % 11 == 0).withColumn("src", F.when(d % 13 == 0, "manual").when(d % 17 == 0, "check").when(d % 19 == 0, "user").otherwise("auto")).withColumn("on", d % 11 != 0).drop("_d")


ACTIVE_SQL = f"act AS (SELECT *, d % 11 = 0 AS user_off, CASE WHEN d % 13 = 0 THEN 'manual' WHEN d % 17 = 0 THEN 'check' WHEN d % 19 = 0 THEN 'user' ELSE 'auto' END AS src, d % 11 <> 0 AS \"on\" FROM (SELECT *, {P.draw_sql('image_id', 'CAST(mask_id AS VARCHAR)', chr(39) + 'user' + chr(39))} AS d FROM masks))"
A1_SQL = f"WITH {MASKS}, {ACTIVE_SQL} SELECT image_id, type, count(*) AS n_masks FROM act WHERE \"on\" GROUP BY CUBE (image_id, type)"
HIDDEN_SQL = f"{P.cells_sql('hw', 'words')}, {P.cells_sql('ha', 'act')}, hid AS (SELECT DISTINCT hw.image_id, hw.word_id FROM hw JOIN ha ON {P.same_cell('hw', 'ha')} AND ha.\"on\" AND {P.inside_sql('hw', 'ha')})"


def _ghostly(words: DataFrame) -> DataFrame:
    """One word in seventeen is a ghost, drawn by hash."""
    return once(words, ghost=P.draw(F.col("image_id"), F.col("word_id").cast("string"), "ghost") % 17 == 0)


REAL_SQL = f"rw AS (SELECT * FROM words WHERE {P.draw_sql('image_id', 'CAST(word_id AS VARCHAR)', chr(39) + 'ghost' + chr(39))} % 17 <> 0)"


def a2_tally(spark, sf_dir):
    words = P.document_words(spark, sf_dir)
    return M.tally(_ghostly(words), _active(M.build_masks(M.typed(words))))


A2_SQL = f"""WITH {MASKS}, {ACTIVE_SQL}, {HIDDEN_SQL}, {REAL_SQL},
c AS (SELECT rw.image_id, count(hid.word_id) AS hidden, count(*) - count(hid.word_id) AS kept FROM rw LEFT JOIN hid USING (image_id, word_id) GROUP BY 1),
y AS (SELECT image_id, count(*) FILTER (WHERE user_off OR src IN ('manual', 'check', 'user')) AS yours FROM act GROUP BY 1)
SELECT image_id, hidden, kept, coalesce(yours, 0)::BIGINT AS yours FROM c LEFT JOIN y USING (image_id)"""


def s9_published(spark, sf_dir):
    words = P.document_words(spark, sf_dir)
    return M.published_words(_ghostly(words), _active(M.build_masks(M.typed(words))))


S9_SQL = f"WITH {MASKS}, {ACTIVE_SQL}, {HIDDEN_SQL}, {REAL_SQL} SELECT rw.image_id, rw.word_id, CASE WHEN hid.word_id IS NULL THEN text ELSE '' END AS text, x, y, w, h, hid.word_id IS NULL AS kept FROM rw LEFT JOIN hid USING (image_id, word_id)"


def w1_order(spark, sf_dir):
    return M.reading_order(P.document_words(spark, sf_dir)).select("image_id", "word_id", "rank")


W1_SQL = f"WITH {W} SELECT image_id, word_id, row_number() OVER (PARTITION BY image_id ORDER BY floor(y / 8 + 0.5), x, word_id) AS rank FROM words"


def f4_kept(spark, sf_dir):
    return M.kept_words(P.document_words(spark, sf_dir))


F4_SQL = rf"""WITH {W}, {P.typed_sql()}, b AS (SELECT *, {P.core_sql('text')} AS bare FROM typed WHERE type IS NULL AND NOT regexp_matches(text, '[0-9]'))
SELECT image_id, lower(bare) AS word, arg_min(bare, word_id) AS spelling, count(*) AS n FROM b WHERE length(regexp_replace(bare, '[^\p{{L}}]', '', 'g')) >= 3 GROUP BY 1, 2"""


def _second_pass(words: DataFrame) -> DataFrame:
    """A second reading, drawn by hash: two pixels off, a tenth of the words missing, a tenth with a digit added, some tall."""
    d = F.col("_d")
    moved = once(words, _d=P.draw(F.col("image_id"), F.col("word_id").cast("string"), "again")).filter(d % 10 != 0).select(
        "image_id", (F.col("word_id") + 1_000_000).alias("word_id"), F.when(d % 10 == 1, F.concat("text", F.lit("1"))).otherwise(F.col("text")).alias("text"),
        (d % 100).cast("double").alias("conf"), (F.col("x") + 2).alias("x"), (F.col("y") + 1).alias("y"), F.when(d % 97 == 0, F.col("w") * 40).otherwise(F.col("w")).alias("w"),
        F.when(d % 89 == 0, F.col("h") * 9).otherwise(F.col("h")).alias("h"), F.lit("second").alias("pass"),
    )
    return moved


SECOND_SQL = f"""sec AS (SELECT image_id, word_id + 1000000 AS word_id, CASE WHEN d % 10 = 1 THEN text || '1' ELSE text END AS text, (d % 100)::DOUBLE AS conf, x + 2 AS x, y + 1 AS y,
 CASE WHEN d % 97 = 0 THEN w * 40 ELSE w END AS w, CASE WHEN d % 89 = 0 THEN h * 9 ELSE h END AS h FROM (SELECT *, {P.draw_sql('image_id', 'CAST(word_id AS VARCHAR)', chr(39) + 'again' + chr(39))} AS d FROM words) WHERE d % 10 <> 0)"""


def f1_plausible(spark, sf_dir):
    return M.plausible(_second_pass(P.document_words(spark, sf_dir))).select("image_id", "word_id", "text")


F1_SQL = rf"""WITH {W}, {SECOND_SQL}, med AS (SELECT image_id, list_sort(list(h))[(count(*) // 2 + 1)::BIGINT] AS med FROM sec GROUP BY 1),
v AS (SELECT sec.*, med, h / med AS tall, regexp_matches(text, '[0-9]') AS dg, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS le FROM sec JOIN med USING (image_id))
SELECT image_id, word_id, text FROM v WHERE NOT (regexp_matches(text, '\A[1Il|!\[\]{{}}()]{{3,}}\z') OR (w < 2 AND h <= med * 0.5 AND conf < 80) OR (tall > 8 AND NOT (dg AND conf >= 90))
 OR (tall > 15 AND w > med * 15) OR (tall > 3 AND NOT dg AND (conf < 80 OR le < 3)) OR (tall > 4 AND conf < 70) OR (w > h * greatest(1, length(text)) * 2.5 AND w > med * 12 AND conf < 85))"""


def _two_passes(spark, sf_dir) -> DataFrame:
    first = P.document_words(spark, sf_dir).select("image_id", "word_id", "text", "conf", "x", "y", "w", "h", F.lit("first").alias("pass"))
    second = _second_pass(first).withColumn("w", F.least("w", F.length("text") * 7.0)).withColumn("h", F.lit(12.0))
    return first.unionByName(second)


def j1_merge(spark, sf_dir):
    return M.merge_passes(_two_passes(spark, sf_dir), ["first", "second"]).select("image_id", "word_id", "text", "pass")


_SEC2 = f"{SECOND_SQL}, s2 AS (SELECT image_id, word_id, text, conf, x, y, least(w, length(text) * 7.0) AS w, 12.0::DOUBLE AS h FROM sec)"
J1_SQL = f"""WITH {W}, {_SEC2}, {P.cells_sql('sc', 's2')}, {P.cells_sql('wc', 'words')}, hit AS (SELECT s.image_id, s.word_id, bool_or(regexp_matches(v.text, '[0-9]')) AS dg FROM sc s JOIN wc v ON {P.same_cell('s', 'v')} AND {P.overlap_sql('s', 'v')} > 0.3 GROUP BY 1, 2)
SELECT image_id, word_id, text, 'first' AS pass FROM words UNION ALL
SELECT s2.image_id, s2.word_id, text, 'second' AS pass FROM s2 LEFT JOIN hit USING (image_id, word_id) WHERE dg IS NULL OR (regexp_matches(text, '[0-9]') AND NOT dg)"""


def f2_ghosts(spark, sf_dir):
    both = _two_passes(spark, sf_dir).withColumn("text", F.when(F.col("pass") == "second", F.concat(F.substring("text", 1, 2), F.lit("16"))).otherwise(F.col("text")))
    return M.flag_ghosts(both).filter("ghost").select("image_id", "word_id", "text")


F2_SQL = rf"""WITH {W}, {_SEC2}, g AS (SELECT image_id, word_id, substr(text, 1, 2) || '16' AS text, conf, x, y, w, h FROM s2 UNION ALL SELECT image_id, word_id, text, conf, x, y, w, h FROM words),
lt AS (SELECT *, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS le, regexp_matches(text, '[0-9]') AS dg, floor(y / 30) AS b FROM g)
SELECT DISTINCT a.image_id, a.word_id, a.text FROM lt a JOIN lt v ON a.image_id = v.image_id AND a.b = v.b AND a.dg AND a.le < 3 AND v.conf >= 85 AND NOT v.dg AND v.le >= 1 AND {P.overlap_sql('a', 'v')} > 0.3"""


def f3_marks(spark, sf_dir):
    """Scraps of a second reading against regions: every third word of the first."""
    words = P.document_words(spark, sf_dir)
    second = _second_pass(words).withColumn("text", F.substring("text", 1, 4)).withColumn("h", F.lit(12.0))
    regions = words.filter("word_id % 3 = 0").select("image_id", F.col("word_id").alias("region_id"), "x", "y", "w", "h")
    return M.mark_only(second, regions).select("image_id", "word_id", "text")


F3_SQL = rf"""WITH {W}, {SECOND_SQL}, s AS (SELECT image_id, word_id, substr(text, 1, 4) AS text, conf, x, y, w, 12.0::DOUBLE AS h FROM sec),
c AS (SELECT * FROM s WHERE NOT regexp_matches(text, '[0-9]') AND conf < 60 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) <= 3),
{P.cells_sql('cc', 'c')}, {P.cells_sql('r', '(SELECT * FROM words WHERE word_id % 3 = 0)')}, seen AS (SELECT DISTINCT c.image_id, c.word_id FROM cc c JOIN r ON {P.same_cell('c', 'r')} AND {P.overlap_sql('c', 'r')} > 0.2)
SELECT image_id, word_id, text FROM c ANTI JOIN seen USING (image_id, word_id)"""


def j2_overlap(spark, sf_dir):
    words = P.document_words(spark, sf_dir).select("image_id", "word_id", "x", "y", "w", "h")
    second = _second_pass(P.document_words(spark, sf_dir)).select("image_id", "word_id", "x", "y", F.lit(20.0).alias("w"), F.lit(12.0).alias("h"))
    return G.overlap_join(second, words, 0.3).select("image_id", "a_word_id", "b_word_id")


J2_SQL = f"WITH {W}, {SECOND_SQL}, s AS (SELECT image_id, word_id, x, y, 20.0::DOUBLE AS w, 12.0::DOUBLE AS h FROM sec), {P.cells_sql('sc', 's')}, {P.cells_sql('wc', 'words')} SELECT DISTINCT s.image_id, s.word_id AS a_word_id, v.word_id AS b_word_id FROM sc s JOIN wc v ON {P.same_cell('s', 'v')} AND {P.overlap_sql('s', 'v')} > 0.3"


def u2_except(spark, sf_dir):
    """Words whose box no padded mask contains."""
    words = P.document_words(spark, sf_dir)
    masks = M.pad_masks(M.build_masks(M.typed(words))).select("image_id", "x", "y", "w", "h")
    return G.except_contained(words.select("image_id", "word_id", "x", "y", "w", "h"), masks, "word_id").select("image_id", "word_id")


U2_SQL = f"""WITH {MASKS}, pad AS (SELECT image_id, x - 3 AS x, y - 3 AS y, w + 6 AS w, h + 6 AS h FROM masks), {P.cells_sql('c', 'words')}, {P.cells_sql('mc', 'pad')}
SELECT image_id, word_id FROM words ANTI JOIN (SELECT DISTINCT c.image_id, c.word_id FROM c JOIN mc m ON {P.same_cell('c', 'm')} AND m.x <= c.x + 1 AND m.y <= c.y + 1 AND m.x + m.w >= c.x + c.w - 1 AND m.y + m.h >= c.y + c.h - 1) k USING (image_id, word_id)"""


def j3_beside(spark, sf_dir):
    return M.beside(P.document_words(spark, sf_dir), -1)


J3_SQL = f"""WITH {W}, pr AS (SELECT a.image_id, a.word_id, b.word_id AS n_word_id, b.text AS n_text, a.x - (b.x + b.w) AS gap FROM words a JOIN words b ON a.image_id = b.image_id AND a.line_no = b.line_no AND a.word_id <> b.word_id
 AND least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) <= least(a.w, b.w) * 0.3)
SELECT image_id, word_id, n_word_id, n_text, gap FROM (SELECT *, row_number() OVER (PARTITION BY image_id, word_id ORDER BY gap, n_word_id) AS r FROM pr WHERE gap >= -2 AND gap <= 36) WHERE r = 1"""


def _ranked(words: DataFrame) -> DataFrame:
    """Report labels laid over the text, drawn by hash: rank words, "of", and small or large numbers."""
    d = F.col("_d")
    fake = F.when(d == 0, "Top").when(d == 1, "of").when(d == 2, "5").when(d == 3, "700").when(d == 4, "Page").otherwise("3%")
    drawn = once(words, _d=P.draw(F.col("image_id"), F.col("word_id").cast("string"), "rank") % 6)
    return drawn.withColumn("text", fake).drop("_d")


RANKED_SQL = f"rk AS (SELECT * REPLACE (['Top', 'of', '5', '700', 'Page', '3%'][1 + {P.draw_sql('image_id', 'CAST(word_id AS VARCHAR)', chr(39) + 'rank' + chr(39))} % 6] AS text) FROM words)"


def j4_labels(spark, sf_dir):
    return M.count_labels(_ranked(P.document_words(spark, sf_dir)))


J4_SQL = f"""WITH {W}, {RANKED_SQL}, nb AS (SELECT *, CASE WHEN x - (lag(x) OVER q + lag(w) OVER q) <= 36 THEN lag(lower(text)) OVER q END AS p, CASE WHEN x - (lag(x) OVER q + lag(w) OVER q) <= 36 THEN lag(word_id) OVER q END AS pid
 FROM rk WINDOW q AS (PARTITION BY image_id, line_no ORDER BY x)),
sm AS (SELECT * FROM nb WHERE text IN ('5', '3%')), safe AS (SELECT image_id, word_id FROM sm WHERE p IN ('top', 'page'))
SELECT image_id, word_id FROM safe UNION SELECT sm.image_id, sm.word_id FROM sm JOIN nb o ON sm.image_id = o.image_id AND sm.pid = o.word_id AND sm.p = 'of' JOIN safe ON safe.image_id = o.image_id AND safe.word_id = o.pid"""


def g4_columns(spark, sf_dir):
    """Cells of line items as a page per order: three number columns, a row per line."""
    items = P.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("image_id"), "l_linenumber", F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col(c).alias("v")) for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount"))))).alias("c"))
    cells = items.select("image_id", (F.col("l_linenumber") * 3 + F.col("c.k")).cast("long").alias("mask_id"), F.lit(T.NUMBER).alias("type"), (F.col("c.k") * 200.0).alias("x"), (F.col("l_linenumber") * 30.0).alias("y"), (F.length(F.col("c.v").cast("string")) * 7.0).alias("w"), F.lit(12.0).alias("h"))
    return M.column_fill(cells)


def s1_tsv(spark, sf_dir):
    """OCR lines written from the documents' words, with a digit's and a letter's confidence drawn by hash, read again at scale 2."""
    words = P.document_words(spark, sf_dir)
    d = (P.draw(F.col("image_id"), F.col("word_id").cast("string"), "ocr") % 60).cast("string")
    num = lambda c: F.col(c).cast("int").cast("string")
    line = F.concat_ws("\t", F.when(F.col("word_id") % 7 == 0, "4").otherwise("5"), F.lit("1"), F.lit("1"), F.lit("1"), F.element_at(F.split("line", "-"), -1), F.lit("1"), *map(num, "xywh"), d, "text")
    return read_ocr_tsv(words.select("image_id", "word_id", line.alias("value")), 2.0, keep=("image_id", "word_id"))


S1_SQL = f"""WITH {W} SELECT image_id, word_id, text, c::DOUBLE AS conf, x / 2 AS x, y / 2 AS y, w / 2 AS w, h / 2 AS h, '1-1-' || line_no AS line FROM (SELECT *, {P.draw_sql('image_id', 'CAST(word_id AS VARCHAR)', chr(39) + 'ocr' + chr(39))} % 60 AS c FROM words)
WHERE word_id % 7 <> 0 AND c >= CASE WHEN regexp_matches(text, '[0-9]') THEN 12 ELSE 30 END"""


def s2_strips(spark, sf_dir):
    """Pages cut into strips of 300 pixels that overlap by 30; every word is read in each strip that shows it."""
    words = P.document_words(spark, sf_dir)
    n = F.floor((F.col("y")) / 270)
    read = words.withColumn("strip_id", F.explode(F.array_distinct(F.array(n, F.greatest(n - 1, F.lit(0)))))).withColumn("y", F.col("y") - F.col("strip_id") * 270).filter("y + h <= 300")
    top = words.agg(F.floor(F.max("y") / 270).alias("m"))
    strips = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("strip_id"))
    strips = strips.select("strip_id", (F.col("strip_id") * 270.0).alias("y0"), F.when(F.col("strip_id") == 0, -1.0).otherwise(F.col("strip_id") * 270.0 + 15).alias("own0"), ((F.col("strip_id") + 1) * 270.0 + 15).alias("own1"))
    return stitch_strips(read, strips).select("image_id", "word_id", "text", "x", "y")


S2_SQL = f"WITH {W} SELECT image_id, word_id, text, x, y FROM words"

QUERIES = {
    "flagship_mask_counts": flagship, "s1_ocr_tsv": s1_tsv, "s2_stitch_strips": s2_strips, "s5_words": s5_words, "s9_published": s9_published, "t1_tokens": t1_tokens,
    "t2_classify": t2_classify, "t3_policy": t3_policy, "f1_plausible": f1_plausible, "f2_ghosts": f2_ghosts, "f3_mark_only": f3_marks, "f4_kept_words": f4_kept,
    "j1_merge_passes": j1_merge, "j2_overlap_join": j2_overlap, "j3_beside": j3_beside, "j4_count_labels": j4_labels, "g2_masks": g2_masks, "g2_masks_exact": g2_masks_exact,
    "g3_padded": g3_padded, "g4_column_fill": g4_columns, "a1_mask_counts": a1_counts, "a2_tally": a2_tally, "w1_reading_order": w1_order, "u2_except_contained": u2_except,
}
SQL = {
    "flagship_mask_counts": FLAGSHIP_SQL, "s1_ocr_tsv": S1_SQL, "s2_stitch_strips": S2_SQL, "s5_words": f"WITH {W} SELECT image_id, word_id, text, x, y, w, h FROM words", "s9_published": S9_SQL, "t1_tokens": T1_SQL,
    "t2_classify": f"WITH {W}, {P.typed_sql()} SELECT text, type, count(*) AS n FROM typed GROUP BY text, type", "t3_policy": T3_SQL, "f1_plausible": F1_SQL, "f2_ghosts": F2_SQL, "f3_mark_only": F3_SQL, "f4_kept_words": F4_SQL,
    "j1_merge_passes": J1_SQL, "j2_overlap_join": J2_SQL, "j3_beside": J3_SQL, "j4_count_labels": J4_SQL, "g2_masks": f"WITH {MASKS} SELECT * FROM masks", "g2_masks_exact": f"WITH {MASKS} SELECT * FROM masks",
    "g3_padded": G3_SQL, "a1_mask_counts": A1_SQL, "a2_tally": A2_SQL, "w1_reading_order": W1_SQL, "u2_except_contained": U2_SQL,
}
