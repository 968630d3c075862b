"""Registered queries: verification, gate, release, benchmark figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.functions.columns import once
from maskwright.operators import masks as M
from maskwright.operators import score as S
from maskwright.operators import verify as V
from maskwright.plans import base as P
from maskwright.plans.masking import ACTIVE_SQL, HIDDEN_SQL, MASKS, SECOND_SQL, _active, _second_pass
from maskwright.plans.store import written


def _page(spark, sf_dir):
    """Typed words, written once for all steps that read them, and their masks with a user's decisions."""
    words = written(M.typed(P.document_words(spark, sf_dir)), "words")
    return words, written(_active(M.build_masks(words)), "masks")


def _drawn(what):
    return P.draw(F.col("image_id"), F.col("word_id").cast("string"), what)


def _reread(words):
    """What a second reader sees: words two pixels off, cut or grown by a letter, a fifth of them twice, and marks below the line."""
    shape = ("image_id", "word_id", "text", "conf", "x", "y", "w", "h")
    again = _second_pass(words).withColumn("w", F.length("text") * 7.0).withColumn("h", F.lit(12.0)).select(*shape)
    twice = again.filter(_drawn("twice") % 5 == 0).withColumn("word_id", F.col("word_id") + 3_000_000).withColumn("x", F.col("x") + 4)
    d = F.col("_d")
    stray = once(words, _d=_drawn("stray")).filter(d % 20 == 0).select("image_id", (F.col("word_id") + 6_000_000).alias("word_id"), F.when(d % 3 == 0, "4").when(d % 3 == 1, "~").otherwise("4x%").alias("text"), F.lit(90.0).alias("conf"), "x", (F.col("y") + 16).alias("y"), F.lit(9.0).alias("w"), F.when(d % 7 == 0, 36.0).otherwise(8.0).alias("h"))
    return again.unionByName(twice).unionByName(stray)


def _regions(words):
    """What a text detector finds, drawn by hash: two of three words; a second look reads some of them."""
    d = F.col("_d")
    return once(words, _d=_drawn("detected")).filter(d % 3 != 0).select("image_id", F.col("word_id").alias("region_id"), "x", "y", "w", "h", F.struct("x", "y", "w", "h").alias("core"), F.when(d % 5 == 0, F.col("text")).alias("look"))


def _d(what):
    return P.draw_sql("image_id", "CAST(word_id AS VARCHAR)", f"'{what}'")


REREAD_SQL = f"""{SECOND_SQL}, ag AS (SELECT image_id, word_id, text, conf, x, y, (length(text) * 7.0)::DOUBLE AS w, 12.0::DOUBLE AS h FROM sec),
rr AS (SELECT * FROM ag UNION ALL SELECT image_id, word_id + 3000000, text, conf, x + 4, y, w, h FROM ag WHERE {_d('twice')} % 5 = 0
  UNION ALL SELECT image_id, word_id + 6000000, CASE d % 3 WHEN 0 THEN '4' WHEN 1 THEN '~' ELSE '4x%' END, 90.0, x, y + 16, 9.0, CASE WHEN d % 7 = 0 THEN 36.0 ELSE 8.0 END FROM (SELECT *, {_d('stray')} AS d FROM words) WHERE d % 20 = 0),
reg AS (SELECT image_id, word_id AS region_id, x, y, w, h, CASE WHEN d % 5 = 0 THEN text END AS look FROM (SELECT *, {_d('detected')} AS d FROM words) WHERE d % 3 <> 0)"""
_SQUASH = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_A, _B = _SQUASH.format("r.text"), _SQUASH.format("v.text")
NEAR_SQL = f"least(length({_A}), length({_B})) >= 4 AND CASE WHEN contains({_A}, {_B}) OR contains({_B}, {_A}) THEN least(length({_A}), length({_B})) >= 0.6 * greatest(length({_A}), length({_B})) ELSE abs(length({_A}) - length({_B})) <= 2 AND levenshtein({_A}, {_B}) <= 2 END"
_L = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_LA, _LB, _LK = _L.format("r.text"), _L.format("v.text"), _L.format("v.look")
_WITHIN = "greatest(0, least(r.x + r.w, {0}) - greatest(r.x, {1})) >= 0.8 * r.w AND abs(r.y + r.h / 2 - v.y - v.h / 2) <= 0.5 * greatest(r.h, v.h)"
#: a's characters are some of b's, in order: the rest of a that is still to be found, after each character of b.
_SUBSEQ = f"list_reduce(list_prepend({_LA}, string_split({_LB}, '')), lambda rest, c: CASE WHEN starts_with(rest, c) THEN substr(rest, 2) ELSE rest END) = ''"
_ONE_OFF = f"(length({_LA}) = length({_LB}) AND len(list_filter(range(1, length({_LA}) + 1), lambda i: {_LA}[i] <> {_LB}[i])) <= 1)"
#: What is known to be safe: words that may stay readable and are not under a mask, and what a second look read.
SAFE_SQL = f"""sure AS (SELECT * FROM rr WHERE conf >= CASE WHEN regexp_matches(text, '[0-9]') THEN 20 ELSE 45 END),
{P.cells_sql('src', 'sure')}, {P.cells_sql('actc', 'act')}, {P.cells_sql('sf0', '(SELECT * FROM typed WHERE type IS NULL)')}, {P.cells_sql('regc', 'reg', '2')},
sf AS (SELECT * FROM sf0 WHERE (image_id, word_id) NOT IN (SELECT v.image_id, v.word_id FROM sf0 v JOIN actc m ON {P.same_cell('v', 'm')} AND m."on" AND {P.overlap_sql('v', 'm')} > 0.5)),
safe_again AS (SELECT r.image_id, r.word_id FROM src r JOIN sf v ON {P.same_cell('r', 'v')} AND NOT regexp_matches(r.text, '[0-9]')
   AND (({P.overlap_sql('r', 'v')} > 0.5 AND (r.w * r.h) / greatest(1, v.w * v.h) > 0.5 AND (r.w * r.h) / greatest(1, v.w * v.h) < 2 AND {NEAR_SQL})
     OR (v.conf >= 85 AND length({_LA}) >= 3 AND {_WITHIN.format('v.x + v.w', 'v.x')} AND ({_SUBSEQ} OR {_ONE_OFF})))
  UNION SELECT r.image_id, r.word_id FROM src r JOIN regc v ON {P.same_cell('r', 'v')} AND v.look <> '' AND length({_LA}) > 0 AND abs(length({_LA}) - length({_LK})) <= 1 AND {_WITHIN.format('v.x + v.w + 2', '(v.x - 2)')})"""
_LOW = r"lower(regexp_replace(regexp_replace(text, '\A\s+|\s+\z', '', 'g'), '\A[^\p{L}\p{N}_]+|[^\p{L}\p{N}_%]+\z', '', 'g'))"
_WORDS = ", ".join(f"'{w}'" for w in [*M.RANK_WORDS, *M.SEQUENCE_WORDS])
#: Count labels among the re-read words; pages of running text have no columns of row numbers.
LABELS_SQL = rf"""rl AS (SELECT *, {_LOW} AS low FROM rr), {P.cells_sql('rlc', 'rl', '36')},
nb AS (SELECT a.image_id, a.word_id, a.low, min(struct_pack(gap := a.x - b.x - b.w, id := b.word_id, t := b.low)) AS n FROM rlc a JOIN rlc b ON {P.same_cell('a', 'b')} AND a.word_id <> b.word_id AND (a.low = 'of' OR regexp_matches(a.low, '\A[0-9]{{1,3}}%?\z'))
  AND abs(b.y + b.h / 2 - a.y - a.h / 2) <= 0.6 * greatest(a.h, b.h) AND least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) <= 0.3 * least(a.w, b.w) AND a.x - b.x - b.w BETWEEN -2 AND 3 * greatest(a.h, 8) GROUP BY 1, 2, 3),
sm AS (SELECT * FROM nb WHERE low <> 'of' AND TRY_CAST(replace(low, '%', '') AS INT) BETWEEN 1 AND 500),
lb0 AS (SELECT image_id, word_id FROM sm WHERE n.t IN ({_WORDS}) UNION SELECT image_id, word_id FROM rl WHERE regexp_matches(low, '\A(top|bottom)[-_]?[0-9]{{1,3}}%?\z')),
lb AS (SELECT * FROM lb0 UNION SELECT sm.image_id, sm.word_id FROM sm JOIN nb o ON sm.n.t = 'of' AND o.image_id = sm.image_id AND o.word_id = sm.n.id JOIN lb0 ON lb0.image_id = o.image_id AND lb0.word_id = o.n.id)"""
_PAIR = r"\p{L}{2}"
_MARK = r"NOT regexp_matches(text, '[0-9]') AND conf < 60 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) <= 3 AND length(regexp_replace(text, '\s', '', 'g')) <= 4"
CAND_SQL = rf"""{SAFE_SQL}, {LABELS_SQL}, {P.cells_sql('wc', f'(SELECT * FROM words WHERE NOT ({_MARK}))')},
cov AS (SELECT DISTINCT r.image_id, r.word_id FROM src r JOIN actc m ON {P.same_cell('r', 'm')} AND (m."on" OR m.user_off) AND {P.inside_sql('r', 'm')}),
ck AS (SELECT text, {P.classify_sql('text')} AS type FROM (SELECT DISTINCT text FROM sure)),
known AS (SELECT r.image_id, r.word_id FROM src r JOIN regc v ON {P.same_cell('r', 'v')} AND {P.overlap_sql('r', 'v')} > 0.2 UNION SELECT r.image_id, r.word_id FROM src r JOIN wc v ON {P.same_cell('r', 'v')} AND {P.overlap_sql('r', 'v')} > 0.3),
cand0 AS (SELECT s.*, ck.type, CASE WHEN ck.type = '{T.TEXT}' THEN 'review' ELSE 'block' END AS severity, k.word_id IS NULL AS likely_mark, length(regexp_replace(text, '\s', '', 'g')) AS n_chars
  FROM sure s JOIN ck USING (text) LEFT JOIN known k USING (image_id, word_id) ANTI JOIN cov USING (image_id, word_id) ANTI JOIN safe_again USING (image_id, word_id) ANTI JOIN lb USING (image_id, word_id)
  WHERE ck.type IS NOT NULL AND NOT (ck.type = '{T.TEXT}' AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) <= 2 AND NOT regexp_matches(text, '[0-9]'))),
{P.cells_sql('shortc', f"(SELECT * FROM cand0 WHERE likely_mark AND n_chars <= 3 AND NOT regexp_matches(text, '{_PAIR}'))", 'q.h', 'q.h')},
clo AS (SELECT DISTINCT r.image_id, r.word_id FROM shortc r JOIN actc m ON {P.same_cell('r', 'm')} AND m."on"
  AND greatest(0, greatest(r.x, m.x) - least(r.x + r.w, m.x + m.w), greatest(r.y, m.y) - least(r.y + r.h, m.y + m.h)) < greatest(4, r.h)),
cand AS (SELECT c.* EXCLUDE (n_chars), c.likely_mark AND n_chars <= 3 AND NOT regexp_matches(text, '\p{{L}}{{2}}') AND (clo.word_id IS NULL OR c.h >= 30) AS aside FROM cand0 c LEFT JOIN clo USING (image_id, word_id)
  WHERE NOT (c.likely_mark AND n_chars <= 3 AND NOT regexp_matches(text, '[0-9]')))"""
CHECK = f"{MASKS}, {ACTIVE_SQL}, {REREAD_SQL}, {CAND_SQL}"


def _candidates(spark, sf_dir):
    words, masks = _page(spark, sf_dir)
    return words, masks, V.candidates(_reread(words), words, masks, regions=_regions(words))


def j12_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)[2].select("image_id", "word_id", "text", "type", "severity", "likely_mark", "aside")


def j12_verify(spark, sf_dir):
    words, masks = _page(spark, sf_dir)
    return V.verify(_reread(words), words, masks, regions=_regions(words))


#: What is read twice comes in pairs, of which the later one gives way to the earlier, but not to one that is aside.
VERIFY_SQL = f"""WITH {CHECK}, lost AS (SELECT DISTINCT b.image_id, b.word_id FROM cand a JOIN cand b ON a.image_id = b.image_id AND a.word_id % 3000000 = b.word_id % 3000000 AND a.word_id < b.word_id AND (NOT a.aside OR b.aside)
  AND greatest(0, least(a.x + a.w + 3, b.x + b.w) - greatest(a.x - 3, b.x)) * greatest(0, least(a.y + a.h + 3, b.y + b.h) - greatest(a.y - 3, b.y)) / least((a.w + 6) * (a.h + 6), b.w * b.h) > 0.3)
SELECT image_id, word_id, text, type, severity, x - 3 AS x, y - 3 AS y, w + 6 AS w, h + 6 AS h, likely_mark, aside, false AS resolved FROM cand ANTI JOIN lost USING (image_id, word_id)"""


def j13_rereads(spark, sf_dir):
    words, masks = _page(spark, sf_dir)
    reread = _reread(words).filter(F.col("conf") >= F.when(F.col("text").rlike("[0-9]"), 20).otherwise(45))
    return V.rereads_safe(reread, V.safe_seen(words, masks), _regions(words))


def _findings(spark, sf_dir):
    """Findings of the check before overlap is dropped, a third of them resolved by hash, some likely marks."""
    words, masks, c = _candidates(spark, sf_dir)
    d = F.col("_d")
    drawn = once(c, _d=P.draw(F.col("image_id"), F.col("word_id").cast("string"), "done"))
    return words, masks, drawn.withColumn("resolved", d % 3 != 0).withColumn("likely_mark", d % 5 == 0).drop("_d")


_D = P.draw_sql("image_id", "CAST(word_id AS VARCHAR)", "'done'")
FOUND = f"{CHECK}, fnd AS (SELECT * REPLACE ({_D} % 5 = 0 AS likely_mark), {_D} % 3 <> 0 AS resolved FROM cand)"


def a3_gate(spark, sf_dir):
    words, _, found = _findings(spark, sf_dir)
    return V.gate(found, words)


A3_SQL = f"WITH {FOUND}, wst AS (SELECT image_id, max(CASE WHEN severity = 'block' THEN 2 ELSE 1 END) AS worst FROM fnd WHERE NOT resolved GROUP BY 1) SELECT i.image_id, CASE worst WHEN 2 THEN 'blocked' WHEN 1 THEN 'review' ELSE 'pass' END AS gate FROM (SELECT DISTINCT image_id FROM words) i LEFT JOIN wst USING (image_id)"


def a4_hide(spark, sf_dir):
    _, masks, found = _findings(spark, sf_dir)
    hidden, _ = V.hide_uncertain(found, masks.select("image_id", "x", "y", "w", "h", "type", "text", "on", "src"))
    return hidden.groupBy("type", "src").agg(F.count("*").alias("n"), F.sum("w").alias("width"))


A4_SQL = f"WITH {FOUND} SELECT type, src, count(*) AS n, sum(w) AS width FROM (SELECT type, src, w FROM act UNION ALL SELECT 'Added after check', 'check', w FROM fnd WHERE NOT resolved) GROUP BY type, src"


def a5_receipts(spark, sf_dir):
    words, masks, found = _findings(spark, sf_dir)
    return V.receipts(words, masks, found, M.published_words(words, masks))


A5_SQL = f"""WITH {FOUND}, {HIDDEN_SQL},
pub AS (SELECT words.image_id, sha256(string_agg(CASE WHEN hid.word_id IS NULL THEN text ELSE '' END, ' ' ORDER BY words.word_id)) AS sha256 FROM words LEFT JOIN hid USING (image_id, word_id) GROUP BY 1),
wst AS (SELECT image_id, max(CASE WHEN resolved THEN 0 WHEN severity = 'block' THEN 2 ELSE 1 END) AS worst, count(*) FILTER (WHERE resolved) AS fm, count(*) FILTER (WHERE NOT resolved) AS fo FROM fnd GROUP BY 1),
k AS (SELECT image_id, count(*) AS n_masks, count(DISTINCT type) AS n_kinds FROM act WHERE "on" GROUP BY 1)
SELECT pub.image_id, CASE worst WHEN 2 THEN 'blocked' WHEN 1 THEN 'review' ELSE 'pass' END AS gate, coalesce(n_masks, 0) AS n_masks, coalesce(n_kinds, 0) AS n_kinds, coalesce(fm, 0) AS findings_masked, coalesce(fo, 0) AS findings_open, sha256
FROM pub LEFT JOIN wst USING (image_id) LEFT JOIN k USING (image_id)"""


def w2_rank(spark, sf_dir):
    _, _, found = _findings(spark, sf_dir)
    return V.rank_findings(found).select("image_id", "word_id", "rank")


W2_SQL = f"WITH {FOUND} SELECT image_id, word_id, row_number() OVER (PARTITION BY image_id ORDER BY resolved::INT, likely_mark::INT, CASE WHEN severity = 'block' THEN 0 ELSE 1 END, word_id) AS rank FROM fnd"


def w3_top(spark, sf_dir):
    """The three widest masks of each page."""
    _, masks = _page(spark, sf_dir)
    return V.top_k(masks, ["image_id"], [F.col("w").desc(), "mask_id"], 3).select("image_id", "mask_id", "w")


W3_SQL = f"WITH {MASKS} SELECT image_id, mask_id, w FROM masks QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY w DESC, mask_id) <= 3"


def s7_release(spark, sf_dir):
    """Conversations as files, turns as pages; a page passes when its text has nothing to mask."""
    turns = P.read(spark, sf_dir, "conversations").select(F.concat(F.lit("f"), (F.col("conv_id") / 10).cast("long").cast("string")).alias("file"), F.concat_ws("-", "conv_id", "turn").alias("image_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("page"), (F.coalesce(F.length("text"), F.lit(0)) > 1500).alias("failed"), "text")
    gates = turns.select("image_id", F.when(F.col("text").rlike("[0-9]"), "blocked").when(F.length("text") > 900, "review").otherwise("pass").alias("gate"))
    return V.release_notes(V.release(turns.drop("text"), gates))


S7_SQL = """WITH t AS (SELECT 'f' || CAST(conv_id // 10 AS VARCHAR) AS file, concat_ws('-', conv_id, turn) AS image_id, conv_id * 1000 + turn AS page, coalesce(length(text), 0) > 1500 AS failed,
 CASE WHEN regexp_matches(text, '[0-9]') THEN 'blocked' WHEN length(text) > 900 THEN 'review' ELSE 'pass' END AS gate FROM conversations),
s AS (SELECT file, CASE WHEN max(failed) OVER (PARTITION BY file) THEN 'error' WHEN row_number() OVER (PARTITION BY file ORDER BY page, image_id) > 30 THEN 'cut' WHEN gate = 'pass' THEN 'done' ELSE 'held' END AS status FROM t),
c AS (SELECT file, count(*) FILTER (WHERE status = 'error') AS bad, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'held') AS held, count(*) FILTER (WHERE status = 'cut') AS cut, count(*) AS pages FROM s GROUP BY file)
SELECT file, CASE WHEN bad > 0 THEN 'error' WHEN held > 0 AND done = 0 THEN 'held' ELSE 'done' END AS status, done, held, cut,
 CASE WHEN bad > 0 THEN '' ELSE concat_ws(', ', CASE WHEN cut > 0 THEN 'first 30 of ' || pages || ' pages' WHEN pages > 1 THEN pages || ' pages' END, CASE WHEN held > 0 AND done > 0 THEN held || ' held back' END) END AS note FROM c"""


def s8_names(spark, sf_dir):
    """Pictures named by language and source; of those named by language alone, some already end in -2."""
    name = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("."), "source")).when(F.col("doc_id") % 7 == 0, F.concat("lang", F.lit("-2"))).otherwise(F.col("lang"))
    files = P.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(name, F.lit(".png")).alias("name"))
    return V.dedupe_names(files)


#: The name that ends in -2 and the second use of the plain one want the same name: the earlier has it.
S8_SQL = r"""WITH f AS (SELECT doc_id AS id, lang, CASE WHEN doc_id % 3 = 0 THEN 'own' WHEN doc_id % 7 = 0 THEN 'two' ELSE 'plain' END AS kind, CASE WHEN doc_id % 3 = 0 THEN lang || '.' || source WHEN doc_id % 7 = 0 THEN lang || '-2' ELSE lang END AS stem FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY id) AS n FROM f),
w AS (SELECT lang, min(id) FILTER (WHERE kind = 'plain' AND n = 2) AS second, min(id) FILTER (WHERE kind = 'two') AS two FROM o GROUP BY lang),
k AS (SELECT o.*, CASE WHEN kind = 'own' OR two IS NULL THEN n WHEN kind = 'plain' THEN CASE WHEN n >= 2 AND two < second THEN n + 1 ELSE n END ELSE CASE WHEN second < two THEN n + 1 ELSE n END END AS nr FROM o LEFT JOIN w USING (lang))
SELECT id, stem || '.png' AS name, CASE WHEN nr = 1 THEN stem || '.png' ELSE stem || '-' || nr || '.png' END AS out FROM k"""


def j11_carry(spark, sf_dir):
    """The same page read again: old decisions lie three pixels off, and what was added by hand or after the check stays."""
    _, old = _page(spark, sf_dir)
    new = old.select("image_id", "mask_id", "type", (F.col("x") + 3).alias("x"), "y", "w", "h", F.lit("auto").alias("src"))
    return V.carry_decisions(new, old).select("image_id", "mask_id", "x", "on", "user_off", "src")


J11_SQL = f"""WITH {MASKS}, {ACTIVE_SQL}, nw AS (SELECT image_id, mask_id, type, x + 3 AS x, y, w, h FROM act), hit AS (SELECT DISTINCT n.image_id, n.mask_id FROM nw n JOIN act o ON o.user_off AND o.src = 'auto' AND n.image_id = o.image_id AND n.type = o.type AND n.y = o.y AND abs(n.x - o.x) < 4 AND abs(n.w - o.w) < 6)
SELECT n.image_id, n.mask_id, x, hit.mask_id IS NULL AS "on", hit.mask_id IS NOT NULL AS user_off, 'auto' AS src FROM nw n LEFT JOIN hit USING (image_id, mask_id)
UNION ALL SELECT image_id, mask_id, x, "on", user_off, src FROM act WHERE src <> 'auto'"""


def _truth(spark, sf_dir):
    """Truth words with a kind from their type; masks cut short by a fifth in one of four; findings from the masks' own leaks."""
    words = M.typed(P.document_words(spark, sf_dir))
    kind = F.when(F.col("type") == T.NUMBER, "number").when(F.col("type") == T.EMAIL, "email").when(F.col("type") == T.IDENTIFIER, "id").when(F.col("type").isNotNull(), "name").when(F.col("text").rlike(r"\A[^\p{L}\p{N}]+\z"), "punctuation").otherwise("label")
    truth = words.withColumn("kind", kind).withColumn("sensitive", F.col("type").isNotNull()).withColumn("rotated", F.col("word_id") % 50 == 0)
    masks = M.build_masks(words)
    d = F.col("_d")
    masks = once(masks, _d=P.draw(F.col("image_id"), F.col("mask_id").cast("string"), "cut") % 8)
    cut = masks.filter(d != 0).withColumn("w", F.when(d == 1, F.col("w") * 0.75).otherwise(F.col("w"))).drop("_d")
    findings = masks.filter(d.isin(0, 2)).select("image_id", F.col("mask_id").alias("finding_id"), "x", "y", "w", "h")
    return truth, cut, findings


_CUT = P.draw_sql("image_id", "CAST(mask_id AS VARCHAR)", "'cut'") + " % 8"
TRUTH = f"""{MASKS}, truth AS (SELECT image_id, line_no, word_id, text, x, y, w, h, CASE type WHEN '{T.NUMBER}' THEN 'number' WHEN '{T.EMAIL}' THEN 'email' WHEN '{T.IDENTIFIER}' THEN 'id' ELSE CASE WHEN type IS NOT NULL THEN 'name' WHEN regexp_matches(text, '\\A[^\\p{{L}}\\p{{N}}]+\\z') THEN 'punctuation' ELSE 'label' END END AS kind,
 type IS NOT NULL AS sensitive, word_id % 50 = 0 AS rotated FROM typed), dm AS (SELECT *, {_CUT} AS d FROM masks), cm AS (SELECT image_id, x, y, CASE WHEN d = 1 THEN w * 0.75 ELSE w END AS w, h FROM dm WHERE d <> 0), ff AS (SELECT image_id, mask_id AS finding_id, x, y, w, h FROM dm WHERE d IN (0, 2))"""


def _cover_sql(boxes: str, name: str) -> str:
    near = f"b.x < t.x + t.w AND b.x + b.w > t.x AND b.y < t.y + t.h AND b.y + b.h > t.y"
    px, py = "(t.x + (k // 6 + 0.5) / 16 * t.w)", "(t.y + (k % 6 + 0.5) / 6 * t.h)"
    return f"""{P.cells_sql(name + 't', 'truth')}, {P.cells_sql(name + 'b', boxes)}, {name}p AS (SELECT DISTINCT t.image_id, t.word_id, t.x, t.y, t.w, t.h, b.x AS bx, b.y AS b_y, b.w AS bw, b.h AS bh, b.x <= t.x AND b.y <= t.y AND b.x + b.w >= t.x + t.w AND b.y + b.h >= t.y + t.h AS whole FROM {name}t t JOIN {name}b b ON {P.same_cell('t', 'b')} AND {near}),
{name} AS (SELECT image_id, word_id, max(c) AS c FROM (SELECT image_id, word_id, 1.0::DOUBLE AS c FROM {name}p WHERE whole
 UNION ALL SELECT image_id, word_id, count(DISTINCT k) / 96.0 AS c FROM {name}p t, unnest(range(96)) AS r(k) WHERE NOT whole AND {px} >= bx AND {px} <= bx + bw AND {py} >= b_y AND {py} <= b_y + bh GROUP BY 1, 2) GROUP BY 1, 2)"""


SCORED = f"{TRUTH}, {_cover_sql('cm', 'c1')}, al AS (SELECT * FROM cm UNION ALL SELECT image_id, x, y, w, h FROM ff), {_cover_sql('al', 'c2')}, sc AS (SELECT truth.*, coalesce(c1.c, 0) AS c1, coalesce(c2.c, 0) AS c2 FROM truth LEFT JOIN c1 USING (image_id, word_id) LEFT JOIN c2 USING (image_id, word_id) WHERE kind NOT IN ('unknown', 'punctuation'))"


def a6_coverage(spark, sf_dir):
    truth, masks, _ = _truth(spark, sf_dir)
    return S.coverage(truth, masks).select("image_id", "word_id", "covered")


A6_SQL = f"WITH {TRUTH}, {_cover_sql('cm', 'c1')} SELECT image_id, word_id, coalesce(c, 0)::DOUBLE AS covered FROM truth LEFT JOIN c1 USING (image_id, word_id)"


def a7_score(spark, sf_dir):
    return S.masking_score(*_truth(spark, sf_dir)).withColumn("leaked_area", F.round("leaked_area", 6))


A7_SQL = f"""WITH {SCORED} SELECT image_id, kind, count(*) FILTER (WHERE sensitive) AS sensitive, count(*) FILTER (WHERE sensitive AND c1 < 0.85) AS first_exposed, count(*) FILTER (WHERE sensitive AND c2 < 0.85) AS exposed,
 count(*) FILTER (WHERE sensitive AND rotated AND c2 < 0.85) AS rotated_exposed, count(*) FILTER (WHERE NOT sensitive) AS safe, count(*) FILTER (WHERE NOT sensitive AND c1 > 0.5) AS over_masked,
 round(coalesce(sum(w * h * (1 - c2)) FILTER (WHERE sensitive AND NOT rotated), 0) / greatest(coalesce(sum(w * h) FILTER (WHERE sensitive AND NOT rotated), 0), 1e-9), 6) AS leaked_area
FROM sc GROUP BY GROUPING SETS ((image_id, kind), (image_id), (kind), ())"""


def a8_alarms(spark, sf_dir):
    truth, masks, findings = _truth(spark, sf_dir)
    exposed = S.coverage(truth.filter("sensitive"), masks).filter("covered < 0.85")
    return S.false_alarms(findings, exposed).groupBy("image_id").agg(F.count("*").alias("n"))


A8_SQL = f"""WITH {TRUTH}, {_cover_sql('cm', 'c1')}, ex AS (SELECT truth.* FROM truth LEFT JOIN c1 USING (image_id, word_id) WHERE sensitive AND coalesce(c, 0) < 0.85),
{P.cells_sql('fc', 'ff')}, {P.cells_sql('ec', 'ex')}, hit AS (SELECT DISTINCT f.image_id, f.finding_id FROM fc f JOIN ec ON {P.same_cell('f', 'ec')} AND {P.overlap_sql('f', 'ec')} > 0.3)
SELECT image_id, count(*) AS n FROM ff ANTI JOIN hit USING (image_id, finding_id) GROUP BY 1"""


def a9_wilson(spark, sf_dir):
    """Toxic share per source of labelled documents."""
    both = P.read(spark, sf_dir, "documents").join(P.read(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    return both.withColumn("v", S.wilson(F.col("k"), F.col("n"))).select("source", "k", "n", "v.pct", "v.lo", "v.hi")


A9_SQL = """WITH t AS (SELECT source, sum(toxic)::BIGINT AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), u AS (SELECT *, k / n::DOUBLE AS p, 1 + 3.8416 / n AS d FROM t),
v AS (SELECT *, (p + 3.8416 / (2 * n)) / d AS c, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / d AS h FROM u)
SELECT source, k, n, floor(p * 10000 + 0.5) / 100 AS pct, floor(greatest(0, c - h) * 10000 + 0.5) / 100 AS lo, floor(least(1, c + h) * 10000 + 0.5) / 100 AS hi FROM v"""


def a10_gate(spark, sf_dir):
    """The score's five overall figures against those of the documents with an even number."""
    truth, masks, findings = _truth(spark, sf_dir)
    truth = truth.select("image_id", "word_id", "kind", "sensitive", "rotated", "x", "y", "w", "h")
    score = S.masking_score(truth, masks, findings).filter("image_id is not null and kind is null")
    exposed = S.coverage(truth.filter("sensitive"), masks).filter("covered < 0.85")
    false = S.false_alarms(findings, exposed).groupBy("image_id").agg(F.count("*").alias("false"))
    alarms = findings.groupBy("image_id").agg(F.count("*").alias("findings")).join(false, "image_id", "left")
    area = truth.filter("sensitive and not rotated").groupBy("image_id").agg(F.sum(F.col("w") * F.col("h")).alias("area"))
    images = score.join(alarms, "image_id", "left").join(area, "image_id", "left").withColumn("leaked", F.col("leaked_area") * F.col("area"))
    images = written(images, "images")  # one row an image, read for both sides

    def figures(rows):
        pct = lambda k, n: S.two_decimals(F.coalesce(F.col(k), F.lit(0)) / F.col(n))
        one = rows.agg(*(F.sum(c).alias(c) for c in ("sensitive", "first_exposed", "exposed", "safe", "over_masked", "false", "findings", "leaked", "area")))
        values = {"residualExposed.pct": pct("exposed", "sensitive"), "residualLeakedAreaPct": pct("leaked", "area"), "firstPassExposed.pct": pct("first_exposed", "sensitive"), "overMasked.pct": pct("over_masked", "safe"), "falseAlarms.pct": pct("false", "findings")}
        return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("figure"), v.alias("value")) for n, v in values.items()))).alias("s")).select("s.figure", "s.value")

    return S.bench_gate(figures(images), figures(images.filter("cast(image_id as long) % 2 = 0")))


_FIG = " UNION ALL ".join(f"SELECT '{n}' AS figure, floor(coalesce(sum({k}), 0) / sum({m}) * 10000 + 0.5) / 100 AS value FROM {{0}}" for n, k, m in (("residualExposed.pct", "e", "s"), ("residualLeakedAreaPct", "lk", "ar"), ("firstPassExposed.pct", "f", "s"), ("overMasked.pct", "o", "n"), ("falseAlarms.pct", "fa", "fn")))
A10_SQL = f"""WITH {SCORED}, ex AS (SELECT * FROM sc WHERE sensitive AND c1 < 0.85), {P.cells_sql('fc', 'ff')}, {P.cells_sql('ec', 'ex')}, hit AS (SELECT DISTINCT f.image_id, f.finding_id FROM fc f JOIN ec ON {P.same_cell('f', 'ec')} AND {P.overlap_sql('f', 'ec')} > 0.3),
al2 AS (SELECT ff.image_id, count(*) AS fn, count(*) - count(hit.finding_id) AS fa FROM ff LEFT JOIN hit USING (image_id, finding_id) GROUP BY 1),
im AS (SELECT image_id, count(*) FILTER (WHERE sensitive) AS s, count(*) FILTER (WHERE sensitive AND c1 < 0.85) AS f, count(*) FILTER (WHERE sensitive AND c2 < 0.85) AS e, count(*) FILTER (WHERE NOT sensitive) AS n, count(*) FILTER (WHERE NOT sensitive AND c1 > 0.5) AS o,
 sum(w * h * (1 - c2)) FILTER (WHERE sensitive AND NOT rotated) AS lk, sum(w * h) FILTER (WHERE sensitive AND NOT rotated) AS ar FROM sc GROUP BY 1),
im2 AS (SELECT im.*, fn, fa FROM im LEFT JOIN al2 USING (image_id)), ev AS (SELECT * FROM im2 WHERE CAST(image_id AS BIGINT) % 2 = 0), a AS ({_FIG.format('im2')}), b AS ({_FIG.format('ev')}),
t(figure, tolerance) AS (VALUES {", ".join(f"('{n}', {v})" for n, v in S.GATE_RULES)})
SELECT figure, a.value, b.value AS base, CASE WHEN a.value > b.value + tolerance THEN '✗' WHEN a.value < b.value THEN '↑' ELSE '✓' END AS state FROM a JOIN b USING (figure) JOIN t USING (figure)"""


def a11_timing(spark, sf_dir):
    """Upper median of a value per kind of event."""
    return M.large_upper_median(P.read(spark, sf_dir, "events"), "value", "event_type")


A11_SQL = "SELECT event_type, list_sort(list(value))[(count(*) // 2 + 1)::BIGINT] AS median FROM events GROUP BY 1"


def a12_replica(spark, sf_dir):
    truth, masks, _ = _truth(spark, sf_dir)
    k = F.col("mask_id")
    replaced = masks.select("image_id", "x", "y", "w", "h", F.when(k % 5 != 0, F.col("text")).otherwise("").alias("original"), F.when(k % 9 == 0, F.col("text")).when(k % 5 == 0, "").otherwise("x").alias("synthetic"), (k % 10 == 0).alias("keep"), (k % 20 == 0).alias("same"))
    return S.replica_score(replaced, truth)


A12_SQL = f"""WITH {TRUTH}, cm2 AS (SELECT image_id, x, y, CASE WHEN d = 1 THEN w * 0.75 ELSE w END AS w, h, mask_id % 10 <> 0 OR mask_id % 20 = 0 AS covers, mask_id % 20 = 0 OR (mask_id % 9 = 0 AND mask_id % 5 <> 0) AS same FROM dm WHERE d <> 0),
held AS (SELECT DISTINCT truth.image_id, truth.word_id FROM truth JOIN cm2 b ON sensitive AND covers AND truth.image_id = b.image_id AND truth.y = b.y AND truth.x + truth.w / 2 > b.x AND truth.x + truth.w / 2 < b.x + b.w),
wd AS (SELECT truth.image_id, count(*) AS words, count(*) - count(held.word_id) AS exposed FROM truth LEFT JOIN held USING (image_id, word_id) WHERE sensitive GROUP BY 1),
bx AS (SELECT image_id, count(*) AS boxes, count(*) FILTER (WHERE same) AS unchanged FROM cm2 GROUP BY 1), j AS (SELECT coalesce(wd.image_id, bx.image_id) AS image_id, coalesce(words, 0) AS words, coalesce(exposed, 0) AS exposed, coalesce(boxes, 0) AS boxes, coalesce(unchanged, 0) AS unchanged FROM wd FULL JOIN bx USING (image_id))
SELECT image_id, sum(words)::BIGINT AS words, sum(exposed)::BIGINT AS exposed, sum(boxes)::BIGINT AS boxes, sum(unchanged)::BIGINT AS unchanged, floor(1000 * sum(exposed) / greatest(sum(words), 1) + 0.5) / 10 AS exposed_pct FROM j GROUP BY GROUPING SETS ((image_id), ())"""

QUERIES = {
    "j12_candidates": j12_candidates, "j12_verify": j12_verify, "j13_rereads_safe": j13_rereads, "a3_gate": a3_gate, "a4_hide_uncertain": a4_hide, "a5_receipts": a5_receipts, "w2_rank_findings": w2_rank, "w3_top_k": w3_top,
    "s7_release": s7_release, "s8_names": s8_names, "j11_carry_decisions": j11_carry, "a6_coverage": a6_coverage, "a7_masking_score": a7_score, "a8_false_alarms": a8_alarms, "a9_wilson": a9_wilson,
    "a10_bench_gate": a10_gate, "a11_timing": a11_timing, "a12_replica_score": a12_replica,
}
SQL = {
    "j12_candidates": f"WITH {CHECK} SELECT image_id, word_id, text, type, severity, likely_mark, aside FROM cand", "j12_verify": VERIFY_SQL, "j13_rereads_safe": f"WITH {MASKS}, {ACTIVE_SQL}, {REREAD_SQL}, {SAFE_SQL} SELECT image_id, word_id FROM safe_again",
    "a3_gate": A3_SQL, "a4_hide_uncertain": A4_SQL, "a5_receipts": A5_SQL, "w2_rank_findings": W2_SQL, "w3_top_k": W3_SQL, "s7_release": S7_SQL, "s8_names": S8_SQL, "j11_carry_decisions": J11_SQL, "a6_coverage": A6_SQL, "a7_masking_score": A7_SQL,
    "a8_false_alarms": A8_SQL, "a9_wilson": A9_SQL, "a10_bench_gate": A10_SQL, "a11_timing": A11_SQL, "a12_replica_score": A12_SQL,
}
