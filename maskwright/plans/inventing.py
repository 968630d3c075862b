"""Registered queries: made-up names, ids and scales, what stands around boxes, second readings, comments, pixels, layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import fakes as K
from maskwright.functions.columns import once
from maskwright.functions.numbers import fake_ticks
from maskwright.functions.text import TEXT
from maskwright.operators import charts as D
from maskwright.operators import comments as Q
from maskwright.operators import context as C
from maskwright.operators import masks as M
from maskwright.operators import pages as V
from maskwright.operators import pixels as I
from maskwright.operators import replace as X
from maskwright.operators import scales as Z
from maskwright.plans import base as P
from maskwright.plans.masking import ACTIVE_SQL, MASKS, W, _active
from maskwright.plans.store import shared_path, written
from maskwright.sources.json_files import read_review, read_truth, review_parts, truth_words


def _key(c: str) -> Column:
    return F.col(c).cast("string").alias("image_id")


def t11_ticks(spark, sf_dir):
    """Joined ticks for every order: from 0 or not, with a decimal or not, three to six of them."""
    o = P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    at = F.when(F.col("k") % 3 == 0, 0).otherwise((F.col("k") % 9 + 1) * 100)
    text = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("k") % 4 + 2), lambda i: (at + i * (F.col("k") % 7 + 1) * 50).cast("string"))
    shown = F.transform(text, lambda t: F.when(F.col("k") % 2 == 0, t).otherwise(F.concat(t, F.lit(".0"))))
    return o.select("k", F.array_join(shown, " ").alias("text")).withColumn("fake", fake_ticks(F.col("text"), 3))


def _tick_unit(what: str) -> str:
    return f"{P.draw_sql('text', chr(39) + '3' + chr(39), chr(39) + what + chr(39) + ' || i')} / 4294967296.0::DOUBLE"


_TWO = "(CASE WHEN {0} = 0 THEN 0 ELSE floor({0} / pow(10.0, floor(log10(abs({0}))) - 1) + 0.5) * pow(10.0, floor(log10(abs({0}))) - 1) END)"
T11_SQL = f"""WITH o AS (SELECT o_orderkey AS k, CASE WHEN k % 3 = 0 THEN 0 ELSE (k % 9 + 1) * 100 END AS a, (k % 7 + 1) * 50 AS st, k % 4 + 3 AS n, k % 2 AS dec FROM orders),
t AS (SELECT *, array_to_string(list_transform(range(n), lambda j: (a + j * st)::VARCHAR || CASE WHEN dec = 1 THEN '.0' ELSE '' END), ' ') AS text FROM o),
d AS (SELECT t.*, i, CASE WHEN {_tick_unit('tick f')} < 0.5 THEN 0.55 + {_tick_unit('tick r')} * 0.3 ELSE 1.18 + {_tick_unit('tick r')} * 0.62 END AS f FROM t, range(40) AS r(i)),
e AS (SELECT *, CASE WHEN a = 0 THEN 0 ELSE floor({_TWO.format('(a * f)')} * pow(10, dec) + 0.5) END::BIGINT AS b, floor({_TWO.format('(st * f)')} * pow(10, dec) + 0.5)::BIGINT AS s FROM d),
g AS (SELECT *, array_to_string(list_transform(range(n), lambda j: CASE WHEN dec = 0 THEN (b + j * s)::VARCHAR ELSE ((b + j * s) // 10)::VARCHAR || '.' || ((b + j * s) % 10)::VARCHAR END), ' ') AS fake FROM e),
h AS (SELECT k, arg_min(fake, i) AS fake FROM g WHERE fake <> text AND abs(length(fake) - length(text)) <= greatest(2, length(text) * 0.08) AND s <> 0 GROUP BY k)
SELECT t.k, t.text, h.fake FROM t LEFT JOIN h USING (k)"""

ROLES = ("person", "company", "city", "country", "state", "product", "email", "phone", "id")


def t13_entities(spark, sf_dir):
    """One made-up value of every role for each customer; two of the names count as brands."""
    c = P.read(spark, sf_dir, "customer")
    made = F.array(*(F.struct(F.lit(r).alias("role"), K.fake_entity(r, F.col("c_name"), 7, "en", "finance", ("hale", "alma", "bank")).alias("fake")) for r in ROLES))
    return c.select("c_custkey", F.explode(made).alias("m")).select("c_custkey", "m.role", "m.fake")


def _entity_sql(role: str, key: str, seed: int, i: str, industry: str = "general") -> str:
    """One draw of a role as SQL; ``i`` is the number of the draw."""
    at = lambda part: P.draw_sql(key, f"'{seed}'", f"'{role}:en:{part}:' || {i}")
    pick = lambda values, part: f"({P.list_sql(values)})[1 + {at(part)} % {len(values)}]"
    given, family = pick(K.GIVEN, "given"), pick(K.FAMILY, "family")
    return {
        "person": f"{given} || ' ' || {family}", "company": f"{family} || ' ' || {pick(K.ORGANISATIONS[industry], 'kind')}", "product": f"{pick(K.PRODUCTS, 'product')} || ' ' || ({at('model')} % 9 + 1)::VARCHAR",
        "email": f"lower({given}) || '.' || lower({family}) || '@' || {pick(K.DOMAINS, 'host')}", "phone": f"'(' || ({at('area')} % 800 + 200)::VARCHAR || ') 555-01' || lpad(({at('line')} % 100)::VARCHAR, 2, '0')",
        "id": f"'ID-' || lpad(({at('number')} % 1000000)::VARCHAR, 6, '0')", "city": pick(K.TOWNS, "city"), "country": pick(K.COUNTRIES, "country"), "state": pick(K.STATES, "state"),
    }[role]


T13_SQL = "WITH " + ", ".join(f"d_{r} AS (SELECT c_custkey, i, {_entity_sql(r, 'c_name', 7, 'i', 'finance')} AS v FROM customer, range(7) AS t(i))" for r in ROLES) + " " + " UNION ALL ".join(
    f"SELECT c_custkey, '{r}' AS role, coalesce(arg_min(v, i) FILTER (WHERE NOT list_has_any(regexp_split_to_array(lower(v), '[^a-z0-9]+'), ['hale', 'alma', 'bank'])), 'Example') AS fake FROM d_{r} GROUP BY c_custkey" for r in ROLES
)


def t14_fitted(spark, sf_dir):
    """Companies about as long as made-up originals of many lengths."""
    c = P.read(spark, sf_dir, "customer").withColumn("original", F.substring(F.concat_ws(" ", K.fake_entity("company", F.col("c_name"), 1), K.fake_entity("city", F.col("c_name"), 1)), F.lit(1), (F.col("c_custkey") % 23 + 3).cast("int")))
    return c.select("c_custkey", "original", K.fitted("company", F.col("original"), F.col("c_name"), 9).alias("fake"))


_LONG = "list_filter(regexp_split_to_array(lower({0}), '[^a-z]+'), lambda w: length(w) >= 3)"
T14_SQL = f"""WITH o AS (SELECT c_custkey, c_name, substr({_entity_sql('company', 'c_name', 1, '0')} || ' ' || {_entity_sql('city', 'c_name', 1, '0')}, 1, (c_custkey % 23 + 3)::INT) AS original FROM customer),
k AS (SELECT *, CASE WHEN n = 0 THEN c_name ELSE c_name || '#' || n END AS key FROM o, range(16) AS t(n)),
d AS (SELECT *, {_entity_sql('company', 'key', 9, '0')} AS v, length(original) AS l FROM k),
f AS (SELECT *, CASE WHEN length(v) > l THEN 2 * (length(v) - l) ELSE l - length(v) END AS cost FROM d WHERE lower(v) <> lower(original) AND NOT list_has_any({_LONG.format('v')}, {_LONG.format('original')})),
b AS (SELECT c_custkey, original, l, coalesce(arg_min(v, n) FILTER (WHERE cost <= greatest(1, l * 0.1)), arg_min(v, cost * 100 + n)) AS best FROM f GROUP BY ALL)
SELECT o.c_custkey, o.original, CASE WHEN length(best) <= l * 1.15 + 1 THEN best WHEN length(split_part(best, ' ', 1) || CASE WHEN len(string_split(best, ' ')) > 2 THEN ' ' || split_part(best, ' ', 2) ELSE '' END) <= l * 1.15 + 1 THEN split_part(best, ' ', 1) || CASE WHEN len(string_split(best, ' ')) > 2 THEN ' ' || split_part(best, ' ', 2) ELSE '' END
 WHEN length(split_part(best, ' ', 1)) <= l * 1.15 + 1 THEN split_part(best, ' ', 1) END AS fake FROM o LEFT JOIN b USING (c_custkey)"""


def t15_ids(spark, sf_dir):
    """Ids of the lines of every order, with prefixes that three lines share or not."""
    text = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "INV-").otherwise("EMP"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"))
    items = P.read(spark, sf_dir, "lineitem").select(_key("l_orderkey"), F.xxhash64("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("mask_id"), text.alias("text"))
    made = C.fake_ids(items, 4).join(items, ["image_id", "mask_id"])
    same = lambda p: F.regexp_extract("made", K.ID_SHAPE, p) == F.regexp_extract("text", K.ID_SHAPE, p)
    kept = same(1) & same(2) & (F.length("made") == F.length("text")) & (F.col("made") != F.col("text"))
    return made.groupBy("image_id", F.substring("text", 1, 3).alias("prefix")).agg(F.count("*").alias("n"), F.count("made").alias("made"), F.count(F.when(kept, 1)).alias("kept"))


T15_SQL = "SELECT CAST(l_orderkey AS VARCHAR) AS image_id, CASE WHEN l_suppkey % 2 = 0 THEN 'INV' ELSE 'EMP' END AS prefix, count(*) AS n, CASE WHEN count(*) >= 3 THEN count(*) ELSE 0 END AS made, CASE WHEN count(*) >= 3 THEN count(*) ELSE 0 END AS kept FROM lineitem GROUP BY 1, 2"


def t15_titles(spark, sf_dir):
    """Titles, suffixes and plain names before customers' names."""
    texts = ("Mr", "Mrs.", "ms", "Miss", "Dr.", "Prof", "Jr.", "SR", "II", "III", "IV", "MD", "PhD", "DDS", "DVM.", "Alma")
    c = P.read(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*map(F.lit, texts)), (F.col("c_custkey") % len(texts)).cast("int")).alias("text"))
    return c.withColumn("fake", K.fake_title(F.col("text"), 2))


_TITLE_TEXTS = ("Mr", "Mrs.", "ms", "Miss", "Dr.", "Prof", "Jr.", "SR", "II", "III", "IV", "MD", "PhD", "DDS", "DVM.", "Alma")
T15_TITLES_SQL = f"""WITH c AS (SELECT c_custkey, ({P.list_sql(_TITLE_TEXTS)})[(1 + c_custkey % {len(_TITLE_TEXTS)})::INT] AS text FROM customer), b AS (SELECT *, regexp_replace(text, '\\.$', '') AS bare FROM c),
s AS (SELECT *, CASE WHEN list_contains({P.list_sql(n.lower() for n in K.HONORIFICS)}, lower(bare)) THEN {P.list_sql(K.HONORIFICS)} WHEN list_contains({P.list_sql(n.lower() for n in K.SUFFIXES)}, lower(bare)) THEN {P.list_sql(K.SUFFIXES)} END AS names FROM b),
o AS (SELECT *, list_filter(names, lambda n: lower(n) <> lower(bare) AND abs(length(n) - length(bare)) <= 1) AS others FROM s)
SELECT c_custkey, text, others[1 + {P.draw_sql('lower(bare)', "'2'", "'title'")} % greatest(len(others), 1)] || CASE WHEN text LIKE '%.' THEN '.' ELSE '' END AS fake FROM o"""


def j8_second_look(spark, sf_dir):
    """Every line read twice more, with confidences of its own; regions of one short word are as small as one character."""
    words = P.document_words(spark, sf_dir).withColumn("region_id", (F.col("y") / 30).cast("long"))
    conf = lambda r: (P.draw(F.col("image_id"), F.col("region_id").cast("string"), f"look{r}") % 60 + 40).cast("double")
    lines = words.groupBy("image_id", "region_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "word_id", "text"))), lambda s: s["text"]).alias("texts"))
    regions = lines.select("image_id", "region_id", F.lit(False).alias("slanted"), ((F.size("texts") == 1) & (F.length(F.get("texts", F.lit(0))) <= 2)).alias("glyph"))
    nr = lines.withColumn("nr", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("c", F.when(F.col("nr") == 1, conf(1)).otherwise(conf(2)))
    short = F.when(F.col("nr") == 1, F.col("texts")).otherwise(F.slice("texts", 1, 2))  # the second reading sees two words
    readings = nr.select("image_id", "region_id", "nr", F.transform(short, lambda t: F.struct(t.alias("text"), F.col("c").alias("conf"))).alias("words"))
    return C.second_look(regions, readings).select("image_id", "region_id", "conf", "reading", "read", "weak", "safe")


_LOOK = lambda r: f"({P.draw_sql('image_id', 'CAST(line_no AS VARCHAR)', chr(39) + f'look{r}' + chr(39))} % 60 + 40)::DOUBLE"
J8_SQL = f"""WITH {W}, {P.typed_sql()}, ln8 AS (SELECT image_id, line_no, list(text ORDER BY x, word_id) AS texts, list(type IS NULL ORDER BY x, word_id) AS fine FROM typed GROUP BY 1, 2),
c8 AS (SELECT *, {_LOOK(1)} AS c1, {_LOOK(2)} AS c2, len(texts) = 1 AND length(texts[1]) <= 2 AS glyph FROM ln8),
b8 AS (SELECT *, c1 >= 70 OR (c2 < 70 AND c1 >= c2) AS one FROM c8),
r8 AS (SELECT *, CASE WHEN one THEN c1 ELSE c2 END AS conf, CASE WHEN one THEN texts ELSE texts[1:2] END AS tx, CASE WHEN one THEN fine ELSE fine[1:2] END AS fn FROM b8),
q8 AS (SELECT *, regexp_replace(array_to_string(tx, ' '), '\\A[^\\p{{L}}\\p{{N}}(]+|[^\\p{{L}}\\p{{N}}.)%]+\\z', '', 'g') AS reading FROM r8),
v8 AS (SELECT *, conf >= 70 AND NOT glyph AND length(regexp_replace(reading, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 2 AS whole FROM q8),
w8 AS (SELECT *, NOT whole AND conf >= 85 AND regexp_matches(reading, '\\A[0-9]{{1,2}}\\z') AS weak, regexp_replace(reading, '\\s', '', 'g') AS dense FROM v8)
SELECT image_id, line_no::BIGINT AS region_id, conf, reading, CASE WHEN whole OR weak THEN reading END AS read, weak,
 (conf >= 70 AND len(list_filter(tx, lambda t: regexp_matches(t, '\\p{{L}}'))) > 0 AND list_bool_and(fn)) OR (glyph AND len(list_filter(texts, lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))) = 0)
 OR (conf >= 70 AND NOT regexp_matches(reading, '[0-9]') AND length(dense) >= 3 AND dense = repeat(dense[1], length(dense))) AS safe FROM w8"""


def _around(spark, sf_dir):
    words = M.typed(P.document_words(spark, sf_dir))
    return M.build_masks(words), words.filter("type is null")


def j10_context(spark, sf_dir):
    return C.context_for(*_around(spark, sf_dir))


J10_SQL = f"""WITH {MASKS}, vis AS (SELECT *, floor(y / 8 + 0.5) AS band FROM typed WHERE type IS NULL),
{P.cells_sql('mc', 'masks', '96')}, {P.cells_sql('vc', 'vis')},
nr10 AS (SELECT DISTINCT m.image_id, m.mask_id, v.word_id, v.text, v.band, v.x, greatest(0, m.x - (v.x + v.w), v.x - (m.x + m.w)) AS far FROM mc m JOIN vc v ON {P.same_cell('m', 'v')} AND v.x + v.w > m.x - 96 AND v.x < m.x + m.w + 96
 UNION ALL SELECT DISTINCT m.image_id, m.mask_id, v.word_id, v.text, v.band, v.x, 54 + 0.5 * greatest(0, m.x - (v.x + v.w), v.x - (m.x + m.w)) FROM mc m JOIN vc v ON m.image_id = v.image_id AND m.cell = v.cell AND v.ln = m.ln - 1 AND v.x + v.w > m.x - 48 AND v.x < m.x + m.w + 48),
tp AS (SELECT * FROM nr10 QUALIFY row_number() OVER (PARTITION BY image_id, mask_id ORDER BY far, word_id) <= 6),
cx AS (SELECT image_id, mask_id, substr(string_agg(text, ' ' ORDER BY band, x, word_id), 1, 120) AS context FROM tp GROUP BY 1, 2)
SELECT m.image_id, m.mask_id, coalesce(context, '') AS context FROM masks m LEFT JOIN cx USING (image_id, mask_id)"""


def j10_labels(spark, sf_dir):
    return C.label_for(*_around(spark, sf_dir))


def j15_redraw(spark, sf_dir):
    """Half of the words made up from six words, the others readable words of the same six; each beside the next."""
    w = P.document_words(spark, sf_dir)
    pool = lambda what: F.get(F.array(*map(F.lit, POOL6)), (P.draw(F.col("image_id"), F.col("word_id").cast("string"), what) % 6).cast("int"))
    w = once(w, _made=P.draw(F.col("image_id"), F.col("word_id").cast("string"), "made") % 2 == 0)
    made = F.col("_made")
    values = w.filter(made).select("image_id", F.col("word_id").alias("mask_id"), F.lit("text").alias("kind"), F.array(pool("p0"), pool("p1"), pool("p2")).alias("draws"), "x", "y", "w", "h")
    return C.redraw_clashes(values, w.filter(~made).withColumn("text", pool("p0")))


POOL6 = ("river", "stone", "cloud bridge", "meadow", "up", "stone field")
_P6 = lambda what: f"({P.list_sql(POOL6)})[1 + {P.draw_sql('image_id', 'CAST(word_id AS VARCHAR)', chr(39) + what + chr(39))} % 6]"
_WORDS3 = lambda c: f"list_filter(string_split(coalesce({c}, ''), ' '), lambda v: length(v) >= 3)"
J15_SQL = f"""WITH {W}, a15 AS (SELECT *, {P.draw_sql('image_id', 'CAST(word_id AS VARCHAR)', chr(39) + 'made' + chr(39))} % 2 = 0 AS mk, {_P6('p0')} AS p0, {_P6('p1')} AS p1, {_P6('p2')} AS p2 FROM words),
b15 AS (SELECT *, lag(p0) OVER q AS lp, lag(mk) OVER q AS lm, x - lag(x + w) OVER q < 18 AS ln, lead(p0) OVER q AS np, lead(mk) OVER q AS nm, lead(x) OVER q - (x + w) < 18 AS nn FROM a15 WINDOW q AS (PARTITION BY image_id, line_no ORDER BY x)),
c15 AS (SELECT *, list_concat({_WORDS3('CASE WHEN NOT lm AND ln THEN lp END')}, {_WORDS3('CASE WHEN NOT nm AND nn THEN np END')}) AS seen FROM b15),
d15 AS (SELECT *, CASE WHEN mk THEN coalesce(list_filter([p0, p1, p2], lambda t: NOT list_has_any({_WORDS3('t')}, seen))[1], p0) END AS once FROM c15),
e15 AS (SELECT *, list_concat(seen, {_WORDS3('CASE WHEN lm AND ln THEN lo END')}) AS taboo FROM (SELECT *, lag(once) OVER (PARTITION BY image_id, line_no ORDER BY x) AS lo FROM d15))
SELECT image_id, word_id AS mask_id, coalesce(list_filter([p0, p1, p2], lambda t: NOT list_has_any({_WORDS3('t')}, taboo))[1], p0) AS made FROM e15 WHERE mk"""


def j16_days(spark, sf_dir):
    """A number after and before a word on one line of every order, at gaps of many sizes; some of the words are months."""
    k = F.col("o_orderkey")
    o = P.read(spark, sf_dir, "orders").select(_key("o_orderkey"), k.alias("k"))
    name = F.get(F.array(*map(F.lit, ("Oct", "october.", "mar,", "ma", "Total", "June"))), (F.col("k") % 6).cast("int"))
    visible = o.select("image_id", F.lit(1).cast("long").alias("word_id"), name.alias("text"), F.lit(100.0).alias("x"), F.lit(10.0).alias("y"), F.lit(40.0).alias("w"), F.lit(12.0).alias("h"))
    gap = (F.col("k") % 31 - 4).cast("double")
    box = lambda i, x: F.struct(F.lit(i).cast("long").alias("mask_id"), x.alias("x"), F.when(F.col("k") % 5 == 0, 18.0).otherwise(10.0).alias("y"))
    tokens = o.select("image_id", F.explode(F.array(box(1, 140 + gap), box(2, 100 - gap - 14), box(3, 400 + gap))).alias("t")).select("image_id", "t.*", F.lit(14.0).alias("w"), F.lit(12.0).alias("h"))
    return C.after_month(tokens, visible)


J16_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS image_id, m AS mask_id FROM orders, (VALUES (1::BIGINT), (2::BIGINT)) AS t(m) WHERE o_orderkey % 6 IN (0, 1, 2, 5) AND o_orderkey % 5 <> 0 AND o_orderkey % 31 - 4 >= -2 AND o_orderkey % 31 - 4 < 14.4"


def g7_axes(spark, sf_dir):
    """Scales drawn for customers: upwards in a column, from 0 or not, with a tick missing or one that breaks the row."""
    o = P.read(spark, sf_dir, "customer").select(_key("c_custkey"), F.col("c_custkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    value = F.when((F.col("k") % 5 == 1) & (F.col("i") == 5), F.col("i") * F.col("i") * 1000 + 7).otherwise((F.col("i") + F.col("k") % 2) * (F.col("k") % 7 + 1) * 100)
    return Z.axis_scales(o.filter("not (k % 3 = 0 and i = 2)").select("image_id", F.col("i").cast("long").alias("mask_id"), value.cast("string").alias("text"), F.lit(10.0).alias("x"), (300 - F.col("i") * 40.0).alias("y"), F.lit(28.0).alias("w"), F.lit(12.0).alias("h")), 3)


def g8_totals(spark, sf_dir):
    """Quantities of every order in a row with their sum, or half as much again, and their shares in the row below."""
    items = P.read(spark, sf_dir, "lineitem").select(_key("l_orderkey"), F.col("l_quantity").cast("long").alias("q"), F.struct("l_linenumber", "l_quantity", "l_partkey", "l_extendedprice").alias("o"))
    lines = items.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "q"))), lambda s: s["q"]).alias("q"), F.sum("q").alias("s"))
    total = F.when(F.col("image_id").cast("long") % 2 == 0, F.col("s")).otherwise(F.floor(F.col("s") * 1.5) + 1)
    n = F.size("q")
    part = lambda i, text, y: F.struct(i.cast("long").alias("mask_id"), text.alias("text"), y.alias("y"))
    rows = F.concat(
        F.transform("q", lambda q, i: part(i, F.concat(q.cast("string"), F.lit(" pcs")), F.lit(0.0))), F.array(part(n, total.cast("string"), F.lit(2.0))),
        F.transform("q", lambda q, i: part(100 + i, F.concat(F.lit("≈ "), F.floor(q * 100 / F.col("s")).cast("string"), F.lit("%")), F.lit(40.0))),
    )
    masks = lines.select("image_id", F.explode(rows).alias("m")).select("image_id", "m.*", (F.col("m.mask_id") % 100 * 50.0).alias("x"), F.lit(30.0).alias("w"), F.lit(12.0).alias("h"))
    return Z.total_links(masks, made=(F.regexp_extract("text", "([0-9]+)", 1).cast("long") * 2).cast("string"))


G8_SQL = """WITH i8 AS (SELECT CAST(l_orderkey AS VARCHAR) AS image_id, l_orderkey AS k, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey, l_extendedprice) - 1 AS i FROM lineitem),
s8 AS (SELECT image_id, k, sum(q)::BIGINT AS s, count(*) AS n, max(q) AS mx FROM i8 GROUP BY 1, 2), t8 AS (SELECT *, CASE WHEN k % 2 = 0 THEN s ELSE floor(s * 1.5)::BIGINT + 1 END AS total FROM s8),
p8 AS (SELECT i8.*, floor(q * 100 / s)::BIGINT AS pc, n FROM i8 JOIN s8 USING (image_id)), u8 AS (SELECT *, sum(pc) OVER (PARTITION BY image_id) AS ps FROM p8),
w8 AS (SELECT *, floor(pc / ps * 100 + 0.5)::BIGINT AS sh FROM u8 WHERE n >= 2 AND ps BETWEEN 85 AND 115), x8 AS (SELECT *, coalesce(sum(sh) OVER (PARTITION BY image_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM w8)
SELECT image_id, (100 + i)::BIGINT AS mask_id, '≈ ' || (CASE WHEN i = n - 1 THEN greatest(1, 100 - bef) ELSE sh END)::BIGINT::VARCHAR || '%' AS text FROM x8
UNION ALL SELECT image_id, n::BIGINT, (s * 2)::BIGINT::VARCHAR FROM t8 WHERE n >= 2 AND abs(total - s) <= 0.06 * s"""


def _tight(words):
    return words.withColumn("y", F.col("y") * 0.8)


def g9_comments(spark, sf_dir):
    """Lines of all documents, set close enough to go on from one another."""
    return Q.comment_types(Q.find_comments(_tight(P.document_words(spark, sf_dir)))).select("image_id", "word_id", "in_comment", "cm_start", "type")


_E = P._q(Q.ENDS)
_OQ = P._q(Q.OPEN_QUOTE)
_LOWS = f"replace(lower({P.core_sql('text')}), '’', '''')"
_KNOWN = lambda c: f"list_contains({P.list_sql(sorted({*P.T.NEUTRAL, *Q.STARTERS}))}, {c})"
COMMENTS_SQL = f"""{P.typed_sql()},
k9 AS (SELECT *, {P.core_sql('text')} AS core FROM typed),
l9 AS (SELECT image_id, line_no, arg_min(text, x) AS f, arg_max(text, x) AS l, count(*) FILTER (WHERE core <> '') AS n, count(*) FILTER (WHERE regexp_matches(core, {P._q(Q.LOWER)})) AS lo, bool_or(regexp_matches(text, '[.,!?;]')) AS mk FROM k9 GROUP BY 1, 2),
o9 AS (SELECT *, regexp_matches(f, {_OQ}) AND n >= 3 AS quoted, NOT regexp_matches(l, {P._q(Q.CLOSE_QUOTE)}) AS op FROM l9 WHERE n > 0),
m9 AS (SELECT *, quoted OR (n >= 7 AND lo >= 0.6 * n AND mk) AS own, lag(op) OVER q AND line_no - lag(line_no) OVER q = 1 AND NOT quoted AND lo >= 0.4 * n AS link FROM o9 WINDOW q AS (PARTITION BY image_id ORDER BY line_no)),
r9 AS (SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY line_no) AS grp FROM m9),
c9 AS (SELECT image_id, line_no, bool_or(own) OVER (PARTITION BY image_id, grp ORDER BY line_no) AS cm FROM r9),
e9 AS (SELECT k9.*, coalesce(cm, false) AS in_comment, CASE WHEN core <> '' OR regexp_matches(text, {_E}) THEN regexp_matches(text, {_E}) END AS ends FROM k9 LEFT JOIN c9 USING (image_id, line_no)),
f9 AS (SELECT *, coalesce(last_value(ends IGNORE NULLS) OVER (PARTITION BY image_id, line_no ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) OR regexp_matches(text, {_OQ}) AS st FROM e9),
g9 AS (SELECT *, in_comment AND st AS cm_start, {_LOWS} AS low FROM f9)"""
G9_SQL = f"""WITH {W}, {COMMENTS_SQL}
SELECT image_id, word_id, in_comment, cm_start, CASE WHEN type <> {P._q(TEXT)} THEN type WHEN type IS NULL OR core = '' OR regexp_matches(core, {P._q(Q.LOWER)}) OR regexp_matches(core, '\\AI([''’][A-Za-z0-9_]+)?\\z') THEN NULL
 WHEN cm_start AND ({_KNOWN('low')} OR (length(low) > 5 AND regexp_matches(low, {P._q(Q.COMMON_END)})) OR (low LIKE '%s' AND {_KNOWN("regexp_replace(low, 's$', '')")})) THEN NULL ELSE 'Name in comment' END AS type FROM g9"""


def g2_page_masks(spark, sf_dir):
    """All masks of documents, comments kept: a reader missed one word in thirty, a detector found every line of text."""
    seen = written(_tight(P.document_words(spark, sf_dir)), "words")
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    lines = seen.groupBy("image_id", "line").agg(F.min("x").alias("x"), F.min("y").alias("y"), right.alias("r"), bottom.alias("b"), F.min("word_id").alias("region_id"))
    none = {"safe": "boolean", "blob": "boolean", "date": "string", "read": "string", "weak": "boolean"}
    box = lines.withColumns({"w": F.col("r") - F.col("x"), "h": F.col("b") - F.col("y")})
    regions = box.select("image_id", "region_id", *"xywh", F.struct(*"xywh").alias("core"), F.lit(0.0).alias("angle"), F.col("w").alias("len"), F.col("h").alias("thick"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    read = seen.filter(P.draw("missed", F.col("image_id"), F.col("word_id")) % 30 != 0)
    typed = written(V.page_types(read, keep_comments=True, regions=regions), "typed")
    masks = V.with_unread(written(V.page_masks(typed), "masks"), typed, regions)
    return masks.groupBy("image_id", "type").agg(F.count("*").alias("n_masks"), F.sum("n_words").alias("n_words"), F.sum(F.floor(F.col("w"))).alias("width"))


def g11_slanted(spark, sf_dir):
    """Two pieces of a slanted label for every customer, at gaps and turns of many sizes, and a level one."""
    k = F.col("k")
    o = P.read(spark, sf_dir, "customer").select(_key("c_custkey"), F.col("c_custkey").alias("k"))
    piece = lambda i, at, angle, across=0.0: F.struct(F.lit(i).cast("long").alias("region_id"), (at - across).cast("double").alias("x"), at.cast("double").alias("y"), angle.cast("double").alias("angle"))
    far = 20 + k % 13  # middles lie this far apart on both axes
    rows = F.array(piece(1, F.lit(100), F.lit(45.0)), piece(2, 100 + far, 45.0 + k % 11), piece(3, F.lit(500), F.lit(2.0)))
    return Z.join_slanted(o.select("image_id", F.explode(rows).alias("p")).select("image_id", "p.*", F.lit(20.0).alias("w"), F.lit(20.0).alias("h"), F.lit(28.0).alias("len"), F.lit(8.0).alias("thick"))).select("image_id", "region_id", "x", "w", "n_pieces")


#: Pieces 28 long: joined to a distance of 34.4 between the middles, if turned by 8 degrees at most.
G11_SQL = """WITH o AS (SELECT CAST(c_custkey AS VARCHAR) AS image_id, 20 + c_custkey % 13 AS far, sqrt(2) * (20 + c_custkey % 13) - 28 <= 6.4 AND c_custkey % 11 <= 8 AS one FROM customer)
SELECT image_id, 1::BIGINT AS region_id, 100.0::DOUBLE AS x, CASE WHEN one THEN 20 + far ELSE 20 END::DOUBLE AS w, CASE WHEN one THEN 2 ELSE 1 END::BIGINT AS n_pieces FROM o UNION ALL SELECT image_id, 2, 100 + far, 20, 1 FROM o WHERE NOT one UNION ALL SELECT image_id, 3, 500, 20, 1 FROM o"""


def _pixels(spark, sf_dir, table: str, key: str, width: int, height: int):
    """A picture for each row of a table: paper of a row's own colour and dark dots."""
    rows = P.read(spark, sf_dir, table).select(_key(key), F.col(key).alias("k"))
    at = rows.withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    d = P.draw(F.col("image_id"), F.col("px").cast("string"), F.col("py").cast("string")) % 100
    dark = d < F.col("k") % 50
    tone = lambda base: F.when(dark, (d % 40).cast("int")).otherwise(base)
    return at.select("image_id", "k", "px", "py", tone((F.col("k") % 3 * 60 + 100).cast("int")).alias("r"), tone(F.lit(200)).alias("g"), tone(F.lit(220)).alias("b"))


def _pixels_sql(name: str, table: str, key: str, width: int, height: int) -> str:
    d = P.draw_sql("image_id", "px::VARCHAR", "py::VARCHAR")
    return f"""{name}0 AS (SELECT CAST({key} AS VARCHAR) AS image_id, {key} AS k, px, py FROM {table}, range({width}) AS a(px), range({height}) AS b(py)), {name}1 AS (SELECT *, {d} % 100 AS d FROM {name}0),
{name} AS (SELECT *, CASE WHEN d < k % 50 THEN d % 40 ELSE k % 3 * 60 + 100 END AS r, CASE WHEN d < k % 50 THEN d % 40 ELSE 200 END AS g, CASE WHEN d < k % 50 THEN d % 40 ELSE 220 END AS b FROM {name}1)"""


def a13_ink(spark, sf_dir):
    """A word in a small picture of every part, half covered, wholly covered or open."""
    pixels = _pixels(spark, sf_dir, "part", "p_partkey", 16, 12)
    parts = P.read(spark, sf_dir, "part").select(_key("p_partkey"), F.col("p_partkey").alias("k"))
    box = lambda x, y, w, h: [F.lit(float(v)).alias(c) for c, v in zip("xywh", (x, y, w, h), strict=True)]
    words = parts.select("image_id", F.lit(1).cast("long").alias("word_id"), *box(1, 4, 9, 4))
    boxes = parts.filter("k % 3 != 0").select("image_id", F.lit(1.0).alias("x"), F.lit(3.0).alias("y"), F.when(F.col("k") % 3 == 1, 10.0).otherwise(5.0).alias("w"), F.lit(7.0).alias("h"))
    return I.ink_exposure(words, boxes, pixels, parts.select("image_id", F.lit(16).alias("width"), F.lit(12).alias("height")))


_COLOUR = "(r // 16 * 256 + g // 16 * 16 + b // 16)"
_FAR = "abs(r - (c // 256 % 16 * 16 + 8)) + abs(g - (c // 16 % 16 * 16 + 8)) + abs(b - (c % 16 * 16 + 8))"
A13_SQL = f"""WITH {_pixels_sql('px13', 'part', 'p_partkey', 16, 12)},
fr AS (SELECT image_id, {_COLOUR} AS c, sum((px BETWEEN 1 AND 10)::INT * ((py = 2)::INT + (py = 10)::INT) + (py BETWEEN 4 AND 8)::INT * ((px = 0)::INT + (px = 12)::INT)) AS n FROM px13 GROUP BY 1, 2),
bg AS (SELECT image_id, c FROM fr WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, c) = 1),
ink AS (SELECT image_id, count(*) FILTER (WHERE {_FAR} > 90) AS ink, count(*) FILTER (WHERE {_FAR} > 90 AND NOT (k % 3 <> 0 AND px + 0.5 BETWEEN 1 AND CASE WHEN k % 3 = 1 THEN 11 ELSE 6 END AND py + 0.5 BETWEEN 3 AND 10)) AS open FROM px13 JOIN bg USING (image_id) WHERE px BETWEEN 1 AND 10 AND py BETWEEN 4 AND 8 GROUP BY 1)
SELECT image_id, 1::BIGINT AS word_id, ink, open, ink > 0 AND open > ink * 0.15 AS exposed FROM ink"""


def a14_distortion(spark, sf_dir):
    """Pixels of every part changed here and there, under a replaced box or not."""
    before = _pixels(spark, sf_dir, "part", "p_partkey", 12, 10)
    moved = P.draw(F.col("image_id"), F.col("px").cast("string"), F.col("py").cast("string"), "new") % 7 == 0
    after = before.withColumn("g", F.when(moved, F.col("g") + 1).otherwise(F.col("g")))
    boxes = before.filter("k % 4 != 0").select("image_id").distinct().select("image_id", F.lit(2.5).alias("x"), F.lit(3.5).alias("y"), F.lit(4.2).alias("w"), F.lit(3.0).alias("h"))
    return I.distortion(before, after, boxes)


A14_SQL = f"""WITH {_pixels_sql('px14', 'part', 'p_partkey', 12, 10)}
SELECT image_id, count(*) FILTER (WHERE {P.draw_sql('image_id', 'px::VARCHAR', 'py::VARCHAR', "'new'")} % 7 = 0 AND NOT (k % 4 <> 0 AND px BETWEEN 2 AND 6 AND py BETWEEN 3 AND 6)) AS changed FROM px14 GROUP BY image_id"""


#: Pictures of pages: a pixel per character of their HTML, 160 a row; signs and digits are blue, capitals dark, all else light.
_WIDE, _INK = 160, {"[<>/=\"0-9]": (30, 90, 220), "[A-Z]": (60, 60, 60)}


def _page_pixels(spark, sf_dir):
    pages = P.read(spark, sf_dir, "pages").filter("html != ''").select(F.col("page_id").cast("string").alias("image_id"), F.posexplode(F.regexp_extract_all("html", F.lit("(?s)."), F.lit(0))).alias("i", "c"))
    shade = lambda k: F.when(F.col("c").rlike(list(_INK)[0]), list(_INK.values())[0][k]).when(F.col("c").rlike(list(_INK)[1]), list(_INK.values())[1][k]).otherwise(250)
    pixels = pages.select("image_id", (F.col("i") % _WIDE).alias("px"), F.floor(F.col("i") / _WIDE).cast("int").alias("py"), *(shade(k).alias(n) for k, n in enumerate("rgb")))
    sizes = pixels.groupBy("image_id").agg(F.lit(_WIDE).alias("width"), (F.max("py") + 1).alias("height"))
    words = sizes.select("image_id", *(F.lit(v).alias(n) for n, v in zip("xywh", (20.0, 6.0, 30.0, 7.0), strict=True)))
    return pixels, words, sizes


def a15_cells(spark, sf_dir):
    return D.hot_cells(*_page_pixels(spark, sf_dir))


def a15_areas(spark, sf_dir):
    pixels, words, sizes = _page_pixels(spark, sf_dir)
    return D.chart_areas(D.hot_cells(pixels, words, sizes), sizes)


_SHADE = ", ".join(f"CASE WHEN regexp_matches(ch, '{list(_INK)[0]}') THEN {list(_INK.values())[0][k]} WHEN regexp_matches(ch, '{list(_INK)[1]}') THEN {list(_INK.values())[1][k]} ELSE 250 END AS {n}" for k, n in enumerate("rgb"))
A15_SQL = f"""WITH l AS (SELECT CAST(page_id AS VARCHAR) AS image_id, regexp_extract_all(html, '(?s).') AS cs FROM pages WHERE html <> ''),
p15 AS (SELECT image_id, (i - 1) % {_WIDE} AS px, (i - 1) // {_WIDE} AS py, {_SHADE} FROM (SELECT image_id, i, cs[i] AS ch FROM l, unnest(range(1, len(cs) + 1)) AS t(i))),
sm AS (SELECT image_id, px // 32 AS bx, py // 32 AS y32, {_COLOUR} AS c, count(*) AS n FROM p15 WHERE px % 2 = 0 AND py % 2 = 0 GROUP BY ALL),
nb AS (SELECT image_id, bx + i AS bx, y32 + j AS y32, c, sum(n) AS n FROM sm, (VALUES (-1), (0), (1)) AS a(i), (VALUES (-1), (0), (1)) AS b(j) GROUP BY ALL),
pn AS (SELECT image_id, bx, y32, c FROM nb QUALIFY row_number() OVER (PARTITION BY image_id, bx, y32 ORDER BY n DESC, c) = 1),
q AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn, px BETWEEN 18 AND 51 AND py BETWEEN 4 AND 14 AS txt FROM p15 p JOIN pn ON p.image_id = pn.image_id AND p.px // 32 = bx AND p.py // 32 = y32),
v AS (SELECT image_id, px // 4 AS cx, py // 4 AS cy, txt, mx > 40 AND (mx - mn) / mx > 0.28 AND mx - mn > 40 AS col, {_FAR} > 150 AS far FROM q),
s AS (SELECT image_id, cx, cy, count(*) AS n, count(*) FILTER (WHERE NOT txt AND col) AS nc, count(*) FILTER (WHERE NOT txt AND NOT col AND far) AS nf FROM v GROUP BY 1, 2, 3)
SELECT image_id, cx::INT AS cx, cy::INT AS cy, CASE WHEN nc > n * 0.12 THEN 1 ELSE 2 END AS hot FROM s WHERE nc > n * 0.12 OR nf > n * 0.45"""


def j1_strict(spark, sf_dir):
    """Three readings: as they are, moved by two pixels, and a fifth of them moved on by four."""
    first = P.document_words(spark, sf_dir).select("image_id", "word_id", "text", "x", "y", "w", "h", F.lit("first").alias("pass"))
    d = F.col("_d")
    second = once(first, _d=P.draw(F.col("image_id"), F.col("word_id").cast("string"), "again")).filter(d % 3 != 0).withColumns({"word_id": F.col("word_id") + 1_000_000, "x": F.col("x") + F.when(d % 5 == 0, F.col("w")).otherwise(2), "y": F.col("y") + 14, "pass": F.lit("second")})
    third = second.filter(d % 5 == 1).withColumns({"word_id": F.col("word_id") + 1_000_000, "x": F.col("x") + 4, "pass": F.lit("third")})
    second, third = second.drop("_d"), third.drop("_d")
    return M.merge_passes_strict(first.unionByName(second).unionByName(third), ["first", "second", "third"]).select("image_id", "word_id", "pass")


def t10_plan(spark, sf_dir):
    """Orders as pages: a column of even ticks, prices with their ship dates read as one, discounts, and joined ticks below."""
    items = P.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), "l_extendedprice", "l_discount", "l_shipdate")
    date = F.date_format("l_shipdate", "M/d/yyyy")
    cell = lambda c, x, text: F.struct(F.lit(c).alias("c"), F.lit(x).alias("x"), text.alias("text"))
    cells = items.select("k", "n", F.explode(F.array(
        cell(0, 0.0, F.format_number(F.col("n") * (F.col("k") % 7 + 2) * 100, 0)), cell(1, 100.0, F.concat(F.lit("$"), F.format_number(F.col("l_extendedprice").cast("double"), 0), F.lit(" "), date)),
        cell(2, 320.0, F.concat((F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))), cell(3, 420.0, F.concat_ws(" ", F.lit("0"), (F.col("k") % 9 + 1) * 10, (F.col("k") % 9 + 1) * 20)), cell(4, 520.0, date),
    )).alias("v"))
    masks = cells.select(F.col("k").cast("string").alias("image_id"), (F.col("n") * 5 + F.col("v.c")).alias("mask_id"), "v.text", "v.x", (F.col("n") * 30.0).alias("y"), (F.length("v.text") * 7.0).alias("w"), F.lit(12.0).alias("h"))
    return Z.plan_values(masks, 3)


def t12_letters(spark, sf_dir):
    """Codes made of the words of every document."""
    words = P.document_words(spark, sf_dir).select("text").distinct()
    code = F.concat(F.lit("x_"), F.col("text"), F.lit("_50/"), F.upper("text"))
    return words.select("text", K.fake_letters(code, 7).alias("fake"))


def a16_fingerprint(spark, sf_dir):
    """The upper part of a picture of every supplier, with a word in it."""
    pixels = _pixels(spark, sf_dir, "supplier", "s_suppkey", 100, 12)
    rows = P.read(spark, sf_dir, "supplier").select(_key("s_suppkey"))
    boxes = rows.select("image_id", F.lit(4.0).alias("x"), F.lit(4.0).alias("y"), F.lit(10.0).alias("w"), F.lit(4.0).alias("h"))
    return I.fingerprint(pixels, boxes, rows.select("image_id", F.lit(100).alias("width"), F.lit(100).alias("height")))


_SAT = "(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END)"
A16_SQL = f"""WITH {_pixels_sql('px16', 'supplier', 's_suppkey', 100, 12)},
ar AS (SELECT px16.*, a.area, {_COLOUR} AS col FROM px16 JOIN (VALUES ('left', 0, 18, 12), ('right', 82, 100, 12), ('band', 0, 100, 10)) AS a(area, x0, x1, h) ON px >= x0 AND px < x1 AND py < a.h),
bg AS (SELECT image_id, area, col AS c FROM (SELECT image_id, area, col, count(*) AS n FROM ar GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY image_id, area ORDER BY n DESC, col) = 1),
sc AS (SELECT image_id, area, c, avg(({_FAR} > 90)::INT) AS ink, avg(({_SAT} > 0.5 AND greatest(r, g, b) > 40)::INT) AS strong FROM ar JOIN bg USING (image_id, area) WHERE NOT (px BETWEEN 2 AND 16 AND py BETWEEN 2 AND 10) GROUP BY ALL),
dp AS (SELECT *, c // 256 % 16 * 16 + 8 AS cr, c // 16 % 16 * 16 + 8 AS cg, c % 16 * 16 + 8 AS cb FROM sc)
SELECT image_id, bool_or(area <> 'band' AND ink > 0.06 AND ink < 0.85) AS corner, bool_or(area = 'band' AND ((greatest(cr, cg, cb) - least(cr, cg, cb)) / greatest(cr, cg, cb) > 0.45 OR strong > 0.35)) AS header FROM dp GROUP BY image_id"""


def u1_layers(spark, sf_dir):
    """Active masks, boxes by hand around every word of twelve letters, and low-confidence words: one layer each."""
    words = P.document_words(spark, sf_dir)
    rules = _active(M.build_masks(M.typed(words))).filter("on").select("image_id", "type", "src", "x", "y", "w", "h")
    hand = words.filter(F.length("text") >= 12).select("image_id", F.lit("manual").alias("src"), "x", "y", "w", "h")
    faint = words.filter(P.draw(F.col("image_id"), F.col("word_id").cast("string"), "seen") % 100 < 60).select("image_id", F.lit("Unread text").alias("type"), "x", "y", "w", "h")
    return M.all_masks(rules, hand, faint).groupBy("image_id", "type", "src").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


U1_SQL = f"""WITH {MASKS}, {ACTIVE_SQL}, u AS (SELECT image_id, type, src, w FROM act WHERE "on" UNION ALL SELECT image_id, NULL, 'manual', w FROM words WHERE length(text) >= 12
 UNION ALL SELECT image_id, 'Unread text', NULL, w FROM words WHERE {P.draw_sql('image_id', 'CAST(word_id AS VARCHAR)', "'seen'")} % 100 < 60) SELECT image_id, type, src, count(*) AS n, sum(w) AS w FROM u GROUP BY 1, 2, 3"""


def s3_truth(spark, sf_dir):
    """Words of all documents written as truth and review files and read again, on the review's pixels."""
    words = P.document_words(spark, sf_dir)
    path = shared_path(spark, "truth")
    kind = F.when(F.col("word_id") % 3 == 0, "name")
    word = F.struct("text", "x", "y", "w", "h", kind.alias("kind"), F.when(F.col("word_id") % 5 != 0, F.col("word_id") % 2 == 0).alias("sensitive"))
    words.groupBy(F.col("image_id").alias("id")).agg(F.lit(800.0).alias("width"), F.lit(600.0).alias("height"), F.transform(F.sort_array(F.collect_list(F.struct("word_id", word.alias("v")))), lambda s: s["v"]).alias("words")).write.json(path)
    review = shared_path(spark, "review")
    words.select(F.col("image_id").alias("id"), F.lit(1200.0).alias("width"), F.lit(900.0).alias("height"), F.lit("pass").alias("gate")).distinct().write.json(review)
    return truth_words(read_truth(spark, path, lines=True), read_review(spark, review, lines=True))


S3_SQL = f"WITH {W} SELECT image_id, word_id - 1 AS word_id, text, x * 1.5 AS x, y * 1.5 AS y, w * 1.5 AS w, h * 1.5 AS h, CASE WHEN word_id % 3 = 0 THEN 'name' END AS kind, CASE WHEN word_id % 5 <> 0 THEN word_id % 2 = 0 ELSE false END AS sensitive, false AS rotated FROM words"


def s4_review(spark, sf_dir):
    """Masks of all documents written as review files and read again."""
    masks = M.build_masks(M.typed(P.document_words(spark, sf_dir)))
    path = shared_path(spark, "review")
    masks.groupBy(F.col("image_id").alias("id")).agg(F.lit("pass").alias("gate"), F.transform(F.sort_array(F.collect_list(F.struct("mask_id", F.struct("x", "y", "w", "h").alias("b")))), lambda s: s["b"]).alias("masks")).write.json(path)
    return review_parts(read_review(spark, path, lines=True))[1]


S4_SQL = f"WITH {MASKS} SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY mask_id) - 1 AS mask_id, x, y, w, h FROM masks"


def t20_read_sizes(spark, sf_dir):
    """Detector and reading sizes of pictures as large as orders."""
    o = P.read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 9000 + 10).cast("double").alias("w"), (F.col("o_totalprice").cast("double") / 20 + 20).alias("h"))
    return o.select("o_orderkey", X.detector_size(F.col("w"), F.col("h"), 960).alias("d"), F.round(X.read_scale(F.col("w"), F.col("h")), 9).alias("scale")).select("o_orderkey", F.col("d.width").alias("width"), F.col("d.height").alias("height"), "scale")


T20_SIZES_SQL = """WITH o AS (SELECT o_orderkey, (o_orderkey % 9000 + 10)::DOUBLE AS w, o_totalprice::DOUBLE / 20 + 20 AS h FROM orders), k AS (SELECT *, least(1.0, 960 / sqrt(w * h), 3840 / greatest(w, h)) AS k FROM o)
SELECT o_orderkey, greatest(32, floor(w * k / 32 + 0.5) * 32)::BIGINT AS width, greatest(32, floor(h * k / 32 + 0.5) * 32)::BIGINT AS height, round(least(1.0, sqrt(9000000 / (w * h)), 10000 / greatest(w, h)), 9)::DOUBLE AS scale FROM k"""

QUERIES = {
    "t11_fake_ticks": t11_ticks, "t13_fake_entities": t13_entities, "t14_fitted": t14_fitted, "t15_fake_ids": t15_ids, "t15_fake_titles": t15_titles, "t20_read_sizes": t20_read_sizes,
    "j8_second_look": j8_second_look, "j10_context": j10_context, "j10_labels": j10_labels, "j15_redraw_clashes": j15_redraw, "j16_after_month": j16_days,
    "g7_axis_scales": g7_axes, "g8_total_links": g8_totals, "g9_comments": g9_comments, "g2_page_masks": g2_page_masks, "g11_join_slanted": g11_slanted,
    "a13_ink_exposure": a13_ink, "a14_distortion": a14_distortion, "a15_hot_cells": a15_cells, "a15_chart_areas": a15_areas, "j1_strict": j1_strict, "t10_plan": t10_plan, "t12_letters": t12_letters, "a16_fingerprint": a16_fingerprint, "u1_mask_layers": u1_layers, "s3_truth_words": s3_truth, "s4_review_masks": s4_review,
}
SQL = {
    "t11_fake_ticks": T11_SQL, "t13_fake_entities": T13_SQL, "t14_fitted": T14_SQL, "t15_fake_ids": T15_SQL, "t15_fake_titles": T15_TITLES_SQL, "t20_read_sizes": T20_SIZES_SQL,
    "j8_second_look": J8_SQL, "j10_context": J10_SQL, "j15_redraw_clashes": J15_SQL, "j16_after_month": J16_SQL, "g8_total_links": G8_SQL, "g9_comments": G9_SQL, "g11_join_slanted": G11_SQL,
    "a13_ink_exposure": A13_SQL, "a14_distortion": A14_SQL, "a15_hot_cells": A15_SQL, "a16_fingerprint": A16_SQL, "u1_mask_layers": U1_SQL, "s3_truth_words": S3_SQL, "s4_review_masks": S4_SQL,
}
