"""Registered queries: labels, dates, scrubbing, closeness of words, model tables, streams."""

from __future__ import annotations

from pyspark.sql import functions as F


from maskwright import streaming as R
from maskwright.functions import dates as D
from maskwright.functions import labels as L
from maskwright.functions import text as T
from maskwright.operators import models as N
from maskwright.plans import base as P

_SING = r"CASE WHEN length(w) < 4 THEN w WHEN w LIKE '%ies' THEN regexp_replace(w, 'ies$', '') || 'y' WHEN regexp_matches(w, '(ches|shes|sses|xes)$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^su]s$') THEN regexp_replace(w, 's$', '') ELSE w END"


def singular_sql(c: str) -> str:
    return rf"array_to_string(list_transform(regexp_split_to_array(regexp_replace(lower(coalesce({c}, '')), '[_-]+', ' ', 'g'), '\s+'), lambda w: {_SING}), ' ')"


def _labels(spark, sf_dir):
    """Report labels made of table columns: nouns picked by a supplier's and a customer's number, singular and plural."""
    nouns = "Customers|Order ID|Physicians|Health Plan|Store|Support ticket|Facilities|Branches|Status|Account Manager|Leads by Region|Cities|E-mail|Invoice #|Product Name|Bank|Shipments|Prepared by|Markets|Agencies".split("|")
    pick = lambda k: F.get(F.array(*map(F.lit, nouns)), (k % len(nouns)).cast("int"))
    return P.read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", pick(F.col("c_custkey")), F.when(F.col("c_custkey") % 3 == 0, pick(F.col("c_custkey") / 20))).alias("label"))


_NOUNS = P.list_sql("Customers|Order ID|Physicians|Health Plan|Store|Support ticket|Facilities|Branches|Status|Account Manager|Leads by Region|Cities|E-mail|Invoice #|Product Name|Bank|Shipments|Prepared by|Markets|Agencies".split("|"))
LABELS_SQL = f"lab AS (SELECT c_custkey, concat_ws(' ', list_extract({_NOUNS}, 1 + (c_custkey % 20)::INT), CASE WHEN c_custkey % 3 = 0 THEN list_extract({_NOUNS}, 1 + (trunc(c_custkey / 20.0 % 20))::INT) END) AS label FROM customer)"


def _first_sql(c: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {P._q(p)}) THEN '{n}'" for n, p in rules) + " END"


def t5_singular(spark, sf_dir):
    return _labels(spark, sf_dir).select("label", L.singular(F.col("label")).alias("singular")).distinct()


T5_SQL = f"WITH {LABELS_SQL} SELECT DISTINCT label, {singular_sql('label')} AS singular FROM lab"


def t6_roles(spark, sf_dir):
    c = F.col("label")
    return _labels(spark, sf_dir).select("label", L.entity_of(c).alias("entity"), L.column_role(c).alias("role"), L.is_placeholder(c).alias("placeholder")).distinct()


_N = "n"
_ENT = f"CASE WHEN regexp_matches(n, {P._q(L.PHYSICIAN)}) THEN NULL ELSE {_first_sql('n', L.ENTITIES)} END"
_BY = _first_sql("n", L.ROLES)
T6_SQL = rf"""WITH {LABELS_SQL}, s AS (SELECT DISTINCT label, {singular_sql('label')} AS n FROM lab), e AS (SELECT *, {_ENT} AS entity, {_BY} AS byname FROM s)
SELECT label, entity, CASE WHEN regexp_matches(n, {P._q(L.PHYSICIAN)}) THEN 'person' WHEN entity IS NOT NULL AND NOT regexp_matches(n, 'e-?mail|phone|\b(id|code|number|no)\b|#') THEN 'company'
 WHEN byname = 'person' AND regexp_matches(n, '\b(customer|client|account|company|vendor|partner|brand)\b') THEN 'company' ELSE byname END AS role, regexp_matches(label, {P._q(L.PLACEHOLDER)}) AS placeholder FROM e"""


def t6_box_roles(spark, sf_dir):
    c = F.col("label")
    return _labels(spark, sf_dir).select("label", L.role_of(c).alias("role"), L.id_prefix(c).alias("prefix")).distinct()


_SKIP = P.list_sql(sorted(L.ID_SKIP))
T6_BOX_SQL = rf"""WITH {LABELS_SQL}, b AS (SELECT DISTINCT label, trim(lower(label)) AS low FROM lab),
d AS (SELECT *, CASE WHEN regexp_matches(low, {P._q(L.BY_SOMEONE)}) THEN '' ELSE regexp_extract(low, '\bby\s+([a-z][a-z ]*)$', 1) END AS dim FROM b),
x AS (SELECT *, CASE WHEN dim <> '' THEN trim(dim) ELSE low END AS said, dim <> '' AND regexp_matches(string_split(dim, ' ')[-1], {P._q(L.PLACE)}) AS place FROM d),
s AS (SELECT *, {singular_sql('said')} AS n FROM x), e AS (SELECT *, {_ENT} AS entity, {_BY} AS byname FROM s),
u AS (SELECT *, coalesce(list_filter(regexp_split_to_array(regexp_replace(upper(label), '[^A-Z\s]', ' ', 'g'), '\s+'), lambda w: w <> '' AND NOT list_contains({_SKIP}, w))[1], 'ID') AS w FROM e),
v AS (SELECT *, substr(substr(w, 1, 1) || regexp_replace(substr(w, 2), '[AEIOU]', '', 'g'), 1, 3) AS bones FROM u)
SELECT label, CASE WHEN place THEN 'city' WHEN said = '' THEN NULL WHEN regexp_matches(said, {P._q(L.PERSON_CUE)}) OR regexp_matches(n, {P._q(L.PHYSICIAN)}) THEN 'person'
 WHEN entity IS NOT NULL AND NOT regexp_matches(n, 'e-?mail|phone|\b(id|code|number|no)\b|#') THEN 'company' WHEN byname = 'person' AND regexp_matches(n, '\b(customer|client|account|company|vendor|partner|brand)\b') THEN 'company' ELSE byname END AS role,
 CASE WHEN length(bones) >= 3 THEN bones ELSE substr(w, 1, 3) END AS prefix FROM v"""


def t16_locale(spark, sf_dir):
    n = P.read(spark, sf_dir, "nation")
    return n.select("n_nationkey", L.locale_for_place(F.col("n_name")).alias("locale"))


T16L_SQL = "SELECT n_nationkey, CASE " + " ".join(f"WHEN regexp_matches(regexp_replace(lower(trim(n_name)), '[-_ ]+', ' ', 'g'), {P._q(chr(92) + 'A' + p + chr(92) + 'z')}) THEN '{loc}'" for p, loc in L.PLACES) + " END AS locale FROM nation"


def t16_industry(spark, sf_dir):
    """Industry of the pages that ten customers' labels make."""
    pages = _labels(spark, sf_dir).groupBy((F.col("c_custkey") / 10).cast("long").alias("image_id")).agg(F.array_join(F.sort_array(F.collect_list("label")), " ").alias("text"))
    hits = pages.select("image_id", *L.industry_hits(F.col("text")))
    return hits.select("image_id", L.best_industry({n: F.col(n) for n, _ in L.INDUSTRIES}).alias("industry"))


_H = ", ".join(f"len(regexp_extract_all(n, {P._q(p)})) AS {n}" for n, p in L.INDUSTRIES)
_GREAT = "greatest(" + ", ".join(n for n, _ in L.INDUSTRIES) + ")"
T16_SQL = f"WITH {LABELS_SQL}, pg AS (SELECT c_custkey // 10 AS image_id, string_agg(label, ' ' ORDER BY label) AS t FROM lab GROUP BY 1), h AS (SELECT image_id, {_H} FROM (SELECT image_id, {singular_sql('t')} AS n FROM pg)) SELECT image_id, CASE WHEN {_GREAT} < 2 THEN 'general' " + " ".join(f"WHEN {n} = {_GREAT} THEN '{n}'" for n, _ in L.INDUSTRIES) + " END AS industry FROM h"


def _dated(spark, sf_dir):
    """Order dates in the seven formats, a page for ten orders; the eighth of eight is no date."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    f = lambda p: F.date_format(d, p)
    text = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("dd/MM/yyyy")).when(k == 2, f("MM/yyyy")).when(k == 3, f("MM-yy")).when(k == 4, f("MMM yyyy")).when(k == 5, f("MMM d, yyyy")).when(k == 6, f("d-MMM-yyyy")).otherwise(F.concat(f("yy"), F.lit("."), f("MMdd")))
    return P.read(spark, sf_dir, "orders").select((F.col("o_orderkey") / 40).cast("long").alias("image_id"), "o_orderkey", text.alias("text"))


DATED_SQL = "dat AS (SELECT o_orderkey // 40 AS image_id, o_orderkey, o_orderdate AS od, CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%m-%y') WHEN 4 THEN strftime(o_orderdate, '%b %Y') WHEN 5 THEN strftime(o_orderdate, '%b %-d, %Y') WHEN 6 THEN strftime(o_orderdate, '%-d-%b-%Y') ELSE strftime(o_orderdate, '%y') || '.' || strftime(o_orderdate, '%m%d') END AS text FROM orders)"


def t7_dates(spark, sf_dir):
    return _dated(spark, sf_dir).withColumn("d", D.parse_date(F.col("text"), "dmy")).filter("d is not null").select("o_orderkey", "text", "d.format", "d.year", "d.month", F.coalesce("d.day", F.lit(0)).alias("day"))


T7_SQL = f"WITH {DATED_SQL} SELECT o_orderkey, text, ['iso', 'num', 'mon_year', 'mon_yy', 'name_year', 'name_day', 'day_name', NULL][1 + (o_orderkey % 8)::INT] AS format, CASE WHEN o_orderkey % 8 = 3 THEN 2000 + year(od) % 100 ELSE year(od) END::INT AS year, month(od)::INT AS month, CASE WHEN o_orderkey % 8 IN (0, 1, 5, 6) THEN day(od)::INT ELSE 0 END AS day FROM dat WHERE o_orderkey % 8 < 7"
SEED = 7


def t8_shift(spark, sf_dir):
    return _dated(spark, sf_dir).select("o_orderkey", D.shift_date(F.col("text"), SEED, "dmy").alias("moved"))


_MV = f"(od - to_months({D.months_back(SEED)}))"
T8_SQL = f"WITH {DATED_SQL} SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN strftime({_MV}, '%Y-%m-%d') WHEN 1 THEN CASE WHEN regexp_matches(text, '^0|/0') THEN strftime({_MV}, '%d/%m/%Y') ELSE strftime({_MV}, '%-d/%-m/%Y') END WHEN 2 THEN CASE WHEN text LIKE '0%' THEN strftime({_MV}, '%m/%Y') ELSE strftime({_MV}, '%-m/%Y') END WHEN 3 THEN strftime({_MV}, '%m-%y') WHEN 4 THEN strftime({_MV}, '%b %Y') WHEN 5 THEN CASE WHEN day(od) > 9 AND day({_MV}) < 10 THEN strftime({_MV}, '%b %d, %Y') ELSE strftime({_MV}, '%b %-d, %Y') END WHEN 6 THEN strftime({_MV}, '%-d-%b-%Y') END AS moved FROM dat"


def t9_order(spark, sf_dir):
    return D.date_order(_dated(spark, sf_dir))


T9_SQL = f"WITH {DATED_SQL}, v AS (SELECT image_id, count(*) FILTER (WHERE o_orderkey % 8 = 1 AND day(od) > 12) AS d FROM dat GROUP BY 1) SELECT image_id, CASE WHEN d > 0 THEN 'dmy' ELSE 'mdy' END AS date_order FROM v"


def t17_scrub(spark, sf_dir):
    docs = P.read(spark, sf_dir, "documents")
    return docs.select("doc_id", T.scrub("text").alias("scrubbed"))


T17_SQL = rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), 'sk-[A-Za-z0-9_-]{{8,}}', '[key removed]', 'g'), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+', '[email removed]', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, 'http(s?://[^{T.JS_WS})]*localhost)', chr(1) || '\1', 'g') AS t FROM a)
SELECT doc_id, substr(replace(regexp_replace(t, 'https?://[^{T.JS_WS})]+', '[link removed]', 'g'), chr(1), 'http'), 1, 400) AS scrubbed FROM b"""


def t18_quotes(spark, sf_dir):
    """Turns quoted with the words of their conversation's first turn as vocabulary."""
    turns = P.read(spark, sf_dir, "conversations")
    vocab = turns.filter("turn = 0").select("conv_id", F.transform(F.split("text", r"\s+"), T.norm_word).alias("vocab"))
    both = turns.join(vocab, "conv_id")
    return both.select("conv_id", "turn", T.scrub_quote(F.col("text"), F.col("vocab")).alias("quote"))


def _norm(c: str) -> str:
    return f"replace(lower({P.core_sql(c)}), '’', chr(39))"


def _fair(c: str) -> str:
    return f"coalesce(list_contains(vocab, {c}) OR list_contains({P.list_sql(T.NEUTRAL)}, {c}), false)"


_RUNS = r"regexp_replace(regexp_replace(j, '(\[…\][^\s\p{L}\p{N}]*\s*){2,}', '[…] ', 'g'), '\s+([.,!?;:])', '\1', 'g')"
T18_SQL = rf"""WITH v AS (SELECT conv_id, list_transform(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: {_norm('w')}) AS vocab FROM conversations WHERE turn = 0),
q AS (SELECT conv_id, turn, vocab, list_filter(regexp_split_to_array(substr(coalesce(text, ''), 1, 400), '[{T.JS_WS}]+'), lambda t: t <> '') AS toks FROM conversations JOIN v USING (conv_id)),
p AS (SELECT conv_id, turn, array_to_string(list_transform(toks, lambda t: CASE WHEN regexp_matches(t, '(?i)\A\[(…|\.\.\.|hidden|redacted|masked|client|name)\][^A-Za-z0-9_]*\z') THEN '[…]' WHEN {_norm('t')} = '' THEN t
 WHEN regexp_matches(t, '(?i)[0-9]|@|https?:|www\.') THEN '[…]' WHEN {_fair(_norm('t'))} THEN t
 WHEN regexp_matches({_norm('t')}, '[-'']') AND len(list_filter(regexp_split_to_array({_norm('t')}, '[-'']'), lambda w: w <> '' AND NOT {_fair('w')})) = 0 THEN t ELSE '[…]' END), ' ') AS j FROM q)
SELECT conv_id, turn, {P.trim_sql(_RUNS)} AS quote FROM p"""


def t19_near(spark, sf_dir):
    """Neighbouring words of a line that are spelled nearly the same."""
    words = P.document_words(spark, sf_dir)
    pair = words.select("image_id", "word_id", T.squash(F.col("text")).alias("a")).join(words.select("image_id", (F.col("word_id") - 1).alias("word_id"), T.squash(F.col("text")).alias("b")), ["image_id", "word_id"])
    a, b = F.col("a"), F.col("b")
    return pair.select("a", "b", T.near_word(a, b).alias("near"), T.is_subsequence(a, b).alias("subsequence"), T.one_off(a, b).alias("one_off")).filter("near or subsequence or one_off").distinct()


T19_SQL = rf"""WITH {P.words_sql()}, q AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS s FROM words), pr AS (SELECT DISTINCT x.s AS a, y.s AS b FROM q x JOIN q y ON x.image_id = y.image_id AND y.word_id = x.word_id + 1),
m AS (SELECT a, b, least(length(a), length(b)) >= 4 AND CASE WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) >= 0.6 * greatest(length(a), length(b)) ELSE abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) <= 2 END AS near,
 regexp_matches(b, array_to_string(string_split(a, ''), '.*')) AS subsequence, length(a) = length(b) AND len(list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i])) <= 1 AS one_off FROM pr)
SELECT a, b, near, subsequence, one_off FROM m WHERE near OR subsequence OR one_off"""


def m1_person_org(spark, sf_dir):
    """The first six components of an embedding as logits: labels 1, 2 are persons, 3, 4 organisations."""
    e = P.read(spark, sf_dir, "embeddings").withColumn("p", N.person_org(F.transform(F.slice("embedding", 1, 6), lambda v: v.cast("double")), [1, 2], [3, 4]))
    return e.select("vec_id", F.round("p.per", 9).alias("per"), F.round("p.org", 9).alias("org"))


M1_SQL = "WITH x AS (SELECT vec_id, list_transform(embedding[1:6], lambda v: exp(v::DOUBLE)) AS e FROM embeddings) SELECT vec_id, round((e[2] + e[3]) / list_sum(e), 9) AS per, round((e[4] + e[5]) / list_sum(e), 9) AS org FROM x"


def _scored_words(spark, sf_dir):
    words = P.document_words(spark, sf_dir)
    d = P.draw(F.col("image_id"), F.col("word_id").cast("string"), "score") % 100
    return words.select("image_id", F.element_at(F.split("line", "-"), -1).cast("long").alias("line_no"), F.col("word_id").alias("pos"), "text", (d % 3 != 0).alias("kept"), (d / 200).alias("per"), (d / 200).alias("org"))


def m3_context(spark, sf_dir):
    return N.context_hits(_scored_words(spark, sf_dir))


M3_SQL = rf"""WITH {P.words_sql()}, s AS (SELECT *, {P.draw_sql('image_id', 'CAST(word_id AS VARCHAR)', "'score'")} % 100 AS d, {P.core_sql('text')} AS c FROM words),
n AS (SELECT *, d / 100.0 AS ent, greatest(coalesce(lag(d) OVER q, 0), coalesce(lead(d) OVER q, 0)) / 100.0 AS nb, sum(regexp_matches(text, '\p{{L}}')::INT) OVER (PARTITION BY image_id, line_no) AS le FROM s WINDOW q AS (PARTITION BY image_id, line_no ORDER BY word_id))
SELECT image_id, line_no::BIGINT AS line_no, word_id AS pos FROM n WHERE le >= 2 AND d % 3 <> 0 AND regexp_matches(c, '\A\p{{Lu}}') AND NOT (length(c) >= 2 AND regexp_matches(c, '\A\p{{Lu}}[\p{{Lu}}0-9&.]*\z')) AND (ent >= 0.8 OR (ent >= 0.5 AND nb >= 0.5))"""


def m4_ctc(spark, sf_dir):
    """Embeddings as eight steps of eight classes."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda v: v.cast("double")))
    e = P.read(spark, sf_dir, "embeddings").withColumn("r", N.ctc_decode(steps, "abcdef", space=True))
    return e.select("vec_id", "r.text", F.round("r.conf", 9).alias("conf"))


M4_SQL = """WITH s AS (SELECT vec_id, i, embedding[i * 8 + 1 : i * 8 + 8] AS p FROM embeddings, unnest(range(8)) AS r(i)), b AS (SELECT vec_id, i, list_position(p, list_max(p)) - 1 AS c, list_max(p)::DOUBLE AS p FROM s),
k AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY vec_id ORDER BY i), -1) AS pr FROM b), g AS (SELECT vec_id, trim(coalesce(string_agg(['', 'a', 'b', 'c', 'd', 'e', 'f', ' '][c + 1], '' ORDER BY i) FILTER (WHERE c <> 0 AND c <> pr), '')) AS text, coalesce(avg(p) FILTER (WHERE c <> 0 AND c <> pr), 0) AS conf FROM k GROUP BY 1)
SELECT vec_id, text, round(conf, 9) AS conf FROM g"""


def m2_pack(spark, sf_dir):
    words = P.document_words(spark, sf_dir).select("image_id", F.element_at(F.split("line", "-"), -1).cast("long").alias("line_no"), F.col("word_id").alias("pos"), F.ceil(F.length("text") / 3).alias("n_tokens"))
    return N.pack_lines(words, 64)


def m5_scorer(spark, sf_dir):
    """A scorer that calls long words names."""
    lines = P.document_words(spark, sf_dir).groupBy("image_id", F.element_at(F.split("line", "-"), -1).cast("long").alias("line_no")).agg(F.transform(F.sort_array(F.collect_list(F.struct("word_id", "text"))), lambda s: s["text"]).alias("words"))
    return N.score_lines(lines, lambda batch: [[(min(len(w), 10) / 10, 0.0) for w in line] for line in batch])


M5_SQL = f"WITH {P.words_sql()} SELECT image_id, line_no::BIGINT AS line_no, row_number() OVER (PARTITION BY image_id, line_no ORDER BY word_id) - 1 AS pos, least(length(text), 10) / 10 AS per, 0.0::DOUBLE AS org FROM words"


def m6_regions(spark, sf_dir):
    """Embeddings as 8 × 8 probability maps."""
    maps = P.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", lambda v: F.least(F.abs(v.cast("double")) * 4, F.lit(1.0))).alias("probs"))
    return N.regions_from_map(maps, thin=1.0)


def _thumbs(spark, sf_dir):
    """Neighbouring embeddings of a label as thumbnails of one canvas, scaled to 0 … 255."""
    e = P.read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("canvas_id"), F.col("vec_id").alias("seq"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 100 + 128).cast("double")).alias("sig"))
    return e


def r1_changes(spark, sf_dir):
    e = _thumbs(spark, sf_dir)
    both = e.join(e.select((F.col("seq") - 1).alias("seq"), F.col("sig").alias("next")), "seq")
    c = R.changed_box(F.col("sig"), F.col("next"), 8)
    return both.withColumn("c", c).select("seq", "c.x", "c.y", "c.w", "c.h", F.round(R.pixel_delta(F.col("sig"), F.col("next")), 6).alias("delta"))


R1_SQL = """WITH t AS (SELECT vec_id AS seq, list_transform(embedding, lambda v: floor(v::DOUBLE * 100 + 128)) AS s FROM embeddings), p AS (SELECT a.seq, i, abs(a.s[i + 1] - b.s[i + 1]) AS d FROM t a JOIN t b ON b.seq = a.seq + 1, unnest(range(64)) AS r(i)),
g AS (SELECT seq, min(i % 8) FILTER (WHERE d > 24) AS x1, max(i % 8) FILTER (WHERE d > 24) AS x2, min(i // 8) FILTER (WHERE d > 24) AS y1, max(i // 8) FILTER (WHERE d > 24) AS y2, sum(d) / 64 AS delta FROM p GROUP BY 1)
SELECT seq, greatest(x1 - 1, 0)::INT AS x, greatest(y1 - 1, 0)::INT AS y, (least(x2 + 2, 8) - greatest(x1 - 1, 0))::INT AS w, (least(y2 + 2, 8) - greatest(y1 - 1, 0))::INT AS h, round(delta, 6) AS delta FROM g"""


def _replayed(spark, parts, transform, name: str):
    """What a stream writes while ``parts`` arrive one after the other; its state and watermark live on between them."""
    from maskwright.plans.store import shared_path

    path, out, state = (shared_path(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    for part in parts:
        part.write.mode("append").parquet(path)
        stream = transform(spark.readStream.schema(part.schema).parquet(path))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def r2_watch(spark, sf_dir):
    kind = F.when(F.col("seq") % 5 == 0, "read").when(F.col("seq") % 7 == 0, "failed").otherwise("drawn")
    events = _thumbs(spark, sf_dir).select("canvas_id", "seq", kind.alias("kind"), "sig")
    return _replayed(spark, [events], lambda e: R.watch_redraws(e, 8), "r2")


def r3_latest(spark, sf_dir):
    e = P.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("canvas_id"), F.col("event_id").alias("seq"), "value")
    return R.latest_run(e)


R3_SQL = "SELECT CAST(user_id AS VARCHAR) AS canvas_id, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1"


def r3_latest_stream(spark, sf_dir):
    """Every third event arrives late: of those, only what is newer than all that came before for its user is let through."""
    e = P.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("canvas_id"), F.col("event_id").alias("seq"), "value")
    return _replayed(spark, [e.filter("seq % 3 != 0"), e.filter("seq % 3 = 0")], R.latest_run_stream, "r3")


R3_STREAM_SQL = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS canvas_id, event_id AS seq, value FROM events), seen AS (SELECT canvas_id, max(seq) AS last FROM e WHERE seq % 3 <> 0 GROUP BY 1)
SELECT e.* FROM e LEFT JOIN seen USING (canvas_id) WHERE seq % 3 <> 0 OR last IS NULL OR seq > last"""


def _event_texts(spark, sf_dir):
    return P.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), F.lit("total"), F.round("value", 2).cast("decimal(18,2)").cast("string")).alias("text"))


def r4_mask_stream(spark, sf_dir):
    """Counts of the windows that the watermark closes; every fourth event arrives late, and counts only in open windows."""
    e = _event_texts(spark, sf_dir)
    out = _replayed(spark, [e.filter("id % 4 != 0"), e.filter("id % 4 = 0")], R.mask_stream, "r4")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


R4_SQL = f"""WITH ev AS (SELECT event_id, ts::TIMESTAMP AS ts, time_bucket(INTERVAL 5 MINUTE, ts::TIMESTAMP) AS start, unnest([event_type, CAST(user_id AS VARCHAR), 'total', 'num']) AS word FROM events),
m AS (SELECT max(ts) FILTER (WHERE event_id % 4 <> 0) - INTERVAL 10 MINUTE AS first, max(ts) - INTERVAL 10 MINUTE AS final FROM ev),
k AS (SELECT word, CASE WHEN word = 'num' THEN '{T.NUMBER}' ELSE {P.classify_sql('word')} END AS type FROM (SELECT DISTINCT word FROM ev))
SELECT start, type, count(*) AS n FROM ev JOIN k USING (word), m WHERE type IS NOT NULL AND start + INTERVAL 5 MINUTE <= date_trunc('millisecond', final) AND (event_id % 4 <> 0 OR start + INTERVAL 5 MINUTE > date_trunc('millisecond', first)) GROUP BY 1, 2"""

QUERIES = {
    "t5_singular": t5_singular, "t6_roles": t6_roles, "t6_box_roles": t6_box_roles, "t7_parse_date": t7_dates, "t8_shift_date": t8_shift, "t9_date_order": t9_order, "t16_industry": t16_industry, "t16_locale": t16_locale,
    "t17_scrub": t17_scrub, "t18_scrub_quote": t18_quotes, "t19_near_words": t19_near, "m1_person_org": m1_person_org, "m2_pack_lines": m2_pack, "m3_context_hits": m3_context, "m4_ctc_decode": m4_ctc, "m5_scorer": m5_scorer,
    "m6_regions": m6_regions, "r1_changed_box": r1_changes, "r2_watch_redraws": r2_watch, "r3_latest_run": r3_latest, "r3_latest_run_stream": r3_latest_stream, "r4_mask_stream": r4_mask_stream,
}
SQL = {
    "t5_singular": T5_SQL, "t6_roles": T6_SQL, "t6_box_roles": T6_BOX_SQL, "t7_parse_date": T7_SQL, "t8_shift_date": T8_SQL, "t9_date_order": T9_SQL, "t16_industry": T16_SQL, "t16_locale": T16L_SQL, "t17_scrub": T17_SQL, "t18_scrub_quote": T18_SQL, "t19_near_words": T19_SQL,
    "m1_person_org": M1_SQL, "m3_context_hits": M3_SQL, "m4_ctc_decode": M4_SQL, "m5_scorer": M5_SQL, "r1_changed_box": R1_SQL, "r3_latest_run": R3_SQL, "r3_latest_run_stream": R3_STREAM_SQL, "r4_mask_stream": R4_SQL,
}
