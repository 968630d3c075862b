"""What the registered queries share: word tables of documents, and the same steps as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.cluster import ship
from maskwright.functions import text as T
from maskwright.sources.words import words_from_text


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_words(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    return words_from_text(read(spark, sf_dir, "documents"), "doc_id", "text", carry)


def draw(*key) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the key alone."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_sql(table: str = "documents", key: str = "doc_id", carry: str = "lang, source") -> str:
    more = f", {carry}" if carry else ""
    return f"""
ln AS (SELECT image_id{more}, i - 1 AS line_no, l[i] AS t FROM (SELECT CAST({key} AS VARCHAR) AS image_id{more}, string_split(text, chr(10)) AS l FROM {table}), unnest(range(1, len(l) + 1)) AS r(i)),
pc AS (SELECT image_id{more}, line_no, j AS piece, p[j] AS text FROM (SELECT *, regexp_split_to_array(t, '[{T.JS_WS}]') AS p FROM ln), unnest(range(1, len(p) + 1)) AS r(j)),
placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY image_id, line_no ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs FROM pc),
words AS (SELECT image_id{more}, line_no, row_number() OVER (PARTITION BY image_id ORDER BY line_no, piece) AS word_id, text, 95.0::DOUBLE AS conf,
          (offs * 7)::DOUBLE AS x, (line_no * 30)::DOUBLE AS y, (length(text) * 7)::DOUBLE AS w, 12.0::DOUBLE AS h FROM placed WHERE text <> '')"""


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '\\A[{T.JS_WS}]+|[{T.JS_WS}]+\\z', '', 'g')"


def clean_sql(c: str) -> str:
    return f"regexp_replace({trim_sql(c)}, {_q(T.STRIP)}, '', 'g')"


def core_sql(c: str) -> str:
    return f"regexp_replace({c}, '\\A[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+\\z', '', 'g')"


def list_sql(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]::VARCHAR[]"


def classify_sql(c: str, allow: str | None = None, clients: str = "[]::VARCHAR[]") -> str:
    """The classification as one CASE over a token column."""
    allow = allow or list_sql(T.NEUTRAL)
    clean, raw = clean_sql(c), trim_sql(c)
    low = f"lower({clean})"
    parts = f"list_filter(regexp_split_to_array(replace({low}, '’', ''''), '[-/&'']'), lambda p: p <> '')"
    period = " OR ".join(f"regexp_matches({clean}, {_q(p)})" for p in (T.YEAR, T.PERIOD, T.WINDOW, T.QUARTERS, T.FISCAL, T.YEARS, T.RANK))
    client = f"len(list_filter({clients}, lambda n: n <> '' AND (contains({low}, n) OR list_contains(regexp_split_to_array(n, '[{T.JS_WS}]+'), {low})))) > 0"
    return f"""CASE WHEN {clean} = '' THEN NULL
      WHEN {client} THEN {_q(T.CLIENT)}
      WHEN regexp_matches({raw}, '[A-Za-z0-9_]@[A-Za-z0-9_]') OR (contains({raw}, '@') AND contains({raw}, '.')) THEN {_q(T.EMAIL)}
      WHEN {period} THEN NULL
      WHEN regexp_matches({clean}, {_q(T.CODE)}) THEN {_q(T.IDENTIFIER)}
      WHEN NOT regexp_matches({clean}, '[\\p{{L}}\\p{{N}}]') THEN NULL
      WHEN regexp_matches({clean}, '[0-9€$£¥₹%]') THEN {_q(T.NUMBER)}
      WHEN length({clean}) <= 1 THEN NULL
      WHEN list_contains({allow}, {low}) THEN NULL
      WHEN len({parts}) > 1 AND len(list_filter({parts}, lambda p: length(p) > 1)) > 0
           AND len(list_filter({parts}, lambda p: length(p) > 1 AND NOT list_contains({allow}, p))) = 0 THEN NULL
      ELSE {_q(T.TEXT)} END"""


def typed_sql(of: str = "words") -> str:
    """Types by distinct token, joined back: the CASE is long."""
    return f"kinds AS (SELECT text, {classify_sql('text')} AS type FROM (SELECT DISTINCT text FROM {of})), typed AS (SELECT {of}.*, kinds.type FROM {of} JOIN kinds USING (text))"


def overlap_sql(a: str, b: str) -> str:
    w = f"greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    h = f"greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"({w} * {h} / least(CASE WHEN {a}.w * {a}.h = 0 THEN 1 ELSE {a}.w * {a}.h END, CASE WHEN {b}.w * {b}.h = 0 THEN 1 ELSE {b}.w * {b}.h END))"


def inside_sql(a: str, b: str) -> str:
    return f"({a}.x + {a}.w / 2 >= {b}.x AND {a}.x + {a}.w / 2 <= {b}.x + {b}.w AND {a}.y + {a}.h / 2 >= {b}.y AND {a}.y + {a}.h / 2 <= {b}.y + {b}.h)"


def cells_sql(name: str, of: str, reach: str = "0", reach_y: str = "0") -> str:
    """``of`` with a row per cell that a box touches: 256 pixels of a line of 30; bounds what spatial joins compare.

    The reaches widen the box to both sides.
    """
    span = lambda at, size, by, cell: f"unnest(range(floor(({at} - {by}) / {cell})::BIGINT, floor(({at} + {size} + {by}) / {cell})::BIGINT + 1))"
    return f"{name} AS (SELECT q.*, cell, ln FROM {of} q, {span('q.x', 'q.w', reach, 256)} AS c(cell), {span('q.y', 'q.h', reach_y, 30)} AS l(ln))"


def same_cell(a: str, b: str) -> str:
    return f"{a}.image_id = {b}.image_id AND {a}.ln = {b}.ln AND {a}.cell = {b}.cell"


#: Groups of flagged words in reading order (needs ``typed``): one row per flagged word with its mask number.
RUNS_SQL = """
o AS (SELECT *, floor(y / 8 + 0.5) AS band FROM typed WHERE type IS NOT NULL),
p AS (SELECT *, lag(type) OVER q AS pt, lag(x) OVER q AS px, lag(w) OVER q AS pw, lag(y) OVER q AS py, lag(h) OVER q AS ph FROM o WINDOW q AS (PARTITION BY image_id ORDER BY band, x, word_id)),
n AS (SELECT *, CASE WHEN pt = type AND abs(py + ph / 2 - (y + h / 2)) < greatest(ph, h) * 0.6 AND x - (px + pw) < greatest(14, h * 1.2) AND x >= px THEN 0 ELSE 1 END AS new FROM p),
runs AS (SELECT *, sum(new) OVER (PARTITION BY image_id ORDER BY band, x, word_id) AS mask_id FROM n),
masks AS (SELECT image_id, mask_id::BIGINT AS mask_id, type, string_agg(text, ' ' ORDER BY x, word_id) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h,
          min(conf) AS conf, count(*) AS n_words FROM runs GROUP BY image_id, mask_id, type)"""
