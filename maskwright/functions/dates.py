"""Dates in text: recognition in seven formats, and moving them back by whole months in the format they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and date formats.
MONTHS = "january february march april may june july august september october november december".split()
MONTH = "|".join(f"{m[:3]}" + "".join(f"(?:{c}" for c in m[3:]) + ")?" * (len(m) - 3) for m in MONTHS)
FORMATS = (
    ("iso", r"\A((?:19|20)[0-9]{2})([-/.])([0-9]{1,2})(?:\2([0-9]{1,2}))?\z"),
    ("num", r"\A([0-9]{1,2})([-/.])([0-9]{1,2})\2((?:19|20)?[0-9]{2})\z"),
    ("mon_year", r"\A([0-9]{1,2})([-/.])((?:19|20)[0-9]{2})\z"),
    ("mon_yy", r"\A(0[1-9]|1[0-2])([-/])([0-9]{2})\z"),
    ("name_year", rf"(?i)\A({MONTH}\.?)([\s\-/]*['’]?)((?:19|20)[0-9]{{2}}|[0-9]{{2}})\z"),
    ("name_day", rf"(?i)\A({MONTH}\.?)(\s*)([0-9]{{1,2}})(st|nd|rd|th)?(?:(,?\s*)((?:19|20)[0-9]{{2}}))?\z"),
    ("day_name", rf"(?i)\A([0-9]{{1,2}})(st|nd|rd|th)?([\s\-/.]+)({MONTH}\.?)(?:([\s\-/.,]+)((?:19|20)[0-9]{{2}}|[0-9]{{2}}))?\z"),
)
PATTERN = dict(FORMATS)


def bare(c: Column) -> Column:
    """Without brackets around and marks behind; a zero read for the O of October is mended."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"\A[(\[]*", ""), r"[.,;:)\]]*\z", "")
    return F.regexp_replace(t, r"(?i)\b0(ct|ctober)\b", "O$1")


def _int(c: Column) -> Column:
    return F.expr("null").cast("int") if c is None else F.when(c != "", c).cast("int")


def _month_no(name: Column) -> Column:
    return ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(F.lower(name), 1, 3)) + 2) / 3).cast("int")


def _full_year(s: Column) -> Column:
    return F.when(F.length(s) == 2, 2000 + _int(s)).otherwise(_int(s))


def parse_date(c: Column, order: Column | str = "mdy") -> Column:
    """struct(format, year, month, day) of a date, null where the text is none. Month 1-12; year or day may be null.

    ``order``: how the page writes dates of numbers, unless this one can only be read the other way.
    """
    order = F.lit(order) if isinstance(order, str) else order
    return F.when(c.isNotNull(), F.element_at(F.transform(F.array(bare(c)), lambda t: _parse(t, order)), 1))


def _parse(t: Column, order: Column) -> Column:
    g = lambda f, i: F.regexp_extract(t, PATTERN[f], i)
    n1, n2 = _int(g("num", 1)), _int(g("num", 3))
    dmy = (n1 > 12) | ((order == "dmy") & (n2 <= 12))
    none = F.lit(None).cast("int")
    s = lambda f, y, m, d: F.struct(F.lit(f).alias("format"), y.cast("int").alias("year"), m.cast("int").alias("month"), d.cast("int").alias("day"))
    parts = {
        "iso": s("iso", _int(g("iso", 1)), _int(g("iso", 3)), _int(g("iso", 4))),
        "num": s("num", _full_year(g("num", 4)), F.when(dmy, n2).otherwise(n1), F.when(dmy, n1).otherwise(n2)),
        "mon_year": s("mon_year", _int(g("mon_year", 3)), _int(g("mon_year", 1)), none),
        "mon_yy": s("mon_yy", _full_year(g("mon_yy", 3)), _int(g("mon_yy", 1)), none),
        "name_year": s("name_year", _full_year(g("name_year", 3)), _month_no(g("name_year", 1)), none),
        "name_day": s("name_day", _int(g("name_day", 6)), _month_no(g("name_day", 1)), _int(g("name_day", 3))),
        "day_name": s("day_name", _full_year(g("day_name", 6)), _month_no(g("day_name", 4)), _int(g("day_name", 1))),
    }
    ok = lambda p: p["month"].between(1, 12) & (p["day"].isNull() | p["day"].between(1, 31))
    return F.coalesce(*(F.when(t.rlike(pattern), F.get(F.filter(F.array(parts[f]), ok), F.lit(0))) for f, pattern in FORMATS))


def months_back(seed: int) -> int:
    return 1 + (seed % 2**32 % 997) % 5


def day_on(day: Column, seed: int) -> Column:
    """Another day of the month, a few days on; or before, at the month's end."""
    j = 2 + seed % 2**32 % 4
    return F.when(day + j <= 28, day + j).otherwise(F.greatest(F.lit(1), day - j))


def fake_day(c: Column, seed: int) -> Column:
    """A bare day of the month beside a month that stays readable: another day, same padding and marks."""
    p = r"\A([^0-9]*)([0-9]{1,2})([^0-9]*)\z"
    t, d = F.trim(c), F.regexp_extract(F.trim(c), p, 2)
    new = F.lpad(day_on(_int(d), seed).cast("string"), F.length(d), "0")
    wide = F.when(F.length(day_on(_int(d), seed).cast("string")) > F.length(d), day_on(_int(d), seed).cast("string")).otherwise(new)
    return F.when(t.rlike(p) & _int(d).between(1, 31), F.concat(F.regexp_extract(t, p, 1), wide, F.regexp_extract(t, p, 3)))


def _pad(n: Column, width: Column | int) -> Column:
    s = n.cast("string")
    width = F.lit(width) if isinstance(width, int) else width
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def _month_name(no: Column, like: Column) -> Column:
    """Month ``no`` written as ``like`` writes its own: full or short, its case, its dot."""
    word, dot = F.regexp_replace(like, r"\.\z", ""), F.regexp_extract(like, r"\.\z", 0)
    full = F.element_at(F.array(*map(F.lit, MONTHS)), no)
    name = F.when((F.length(word) > 4) & F.lower(word).isin(*MONTHS), full).when((F.lower(word) == "sept") & (no == 9), "sept").otherwise(F.substring(full, 1, 3))
    cased = F.when(word == F.upper(word), F.upper(name)).when(word.rlike(r"\A[A-Z]"), F.initcap(name)).otherwise(name)
    return F.concat(cased, dot)


def shift_date(c: Column, seed: int, order: Column | str = "mdy") -> Column:
    """The same date moved back by the seed's 1 to 5 months, in its own format; null where the text is no date.

    The day stays unless the new month is shorter; without a year only the day moves.
    """
    bound = F.array(F.struct(F.trim(c).alias("raw"), bare(c).alias("t"), parse_date(c, order).alias("p")))
    return F.when(c.isNotNull(), F.element_at(F.transform(bound, lambda b: _shift(b["raw"], b["t"], b["p"], seed, order)), 1))


def _shift(raw: Column, t: Column, p: Column, seed: int, order: Column | str) -> Column:
    pre = F.regexp_extract(raw, r"\A[(\[]*", 0)
    post = F.regexp_extract(F.regexp_replace(raw, r"\A[(\[]*", ""), r"[.,;:)\]]*\z", 0)
    k = p["year"] * 12 + p["month"] - 1 - months_back(seed)
    y, m = F.floor(k / 12).cast("int"), (F.pmod(k, F.lit(12)) + 1).cast("int")
    d = F.least(p["day"], F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1)))))
    g = lambda f, i: F.regexp_extract(t, PATTERN[f], i)
    year = lambda s: F.when(F.length(s) == 2, _pad(y % 100, 2)).otherwise(y.cast("string"))
    zero = g("num", 1).startswith("0") | g("num", 3).startswith("0")
    dd, mm = F.when(zero, _pad(d, 2)).otherwise(d.cast("string")), F.when(zero, _pad(m, 2)).otherwise(m.cast("string"))
    dmy = (_int(g("num", 1)) > 12) | (((F.lit(order) if isinstance(order, str) else order) == "dmy") & (_int(g("num", 3)) <= 12))
    sep = g("num", 2)
    bare_day = day_on(p["day"], seed)
    out = {
        "iso": F.concat(y.cast("string"), g("iso", 2), _pad(m, F.length(g("iso", 3))), F.when(p["day"].isNull(), "").otherwise(F.concat(g("iso", 2), _pad(d, F.length(g("iso", 4)))))),
        "num": F.concat(F.when(dmy, F.concat(dd, sep, mm)).otherwise(F.concat(mm, sep, dd)), sep, year(g("num", 4))),
        "mon_year": F.concat(F.when(g("mon_year", 1).startswith("0"), _pad(m, 2)).otherwise(m.cast("string")), g("mon_year", 2), y.cast("string")),
        "mon_yy": F.concat(_pad(m, 2), g("mon_yy", 2), _pad(y % 100, 2)),
        "name_year": F.concat(_month_name(m, g("name_year", 1)), g("name_year", 2), year(g("name_year", 3))),
        "name_day": F.concat(
            _month_name(F.coalesce(m, p["month"]), g("name_day", 1)), F.when(g("name_day", 2) == "", " ").otherwise(g("name_day", 2)), _pad(F.coalesce(d, bare_day), F.length(g("name_day", 3))),
            g("name_day", 4), F.when(p["year"].isNull(), "").otherwise(F.concat(g("name_day", 5), y.cast("string"))),
        ),
        "day_name": F.concat(
            _pad(F.coalesce(d, bare_day), F.length(g("day_name", 1))), g("day_name", 2), g("day_name", 3), _month_name(F.coalesce(m, p["month"]), g("day_name", 4)),
            F.when(p["year"].isNull(), "").otherwise(F.concat(g("day_name", 5), year(g("day_name", 6)))),
        ),
    }
    moved = F.lit(None).cast("string")
    for f, v in out.items():
        moved = F.when(p["format"] == f, v).otherwise(moved)
    return F.when(p.isNotNull(), F.concat(pre, moved, post))


def date_order(df: DataFrame, text: str = "text", key: str = "image_id") -> DataFrame:
    """Per page "dmy" where more dates of numbers begin with a number over 12 than have one second, else "mdy"."""
    t = F.regexp_replace(F.trim(F.col(text)), r"[.,;:)]+\z", "")
    first, second = F.regexp_extract(t, PATTERN["num"], 1), F.regexp_extract(t, PATTERN["num"], 3)
    votes = df.groupBy(key).agg(F.count(F.when(_int(first) > 12, 1)).alias("dmy"), F.count(F.when(_int(second) > 12, 1)).alias("mdy"))
    return votes.select(key, F.when(F.col("dmy") > F.col("mdy"), "dmy").otherwise("mdy").alias("date_order"))
