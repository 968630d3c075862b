"""Invented numbers that keep the shape of the real ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.dates import shift_date

#: Digits of a number that is scaled; longer runs get new digits one by one.
SCALED = 15
#: Draws of a factor, and of digits where no factor fits.
TRIES = 8


def _unit(key: Column, seed: int | Column, what: Column) -> Column:
    """A number from 0 to 1 (exclusive)."""
    own = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.conv(F.substring(F.md5(F.concat_ws("|", key, own, what).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def fake_value(c: Column, seed: int | Column, exact: Column | None = None, value_years: Column | None = None) -> Column:
    """``c`` with every number made up: as many digits before and after the point, same sign, currency, unit, separators.

    A number is scaled by 0.55 to 0.85 or 1.18 to 1.8 and never stays; percentages stay within 100, a rating within its
    scale, which stays itself; lone years stay; minutes and seconds stay valid; long runs of digits get new ones. Dates are
    the business of ``shift_date``, of whole texts ``fake_text``. Equal texts get equal values for one seed.

    ``exact``: the value that the text's main number, its longest, shows instead (a tick of an axis that was made anew; 0
    stays 0), if it has as many digits; null for none. ``value_years``: numbers like years that are values on this page.
    """
    run = r"[0-9](?:[0-9,]*[0-9])?(?:\.[0-9]+)?"
    pieces = F.regexp_extract_all(c, F.lit(rf"({run}|[^0-9]+)"), F.lit(1))

    def main(all_: Column) -> Column:
        sizes = F.transform(all_, lambda p: F.when(p.rlike(r"\A[0-9]"), F.length(p)).otherwise(0))
        return F.array_position(sizes, F.array_max(sizes)) - 1

    ten = lambda k: F.pow(F.lit(10.0), k)

    # every step's columns are bound before the next one uses them, for each may be used many times
    def one(all_: Column, i: Column) -> Column:
        near = lambda k: F.coalesce(F.get(all_, i + k), F.lit(""))
        mine = (exact.isNotNull() & (i == main(all_))) if exact is not None else F.lit(False)
        seen = F.struct(
            F.get(all_, i).alias("piece"), near(-1).alias("before"), near(1).alias("after"), near(2).alias("next"), mine.alias("mine"), i.alias("i"),
            F.array_join(all_, "").rlike(r"(?i)[ap]\.?m").alias("noon"), F.concat_ws("#", c, i.cast("string")).alias("key"),
        )
        return F.when(~F.get(all_, i).rlike(r"\A[0-9]"), F.get(all_, i)).otherwise(_bound(seen, number))

    def number(t: Column) -> Column:
        u = lambda what, k: _unit(t["key"], seed, F.concat(F.lit(what), k.cast("string")))
        piece, before, after = t["piece"], t["before"], t["after"]
        year = piece.rlike(r"\A(19|20)[0-9]{2}\z")
        if value_years is not None:
            year = year & ~F.coalesce(F.array_contains(value_years, piece), F.lit(False))
        zero = (t["mine"] & (exact == 0)) if exact is not None else F.lit(False)
        n = F.length(piece)
        minutes = F.lpad(F.floor(u("m", t["i"]) * 60).cast("int").cast("string"), F.greatest(n, F.lit(2)), "0")
        clock = before.endswith(":") | (after.startswith(":") & t["next"].rlike(r"\A[0-5][0-9]\z"))
        hour = F.floor(u("o", t["i"]) * F.when(t["noon"], 12).otherwise(24)).cast("int")
        hours = F.when(t["noon"] & (hour == 0), F.lit("12")).otherwise(F.lpad(hour.cast("string"), n, "0"))
        whole, dec = F.regexp_replace(F.element_at(F.split(piece, r"\."), 1), ",", ""), F.coalesce(F.get(F.split(piece, r"\."), F.lit(1)), F.lit(""))
        scale = F.when(after.rlike(r"\A\s*/\s*\z"), F.regexp_replace(t["next"], ",", "").try_cast("double"))
        short = F.length(whole) + F.length(dec) <= SCALED
        parts = F.struct(
            t.alias("t"), F.length(whole).alias("n_whole"), F.length(dec).alias("n_dec"), short.alias("short"), F.when(short, F.concat(whole, dec).cast("bigint")).alias("value"),
            ten(F.length(dec)).alias("unit"), F.trim(after).startswith("%").alias("percent"), (F.least(F.when(F.trim(after).startswith("%"), 100.0), scale) * ten(F.length(dec))).alias("most"),
        )
        return (
            F.when(year | before.rlike(r"/\s*\z"), piece)
            .when(zero, F.regexp_replace(F.regexp_replace(piece, "[0-9]", "0"), r"\A0+(?=0)", ""))
            .when(before.endswith(":"), minutes)
            .when(clock, hours)
            .otherwise(_bound(parts, lambda p: _bound(F.struct(p.alias("p"), drawn_value(p).alias("x")), written_like)))
        )

    def fits(p: Column, x: Column) -> Column:
        int_part = F.floor(x / p["unit"])
        right = (int_part < ten(p["n_whole"])) & ((p["n_whole"] == 1) | (int_part >= ten(p["n_whole"] - 1)))
        return (x > 0) & (x != p["value"]) & right & (p["most"].isNull() | (x <= p["most"]))

    def drawn_value(p: Column) -> Column:
        """The new number in units of its last decimal."""
        t, unit, most, n_whole = p["t"], p["unit"], p["most"], p["n_whole"]
        u = lambda what, k: _unit(t["key"], seed, F.concat(F.lit(what), k.cast("string")))
        ok = lambda x: F.when(fits(p, x), x)
        scaled = lambda k: F.floor(p["value"] * F.when(u("f", k) < 0.5, 0.55 + u("r", k) * 0.3).otherwise(1.18 + u("r", k) * 0.62) + 0.5)

        def drawn(k: Column) -> Column:
            low = F.when(n_whole == 1, 1.0).otherwise(ten(n_whole - 1))
            x = F.floor((low + F.floor(u("d", k) * (ten(n_whole) - low))) * unit + F.floor(u("e", k) * unit))
            return F.when(most.isNull() | (x <= most), x).otherwise(F.floor(most * (0.5 + 0.45 * u("c", k))))

        more = F.sequence(F.lit(1), F.lit(TRIES - 1))
        high = F.floor((90 + F.floor(u("h", t["i"]) * 10)) * unit + F.floor(u("g", t["i"]) * unit))  # 100 % becomes a high percentage
        tries = [_bound(scaled(F.lit(0)), ok), F.get(F.filter(F.transform(more, scaled), lambda x: fits(p, x)), F.lit(0))]
        tries += [F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), drawn), lambda x: x != p["value"]), F.lit(0))]
        if exact is not None:
            tries = [F.when(t["mine"], _bound(F.floor(exact * unit + 0.5), ok)), *tries]
        return F.when(p["short"], F.when(p["percent"] & (p["value"] >= 100 * unit), high).otherwise(F.coalesce(*tries)))

    def written_like(b: Column) -> Column:
        """The number with the decimals and separators of the real one."""
        p, t = b["p"], b["p"]["t"]
        n_whole, n_dec, comma = p["n_whole"], p["n_dec"], F.contains(t["piece"], F.lit(","))
        u = lambda k: _unit(t["key"], seed, F.concat(F.lit("n"), k.cast("string")))
        size = F.when(p["percent"] & (p["value"] >= 100 * p["unit"]), 2 + n_dec).otherwise(n_whole + n_dec)
        digit = lambda k: F.floor(F.when(k == 0, 1 + u(k) * 9).otherwise(u(k) * 10)).cast("int").cast("string")
        plain = b["x"].cast("bigint").cast("string")
        text = F.when(p["short"], F.when(F.length(plain) < size, F.lpad(plain, size, "0")).otherwise(plain)).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n_whole + n_dec - 1), digit), ""))

        def cut(x: Column) -> Column:
            left = F.substring(x, F.lit(1), F.length(x) - n_dec)
            left = F.when(comma, F.regexp_replace(left, r"(?<=[0-9])(?=(?:[0-9]{3})+\z)", ",")).otherwise(left)
            return F.when(n_dec > 0, F.concat(left, F.lit("."), F.substring(x, F.length(x) - n_dec + 1, n_dec))).otherwise(left)

        return _bound(text, cut)

    bound = F.transform(F.array(pieces), lambda p: F.array_join(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: one(p, i)), ""))
    return F.when(c.rlike("[0-9]"), F.element_at(bound, 1)).otherwise(c)


#: Draws of a scale for joined ticks.
TICK_TRIES = 40


def two_digits(x: Column) -> Column:
    """``x`` rounded to its first two digits."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 1)
    return F.when(x == 0, x).otherwise(F.floor(x / p + 0.5) * p)


def fake_ticks(c: Column, seed: int | Column) -> Column:
    """Three or more evenly stepped numbers in one text ("0 20 40 60") as another even scale; null where the text is none.

    As many numbers and decimals, thousands separated if they were; a scale from 0 starts at 0 again; no number is negative;
    the text is never the same and about as long. Steps are whole units of the last decimal, so that the scale stays even.
    """
    ticks = F.split(F.trim(c), r"\s+")
    plain = c.rlike(r"\A\s*[0-9][0-9,]*(\.[0-9]+)?(\s+[0-9][0-9,]*(\.[0-9]+)?){2,}\s*\z") & F.forall(ticks, lambda t: F.length(F.regexp_replace(t, "[^0-9]", "")) <= 12)
    decimals = F.array_max(F.transform(ticks, lambda t: F.length(F.regexp_extract(t, r"\.([0-9]+)\z", 1))))
    read = F.struct(F.array_join(ticks, " ").alias("joined"), F.transform(ticks, lambda t: F.regexp_replace(t, ",", "").try_cast("double")).alias("vals"), decimals.alias("dec"))

    def scaled(t: Column) -> Column:
        """Of the draws the first that fits."""
        joined, vals, dec, first = t["joined"], t["vals"], t["dec"], F.get(t["vals"], F.lit(0))
        step, unit = F.get(vals, F.lit(1)) - first, F.pow(F.lit(10.0), dec)
        even = (step != 0) & F.forall(F.transform(vals, lambda v, i: F.abs(v - first - i * step)), lambda d: d <= F.abs(step) * 0.01)

        def drawn(k: Column) -> Column:
            u = lambda what: _unit(joined, seed, F.concat(F.lit(what), k.cast("string")))
            factor = F.when(u("tick f") < 0.5, 0.55 + u("tick r") * 0.3).otherwise(1.18 + u("tick r") * 0.62)
            whole = lambda x: F.floor(two_digits(x) * unit + 0.5)
            return _bound(factor, lambda f: F.struct(F.when(first == 0, F.lit(0).cast("bigint")).otherwise(whole(first * f)).alias("begin"), whole(step * f).alias("by")))

        def shown(s: Column) -> Column:
            text = lambda v: F.call_function("format_number", (v / unit).cast("decimal(30,12)"), dec)
            scale = F.array_join(F.transform(vals, lambda _, i: text(s["begin"] + i * s["by"])), " ")
            return F.when(F.contains(joined, F.lit(",")), scale).otherwise(F.regexp_replace(scale, ",", ""))

        scales = F.filter(F.transform(F.sequence(F.lit(0), F.lit(TICK_TRIES - 1)), drawn), lambda s: (s["by"] != 0) & (s["begin"] >= 0) & (s["begin"] + (F.size(vals) - 1) * s["by"] >= 0))
        fits = lambda x: (x != joined) & (F.abs(F.length(x) - F.length(joined)) <= F.greatest(F.lit(2.0), F.length(joined) * 0.08))
        return F.when(even, F.get(F.filter(F.transform(scales, shown), fits), F.lit(0)))

    return F.when(plain, _bound(read, scaled))


def fake_text(c: Column, seed: int, order: Column | str = "mdy", exact: Column | None = None, value_years: Column | None = None) -> Column:
    """struct(made, how) of a number mask's text, by the first rule that applies.

    ``axis``: its value on an axis that was made anew is known. ``date``: the page's shift, in its own format. ``parts``: a
    value and a date that were read as one, each part by its own rule. ``ticks``: joined ticks, another even scale.
    ``value``: made-up numbers. ``order``: how the page writes dates of numbers.
    """
    none = F.lit(None).cast("double")
    known = none if exact is None else exact
    parts = F.filter(F.split(F.trim(c), r"\s+"), lambda p: p != "")
    # no date is without a separator or a month's name: most numbers need not be looked at any closer
    shifted = lambda p: F.when(p.rlike(r"[0-9].*[-/.]|[-/.].*[0-9]|\p{L}{3}") & p.rlike("[0-9]"), shift_date(p, seed, order))
    dated = F.transform(parts, shifted)

    def each(t: Column) -> Column:
        own = lambda p, i: F.coalesce(F.get(t["dates"], i), fake_value(p, F.concat(F.lit(f"{seed}#"), i.cast("string")), F.when(i == 0, known), value_years))
        return F.array_join(F.transform(t["parts"], own), " ")

    made = lambda text, how: F.struct(text.alias("made"), F.lit(how).alias("how"))
    date, ticks = shifted(c), fake_ticks(c, seed)
    mixed = _bound(F.struct(parts.alias("parts"), dated.alias("dates")), lambda t: F.when((F.size(t["parts"]) > 1) & F.exists(t["dates"], lambda d: d.isNotNull()), each(t)))
    return F.when(known.isNotNull(), made(fake_value(c, seed, known, value_years), "axis")).otherwise(
        F.coalesce(F.when(date.isNotNull(), made(date, "date")), F.when(mixed.isNotNull(), made(mixed, "parts")), F.when(ticks.isNotNull(), made(ticks, "ticks")), made(fake_value(c, seed, None, value_years), "value"))
    )


def _bound(c: Column, then) -> Column:
    """``then`` of a column that is computed once."""
    return F.get(F.transform(F.array(c), then), F.lit(0))
