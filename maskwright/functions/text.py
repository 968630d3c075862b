"""Token rules as Column expressions: stripping, classification, closeness of spellings, scrubbing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.columns import once

#: White space as ECMAScript has it (with U+00A0 and U+FEFF, without U+0085); the inside of a character class.
JS_WS = "\\t\\n\\x{0B}\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"

#: Neutral words of reports that stay readable by default; callers pass longer lists as a parameter.
NEUTRAL = tuple(
    "the of and in to is for it by with that at are be was on an from this or as not no all by per new open closed total "
    "average count rate sum share date day week month quarter year time name type status region area city country store "
    "order orders sales revenue cost price margin profit budget target actual plan growth change trend top bottom page "
    "report summary detail details overview chart table filter north south east west jan feb mar apr may jun jul aug sep "
    "oct nov dec der die das und von zu den mit ist de la le les et des un une en el los las que".split()
)

# Names of the text types.
CLIENT, EMAIL, IDENTIFIER, NUMBER, TEXT = "Client name", "Email", "Identifier", "Number or money", "Text not on allowlist"

# Patterns of the token rules.
STRIP = r"\A[^\p{L}\p{N}_€$£¥₹%#@]+|[^\p{L}\p{N}_€$£¥₹%]+\z"
#: Tokens that ``STRIP`` leaves as they are.
BARE = r"(?s)\A[#@]?+(?:[\p{L}\p{N}_€$£¥₹%]|[\p{L}\p{N}_€$£¥₹%].*[\p{L}\p{N}_€$£¥₹%])\z"
#: Tokens of two letters or more and nothing else.
PLAIN = r"\A\p{L}{2,}+\z"
YEAR = r"\A(19|20)[0-9]{2}\z"
PERIOD = r"(?i)\A(q[1-4]|h[12]|fy[0-9]{2,4}|w[0-9]{1,2}|p[0-9]{1,2})\z"
WINDOW = r"(?i)\A[lrtpn][0-9]{1,3}[dwmqy]\z"
QUARTERS = r"(?i)\Aq[1-4][-–]q[1-4]\z"
FISCAL = r"(?i)\Afy[0-9]{2}[-–/][0-9]{2}\z"
YEARS = r"\A(19|20)[0-9]{2}[-–/]((19|20)?[0-9]{2})\z"
RANK = r"\A#[0-9]{1,2}\z"
CODE = r"[A-Za-z]{2,}[-_]?[0-9]{3,}|[0-9]{3,}[-_][A-Za-z]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_array(words: Sequence[str] | Column) -> Column:
    return words if isinstance(words, Column) else F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"\\A[{JS_WS}]+|[{JS_WS}]+\\z", "")


def clean_token(c: Column | str) -> Column:
    return F.regexp_replace(js_trim(_col(c)), STRIP, "")


def core(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"\A[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", "")


def norm_word(c: Column | str) -> Column:
    return F.replace(F.lower(core(c)), F.lit("’"), F.lit("'"))


def session_key(c: Column | str) -> Column:
    bare = F.regexp_replace(F.replace(_col(c), F.lit("’"), F.lit("'")), r"[^\p{L}\p{N}_'-]", "")
    return F.regexp_replace(bare, r"\A'+|'+\z", "")


def has(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def is_client(low: Column, clients: Column) -> Column:
    return F.exists(clients, lambda n: (n != "") & (F.contains(low, n) | F.array_contains(F.split(n, f"[{JS_WS}]+"), low)))


def is_period(clean: Column) -> Column:
    out = has(clean, YEAR)
    for p in (PERIOD, WINDOW, QUARTERS, FISCAL, YEARS, RANK):
        out = out | has(clean, p)
    return out


def _rules(allow: Sequence[str] | Column, clients: Sequence[str] | Column, session: Sequence[str] | Column) -> Callable[[Column, Column, Column], Column]:
    """The type of a token from its trimmed, stripped and lower-case forms. The first rule that applies decides."""
    names, none = words_array(clients), F.lit(None).cast("string")
    with_session = isinstance(session, Column) or bool(session)
    # a list of words is looked up by hash
    allowed = (lambda w: F.array_contains(allow, w)) if isinstance(allow, Column) else (lambda w: w.isin(*allow)) if allow else (lambda w: F.lit(False))

    def rules(raw: Column, clean: Column, low: Column) -> Column:
        parts = F.filter(F.split(F.replace(low, F.lit("’"), F.lit("'")), "[-/&']"), lambda p: p != "")
        safe = allowed(low)
        if with_session:
            safe = safe | F.array_contains(words_array(session), session_key(low))
        compound = has(low, "[-/&'’]") & (F.size(parts) > 1) & F.exists(parts, lambda p: F.length(p) > 1) & F.forall(parts, lambda p: (F.length(p) <= 1) | allowed(p))
        plain = lambda w: w.when(F.length(clean) <= 1, none).when(safe, none).when(compound, none).otherwise(TEXT)
        # tokens without digit, @, currency or percent sign can only be words: the other patterns need one of those
        marked = (
            F.when(has(raw, r"[A-Za-z0-9_]@[A-Za-z0-9_]") | (F.contains(raw, F.lit("@")) & F.contains(raw, F.lit("."))), EMAIL)
            .when(is_period(clean), none)
            .when(has(clean, CODE), IDENTIFIER)
            .when(~has(clean, r"[\p{L}\p{N}]"), none)
            .when(has(clean, r"[0-9€$£¥₹%]"), NUMBER)
        )
        word = F.when(~has(clean, r"[\p{L}\p{N}]"), none)
        out = F.when(clean == "", none)
        if not isinstance(clients, Column) and not clients:
            pass
        else:
            out = out.when(is_client(low, names), CLIENT)
        return out.when(has(raw, r"[0-9@€$£¥₹%]"), plain(marked)).otherwise(plain(word))

    return rules


def _forms(c: Column) -> tuple[Column, Column]:
    """The trimmed and the stripped form; most tokens have nothing to strip: their first and last characters say so."""
    bare = has(c, BARE)
    return F.when(bare, c).otherwise(js_trim(c)), F.when(bare, c).otherwise(clean_token(c))


def classify(c: Column | str, allow: Sequence[str] | Column = NEUTRAL, clients: Sequence[str] | Column = (), session: Sequence[str] | Column = ()) -> Column:
    """The text type of one token, null when it may stay readable. The first rule that applies decides."""
    rules = _rules(allow, clients, session)
    # the stripped forms are made once per token and bound by a lambda
    raw, clean = _forms(_col(c))
    token = F.array(F.struct(raw.alias("raw"), clean.alias("clean"), F.lower(clean).alias("low")))
    return F.when(_col(c).isNotNull(), F.element_at(F.transform(token, lambda t: rules(t["raw"], t["clean"], t["low"])), 1))


def with_type(df: DataFrame, c: str = "text", name: str = "type", allow: Sequence[str] = NEUTRAL, clients: Sequence[str] = ()) -> DataFrame:
    """``df`` with the ``classify`` of a column: for tables, where each form and the type are worked out once a row."""
    t, low = F.col(c), F.col("_low")
    raw, clean = _forms(t)
    rules = _rules(allow, clients, ())(F.col("_raw"), F.col("_clean"), low)
    if not clients:
        # most tokens are letters alone: nothing to strip, no rule but the list
        safe = low.isin(*allow) if allow else F.lit(False)
        rules = F.when(F.col("_plain"), F.when(~safe, TEXT)).otherwise(rules)
    plain = F.col("_plain")
    forms = once(once(df, _plain=t.rlike(PLAIN)), _raw=F.when(plain, t).otherwise(raw), _clean=F.when(plain, t).otherwise(clean))
    return once(once(forms, _low=F.lower("_clean")), **{name: F.when(t.isNotNull(), rules)}).drop("_plain", "_raw", "_clean", "_low")


def squash(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def near_word(a: Column, b: Column) -> Column:
    """Close spellings: one inside the other with a length ratio of 0.6, or two edits apart; both of four letters or more."""
    la, lb = F.length(a), F.length(b)
    inside = F.contains(a, b) | F.contains(b, a)
    return (F.least(la, lb) >= 4) & F.when(inside, F.least(la, lb) >= 0.6 * F.greatest(la, lb)).otherwise((F.abs(la - lb) <= 2) & (F.levenshtein(a, b) <= 2))


def is_subsequence(a: Column, b: Column) -> Column:
    """Whether the characters of a occur in b in this order."""
    chars = F.split(b, "")
    left = F.aggregate(chars, a, lambda rest, c: F.when((c != "") & F.startswith(rest, c), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest))
    return left == ""


def one_off(a: Column, b: Column) -> Column:
    """Equal length and at most one character different."""
    return (F.length(a) == F.length(b)) & (F.size(F.filter(F.arrays_zip(F.split(a, "").alias("p"), F.split(b, "").alias("q")), lambda z: z["p"] != z["q"])) <= 1)


# What is taken out of free text, and how much of it is kept.
SECRETS = ((r"sk-[A-Za-z0-9_-]{8,}", "[key removed]"), (r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+", "[email removed]"))
SCRUB_LIMIT = 400


def scrub(c: Column | str, own_hosts: Sequence[str] = ("localhost",)) -> Column:
    """Free text without API keys, email addresses and links that name none of ``own_hosts`` (patterns); 400 characters."""
    out = F.coalesce(_col(c), F.lit(""))
    for pattern, mark in SECRETS:
        out = F.regexp_replace(out, pattern, mark)
    own = f"(?![^{JS_WS})]*(?:{'|'.join(own_hosts)}))" if own_hosts else ""
    return F.substring(F.regexp_replace(out, rf"https?://{own}[^{JS_WS})]+", "[link removed]"), 1, SCRUB_LIMIT)


def scrub_quote(c: Column, vocabulary: Column, clients: Column | Sequence[str] = (), known: Sequence[str] = NEUTRAL, limit: int = 400) -> Column:
    """A quote of at most ``limit`` characters in which words outside the kept vocabulary become […]."""
    hidden, names, common = F.lit("[…]"), words_array(clients), words_array(known)
    ok = lambda w: F.array_contains(vocabulary, w) | F.array_contains(common, w)

    def one(tok: Column) -> Column:
        lc = norm_word(tok)
        parts = F.filter(F.split(lc, "[-']"), lambda p: p != "")
        return (
            F.when(tok.rlike(r"(?i)\A\[(…|\.\.\.|hidden|redacted|masked|client|name)\][^A-Za-z0-9_]*\z"), hidden)
            .when(lc == "", tok)
            .when(tok.rlike(r"(?i)[0-9]|@|https?:|www\."), hidden)
            .when(is_client(lc, names), hidden)
            .when(ok(lc) | (lc.rlike("[-']") & F.forall(parts, ok)), tok)
            .otherwise(hidden)
        )

    tokens = F.filter(F.split(F.substring(F.coalesce(c, F.lit("")), 1, limit), f"[{JS_WS}]+"), lambda t: t != "")
    joined = F.array_join(F.transform(tokens, one), " ")
    runs = F.regexp_replace(joined, r"(\[…\][^\s\p{L}\p{N}]*\s*){2,}", "[…] ")
    return js_trim(F.regexp_replace(runs, r"\s+([.,!?;:])", "$1"))
