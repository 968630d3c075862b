"""Made-up words and addresses that keep the shape of what they replace; equal keys get equal values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.text import NEUTRAL, words_array

#: Neutral words by length, one letter to twelve.
POOL = (
    ("a", "o"), ("at", "by", "go", "up"), ("day", "sun", "map", "pen", "oak"), ("leaf", "moon", "path", "sand", "tree"), ("cloud", "field", "light", "river", "stone"),
    ("bridge", "garden", "meadow", "planet", "window"), ("balance", "blanket", "morning", "picture", "village"), ("daylight", "mountain", "notebook", "painting", "sunlight"),
    ("adventure", "butterfly", "landscape", "telescope", "waterfall"), ("background", "blackboard", "generation", "playground", "strawberry"), ("candlelight", "countryside", "imagination", "temperature", "wheelbarrow"),
    ("architecture", "refrigerator", "neighborhood", "presentation", "conversation"),
)
#: Domains that are reserved for examples.
DOMAINS = ("example.com", "example.org", "example.net")


def draw(key: Column, seed: int, what: str) -> Column:
    """A number from 0 to 2^32 - 1 from the key, the seed and a name of what is drawn."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(str(seed)), F.lit(what)).cast("binary")), 1, 8), 16, 10).cast("bigint")


def fake_word(c: Column, seed: int) -> Column:
    """A neutral word of the same length and capitalisation; longer words are put together from two."""
    n = F.length(c)
    pools = F.array(*(F.array(*map(F.lit, words)) for words in POOL))

    def of(length: Column, what: str) -> Column:
        pool = F.get(pools, length - 1)
        return F.get(pool, (draw(F.lower(c), seed, what) % F.size(pool)).cast("int"))

    top = len(POOL)
    tail = F.repeat(F.lit("lorem"), 20)
    word = F.when(n <= top, of(n, "word")).otherwise(F.concat(of(F.lit(top), "word"), F.substring(tail, F.lit(1), n - top)))
    word = F.when(n > top + 100, F.rpad(word, n, "lorem")).otherwise(word)
    cased = F.when(c == F.upper(c), F.upper(word)).when(F.substring(c, 1, 1) == F.upper(F.substring(c, 1, 1)), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), n))).otherwise(word)
    return F.when(c.isNotNull() & (n > 0), cased).otherwise(c)


def fake_letters(c: Column, seed: int, safe: Sequence[str] | Column = NEUTRAL) -> Column:
    """A code or path whose runs of three letters or more are made up, but for ``safe`` words (lower case).

    A run gets the same word wherever it stands and whatever its case, which the word takes over; all else stays.
    """
    known = words_array(safe)
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    one = lambda run: F.when(run.rlike(r"\A\p{L}{3,}\z") & ~F.array_contains(known, F.lower(run)), fake_word(run, seed)).otherwise(run)
    return F.when(c.isNotNull(), F.array_join(F.transform(runs, one), ""))


def fake_email(c: Column, seed: int) -> Column:
    """An address at a reserved domain with a local part about as long as the original leaves room for."""
    room = F.greatest(F.lit(3), F.least(F.length(c) - 12, F.lit(12)))
    name = F.get(F.array(*(F.array(*map(F.lit, words)) for words in POOL)), room - 1)
    local = F.get(name, (draw(F.lower(c), seed, "mail") % F.size(name)).cast("int"))
    host = F.get(F.array(*map(F.lit, DOMAINS)), (draw(F.lower(c), seed, "host") % len(DOMAINS)).cast("int"))
    return F.concat(local, F.lit("@"), host)


# Made-up names: parameters of ``fake_entity`` where others are wanted.
GIVEN = tuple("Alma Bruno Celia Dario Edda Felix Greta Hugo Ilona Jonas Karla Leon Mira Nils Olga Pavel Rhea Simon Thea Urs Vera Wanda Yara Zeno".split())
FAMILY = tuple("Aldern Brisk Corvin Dalloway Ebers Fennick Garrow Hale Ivers Jessop Kittel Lorne Marlow Norwin Ostrey Pellam Quill Rusk Selwin Tarrow Ulver Vasey Wexley Yarrow".split())
TOWNS = tuple("Aldmere Birchford Coldwick Dunholt Eastfen Farley Greywater Hollowbrook Inchmere Kelby Larkmoor Milford Northwold Oakhurst Redcliff Stonebury".split())
COUNTRIES = tuple("Ardania Belmora Corvania Drestia Eldora Fenland Gorvia Hestia".split())
STATES = tuple("Alder Bay, East Ridge, Fairmont, Great Plain, High Valley, Lakeland, North Shore, Westmark".split(", "))
PRODUCTS = tuple("Arc, Beacon, Cobalt, Delta, Ember, Fjord, Grove, Harbor, Iris, Juniper".split(", "))
#: Closing words of organisations by industry.
ORGANISATIONS = {
    "general": ("Group", "Partners", "Holdings", "Works"), "healthcare": ("Clinic", "Hospital", "Medical Center", "Health"), "finance": ("Capital", "Bank", "Advisors", "Trust"),
    "retail": ("Stores", "Market", "Outfitters", "Goods"), "technology": ("Systems", "Software", "Labs", "Networks"),
}
#: Names that no draw may contain.
BRANDS = tuple("acme amazon apple google microsoft oracle walmart siemens toyota samsung nestle pfizer visa boeing".split())
REDRAWS = 6
FITTED_DRAWS = 16
# Titles before and suffixes after names.
HONORIFICS = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof")
SUFFIXES = ("Jr", "Sr", "II", "III", "IV", "MD", "PhD", "DDS", "DVM")


def _pick(values, key: Column, seed: int, what: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), (draw(key, seed, what) % len(values)).cast("int"))


def looks_real(c: Column, brands: tuple[str, ...] = BRANDS) -> Column:
    """Whether one of the brands is among the words of ``c``."""
    return F.arrays_overlap(F.split(F.lower(c), "[^a-z0-9]+"), F.array(*map(F.lit, brands)))


def fake_entity(role: str, key: Column, seed: int, locale: str = "en", industry: str = "general", brands: tuple[str, ...] = BRANDS) -> Column:
    """A made-up person, company, city, country, state, product, phone, email or id; equal keys get equal values.

    Addresses are at reserved domains, phones in the range kept for fiction. A value with the name of a brand is drawn
    again, ``REDRAWS`` times at most; then a neutral word stands in.
    """
    what = lambda part, i: f"{role}:{locale}:{part}:{i}"

    def one(i: int) -> Column:
        pick = lambda values, part: _pick(values, key, seed, what(part, i))
        digits = lambda n, part: F.lpad((draw(key, seed, what(part, i)) % 10**n).cast("string"), n, "0")
        given, family = pick(GIVEN, "given"), pick(FAMILY, "family")
        if role == "person":
            return F.concat_ws(" ", given, family)
        if role == "company":
            return F.concat_ws(" ", family, pick(ORGANISATIONS.get(industry, ORGANISATIONS["general"]), "kind"))
        if role == "product":
            return F.concat_ws(" ", pick(PRODUCTS, "product"), (draw(key, seed, what("model", i)) % 9 + 1).cast("string"))
        if role == "email":
            return F.concat(F.lower(given), F.lit("."), F.lower(family), F.lit("@"), pick(DOMAINS, "host"))
        if role == "phone":
            return F.concat(F.lit("("), (draw(key, seed, what("area", i)) % 800 + 200).cast("string"), F.lit(") 555-01"), digits(2, "line"))
        if role == "id":
            return F.concat(F.lit("ID-"), digits(6, "number"))
        lists = {"city": TOWNS, "country": COUNTRIES, "state": STATES}
        if role not in lists:
            raise ValueError(f"no such role: {role}")
        return pick(lists[role], role)

    free = lambda v: F.get(F.filter(F.array(v), lambda x: ~looks_real(x, brands)), F.lit(0))
    return F.coalesce(*(free(one(i)) for i in range(1 + REDRAWS)), F.lit("Example"))


def fitted(role: str, original: Column, key: Column, seed: int, **options) -> Column:
    """``fake_entity`` about as long as the original: of sixteen draws the first within a tenth of its length, else the
    cheapest (a letter too many costs two, one too few one), without trailing words that would not fit. Null where none
    fits. Draws that are the original or share a word of three letters or more with it do not count."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: F.length(w) >= 3)
    size = F.length(original)
    most = size * 1.15 + 1
    bound = lambda c, then: F.get(F.transform(F.array(c), then), F.lit(0))
    names = F.transform(F.sequence(F.lit(0), F.lit(FITTED_DRAWS - 1)), lambda i: fake_entity(role, F.when(i == 0, key).otherwise(F.concat(key, F.lit("#"), i.cast("string"))), seed, **options))
    costs = lambda v, i: F.struct(F.when(F.length(v) > size, 2 * (F.length(v) - size)).otherwise(size - F.length(v)).alias("cost"), i.alias("i"), v.alias("v"))
    fair = lambda own: F.filter(F.transform(names, costs), lambda d: (F.lower(d["v"]) != F.lower(original)) & ~F.arrays_overlap(words(d["v"]), own))
    best = lambda draws: F.coalesce(F.get(F.filter(draws, lambda d: d["cost"] <= F.greatest(F.lit(1.0), size * 0.1)), F.lit(0)), F.array_min(draws))
    heads = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_join(F.slice(w, F.lit(1), F.size(w) - i), " "))
    chosen = bound(bound(words(original), fair), best)
    return bound(F.split(chosen["v"], " "), lambda w: F.when(w.isNotNull(), F.get(F.filter(heads(w), lambda t: F.length(t) <= most), F.lit(0))))


def fake_title(c: Column, seed: int) -> Column:
    """Another title for a title and another suffix for a suffix of a name, at most a letter longer or shorter; a closing
    point stays. Null for other texts."""
    bare = F.regexp_replace(F.trim(c), r"\.\z", "")
    out = F.lit(None).cast("string")
    for names in (HONORIFICS, SUFFIXES):
        others = F.filter(F.array(*map(F.lit, names)), lambda n: (F.lower(n) != F.lower(bare)) & (F.abs(F.length(n) - F.length(bare)) <= 1))
        at = (draw(F.lower(bare), seed, "title") % F.greatest(F.size(others), F.lit(1))).cast("int")
        out = F.when(F.lower(bare).isin(*(n.lower() for n in names)), F.concat(F.get(others, at), F.when(F.trim(c).endswith("."), ".").otherwise(""))).otherwise(out)
    return out


ID_SHAPE = r"\A([A-Z]{2,5})([-_ ]?)([0-9]{3,})\z"


def fake_id_digits(c: Column, key: Column, seed: int) -> Column:
    """An id with its own prefix and as many other digits, none of them leading zero."""
    part = lambda i: F.regexp_extract(F.trim(c), ID_SHAPE, i)
    digits = part(3)

    def drawn(k: int) -> Column:
        one = lambda i: F.when(i == 0, 1 + _digit(key, seed, k, i) % 9).otherwise(_digit(key, seed, k, i) % 10).cast("string")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), one), "")

    other = F.get(F.filter(F.array(*(drawn(k) for k in range(4))), lambda d: d != digits), F.lit(0))
    return F.when(c.rlike(r"\A\s*[A-Z]{2,5}[-_ ]?[0-9]{3,}\s*\z"), F.concat(part(1), part(2), other))


def _digit(key: Column, seed: int, k: int, i: Column) -> Column:
    return draw(F.concat_ws("|", key, i.cast("string")), seed, f"id{k}")
