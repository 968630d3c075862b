"""What labels and columns mean: entity, role, industry and locale of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first pattern that matches the singular, lower-case name decides.
PHYSICIAN = r"\b(physician|doctor|clinician|surgeon|attending|prescriber|rendering provider|referring provider)\b"
ENTITIES = (
    ("payer", r"\b(payer|payor|insurer|health plan|insurance (company|carrier|provider)|underwriter)\b"),
    ("provider", r"\b(hospital|health system|clinic|practice|provider|facility|medical (center|group)|care site|physician group|health center|surgery center)\b"),
    ("pharmacy", r"\b(pharmacy|drugstore|dispensary)\b"),
    ("bank", r"\b(bank|lender|credit union)\b"),
    ("fund", r"\b(fund|asset manager|investment firm)\b"),
    ("school", r"\b(school|university|college|campus|school district|academy)\b"),
    ("store", r"\b(store|retailer|outlet|shop|dealership|branch)\b"),
    ("carrier", r"\b(carrier|shipper|forwarder|3pl|courier)\b"),
    ("agency", r"\b(agency)\b"),
    ("manufacturer", r"\b(manufacturer|maker|oem|plant operator)\b"),
    ("company", r"\b(company|customer|client|account|vendor|supplier|partner|organi[sz]ation|brand|merchant|employer|business|firm|tenant|payee|distributor|reseller|competitor)\b"),
)
ROLES = (
    ("email", r"e-?mail"),
    ("phone", r"phone|mobile|\btel\b|telephone|cell"),
    ("id", r"\b(id|ref|reference|number|no|code|sku)\b|#"),
    ("city", r"\b(city|town)\b"),
    ("country", r"\b(country|nation|market)\b"),
    ("state", r"\b(state|province|county)\b"),
    ("product", r"\b(product|plan|offering|item name|model)\b"),
    ("company", r"\b(company|customer|client|account|vendor|supplier|partner|organi[sz]ation|brand|merchant|employer|business|firm|tenant)\b"),
    ("person", r"\b(name|owner|rep|agent|manager|assignee|contact|user|employee|author|reviewer|lead|advisor|analyst|engineer|seller|buyer|requester|approver|recruiter|candidate|member|person|people|staff)\b"),
)
PERSON_CUE = r"(?i)\b(manager|owner|rep|agent|assignee|contact|employee|author|reviewer|analyst|engineer|seller|buyer|approver|recruiter|lead|prepared by|owned by|created by|assigned to|advisor|consultant|director|physician|doctor|nurse|user name|full name)\b"
PLACE = r"\A(regions?|territor(y|ies)|areas?|zones?|locations?|markets?|sites?|cit(y|ies)|towns?)\z"
BY_SOMEONE = r"\b(prepared|owned|created|assigned|submitted|approved|reported|managed) by\b"
PLACEHOLDER = r"(?i)\A\s*\[?\s*(client|customer|company|account|item|person|user|rep|owner|product|location|city|name|entity|vendor|partner|hospital|provider|clinic|facility|payer|store|school|bank)\s*\]?\s*[0-9]*\s*\z"
INDUSTRIES = (
    ("healthcare", r"\b(patient|clinic|hospital|admission|readmission|encounter|diagnos[ie]s|physician|nurse|bed|icd|medication|prescription|lab test|care|health|medical|discharge|length of stay|surgery|appointment|visit|provider)\b"),
    ("insurance", r"\b(premium|policy|policie|underwriting|loss ratio|claim|payer|broker|coverage|insured|deductible)\b"),
    ("finance", r"\b(portfolio|aum|loan|deposit|fund|trading|credit|interest|asset|equity|yield|nav|bank|revenue|ebitda|margin|cogs|expense|budget|cash)\b"),
    ("retail", r"\b(store|sku|basket|shopper|merchandise|inventory|footfall|aov|unit sold|pos|order|product|category|discount|return)\b"),
    ("technology", r"\b(mrr|arr|churn|subscription|user|session|signup|dau|mau|uptime|ticket|api|saas|deployment|crash|install|release|page view|bounce)\b"),
    ("logistics", r"\b(shipment|freight|carrier|delivery|warehouse|on time|route|fleet|pallet|transit|lane)\b"),
    ("education", r"\b(student|enrollment|enrolment|course|grade|gpa|school|campus|faculty|attendance|graduation)\b"),
    ("manufacturing", r"\b(production|defect|downtime|plant|oee|scrap|machine|throughput|supplier quality|work order)\b"),
)
PLACES = (
    (r"(united states( of america)?|usa|u\.s\.a?\.?|us|america)", "en_US"),
    (r"(united kingdom|uk|u\.k\.|great britain|britain|england|scotland|wales|northern ireland)", "en_GB"),
    (r"(india|bharat)", "en_IN"), (r"canada", "en_CA"), (r"australia", "en_AU"), (r"(south africa|rsa)", "en_ZA"),
    (r"(germany|deutschland|austria|österreich|switzerland|schweiz|dach)", "de"), (r"(france|belgium|belgique|luxembourg)", "fr"),
    (r"(spain|españa)", "es"), (r"(mexico|méxico)", "es_MX"), (r"(italy|italia)", "it"), (r"(brazil|brasil)", "pt_BR"),
    (r"(japan|nippon)", "ja"), (r"(china|prc)", "zh_CN"),
)
CURRENCIES = (
    (r"(?i)R\$|BRL", "pt_BR"), (r"(?i)A\$|AUD", "en_AU"), (r"(?i)C\$|CAD", "en_CA"), (r"(?i)MX\$|MXN", "es_MX"), (r"(?i)£|GBP", "en_GB"),
    (r"(?i)₹|INR|Rs\.?", "en_IN"), (r"(?i)¥|JPY", "ja"), (r"(?i)CNY|RMB|元", "zh_CN"), (r"(?i)\AR\z|ZAR", "en_ZA"), (r"(?i)€|EUR", "de"), (r"(?i)\$|USD", "en_US"),
)
ID_SKIP = ("ID", "NO", "NUM", "NUMBER", "REF", "REFERENCE", "CODE", "THE", "OF")


def first_match(c: Column, rules, otherwise=None) -> Column:
    out = None
    for name, pattern in rules:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise(F.lit(otherwise)) if otherwise else out


def singular(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[_-]+", " "), r"\s+")
    one = lambda w: (
        F.when(F.length(w) < 4, w)
        .when(w.endswith("ies"), F.concat(F.regexp_replace(w, "ies$", ""), F.lit("y")))
        .when(w.rlike("(ches|shes|sses|xes)$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("[^su]s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )
    return F.array_join(F.transform(words, one), " ")


def entity_of(c: Column) -> Column:
    n = singular(c)
    return F.when(n.rlike(PHYSICIAN), F.lit(None).cast("string")).otherwise(first_match(n, ENTITIES))


def column_role(c: Column, kind: str = "text") -> Column:
    n, by_name = singular(c), first_match(singular(c), ROLES)
    none = F.lit(None).cast("string")
    if kind == "id":
        return F.lit("id")
    org = entity_of(c).isNotNull() & ~n.rlike(r"e-?mail|phone|\b(id|code|number|no)\b|#")
    named = F.when((by_name == "person") & n.rlike(r"\b(customer|client|account|company|vendor|partner|brand)\b"), "company")
    if kind == "category":
        named = named.when(by_name == "id", none)
    named = named.otherwise(by_name)
    if kind in ("text", "category"):
        return F.when(n.rlike(PHYSICIAN), "person").when(org, "company").otherwise(named)
    if kind == "org":
        return F.when(n.rlike(PHYSICIAN), "person").otherwise(F.lit("company"))
    if kind == "person":
        return F.when(by_name.isin("email", "phone"), by_name).otherwise("person")
    return none


def role_of(c: Column) -> Column:
    """Role of a box's label; words after a closing "by" name the dimension."""
    low = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    dim = F.when(~low.rlike(BY_SOMEONE), F.regexp_extract(low, r"\bby\s+([a-z][a-z ]*)$", 1)).otherwise("")
    last = F.element_at(F.split(dim, " "), -1)
    plain = lambda x: F.when(x == "", F.lit(None).cast("string")).when(x.rlike(PERSON_CUE), "person").otherwise(column_role(x))
    return F.when(dim != "", F.when(last.rlike(PLACE), "city").otherwise(plain(F.trim(dim)))).otherwise(plain(low))


def is_placeholder(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(PLACEHOLDER)


def id_prefix(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^A-Z\s]", " "), r"\s+")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*ID_SKIP))
    w = F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit("ID"))
    bones = F.substring(F.concat(F.substring(w, 1, 1), F.regexp_replace(F.substring(w, F.lit(2), F.length(w)), "[AEIOU]", "")), 1, 3)
    return F.when(F.length(bones) >= 3, bones).otherwise(F.substring(w, 1, 3))


def locale_for_place(c: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[-_]+", " "), r"\s+", " ")
    return first_match(p, [(loc, rf"\A{pattern}\z") for pattern, loc in PLACES])


def locale_for_currency(c: Column) -> Column:
    return first_match(c, [(loc, pattern) for pattern, loc in CURRENCIES], "en_US")


def industry_hits(c: Column) -> list[Column]:
    n = singular(c)
    return [F.regexp_count(n, F.lit(p)).alias(name) for name, p in INDUSTRIES]


def best_industry(hits: dict[str, Column]) -> Column:
    """The industry with most hits, at least two; the earliest listed wins a tie, healthcare before all."""
    out, score = F.lit("general"), F.lit(1)
    for name, n in hits.items():
        out, score = F.when(n > score, name).otherwise(out), F.greatest(score, n)
    return out
