"""Lenient parsing and text keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "no value", and the query parameters whose value is hidden.
MISSING_TEXT = r"^(\.|na|n/a|null|none|-|m|-?999(\.9+)?|-9999)?$"
SECRET_PARAMETERS = "key|token|secret|password|sig|auth|pass"
# Government words and appended county names that do not belong to a city name, and name aliases.
GOVERNMENT_WORDS = (
    "city|and county|county|metropolitan government|metro government|consolidated government|urban county government|"
    "unified government|municipality|-davidson|-jefferson|-fayette|-richmond|-bibb|-clarke|dc"
)
PLACE_ALIASES = {
    "batonrougeeastbatonrougeparish": "batonrouge", "wyandotteandkansasunifiedgovernment": "kansas", "wyandotteandkansas": "kansas",
    "sanfranciscoand": "sanfrancisco", "denverand": "denver", "augustaconsolidatedgovernment": "augusta",
    "columbusconsolidatedgovernment": "columbus", "athensunifiedgovernment": "athens", "maconbibb": "macon",
    "honoluluand": "honolulu", "washingtondc": "washington", "anchoragemunicipality": "anchorage",
    "lexingtonurbangovernment": "lexington", "louisvillemetrogovernment": "louisville",
}
# What counts as an action on everything, import value (bn) by scope, value without a stated one.
BROAD_SCOPE = (
    "all goods|all shipments|all modes|universal|all countries|of us imports|broad product list|"
    "broad intermediate and consumer goods|most goods|reciprocal rate|certain goods|country-specific reciprocal"
)
SCOPE_VALUE = [
    ("global", 3100.0), ("universal", 3100.0), ("all countries", 3100.0), ("trading partners", 2200.0), ("china", 440.0),
    ("canada", 410.0), ("mexico", 505.0), ("european union", 550.0), ("eu", 550.0), ("japan", 150.0), ("korea", 130.0),
    ("india", 90.0), ("brazil", 43.0), ("uk", 65.0), ("united kingdom", 65.0),
]
PRODUCT_VALUE = 10.0


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lenient_number(text) -> Column:
    """Number from published text: strips , $ % and spaces; missing tokens and junk become NULL, never 0."""
    stripped = F.regexp_replace(F.lower(_c(text)), r"[,$%\s]", "")
    value = stripped.try_cast("double")
    return F.when(~stripped.rlike(MISSING_TEXT) & ~F.isnan(value) & (F.abs(value) != float("inf")), value)


def alnum_key(text) -> Column:
    """Entity names reduced to lower-case letters and digits, HTML entities and footnote marks removed."""
    c = F.regexp_replace(F.lower(_c(text)), r"&[a-z]+;|&#\d+;", " ")
    c = F.regexp_replace(c, r"\(\d+\)|\[\d+\]", "")
    return F.regexp_replace(c, r"[^a-z0-9]", "")


def place_key(text, aliases: dict[str, str] | None = None) -> Column:
    """City names: ft becomes fort, saint becomes st, government words dropped, letters only, then aliases."""
    c = F.regexp_replace(F.lower(_c(text)), r"\bft[. ]+", "fort ")
    c = F.regexp_replace(c, rf"\b({GOVERNMENT_WORDS})\b|({'|'.join(w for w in GOVERNMENT_WORDS.split('|') if w[0] == '-')})\b", " ")
    c = F.regexp_replace(F.regexp_replace(c, "saint", "st"), r"[^a-z]", "")
    table = F.create_map(*[F.lit(x) for kv in (aliases or PLACE_ALIASES).items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(text))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def description_key(text) -> Column:
    """Trailing '[n]' removed, trimmed, upper case."""
    return F.upper(F.trim(F.regexp_replace(_c(text), r"\s*\[\d+\]\s*$", "")))


def monthly_period(period) -> Column:
    """True for M01..M12 (not the annual M13)."""
    return _c(period).like("M%") & (_c(period) != "M13")


def series_area(series) -> Column:
    return F.substring(_c(series), 5, 4)


def series_item(series) -> Column:
    return F.substr(_c(series), F.lit(9))


def first_match(text, rules, default=None) -> Column:
    """Label of the first regex (in order) found in the text; rules is [(pattern, label), ...]."""
    c = F.lower(_c(text))
    out = None
    for pattern, label in rules:
        hit = c.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default))


def mask_query_secret(url) -> Column:
    """Values of secret-looking query parameters replaced by REDACTED."""
    return F.regexp_replace(_c(url), rf"(?i)([?&][^=&#]*(?:{SECRET_PARAMETERS})[^=&#]*=)[^&#]*", "$1REDACTED")


def money_in_text(text) -> Column:
    """Billions from '$n B'; NULL when absent."""
    found = F.regexp_extract(_c(text), r"(?i)\$\s?([\d,]+(?:\.\d+)?)\s?B", 1)
    return F.regexp_replace(found, ",", "").try_cast("double")


def scope_value(text) -> Column:
    """Stated billions, else the partner's total for actions on everything, else the product placeholder."""
    broad = F.when(F.lower(_c(text)).rlike(BROAD_SCOPE), first_contained(text, SCOPE_VALUE))
    return F.coalesce(money_in_text(text), broad, F.lit(PRODUCT_VALUE))


def first_contained(text, table: list[tuple[str, float]]) -> Column:
    """Value of the first key (in table order) contained in the text."""
    c = F.lower(_c(text))
    return F.coalesce(*[F.when(F.contains(c, F.lit(k.lower())), F.lit(v)) for k, v in table])


def first_line(text, pattern: str) -> Column:
    """First line of a message that matches; NULL when none does."""
    return F.try_element_at(F.filter(F.split(_c(text), "\n"), lambda line: line.rlike(pattern)), F.lit(1))


def event_family(label, kin_labels) -> Column:
    """Shared 'a_b_' prefix when at least three labels of the group carry it, else the label."""
    prefix = F.concat(F.substring_index(_c(label), "_", 2), F.lit("_"))
    kin = F.size(F.filter(kin_labels, lambda k: k.startswith(prefix)))
    return F.when((F.size(F.split(_c(label), "_")) > 2) & (kin >= 3), F.regexp_replace(prefix, "_$", "")).otherwise(_c(label))


def strike_basis_points(kind, text) -> Column:
    """Signed basis points of a Cut or Hike strike; an open-ended '>25' counts as 50."""
    c = F.trim(_c(text))
    size = F.when(c.startswith(">"), 50.0).otherwise(c.try_cast("double"))
    return F.when(_c(kind) == "Cut", -size).when(_c(kind) == "Hike", size)


def age_range(text) -> Column:
    """'under 5', '85 years and over', '5 to 9', '60 and 61 years', '20 years' to struct(lo, hi).

    A label is read as words: the word for years is taken out and remembered,
    and what is left is a number, two numbers around a joining word, or a number
    with a word for an open end on either side.
    """
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(_c(text)), ",", "")), r"\s+"), lambda w: w != "")
    unit = F.exists(words, lambda w: w.isin("year", "years"))
    rest = F.filter(words, lambda w: ~w.isin("year", "years"))

    def word(i):
        return F.try_element_at(rest, F.lit(i))

    def number(i):
        return word(i).try_cast("int")

    n, joint = F.size(rest), word(2)
    lo = F.when((n == 2) & (word(1) == "under"), F.lit(0)).otherwise(number(1))
    hi = (
        F.when((n == 2) & (word(1) == "under"), number(2) - 1)
        .when((n == 1) & unit, number(1))
        .when((n >= 3) & joint.isin("to", "through"), number(3))
        .when((n == 3) & unit & (joint == "and"), F.when(word(3).isin("over", "older"), F.lit(200)).otherwise(number(3)))
    )
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def standard_bin(text, bins: list[str], strict: bool = False) -> Column:
    """The five-year bin that contains an age label; NULL where the label spans bins or does not parse.

    With ``strict`` a label that spans bins is an error when the row is read.
    """
    r = age_range(text)
    out = None
    for b in bins:
        lo, hi = (int(b[:-1]), 200) if b.endswith("+") else tuple(int(x) for x in b.split("-"))
        inside = (r["lo"] >= lo) & (r["hi"] <= hi)
        out = F.when(inside, b) if out is None else out.when(inside, b)
    if strict:
        out = out.when(r.isNotNull(), F.raise_error(F.concat(F.lit("age label spans bins: "), _c(text))).cast("string"))
    return out


def label_parts(label) -> Column:
    """'Total!!Male:!!Under 5 years' to trimmed lower-case parts without trailing colons."""
    return F.transform(F.split(_c(label), "!!"), lambda p: F.regexp_replace(F.lower(F.trim(p)), ":$", ""))


def label_sex(label) -> Column:
    parts = label_parts(label)
    return F.when(F.array_contains(parts, "male"), "M").when(F.array_contains(parts, "female"), "F")


def label_age(label) -> Column:
    return F.try_element_at(F.filter(label_parts(label), lambda p: F.contains(p, F.lit("year"))), F.lit(1))
