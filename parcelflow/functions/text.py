"""Text functions for addresses, names, codes and adverts, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"
#: Abbreviations of address words. (Fixed values.)
ADDRESS_WORDS = (("AV", "AVENIDA"), ("AVDA", "AVENIDA"), ("AVE", "AVENIDA"), ("PJE", "PASAJE"), ("CLLE", "CALLE"), ("DR", "DOCTOR"))


def unaccent(s: Column) -> Column:
    return F.translate(s, _ACCENTED, _PLAIN)


def fold(s: Column) -> Column:
    return F.trim(F.lower(unaccent(s)))


def upper_plain(s: Column) -> Column:
    return F.upper(unaccent(F.coalesce(s, F.lit(""))))


def slug(s: Column, dash: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(fold(s), "[^a-z0-9]+", dash), f"^{dash}+|{dash}+$", "")


def trigrams(s: Column) -> Column:
    """Different runs of three characters of the text between two spaces and one."""
    padded = F.concat(F.lit("  "), s, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared)


def compared_runs(s: Column) -> Column:
    """What ``text_similarity`` compares: a text's trigrams, folded, other signs as spaces; null under two characters."""
    plain = F.trim(F.regexp_replace(fold(s), "[^a-z0-9]+", " "))
    return F.when(F.length(plain) >= 2, trigrams(plain))


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of whole texts' trigrams, folded, other signs as spaces; null if either has under two characters then."""
    return jaccard(compared_runs(a), compared_runs(b))


def words(s: Column) -> Column:
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_trigrams(s: Column) -> Column:
    """Trigrams of each word between two spaces and one."""
    return F.array_distinct(F.flatten(F.transform(words(s), trigrams)))


def similarity(a: Column, b: Column) -> Column:
    return F.coalesce(jaccard(word_trigrams(a), word_trigrams(b)), F.lit(0.0))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words by the fewer words of the two."""
    a, b = F.array_distinct(words(fold(a))), F.array_distinct(words(fold(b)))
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)))


def word_similarity(a: Column, b: Column) -> Column:
    """Shared words by the more words of the two."""
    a, b = F.array_distinct(words(fold(a))), F.array_distinct(words(fold(b)))
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.greatest(F.size(a), F.size(b)))


def address(s: Column) -> Column:
    out = F.regexp_replace(upper_plain(s), "[^A-Z0-9 ]", " ")
    for short, full in ADDRESS_WORDS:
        out = F.regexp_replace(out, rf"\b{short}\b", full)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def street(s: Column) -> Column:
    return F.nullif(F.regexp_extract(address(s), r"^(.+?)\s+(\d+)", 1), F.lit(""))


def street_number(s: Column) -> Column:
    return F.regexp_extract(address(s), r"^(.+?)\s+(\d+)", 2).try_cast("int")


def same_address(a: Column, b: Column, least: float = 0.6) -> Column:
    """Whether two addresses may be one: numbers agree where both have one, and most of the words of the shorter do.

    Words are those of three letters or more; without any on one side both
    need a number. An empty address agrees with none.
    """
    a, b = address(a), address(b)
    n, m = (F.nullif(F.regexp_extract(x, r"\b(\d{1,6})\b", 1), F.lit("")) for x in (a, b))
    long = lambda x: F.array_distinct(F.filter(F.split(x, " "), lambda w: (F.length(w) > 2) & ~w.rlike(r"^\d+$")))
    u, v = long(a), long(b)
    fewer = F.least(F.size(u), F.size(v))
    agree = F.when(fewer == 0, n.isNotNull() & m.isNotNull()).otherwise(F.size(F.array_intersect(u, v)) / F.nullif(fewer, F.lit(0)) >= least)
    return F.coalesce((a != "") & (b != "") & ~F.coalesce(n != m, F.lit(False)) & agree, F.lit(False))


#: Words that begin the part of an address inside a building. (Fixed values.)
UNIT_WORDS = ("DP", "DPTO", "DEPTO", "DEP", "BD", "BOD", "BDGA", "BODEGA", "BX", "EST", "ESTAC", "LC", "LOC", "LOCAL", "OF", "OFIC", "OFICINA", "CS", "CASA", "PISO", "BLOCK", "BLK", "TORRE")
_UNIT = rf"^(.*?[0-9]+)\s+(?:{'|'.join(UNIT_WORDS)})(?:\s|$).*$"


def base_address(s: Column) -> Column:
    """The address of the building: without what follows the street number from a unit word on."""
    return F.regexp_replace(F.trim(F.upper(s)), _UNIT, "$1")


def is_unit(s: Column) -> Column:
    return F.trim(F.upper(s)).rlike(_UNIT)


def roll(s: Column) -> Column:
    """A roll number "block-lot" without leading zeros; null if malformed."""
    ok = F.trim(s).rlike(r"^\d+-\d+$")
    return F.when(ok, F.regexp_replace(F.trim(s), r"(^|-)0+(?=\d)", "$1"))


def roll_padded(s: Column, width: int = 5) -> Column:
    parts = F.split(roll(s), "-")
    return F.concat_ws("-", F.lpad(parts[0], width, "0"), F.lpad(parts[1], width, "0"))


def phone(s: Column) -> Column:
    """The last nine digits of at least eight."""
    digits = F.regexp_replace(s, r"\D", "")
    return F.when(F.length(digits) >= 8, F.right(digits, F.lit(9)))


def agency(s: Column) -> Column:
    out = F.trim(F.regexp_replace(fold(s), "[^a-z0-9]+", " "))
    return F.when(F.length(out) >= 3, out)


def without_tags(s: Column) -> Column:
    """Text of a piece of HTML: no tags, the common references decoded, single spaces."""
    out = F.regexp_replace(s, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def age_days(s: Column) -> Column:
    """Days from "hace N días", weeks, months or years; today and just published are 0; unknown is null."""
    t = fold(s)
    n = F.regexp_extract(t, r"hace\s+(\d+)", 1).try_cast("int")
    per = F.when(t.rlike(r"\bdias?\b"), 1).when(t.rlike(r"\bsemanas?\b"), 7).when(t.rlike(r"\bmes(es)?\b"), 30).when(t.rlike(r"\banos?\b"), 365)
    return F.when(t.rlike(r"\bhoy\b|recien"), 0).otherwise(n * per)


def areas(title: Column) -> Column:
    """Land and built area of a title with two areas ("4.022/258 Mt2"): the larger and the smaller."""
    part = lambda i: F.regexp_replace(F.regexp_extract(title, r"(?i)(\d[\d.]*)\s*/\s*(\d[\d.]*)\s*mt?s?2", i), r"\.", "").try_cast("int")
    return F.struct(F.greatest(part(1), part(2)).alias("land"), F.least(part(1), part(2)).alias("built"))


def clean_url(s: Column) -> Column:
    out = F.regexp_replace(F.trim(s), r"[?#].*$", "")
    out = F.regexp_replace(out, "/+$", "")
    return F.when(out.rlike("^https?://"), out).otherwise(F.concat(F.lit("https://"), out))


def first_pattern(s: Column, table: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Name of the first pattern that fits, in any case: platforms of sites, kinds of owners."""
    out = F.lit(default)
    for pattern, name in reversed(table):
        out = F.when(s.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def labelled_amount(s: Column, label: str) -> Column:
    """The amount after a label: "label ... CLP 1.234"."""
    return F.regexp_replace(F.regexp_extract(s, rf"(?is){label}[^\n]*?CLP\s*([\d.]+)", 1), r"\.", "").try_cast("long")


#: Parts of a portal's domain id and what they say. (Fixed values.)
OPERATIONS = (("FOR_RENT", "rent"), ("FOR_SALE", "sale"))
KINDS = (("APARTMENT", "departamento"), ("HOUSE", "casa"))


def domain_kind(s: Column) -> Column:
    """Operation, property type (null if unknown) and whether it is a development, from a portal's domain id."""
    return F.struct(first_pattern(s, OPERATIONS).alias("operation"), first_pattern(s, KINDS).alias("property_type"), F.coalesce(s.rlike("(?i)DEVELOPMENT"), F.lit(False)).alias("is_development"))


#: Parts of a company's name. (Fixed values.)
COMPANY_PARTS = ("S.A.", "SPA", "LTDA", "EIRL", "E.I.R.L", "SOCIEDAD", "LIMITADA", "INMOBILIARIA", "INVERSIONES", "COMERCIAL", "CONSTRUCTORA", "INC.", "CORP", "COMPAÑIA", "COMPAÑÍA", "FONDO")


def is_company(s: Column) -> Column:
    name, out = F.upper(F.coalesce(s, F.lit(""))), F.lit(False)
    for part in COMPANY_PARTS:
        out = out | F.contains(name, F.lit(part))
    return out


def place_names(s: Column) -> Column:
    """Folded names to look up, in order: the whole text, then its parts, without "comuna de" and the like."""
    whole = F.trim(F.coalesce(s, F.lit("")))
    parts = F.concat(F.array(whole), F.split(whole, r"[,\-–—/]| en "))
    plain = F.transform(parts, lambda p: F.regexp_replace(fold(p), r"^(comuna|localidad|sector)\s+(de\s+)?", ""))
    return F.filter(plain, lambda p: p != "")


#: Form of an advert's id, and digits from which a number may be one and is worth a visit. (Fixed values.)
ADVERT_PREFIX, ADVERT_DIGITS, VISIT_DIGITS = "MLC", 8, 9


def search_box(s: Column) -> Column:
    """What a typed text asks for: (advert_id, url, code, like_text, fetchable), nulls where it doesn't.

    An URL names an advert or is looked for as a part of stored ones; a
    written advert id is no code; a number may be both; anything else is a
    code, whole or in part.
    """
    raw = F.regexp_replace(F.trim(s), r"""^[<"'\s]+|[>"'\s]+$""", "")
    digits = F.nullif(F.regexp_extract(raw, rf"(?i){ADVERT_PREFIX}-?(\d+)", 1), F.lit(""))
    number, written = raw.rlike(r"^\d+$"), raw.rlike(rf"(?i)^{ADVERT_PREFIX}-?\d+$")
    is_url = raw.rlike(r"(?i)^https?://") | raw.rlike(r"(?i)^(?:www\.)?[a-z0-9.-]+\.[a-z]{2,}/")
    name = lambda d: F.concat(F.lit(f"{ADVERT_PREFIX}-"), d)
    advert = F.when(number, F.when(F.length(raw) >= ADVERT_DIGITS, name(raw))).otherwise(name(digits))
    url = F.when(is_url, clean_url(raw))
    code = F.when(~is_url & ~written & (raw != ""), raw)
    like = F.when(is_url, F.when(advert.isNull(), F.regexp_replace(url, r"(?i)^https?://(?:www\.)?", ""))).otherwise(code)
    fetch = F.when(is_url, advert.isNotNull()).when(written, F.length(digits) >= ADVERT_DIGITS).when(number, F.length(raw) >= VISIT_DIGITS).otherwise(False)
    return F.struct(advert.alias("advert_id"), url.alias("url"), code.alias("code"), like.alias("like_text"), F.coalesce(fetch, F.lit(False)).alias("fetchable"))
