"""Numbers, dates, prices and picture hashes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_int(s: Column) -> Column:
    """Digits with points between thousands; a comma is the decimal mark; rounded."""
    return F.round(F.replace(F.regexp_replace(s, r"[.\s]", ""), F.lit(","), F.lit(".")).try_cast("double")).cast("long")


def local_decimal(s: Column) -> Column:
    """Points before three digits are dropped; a comma is the decimal mark."""
    return F.replace(F.regexp_replace(F.trim(s), r"\.(?=\d{3}(?:\D|$))", ""), F.lit(","), F.lit(".")).try_cast("double")


def round_away(x: Column, digits: int = 0) -> Column:
    """Half away from zero, as decimal numbers are rounded."""
    return F.round(x.cast("decimal(38,10)"), digits).cast("double")


def round_even(x: Column) -> Column:
    """Half to the even neighbour, as double numbers are rounded."""
    return F.rint(x)


def round_up_half(x: Column) -> Column:
    """Half towards the greater neighbour, below zero too."""
    return F.floor(x + 0.5).cast("double")


def leading_int(s: Column) -> Column:
    return F.regexp_extract(s, r"^\s*(-?\d+)", 1).try_cast("long")


def difference(a: Column, b: Column) -> Column:
    """|a - b| by the larger of the two; null without positive values."""
    return F.when(F.greatest(a, b) > 0, F.abs(a - b) / F.greatest(a, b))


def discrepant(a: Column, b: Column, most: float = 0.05) -> Column:
    return F.coalesce(F.when(F.least(a, b) > 0, F.abs(a - b) / F.least(a, b) > most), F.lit(False))


def sigmoid(x: Column, k: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-k * x))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def interpolate(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through ``points`` by ascending x, level outside."""
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x.isNull(), None).when(x <= points[0][0], F.lit(float(points[0][1]))).otherwise(out)


def hash_of_hex(s: Column) -> Column:
    """A 64-bit picture hash from 16 hex digits, as a signed number; null if malformed."""
    return F.when(s.rlike("^[0-9A-Fa-f]{16}$"), F.conv(s, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def least_hamming(a: Column, b: Column) -> Column:
    """Between any hash of one array and any of the other."""
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: hamming(x, y)))))


def difference_hash(grid: Column) -> Column:
    """64 bits of 72 brightness values in rows of nine: whether each is darker than the one to its right."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(grid, (F.floor(i / 8) * 9 + i % 8).cast("int")) < F.get(grid, (F.floor(i / 8) * 9 + i % 8 + 1).cast("int")), "1").otherwise("0"))
    return F.conv(F.array_join(bits, ""), 2, -10).cast("long")


def any_date(s: Column) -> Column:
    """A date as YYYY-MM-DD, DD/MM/YYYY or DD-MM-YYYY anywhere in the text."""
    iso, day = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{2})[/-](\d{2})[/-](\d{4})"
    at = lambda p, i: F.regexp_extract(s, p, i)
    return F.coalesce(F.concat_ws("-", at(iso, 1), at(iso, 2), at(iso, 3)).try_cast("date"), F.concat_ws("-", at(day, 3), at(day, 2), at(day, 1)).try_cast("date"))


def days_between(start: Column, as_of: Column) -> Column:
    return F.round((F.unix_timestamp(as_of) - F.unix_timestamp(start)) / 86400).cast("long")


def semester(d: Column) -> Column:
    return F.concat_ws("-", F.year(d).cast("string"), F.when(F.month(d) <= 6, "1").otherwise("2"))


def in_business_hours(ts: Column, zone: str = "America/Santiago", start: int = 8, end: int = 23) -> Column:
    hour = F.hour(F.from_utc_timestamp(ts, zone))
    return (hour >= start) & (hour < end)


CURRENCIES = ("CLP", "UF", "USD")


def currency(s: Column) -> Column:
    up = F.upper(F.trim(s))
    return F.when(up.isin(*CURRENCIES), up).otherwise("CLP")


def price_in_clp(clp: Column, uf: Column, usd: Column, tagged: Column, tag: Column, uf_rate: Column, usd_rate: Column) -> Column:
    """An explicit price, else by its currency's rate, else by the tag; null without the rate; rounded."""
    by_tag = F.when(currency(tag) == "UF", tagged * uf_rate).when(currency(tag) == "USD", tagged * usd_rate).otherwise(tagged)
    return F.round(F.coalesce(clp, uf * uf_rate, usd * usd_rate, by_tag)).cast("long")
