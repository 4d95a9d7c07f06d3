"""Checks of identifiers as column expressions; NULL in, NULL or false out, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = "0-9A-Fa-f"
#: Employer number prefixes the tax office has not issued.
EIN_UNISSUED = (0, 7, 8, 9, 17, 18, 19, 28, 29, 49, 69, 70, 78, 79, 89, 96, 97)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_ok(c: Column) -> Column:
    return c.rlike("^[0-9]+$") & F.call_function("luhn_check", c)


def card_iin_known(c: Column) -> Column:
    two, four = F.left(c, F.lit(2)), F.left(c, F.lit(4))
    return c.startswith("4") | two.between("51", "55") | (four.rlike("^[0-9]{4}$") & four.between("2221", "2720")) | two.isin("34", "37", "65") | (four == "6011")


def ssn_ok(area: Column, group: Column, serial: Column) -> Column:
    return ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")


def nanp_ok(area: Column, exchange: Column) -> Column:
    return area.rlike("^[2-9]") & exchange.rlike("^[2-9]")


def ipv4_ok(c: Column) -> Column:
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return c.rlike(rf"^{octet}(?:\.{octet}){{3}}$")


def ipv6_ok(c: Column) -> Column:
    """Eight groups, or fewer around one double colon."""
    group = f"[{HEX}]{{1,4}}"
    gaps = F.size(F.split(c, "::", -1)) - 1
    groups = F.size(F.filter(F.split(c, ":"), lambda g: g != ""))
    plain = c.rlike(f"^{group}(?::{group}){{7}}$")
    short = (gaps == 1) & ~c.contains(":::") & (groups <= 7) & c.rlike(f"^(?:{group}(?::{group})*)?::(?:{group}(?::{group})*)?$")
    return plain | short


def plausible_dob(year: Column, month: Column, day: Column, as_of: Column | None = None) -> Column:
    """A calendar date from 1900 to the year of as_of (today)."""
    limit = F.year(as_of if as_of is not None else F.current_date())
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd").isNotNull() & year.cast("int").between(F.lit(1900), limit)


def _weighted(c: Column, weights: list[int]) -> Column:
    numbers = F.transform(F.split(c, ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    pairs = F.zip_with(numbers, F.array(*map(F.lit, weights)), lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0)))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def aba_ok(c: Column) -> Column:
    return c.rlike("^[0-9]{9}$") & (_weighted(c, [3, 7, 1] * 3) % 10 == 0)


def vin_ok(c: Column) -> Column:
    up = F.upper(c)
    values = F.translate(up, "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789")
    rest = _weighted(values, [*range(8, 1, -1), 10, 0, *range(9, 1, -1)]) % 11
    check = F.substring(up, 9, 1)
    return up.rlike("^[0-9A-HJ-NPR-Z]{17}$") & (check == F.when(rest == 10, "X").otherwise(rest.cast("string")))


def swift_ok(c: Column) -> Column:
    return F.regexp_replace(c, "[ -]", "").rlike("^(?i)[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$")


def mac_ok(c: Column) -> Column:
    return c.rlike(rf"^[{HEX}]{{2}}([:-])[{HEX}]{{2}}(?:\1[{HEX}]{{2}}){{4}}$")


def ein_ok(c: Column) -> Column:
    return c.rlike("^[0-9]{9}$") & ~F.left(c, F.lit(2)).try_cast("int").isin(*EIN_UNISSUED)
