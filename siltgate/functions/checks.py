"""Checksums, entropy and exemptions as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The resident number's weights and check characters, and reserved mail domains.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"
RESERVED_DOMAINS = ("example.com", "example.org", "example.net", "example.edu")
RESERVED_TLDS = ("example", "test", "invalid", "localhost")

WIDE_DIGITS = "０１２３４５６７８９"


def mod11_valid(number: Column) -> Column:
    """Whether 17 digits and a check character agree."""
    plain = F.translate(number, WIDE_DIGITS, "0123456789")
    total = F.aggregate(
        F.zip_with(F.split(F.substr(plain, F.lit(1), F.lit(17)), ""), F.lit(list(ID_WEIGHTS)), lambda d, w: d.try_cast("int") * w),
        F.lit(0),
        lambda s, x: s + x,
    )
    check = F.substr(F.lit(ID_CHECKS), total % 11 + 1, F.lit(1))
    return F.coalesce((F.length(plain) == 18) & (check == F.upper(F.substr(plain, F.lit(18), F.lit(1)))), F.lit(False))


def reserved_email(address: Column) -> Column:
    """Whether an address is in a domain that is reserved for examples."""
    domain = F.lower(F.substr(address, F.instr(address, "@") + 1, F.length(address)))
    names = "|".join(d.replace(".", "\\.") for d in RESERVED_DOMAINS)
    return domain.rlike(rf"(?:\A|\.)(?:{names})\z|\.(?:{'|'.join(RESERVED_TLDS)})\z")


def entropy(token: Column) -> Column:
    """Shannon entropy in bits per character; characters count in the order of their first place."""
    chars = F.split(token, "")
    n = F.size(chars)
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return -F.aggregate(parts, F.lit(0.0), lambda s, p: s + p * F.log2(p))


def card_valid(digits: Column) -> Column:
    """At least 13 digits that pass the Luhn check."""
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


def iban_valid(number: Column) -> Column:
    """The country's letters and check digits moved to the end, letters as numbers: 1 modulo 97."""
    moved = F.concat(F.substr(number, F.lit(5), F.length(number)), F.substr(number, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.transform(F.split(moved, ""), value), F.lit(0), lambda r, v: F.when(v > 9, (r * 100 + v) % 97).otherwise((r * 10 + v) % 97))
    return rest == 1
