"""Checksums and entropy over string columns, all in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    """13 or more digits with a valid Luhn checksum."""
    digits = _digits(value)
    weighted = F.transform(
        F.split(F.reverse(digits), ""),
        lambda ch, i: F.when(i % 2 == 0, ch.cast("int")).otherwise(
            F.element_at(F.expr("array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)"), ch.cast("int") + 1)
        ),
    )
    total = F.aggregate(weighted, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(F.length(digits) >= 13, total % 10 == 0).otherwise(F.lit(False))


def ssn_valid(value: Column) -> Column:
    """Nine digits with an issued area, group and serial."""
    d = _digits(value)
    area = F.substring(d, 1, 3)
    return (
        (F.length(d) == 9)
        & ~area.isin("000", "666")
        & ~area.startswith("9")
        & (F.substring(d, 4, 2) != "00")
        & (F.substring(d, 6, 4) != "0000")
    )


def iban_valid(value: Column) -> Column:
    """Mod-97 check, folded digit by digit so no big integer is needed."""
    cleaned = F.upper(F.regexp_replace(value, r"\s", ""))
    rotated = F.concat(F.substring(cleaned, 5, 40), F.substring(cleaned, 1, 4))
    step = F.aggregate(
        F.split(rotated, ""),
        F.lit(0),
        lambda acc, ch: F.when(ch == "", acc)
        .when(ch.rlike("^[0-9]$"), (acc * 10 + ch.cast("int")) % 97)
        .otherwise((acc * 100 + F.ascii(ch) - 55) % 97),
    )
    return cleaned.rlike("^[0-9A-Z]{15,34}$") & (step == 1)


def phone_valid(value: Column) -> Column:
    return F.length(_digits(value)).between(7, 15)


def shannon_entropy(value: Column) -> Column:
    """Bits per character; 0 for the empty string."""
    n = F.length(value)
    bits = F.aggregate(
        F.array_distinct(F.split(value, "")),
        F.lit(0.0),
        lambda acc, ch: acc
        - F.when(ch == "", F.lit(0.0)).otherwise(
            ((n - F.length(F.replace(value, ch, F.lit("")))) / n)
            * F.log2((n - F.length(F.replace(value, ch, F.lit("")))) / n)
        ),
    )
    return F.when(n > 0, bits).otherwise(F.lit(0.0))
