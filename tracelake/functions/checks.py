"""Checksum and plausibility tests on digit strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake import fixed


def digit(text: Column, position: int | Column) -> Column:
    where = F.lit(position) if isinstance(position, int) else position
    return F.substring(text, where, F.lit(1)).try_cast("int")


def luhn_ok(number: Column) -> Column:
    """Every second digit from the right counts double."""
    mirrored = F.reverse(number)

    def add(total: Column, place: Column) -> Column:
        value = digit(mirrored, place) * F.when(place % 2 == 0, 2).otherwise(1)
        return total + value - F.when(value > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add)
    return F.coalesce(number.rlike("^[0-9]{8,28}$") & (total % 10 == 0), F.lit(False))


def card_plausible(number: Column) -> Column:
    """Issuer ranges of the common payment networks."""
    size = F.length(number)
    two = F.substring(number, 1, 2).try_cast("int")
    four = F.substring(number, 1, 4).try_cast("int")
    sixteen = (size == 16) & (
        two.between(51, 55) | four.between(2221, 2720)
        | number.rlike("^(?:6011|65|35|220)"))
    other = number.rlike("^4") | sixteen | (size.between(16, 19) & number.startswith("62"))
    return F.when(size == 15, number.rlike("^3[47]")).otherwise(other)


def weighted(number: Column, weights: list[int]) -> Column:
    return reduce(lambda a, b: a + b, [digit(number, i + 1) * w for i, w in enumerate(weights) if w])


def inn_ok(number: Column) -> Column:
    """Ten digits carry one control digit, twelve carry two."""
    ten = weighted(number, fixed.INN_WEIGHTS_10) % 11 % 10 == digit(number, 10)
    twelve = ((weighted(number, fixed.INN_WEIGHTS_11) % 11 % 10 == digit(number, 11))
              & (weighted(number, fixed.INN_WEIGHTS_12) % 11 % 10 == digit(number, 12)))
    verdict = (F.when(number.rlike("^[0-9]{10}$"), ten)
               .when(number.rlike("^[0-9]{12}$"), twelve).otherwise(F.lit(False)))
    return F.coalesce(verdict, F.lit(False))


def snils_ok(number: Column) -> Column:
    """Weights run 9 to 1; early numbers carry no check. 100 and 101 both mean zero."""
    total = weighted(number, list(range(9, 0, -1)))
    control = F.when(total < 101, total).otherwise(total % 101) % 100
    early = F.substring(number, 1, 9).try_cast("long") <= fixed.SNILS_UNCHECKED_UP_TO
    right = control == F.substring(number, 10, 2).try_cast("int")
    return F.coalesce(number.rlike("^[0-9]{11}$") & (early | right), F.lit(False))


def ipv4_plausible(value: Column) -> Column:
    """Not a version number, loopback, null network or broadcast."""
    octets = F.split(value, r"\.")
    return ((F.size(F.filter(octets, lambda o: F.length(o) >= 2)) >= 2)
            & F.forall(octets, lambda o: o.try_cast("int").between(0, 255))
            & ~octets[0].isin("0", "127") & (value != "255.255.255.255"))


def mask_card(number: Column) -> Column:
    return F.concat(F.substring(number, 1, 4), F.lit(" **** **** "), F.right(number, F.lit(4)))


def shannon_entropy(token: Column) -> Column:
    """Bits per character."""
    size = F.length(token).cast("double")

    def add(total: Column, letter: Column) -> Column:
        share = (F.length(token) - F.length(F.replace(token, letter, F.lit("")))) / size
        return total - share * F.log2(share)

    letters = F.array_distinct(F.filter(F.split(token, ""), lambda c: c != ""))
    return F.aggregate(letters, F.lit(0.0), add)
