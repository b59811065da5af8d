"""Check digits of health identifiers, as native column arithmetic. Null in, null out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 24 letters without I and O; weights of the check sums.
NHI_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
NHI_WEIGHTS = (7, 6, 5, 4, 3, 2)
MEDICARE_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9)
IHI_PREFIX = "800360"


def _digit(c: Column, place: int) -> Column:
    return F.substring(c, place, 1).cast("int")


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def nhi_valid(c: Column) -> Column:
    """Old form: three letters (no I, O), three digits, a check digit modulo 11."""
    shape = F.regexp_like(c, F.lit(f"^[{NHI_LETTERS}]{{3}}[0-9]{{4}}$"))
    letters = [F.instr(F.lit(NHI_LETTERS), F.substring(c, i + 1, 1)) * NHI_WEIGHTS[i] for i in range(3)]
    numbers = [_digit(c, i + 1) * NHI_WEIGHTS[i] for i in range(3, 6)]
    rest = _sum(letters + numbers) % 11
    return F.when(shape, (rest > 1) & (11 - rest == _digit(c, 7))).otherwise(shape)


def medicare_valid(c: Column) -> Column:
    """Ten digits, the first 2 to 6, the ninth a weighted sum modulo 10; the tenth is free."""
    d = digits_only(c)
    shape = F.regexp_like(d, F.lit("^[2-6][0-9]{9}$"))
    total = _sum([_digit(d, i + 1) * w for i, w in enumerate(MEDICARE_WEIGHTS)])
    return F.when(shape, total % 10 == _digit(d, 9)).otherwise(shape)


def luhn_valid(c: Column) -> Column:
    d = digits_only(c)
    return (F.length(d) >= 2) & F.call_function("luhn_check", d)


def ihi_valid(c: Column) -> Column:
    d = digits_only(c)
    return (F.length(d) == 16) & F.startswith(d, F.lit(IHI_PREFIX)) & F.call_function("luhn_check", d)
