"""Column functions that mask personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .text import Rules, fold


def bsn_valid(number: Column) -> Column:
    """The eleven-test of a citizen service number of nine digits: weights 9..2 and -1."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.substring(number, i, F.lit(1)).cast("int") * F.when(i == 9, F.lit(-1)).otherwise(10 - i))
    total = F.aggregate(digits, F.lit(0), lambda a, x: a + x)
    return F.coalesce(number.rlike("^[0-9]{9}$") & (F.pmod(total, F.lit(11)) == 0), F.lit(False))


def mask_bsn(text: Column) -> Column:
    """Nine-digit numbers that pass the test become [BSN]; others stay."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{9})(?![0-9])"), F.lit(1)))
    return F.aggregate(F.filter(runs, bsn_valid), text, lambda t, n: F.regexp_replace(t, F.concat(F.lit("(?<![0-9])"), n, F.lit("(?![0-9])")), F.lit("[BSN]")))


def mask_dates(text: Column) -> Column:
    return fold(text, R.DATES)


def mask_phones(text: Column) -> Column:
    return fold(text, R.PHONES)


def mask_patient_numbers(text: Column) -> Column:
    return fold(text, R.PATIENT)


def mask_numbers(text: Column) -> Column:
    return fold(text, R.NUMBERS)


def deidentify(text: Column, bsn: bool = True, patient: bool = False, phone: bool = False, date: bool = False, url: bool = False, doi: bool = False, custom: Rules = (), numbers: bool = True) -> Column:
    """The masks in their fixed order: BSN, patient number, phone, date, link, DOI, custom rules, numbers."""
    if bsn:
        text = mask_bsn(text)
    for on, rule in ((patient, R.PATIENT), (phone, R.PHONES), (date, R.DATES), (url, R.LINKS), (doi, R.DOI), (bool(custom), custom), (numbers, R.NUMBERS)):
        if on:
            text = fold(text, rule)
    return text
