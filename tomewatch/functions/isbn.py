"""ISBN expressions. Input is any text; hyphens and spaces are ignored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

THIRTEEN, TEN = "^97[89][0-9]{10}$", "^[0-9]{9}[0-9Xx]$"
# Group prefixes doubled by a faulty feed.
DOUBLED = ("9789789", "9799789", "9789979", "9799979")


def normalize(raw: Column) -> Column:
    return F.translate(F.coalesce(raw, F.lit("")), "- ", "")


def _weighed(text: Column, weights: list[int]) -> Column:
    """Sum of the leading digits (X is ten) times ``weights``, of text that has as many."""
    value = lambda k: F.least(F.position(F.substring(text, k, 1), F.lit("0123456789Xx")) - 1, F.lit(10))
    return sum((value(k) * w for k, w in enumerate(weights, 1)), F.lit(0))


def _sum13(text: Column, digits: int) -> Column:
    return _weighed(text, [1 if k % 2 == 0 else 3 for k in range(digits)])


def _misread(clean: Column) -> Column:
    """A ten-digit number that is the head of a 13-digit one."""
    return F.substring(clean, 1, 3).isin("978", "979")


def is_valid(raw: Column) -> Column:

    def judge(c: Column) -> Column:
        long = F.when(F.substring(c, 1, 7).isin(*DOUBLED), F.lit(False)).otherwise(_sum13(c, 13) % 10 == 0)
        short = F.when(_misread(c), F.lit(False)).otherwise(_weighed(c, list(range(10, 0, -1))) % 11 == 0)
        return F.when(c.rlike(THIRTEEN), long).when(c.rlike(TEN), short).otherwise(F.lit(False))

    return once(normalize(raw), judge)


def to_isbn13(raw: Column) -> Column:
    """The 13-digit form, checksum of the input not verified; null if there is none."""
    c = normalize(raw)
    body = F.concat(F.lit("978"), F.substring(c, 1, 9))
    made = F.concat(body, ((10 - _sum13(body, 12) % 10) % 10).cast("string"))
    return F.when(c.rlike(THIRTEEN), c).when(c.rlike(TEN) & ~_misread(c), made)


def to_isbn10(raw: Column) -> Column:
    """The 10-digit form; 979 numbers have none."""
    c = normalize(raw)
    body = F.substring(c, 4, 9)
    check = (11 - _weighed(body, list(range(10, 1, -1))) % 11) % 11
    made = F.concat(body, F.when(check == 10, "X").otherwise(check.cast("string")))
    return F.when(c.rlike(TEN), F.upper(c)).when(c.rlike(THIRTEEN) & c.startswith("978"), made)


def arbitrate(isbn: Column, ean: Column) -> Column:
    """One number from a feed's two fields: a valid ISBN, else the EAN, else an ISBN-10 recovered to 13 digits.

    Where both are there and the nine significant digits agree, the EAN stands for a broken check digit.
    """
    i, e = normalize(isbn), normalize(ean)
    return (
        F.when(is_valid(i), i)
        .when(is_valid(e) & (F.substring(e, 4, 9) == F.substring(i, 1, 9)), e)
        .when(i.rlike(TEN) & ~_misread(i), to_isbn13(i))
        .when(is_valid(e), e)
    )
