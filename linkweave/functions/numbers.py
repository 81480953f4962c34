"""Native column rules for issue numbers, years, dates, prices and barcodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Barcode that means none.
NO_BARCODE = "0" * 14


def catalog_number(c: Column) -> Column:
    """Number as the catalog spells it: half as 0.5, annuals, letters as they are, numerics as integers, else 1."""
    t = F.trim(F.coalesce(c, F.lit("")))
    number = t.try_cast("double")
    return (
        F.when(t == "", F.lit("1"))
        .when(t.isin("½", "1/2"), F.lit("0.5"))
        .when(F.lower(t).isin("annual", "ann"), F.lit("Annual"))
        .when(t.rlike(r"^(\p{L}+|\d+\p{L}+)$"), t)
        .when(number.isNotNull(), number.cast("bigint").cast("string"))
        .otherwise(F.lit("1"))
    )


def parsed(c: Column) -> Column:
    """Struct of canonical number, variant suffix and error code by the number grammar."""
    t = F.trim(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(t, r"^#", "")
    shape = r"^(-?\d+(?:[./]\d+)?)(?:\.?([A-Za-z][A-Za-z.]*))?$"
    error = (
        F.when(t == "", F.lit("EMPTY_INPUT"))
        .when(t.rlike(r"^[-./#]+$"), F.lit("ONLY_SEPARATOR"))
        .when(bare.rlike(r"[,&]") | bare.rlike(r"^-?\d+[A-Za-z]*-\d"), F.lit("MULTI_ISSUE_RANGE"))
        .when(~bare.rlike(shape), F.lit("INVALID_FORMAT"))
    )
    ok = error.isNull()
    suffix = F.regexp_extract(bare, shape, 2)
    return F.struct(F.when(ok, F.regexp_extract(bare, shape, 1)).alias("canonical"), F.when(ok & (suffix != ""), suffix).alias("suffix"), error.alias("error_code"))


def year(c: Column, first: int, last: int) -> Column:
    """Integer part of a year within a range, else null."""
    y = F.trim(c).try_cast("double").cast("int")
    return F.when(y.between(first, last), y)


def cover_year(publication: Column, key_date: Column) -> Column:
    """First four digits of free text, else the part of the key date before its first hyphen."""
    found = F.regexp_extract(publication, r"(\d{4})", 1).try_cast("int")
    return F.coalesce(found, F.split(key_date, "-")[0].try_cast("int"))


def date(c: Column) -> Column:
    """Date in one of the usual spellings; a ``-00`` day or month counts as the first."""
    t = F.regexp_replace(F.trim(c), r"-00", "-01")
    spellings = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "MMMM yyyy", "MMM yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy-MM", "yyyy")
    return F.coalesce(*(F.try_to_date(t, s) for s in spellings))


def price(c: Column) -> Column:
    return F.replace(F.regexp_extract(c, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit("")).try_cast("double")


def pages(c: Column) -> Column:
    return F.regexp_extract(c, r"([0-9]+)", 1).try_cast("int")


def barcode(c: Column) -> Column:
    """Digits without spaces and hyphens; anything else, blank or all zeros is null."""
    t = F.regexp_replace(c, r"[\s-]", "")
    return F.when(t.rlike(r"^\d+$") & (t != NO_BARCODE), t)
