"""Dates that come as free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALLBACK = "01/01/2022"
#: Formats tried in order; what none of them reads counts as unparsable.
FORMATS = ("MM/dd/yyyy", "yyyy-MM-dd", "MMM d, yyyy", "d MMM yyyy")


def claim_date(text: Column) -> Column:
    """`day-month-year` as MM/DD/YYYY. Years of one digit are 200y, of two digits 20yy up to 26 and 19yy above; anything else that isn't three numbers becomes FALLBACK."""
    parts = F.split(text, "-")
    year = F.get(parts, F.lit(2))
    full = F.when(F.length(year) == 1, F.concat(F.lit("200"), year)).when((F.length(year) == 2) & (year.cast("int") <= 26), F.concat(F.lit("20"), year)).when(F.length(year) == 2, F.concat(F.lit("19"), year)).otherwise(year)
    two = lambda x: F.lpad(x, 2, "0")
    valid = text.rlike(r"^\d{1,2}-\d{1,2}-\d{1,4}$")
    return F.when(valid, F.concat_ws("/", two(F.get(parts, F.lit(1))), two(F.get(parts, F.lit(0))), full)).otherwise(FALLBACK)


def parse_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in FORMATS])


def before_claim(result: Column, claim: Column) -> Column:
    """Keep a result without a date, with an unparsable date or dated strictly before the claim."""
    return F.coalesce(parse_date(result) < parse_date(claim), F.lit(True))


def date_range(claim: Column) -> Column:
    """The search engine's custom range: anything up to the claim's date."""
    return F.concat(F.lit("cdr:1,cd_min:1/1/1900,cd_max:"), claim)
