"""Tolerant dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import close_match

#: Fixed values.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MISSPELT_CUTOFF = 0.7


def tidy(text: Column) -> Column:
    """No dots, single blanks, ``Sept`` as ``Sep``."""
    s = F.trim(F.regexp_replace(F.regexp_replace(text, r"\.", ""), r"(?U)\s+", " "))
    return F.regexp_replace(s, "Sept ", "Sep ")


def parse_date(text: Column) -> Column:
    """A date written like ``Sept. 1, 1969`` or ``OCT 23 2025``, also with a misspelt month.

    Month names count from three letters on; a word that is no beginning of a month
    is taken for the month it is most like. Null, no date, or no such day (June 31): null.
    """
    s = tidy(text)
    pattern = r"(?i)^([a-z]+) (\d{1,2}),? ?(\d{4})$"
    word = F.initcap(F.regexp_extract(s, pattern, 1))
    number = None
    for k, name in enumerate(MONTHS, 1):
        hit = (F.length(word) >= 3) & F.lit(name).startswith(word)
        number = F.when(hit, k) if number is None else number.when(hit, k)
    # Python sees only words that no month begins with.
    guess = close_match(MONTHS, MISSPELT_CUTOFF)(F.when((word != "") & number.isNull(), word))
    place = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), guess)
    number = F.coalesce(number, F.nullif(place, F.lit(0)).cast("int"))
    year, day = F.regexp_extract(s, pattern, 3), F.regexp_extract(s, pattern, 2)
    built = F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when((word != "") & number.isNotNull(), F.try_to_date(built, "yyyy-MM-dd"))


def long_date(day: Column) -> Column:
    """``June 22, 1961``, or ``date unknown``."""
    return F.coalesce(F.date_format(day, "MMMM d, yyyy"), F.lit("date unknown"))
