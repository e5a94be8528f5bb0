"""Date parsing and calendar helpers.

``to_date`` raises on bad input under ANSI mode, so parsing goes through
``try_to_date`` and a NULL result is the signal of an unparseable value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted forms (a pattern the text must match, its format).  Slashes between one- or
# two-digit numbers mean month/day/year; two-digit years are 2000-2099.
DATE_FORMS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_mixed_date(c: Column | str) -> Column:
    """Text in ``yyyy-MM-dd`` (a time may follow) or one of ``DATE_FORMS`` to DATE; NULL if none fits.

    Month names may have any case.
    """
    text = F.trim(_col(c).cast("string"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([ T].*)?$"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    named = F.initcap(F.regexp_replace(text, "-", " "))
    others = [
        F.when(text.rlike(pattern), F.try_to_date(named, form.replace("-", " ")) if "MMM" in form
               else F.try_to_date(text, form))
        for pattern, form in DATE_FORMS
    ]
    return F.coalesce(iso, *others)


def month_start(d: Column | str) -> Column:
    """First day of the month as DATE (``trunc``; ``date_trunc`` would yield a TIMESTAMP)."""
    return F.trunc(_col(d), "MM")


def months_between_div30(later: Column | str, earlier: Column | str) -> Column:
    """Whole 30-day months between two dates (floor division of the day difference)."""
    return F.floor(F.datediff(_col(later), _col(earlier)) / F.lit(30)).cast("int")
