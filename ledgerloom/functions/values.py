"""Money, dates and their printed forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.keys import blank_to_null, strip

MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    """'S$1,234.56' -> 1234.56; blanks, lone signs and malformed numbers give NULL."""
    digits = F.regexp_replace(c, r"[^\d.\-]", "")
    return F.when(digits.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), digits.try_cast(MONEY))


def parse_date(c: Column) -> Column:
    """Printed date to DATE; day-first wins over month-first where both are possible.

    Each format is tried only on strings of its shape, so no row pays for parse failures of the rest.
    """
    s = strip(c)
    named = F.regexp_replace(s, r"^(\d{1,2})\s*([A-Za-z]{3})[A-Za-z]{0,6}\s*(\d{4})$", "$1 $2 $3")
    plain = F.translate(s, "./", "--")

    def shaped(text: Column, shape: str, *formats: str) -> Column:
        tries = [F.try_to_date(text, f) for f in formats]
        return F.when(text.rlike(shape), tries[0] if len(tries) == 1 else F.coalesce(*tries))

    return F.coalesce(
        shaped(plain, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        shaped(plain, r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy", "M-d-yyyy"),
        shaped(s, r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
        shaped(named, r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
        F.when(plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
               F.try_to_date(F.substring_index(plain, " ", 1), "yyyy-M-d")),
    )


def number_text(c: Column) -> Column:
    """Printed amount with at least one and at most two decimals: 571.06, 77.5, 10.0."""
    return F.regexp_replace(c.cast("decimal(30,2)").cast("string"), r"(\.\d)0$", "$1")


def join_notes(*parts: Column) -> Column:
    """Parts joined by '; ', skipping the empty ones."""
    return F.concat_ws("; ", *[blank_to_null(p) for p in parts])


def edited_number(c: Column) -> Column:
    """A typed-in amount; NULL when it is not a number."""
    return strip(F.regexp_replace(c, ",", "")).try_cast(MONEY)


def edited_date(c: Column) -> Column:
    s = strip(c)
    return F.coalesce(parse_date(s), F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_date(F.substring(s, 1, 10))))


def day_text(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")
