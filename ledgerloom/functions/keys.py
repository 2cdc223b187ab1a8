"""Identifier and key normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that are never an invoice number.
INVOICE_NO_STOPWORDS = (
    "ON", "IN", "DO", "DATE", "GST", "NO", "TO", "OF", "THE", "INVOICE",
    "TAX", "BILL", "SHIP", "PO", "TOTAL", "AMOUNT", "PAGE", "REF",
)
# Legal forms and regions dropped from a supplier key.
SUPPLIER_NOISE_WORDS = ("PTE", "LTD", "LIMITED", "INC", "LLC", "CO", "CORP", "SINGAPORE", "ASIA")
# Street words; the first list only counts as whole words.
STREET_WORDS_WHOLE = ("Jln", "Jalan", "Road", "Rd", "Street", "St", "Ave", "Avenue", "Blk",
                      "Block", "Singapore", "Lorong")
STREET_WORDS_ANYWHERE = ("Jln", "Jalan", "Road", "Street", "Avenue", "Singapore", "Lorong")
# Confusable characters, from -> to, for folding a key and for repairing a reading.
FOLD_FROM, FOLD_TO = "OILSB", "01158"
REPAIR_FROM, REPAIR_TO = "OolISB", "001158"
# Pairs a scan is known to confuse, in either direction.
CONFUSABLE_PAIRS = (("O", "0"), ("I", "1"), ("L", "1"), ("S", "5"), ("B", "8"),
                    ("Z", "2"), ("G", "6"), ("Q", "0"), ("D", "0"))


# Every character that counts as white space.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Trim every kind of white space; ``trim`` alone only removes blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def identifier_text(c: Column) -> Column:
    """Printable form of a *numeric* identifier: 523.0 prints as 523."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def document_key(c: Column) -> Column:
    """Join key of an invoice or order number; NULL when nothing is left."""
    return blank_to_null(F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}_\-/]", ""))


def supplier_key(c: Column) -> Column:
    """Comparable supplier name; NULL when nothing is left."""
    words = "|".join(SUPPLIER_NOISE_WORDS)
    bare = F.regexp_replace(F.upper(c), rf"(?U)\b({words})\b", "")
    return blank_to_null(F.regexp_replace(bare, r"[^A-Z0-9]", ""))


def fold_key(c: Column) -> Column:
    """Collapse the characters a scan confuses, to compare keys up to misreads."""
    return F.translate(F.upper(c), FOLD_FROM, FOLD_TO)


def confusion_class(c: Column) -> Column:
    """Equal for any two strings that differ only in confusable characters."""
    letters = "".join(a for a, _ in CONFUSABLE_PAIRS)
    digits = "".join(b for _, b in CONFUSABLE_PAIRS)
    return F.translate(F.upper(c), letters, digits)


def repair_digits(c: Column) -> Column:
    """Digits for look-alike letters, only for fields that should be numeric."""
    return F.translate(c, REPAIR_FROM, REPAIR_TO)


def number_shape(c: Column) -> Column:
    """INV-0386 -> AAA-9999; a trailing .0 is ignored and a missing number has shape ''."""
    s = F.regexp_replace(strip(c), r"\.0$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\d", "9"), "[A-Za-z]", "A")
    return F.coalesce(s, F.lit(""))


def compare_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def is_valid_number(c: Column) -> Column:
    """Whether a reading looks like an invoice number at all. Never NULL."""
    s = strip(c)
    street = rf"\b(?:{'|'.join(STREET_WORDS_WHOLE)})\b|{'|'.join(STREET_WORDS_ANYWHERE)}"
    ok = (
        s.rlike(r"(?U)\d")
        & (F.length(F.regexp_replace(s, r"[^\p{L}\p{N}_]", "")) >= 4)
        & ~F.upper(s).isin(*INVOICE_NO_STOPWORDS)
        & ~s.rlike(rf"(?iU)^(?:19|20)\d{{2}}$|{street}")
    )
    return F.coalesce(ok, F.lit(False))


def spread_null(key: Column, row_id: Column) -> Column:
    """A key for outer joins whose NULLs do not all meet in one shuffle partition.

    NULL keys become distinct values ("~" never occurs in a key) that match nothing, so the rows keep their outer-join meaning.
    """
    return F.coalesce(key, F.concat(F.lit("~"), row_id.cast("string")))
