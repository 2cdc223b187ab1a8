"""Whole licence texts, found by the digest of their canonical form.

The canonical form is lower case, without lines that state a copyright, with equivalent spellings made one (the pairs of
the public licence matching guidelines), and with every run of anything but letters and digits as one blank. Texts and
known licences go through the same column expression, and the digests meet in an equi-join; no part of a text matches.

Known are a few one-line notices and the whole texts in ``licenses/``; ``known_licenses`` takes further ones.

``scan`` looks at whole documents, ``scan_lines`` at the same whole-text rule for each line, so that a notice that makes
up a line of a document is reported with its line numbers.

Edge cases: null, empty and wordless texts match nothing. Repeated rows each get their own result. If several known
licences share a canonical form, the first name in order is reported. Extra columns of the documents are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Equivalent words of the public licence matching guidelines.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgment", "judgement"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "wilfull"), ("noncommercial", "non-commercial"), ("copyright owner", "copyright holder"),
    ("sublicence", "sublicense"), ("sub-license", "sublicense"), ("https", "http"),
)

# Short public licence notices, by identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
             "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
             "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
             "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
             "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
)

FULL_TEXTS = Path(__file__).with_name("licenses")


def full_texts() -> Iterator[tuple[str, str]]:
    """(license, text) of the whole public texts, also without the title, with reserved rights, without the appendix."""
    for path in sorted(FULL_TEXTS.glob("*.txt")):
        text = path.read_text("utf-8")
        for end in re.finditer(r"END OF TERMS AND CONDITIONS\s", text):
            yield path.stem, text[:end.start()]
            yield path.stem, text[:end.end()]
        yield path.stem, text
        title, body = text.split("\n\n", 1)
        if path.stem in UNTITLED:
            for first in (title, f"The {title}", f"The {title} ({path.stem})", f"{title} ({path.stem})", ""):
                yield path.stem, f"{first}\n\n{body}"
                yield path.stem, f"{first}\n\nAll rights reserved.\n\n{body}"


#: Short licences, often given without their title.
UNTITLED = ("BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT")
KNOWN = NOTICES + tuple(full_texts())

_GAP = r"[^\p{L}\p{N}\n]*"
_YEAR = r"(?:19|20)[0-9]{2}"
#: A statement that shows as one wherever it stands: the word with a sign, a year or reserved rights, (c) with a year or
#: a kind of holder, or a sign alone.
_STATED = (rf"{_GAP}(?:copyright{_GAP}(?:[0-9]|c[^\p{{L}}\p{{N}}\n]+[0-9]|\(c\)|©)[^\n]*"
           rf"|(?:copyright|\(c\))[^\n]*[^\p{{L}}\p{{N}}\n]{_YEAR}{_GAP}$"
           rf"|(?:copyright|\(c\))[^\n]*all rights reserved{_GAP}$"
           rf"|\(c\){_GAP}[0-9][^\n]*"
           r"|\(c\)[ \t]+(?:[^ \t\r\n]+[ \t]+){0,6}"
           rf"(?:authors?|contributors|company|corp|corporation|developers|foundation|gmbh|inc|llc|ltd|project|team){_GAP}$"
           r"|©[^\n]*)")
#: The word and a short name, which a wrapped sentence about copyright holders can look like.
_NAMED = rf"{_GAP}copyright[ \t]+(?:\p{{L}}[^ \t\r\n]*)(?:[ \t]+[^ \t\r\n]+){{0,6}}[ \t\r]*$"
#: Lines that state a copyright, in lower case; those with a bare name only where a paragraph starts, after at most eight
#: other such lines.
COPYRIGHT_LINE = (rf"(?m)^(?:(?:\A|{_GAP}\n)(?:(?:{_STATED}|{_NAMED})\n){{0,8}}(?:{_STATED}|{_NAMED})|{_STATED})")
#: What each of them holds; texts without any are not searched.
COPYRIGHT_SIGNS = ("copyright", "(c)", "©")


def words_of(low: Column) -> Column:
    """Words of a lower-case text with single blanks between and around, without lines that state a copyright."""
    any_sign = F.contains(low, F.lit(COPYRIGHT_SIGNS[0]))
    for sign in COPYRIGHT_SIGNS[1:]:
        any_sign = any_sign | F.contains(low, F.lit(sign))
    kept = F.when(any_sign, F.regexp_replace(low, COPYRIGHT_LINE, "")).otherwise(low)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(kept, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def any_word(words: list[str]) -> str:
    """A pattern of any of the words, as a tree of their letters: a word of the text is given up at its first odd letter."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    branches = [(re.escape(h) + any_word(rest)) if h else "" for h, rest in sorted(heads.items(), reverse=True)]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def one_spelling(words: Column) -> Column:
    """The words with equivalent spellings made one; blank if there are none. Most texts need one look only."""
    pairs = [(f" {a.replace('-', ' ')} ", f" {b.replace('-', ' ')} ") for a, b in EQUIVALENT]
    changed = words
    for one, other in pairs:
        changed = F.replace(changed, F.lit(one), F.lit(other))
    any_of = " " + any_word([one.strip() for one, _ in pairs]) + " "
    return F.trim(F.when(words.rlike(any_of), changed).otherwise(words))


def with_digest(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """Kept columns and the digest of the canonical form, an empty string without words.

    The steps are projections of their own and the digest is never null, so that no step is computed twice.
    """
    low = rows.select(*keep, F.lower(F.coalesce(text, F.lit(""))).alias("_low"))
    words = low.select(*keep, words_of(F.col("_low")).alias("_words"))
    forms = words.select(*keep, one_spelling(F.col("_words")).alias("_form"))
    return forms.select(*keep, F.coalesce(F.when(F.length("_form") > 0, F.sha2("_form", 256)), F.lit("")).alias("digest"))


def known_licenses(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """(license, digest) of the built-in notices and of further (license, text) rows."""
    rows = spark.createDataFrame(list(KNOWN), "license string, text string")
    if extra is not None:
        rows = rows.unionByName(extra.select("license", "text"))
    # Null, not a comparison with the empty digest: Spark would ask the texts that are joined for the same comparison, ahead of
    # the steps that make their digest, and compute all of them several times.
    found = with_digest(rows, F.col("text"), "license").select("license", F.nullif("digest", F.lit("")).alias("digest"))
    return found.where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, digest (null without words) and license (null if unknown)."""
    rows = with_digest(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text"), "doc_id")
    return rows.join(known.select("digest", "license"), "digest", "left").select(
        "doc_id", F.nullif("digest", F.lit("")).alias("digest"), "license")


def scan_lines(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, license): lines, counted from 1, that are a known licence as a whole."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "text"))
    rows = with_digest(lines, F.col("text"), "doc_id", "line")
    return rows.join(known.select("digest", "license"), "digest").select(
        "doc_id", (F.col("line") + 1).cast("long").alias("line"), "license")
