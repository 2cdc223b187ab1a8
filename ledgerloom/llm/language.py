"""Language by compression: the language whose raw-content dictionary makes a text smallest.

A dictionary is up to ``dict_bytes`` of learning text, put before the text as if it had just been compressed. Whole
texts are read, in lower case and reduced to letters with single blanks between, in blocks so that the dictionary stays
in reach; the sizes of a text's blocks add up.

Learning reads at most ``texts_per_lang`` different excerpts of ``excerpt_chars`` characters per language, those whose
hash is smallest, over at most ``max_langs`` languages. As labels can be wrong, the excerpts of each half are classified under
dictionaries of the other half, and those that disagree with their label are left out. Prediction sees nothing but the
text.

Edge cases: null texts and texts without a letter are ``und`` with score 0. With no learning rows, every text is
``und``. Equal sizes go to the first language in alphabetical order, with score 0. Columns named like the results are
replaced; other columns stay.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
LETTER, NOT_LETTERS = regex.compile(r"\p{L}"), regex.compile(r"\P{L}+")
BLOCK_BYTES = 2 << 10
LEVEL = 6
LEAD_BYTES = 256
MIN_MARGIN = 0.001


def letters(text: str) -> str:
    """Lower case, with one blank for each run of anything but letters."""
    return NOT_LETTERS.sub(" ", text.lower())


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dict_bytes: int = 96 << 10,
          texts_per_lang: int = 400, excerpt_chars: int = 600, max_langs: int = 200) -> dict[str, bytes]:
    """Language -> dictionary content, from rows that have a language and letters.

    Copies of an excerpt are one. The smallest hashes win, of a share of the distinct excerpts that keeps the shuffle
    small. At most max_langs * texts_per_lang * excerpt_chars characters reach the driver.
    """
    start = F.substring(text_col, 1, excerpt_chars)
    # A text that begins with a long stretch without letters is read from its first letter on.
    excerpt = F.when(start.rlike(r"\p{L}"), start).otherwise(
        F.regexp_extract(text_col, rf"(?s)\p{{L}}.{{0,{excerpt_chars - 1}}}", 0))
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), excerpt.alias("t")).where(
        "t <> ''").select("lang", F.regexp_replace(F.lower("t"), r"\P{L}+", " ").alias("t")).withColumn(
        "h", F.xxhash64("t"))
    held = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("texts")).orderBy(
        F.desc("n"), "lang").limit(max_langs).collect()
    if not held:
        return {}
    # A share of each language's distinct excerpts by hash, about twice the wanted number; all where there are few.
    cut = F.create_map(*[F.lit(x) for r in held for x in (
        r["lang"], int(min(1.0, 2 * texts_per_lang / max(1, r["texts"])) * (1 << 30)))])
    rows = known.where(F.pmod("h", F.lit(1 << 30)) < cut[F.col("lang")]).select("lang", "h", "t").distinct()
    first = Window.partitionBy("lang").orderBy("h", "t")
    picked = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= texts_per_lang)
    labels: dict[str, set[str]] = {}
    for lang, h, t in sorted(map(tuple, picked.select("lang", "h", "t").limit(max_langs * texts_per_lang).collect())):
        labels.setdefault(letters(t), set()).add(lang)
    texts: dict[str, list[str]] = {}
    for t, langs in labels.items():
        if len(langs) == 1:
            texts.setdefault(min(langs), []).append(t)
    texts = {lang: texts[lang] for lang in sorted(texts)[:max_langs]}
    return {lang: joined(ts, dict_bytes) for lang, ts in trusted(texts, dict_bytes).items()}


def joined(texts: list[str], dict_bytes: int) -> bytes:
    return "\n".join(texts).encode("utf-8", "surrogatepass")[:dict_bytes]


def trusted(texts: dict[str, list[str]], dict_bytes: int) -> dict[str, list[str]]:
    """The excerpts that dictionaries of the other half agree with; all of a language if none agrees."""
    if len(texts) < 2 or min(map(len, texts.values())) < 4:
        return texts
    out: dict[str, list[str]] = {lang: [] for lang in texts}
    for half in (0, 1):
        size_of = sizes({lang: joined(ts[1 - half::2], dict_bytes) for lang, ts in texts.items()})
        for lang, ts in texts.items():
            for t in ts[half::2]:
                by = dict(zip(sorted(texts), size_of(t)))
                if by[lang] == min(by.values()):
                    out[lang].append(t)
    return {lang: out[lang] or ts for lang, ts in texts.items()}


def sizes(dictionaries: dict[str, bytes], block_bytes: int = BLOCK_BYTES, level: int = LEVEL):
    """A function from a text of letters to its compressed size under each dictionary, in the languages' order.

    The text follows a piece of the dictionary, which costs next to nothing: alone, a text of a few words would be
    stored as it is, with the same size everywhere.
    """
    coders, leads = [], []
    for lang in sorted(dictionaries):
        d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False,
                                               write_checksum=False, write_dict_id=False))
        leads.append(dictionaries[lang][-LEAD_BYTES:])

    def of(text: str) -> list[int]:
        raw = b" " + text.encode("utf-8", "surrogatepass") + b" "
        rest = [raw[i:i + block_bytes] for i in range(block_bytes, len(raw), block_bytes)]
        return [len(c.compress(lead + raw[:block_bytes])) + sum(len(c.compress(b)) for b in rest)
                for c, lead in zip(coders, leads)]

    return of


def predictor(dictionaries: dict[str, bytes], min_margin: float):
    langs = sorted(dictionaries)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        size_of = sizes(dictionaries)
        for texts in batches:
            rows = []
            for text in texts:
                if text is None or not langs or not LETTER.search(text):
                    rows.append((UNKNOWN, 0.0, True))
                    continue
                by = size_of(letters(text))
                best = min(range(len(langs)), key=by.__getitem__)
                second = min((s for i, s in enumerate(by) if i != best), default=None)
                score = 1.0 if second is None else (second - by[best]) / second
                rows.append((langs[best], float(score), score < min_margin))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    return F.pandas_udf(predict, "lang_pred string, score double, rejected boolean")


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """All columns plus lang_pred, score (how much smaller the best is than the second) and rejected."""
    found = predictor(dictionaries, min_margin)(F.col(text_col))
    keep = [F.col(c) for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.select(*keep, found.alias("_found")).select(*[c for c in docs.columns if c not in (
        "lang_pred", "score", "rejected")], "_found.lang_pred", "_found.score", "_found.rejected")


def remainder(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3


def drop_unknown(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text",
                 min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents with a language that stands out, with their own columns."""
    found = predictor(dictionaries, min_margin)(F.col(text_col))
    return docs.select(*docs.columns, found.alias("_found")).where("not _found.rejected").select(*docs.columns)
