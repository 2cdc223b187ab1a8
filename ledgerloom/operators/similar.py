"""Similarity join of supplier keys, without a product of the two sides.

Short names meet on what is left of them after the letters that a similar name may lack are dropped: equal remains
are rare, so the work follows the pairs found. Dropping letters from long names gives too many remains; those meet
on rare letter pairs instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.config import Config
from ledgerloom.functions.shipping import ship_with_tasks
from ledgerloom.functions.similarity import similarity
from ledgerloom.sources.scratch import written

ship_with_tasks(__name__)

#: A length whose names, or their counterparts, leave more remains of one kind than this is looked up by letter pairs.
MOST_REMAINS = 400


def common_letters(m: int, n: int, threshold: float) -> int:
    """Fewest letters in common of two texts of these lengths whose ratio reaches the threshold."""
    return ceil(threshold * (m + n) / 200.0 - 1e-9)


def meetings(m: int, threshold: float) -> tuple[tuple[int, ...], tuple[tuple[int, int], ...], tuple[tuple[int, int], ...]] | None:
    """How a name of ``m`` letters meets longer ones: lengths of its remains, (window, remains) and (whole, remains).

    A window of ``m`` letters stands anywhere in the longer name, a shorter one at either end of it. Where a shorter
    window asks for as many letters as a longer one, the longer one holds them too. None if there are too many remains.
    """
    windows: dict[int, int] = {}
    for w in range(m, 0, -1):
        letters = common_letters(m, w, threshold)
        if letters <= w:
            windows.setdefault(letters, w)
    wholes, n = [], m + 1
    while (letters := common_letters(m, n, threshold)) <= m:
        wholes.append((n, letters))
        n += 1
        if n > 4 * m + 4:
            return None
    kept = {*windows, *(k for _, k in wholes)}
    sizes = [comb(m, k) for k in kept] + [comb(w, k) for k, w in windows.items()] + [comb(n, k) for n, k in wholes]
    if m == 0 or min(kept, default=0) < 1 or max(sizes) > MOST_REMAINS:
        return None
    return tuple(sorted(kept)), tuple((w, k) for k, w in windows.items()), tuple(wholes)


def meeting_plan(threshold: float) -> dict[int, tuple]:
    """``meetings`` of all lengths from 1 up to the first with too many remains."""
    plan, m = {}, 1
    while m <= 64 and (how := meetings(m, threshold)) is not None:
        plan[m], m = how, m + 1
    return plan


def _remains(text: str, k: int) -> set[str]:
    return {"".join(c) for c in combinations(text, k)}


def short_remains(name: str, plan: dict[int, tuple]) -> set[str]:
    return {r for k in plan[len(name)][0] for r in _remains(name, k)}


def long_remains(name: str, lengths: list[int], plan: dict[int, tuple]) -> dict[int, set[str]]:
    """Per length of shorter names, the remains that one of them must share."""
    out = {}
    for m in lengths:
        if m > len(name):
            continue
        _, windows, wholes = plan[m]
        found = out[m] = set()
        for w, k in windows:
            starts = range(len(name) - m + 1) if w == m else (0, len(name) - w)
            for i in starts:
                found |= _remains(name[i:i + w], k)
        for n, k in wholes:
            if n == len(name):
                found |= _remains(name, k)
    return out


def min_common_bigrams(length: Column, threshold: float) -> Column:
    """Fewest letter pairs of the shorter name that its counterpart must contain.

    A letter dropped from the shorter name breaks two of its pairs, an inserted one breaks one. With L
    letters kept that is at most m - L (3 - 2/s) pairs, worst for the fewest or for all letters kept.
    """
    share = threshold / 100.0
    slope = 3.0 - 2.0 / share
    fewest = F.ceil(length * (share / (2.0 - share)) - 1e-9)
    broken = F.floor(F.greatest(length - fewest * slope, length - length * slope) + 1e-9)
    return (length - 1 - broken).cast("int")


def _grams(name: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(name) - size + 1), lambda i: F.substring(name, i, size))


def _numbered_bigrams(name: Column) -> Column:
    """The letter pairs with their occurrence numbers, so that a set intersection counts repeats."""
    grams = F.when(F.length(name) > 1, _grams(name, F.lit(2))).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda g, i: F.concat(
        g, F.size(F.filter(F.slice(grams, 1, i), lambda h: h == g)).cast("string")))


def _names(df: DataFrame) -> DataFrame:
    """Distinct names with their letter pairs. The table is small and the work on it is not, so it is
    spread over all cores by number; a shuffle by size would leave it in one task."""
    n = df.where("name is not null").select("name").distinct().repartition(
        df.sparkSession.sparkContext.defaultParallelism)
    return n.withColumns({"bigrams": _numbered_bigrams(F.col("name")), "length": F.length("name")})


def _letters(name: Column) -> Column:
    return F.array_distinct(_grams(name, F.lit(1)))


def _with_marks(names: DataFrame, threshold: float) -> DataFrame:
    """Marks to look names up by: their numbered bigrams, or where none of those is sure to stay (one-letter
    names, low thresholds) their letters."""
    n = names.where("length > 0").withColumn(
        "needed", F.greatest(min_common_bigrams(F.col("length"), threshold), F.lit(0)))
    return n.withColumn("mark", F.explode(F.when(F.col("needed") > 0, F.col("bigrams")).otherwise(_letters(F.col("name")))))


def _rarest_marks(short: DataFrame, long: DataFrame, threshold: float) -> DataFrame:
    """Each shorter name with just enough marks, the rarest first.

    Of m - 1 bigrams a counterpart has at least the needed ones, so among any m - needed of them one is
    shared (of letters, all are kept). Taking the rarest keeps a piece that a third of all names contain from pairing them all.
    """
    counts = long.groupBy("mark").agg(F.count("*").alias("freq"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.coalesce("freq", F.lit(0)), "mark"))
    return (_with_marks(short, threshold).join(counts, "mark", "left").withColumn("rank", rank)
            .where(F.col("rank") <= F.col("length") - F.col("needed")))


def _merged(s: DataFrame, t: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of the pieces of names, never by broadcast.

    Spark judges the pieces by the file of the names they come from. They are up to a hundred times as large, and a
    broadcast would gather them in the driver.
    """
    return s.hint("merge").join(t.hint("merge"), keys)


def _candidates(short: DataFrame, long: DataFrame, threshold: float) -> DataFrame:
    """Pairs that share a mark and, for the shorter name, enough bigrams. No pair at the threshold is lost."""
    marked = long.where("length > 0").withColumn("mark", F.explode(F.concat("bigrams", _letters(F.col("name")))))
    s = _rarest_marks(short, marked, threshold).select(
        F.col("name").alias("short"), F.col("bigrams").alias("short_bigrams"), F.col("length").alias("short_length"),
        "needed", "mark")
    t = marked.select(F.col("name").alias("long"), F.col("bigrams").alias("long_bigrams"),
                      F.col("length").alias("long_length"), "mark")
    common = F.size(F.array_intersect("short_bigrams", "long_bigrams"))
    return (_merged(s, t, ["mark"]).where("short_length <= long_length").where(common >= F.col("needed"))
            .select("short", "long").distinct())


def _met(short: DataFrame, long: DataFrame, plan: dict[int, tuple]) -> DataFrame:
    """(short, long): pairs that share a remain, of shorter names up to the lengths of the plan."""
    short = short.where(F.length("name").between(1, len(plan))).select("name")
    lengths = sorted(r["m"] for r in short.select(F.length("name").alias("m")).distinct().collect())  # a row a length

    def of_short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(n, len(n), r) for n in b.name for r in short_remains(n, plan)],
                               columns=["short", "m", "remain"])

    def of_long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):  # a long name meets every shorter length and may leave thousands of remains
                yield pd.DataFrame([(n, m, r) for n in b.name[at:at + 256]
                                    for m, found in long_remains(n, lengths, plan).items() for r in found],
                                   columns=["long", "m", "remain"])

    s = short.mapInPandas(of_short, "short string, m int, remain string")
    t = long.select("name").mapInPandas(of_long, "long string, m int, remain string")
    return _merged(s, t, ["m", "remain"]).select("short", "long").distinct()


def similar_names(left: DataFrame, right: DataFrame, cfg: Config) -> DataFrame:
    """(left_name, right_name, similarity) of all pairs of distinct names at or above the threshold.

    Takes frames with a column ``name``; only distinct names are compared, so the cost follows the
    number of suppliers and not the number of rows. They are stored, as each side is read several times.
    """
    t = cfg.similarity_threshold
    plan = meeting_plan(t)
    a, b = (written(_names(df), "names") for df in (left, right))

    def pairs(short: DataFrame, long: DataFrame) -> DataFrame:
        rest = F.length("name") > len(plan)
        return _met(short, long, plan).unionByName(_candidates(short.where(rest), long.where(rest), t))

    forward = pairs(a, b).select(F.col("short").alias("left_name"), F.col("long").alias("right_name"))
    backward = pairs(b, a).select(F.col("long").alias("left_name"), F.col("short").alias("right_name"))
    spread = a.sparkSession.sparkContext.defaultParallelism
    return (forward.unionByName(backward).distinct().repartition(spread)
            .withColumn("similarity", similarity(F.col("left_name"), F.col("right_name")))
            .where(F.col("similarity") >= t))
