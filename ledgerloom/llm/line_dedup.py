"""Lines that many documents share, kept in one of them; the result is a keep bitmap per document, not text.

Every line of a whole text gets a 128-bit digest of its key (blanks stripped at both ends, A-Z in lower case). Digests are
range-partitioned and sorted by document, largest id first, then by position, so that one pass over a partition meets the
document that keeps a key before all others and counts documents as they change. Positions to drop come back per row as
words of 64 bits, of which only those that drop a line are listed.

A key that very many lines carry would fill one partition. The most frequent keys of a sample of lines, at most
``HOT_KEYS``, are settled where the lines are instead: an aggregation finds the documents that hold each, and a broadcast
of that bounded list drops its lines. The sample decides who does the work, never what is dropped.

Edge cases: a null or empty text is one empty line. Keys shorter than ``min_chars`` never lose a line. Rows that share an
id are one document: their keys count once, and if theirs is the largest id they all keep their lines. A null id is one
document too, smaller than all others. Repeated rows each get a result row, with equal values. An empty table gives no
rows. Only id and text are read, so other columns, whatever their names, come through ``apply_bitmaps`` untouched.
Everything runs in the JVM. Digests stand for keys; texts are never compared again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.sources.scratch import written

HOT_KEYS = 4096
SAMPLE = 32
BLANKS = " \t\n\x0b\x0c\r"
BITMAP = "array<struct<word:int,dropped:bigint>>"


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _upper_to_lower(text: Column) -> Column:
    """Only A-Z; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, row, at, key): digest and position of every line whose key is long enough; ``row`` tells texts apart."""
    text = _text(text_col)
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("row"),
                        F.posexplode(F.split(_upper_to_lower(text), "\n")).alias("at", "line"))
    lines = lines.select("doc", "row", "at", F.trim("line", F.lit(BLANKS)).alias("key"))
    return lines.where(F.char_length("key") >= min_chars).withColumn("key", F.unhex(F.md5("key")))


def hot_keys(lines: DataFrame) -> DataFrame:
    """At most HOT_KEYS keys, the most frequent ones of every 32nd line or so."""
    return (lines.where(F.pmod(F.xxhash64("doc", "row", "at"), F.lit(SAMPLE)) == 0).groupBy("key")
            .agg(F.count("*").alias("n")).where("n >= 8").orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key"))


def dropped_hot(lines: DataFrame, hot: DataFrame, min_docs: int) -> DataFrame:
    """Lines to drop among the hot keys, decided in place.

    Whether a key is in ``min_docs`` documents takes one aggregation per document: the largest id, then the largest
    below it, and so on. Each is one row per hot key and combines before its shuffle.
    """
    mine = lines.join(F.broadcast(hot), "key")
    state = mine.groupBy("key").agg(F.max("doc").alias("keeper"), F.max(F.col("doc").isNull()).alias("idless"))
    state = written(state.withColumns({"low": F.col("keeper"), "n_docs": F.col("keeper").isNotNull().cast("int")}), "hot")
    for _ in range(min_docs - 1):
        below = mine.join(F.broadcast(state), "key").where("doc < low").groupBy("key").agg(F.max("doc").alias("next"))
        state = written(state.join(F.broadcast(below), "key", "left").withColumns({
            "low": F.col("next"), "n_docs": F.col("n_docs") + F.col("next").isNotNull().cast("int")}).drop("next"), "hot")
    shared = state.where(F.col("n_docs") + F.col("idless").cast("int") >= min_docs).select("key", "keeper")
    return mine.join(F.broadcast(shared), "key").where(~F.col("doc").eqNullSafe(F.col("keeper"))).select("doc", "row", "at")


def dropped_in_ranges(lines: DataFrame, min_docs: int) -> DataFrame:
    """Lines to drop, by a pass over digest ranges in which each key's documents follow each other, largest id first."""
    ranged = lines.repartitionByRange("key")
    by_doc = Window.partitionBy("key").orderBy(F.desc("doc"))
    in_order = Window.partitionBy("key").orderBy(F.desc("doc"), "at")
    all_of_key = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = ranged.withColumn("nth_doc", F.dense_rank().over(by_doc))
    met = met.withColumn("n_docs", F.last("nth_doc").over(all_of_key))
    return met.where((F.col("n_docs") >= min_docs) & (F.col("nth_doc") > 1)).select("doc", "row", "at")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                 min_docs: int = 3) -> DataFrame:
    """(doc, row, n_dropped, bitmap) of the rows that lose lines; ``row`` is the xxhash64 of the text.

    ``bitmap`` lists (word, dropped) by word: bit i of ``dropped`` is line 64 * word + i. Words without a bit are left out.
    """
    lines = written(line_keys(docs, id_col, text_col, min_chars), "lines")
    hot = written(hot_keys(lines), "hot")
    cold = lines.join(F.broadcast(hot), "key", "left_anti")
    gone = dropped_hot(lines, hot, min_docs).unionByName(dropped_in_ranges(cold, min_docs))
    words = gone.repartition("doc", "row").groupBy("doc", "row", F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("dropped"))
    return words.groupBy("doc", "row").agg(
        F.sum(F.bit_count("dropped")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", "dropped"))).cast(BITMAP).alias("bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``; columns that have these names are replaced."""
    text = F.coalesce(F.col(f"of.`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("of"), F.col(id_col).alias("doc"),
                       F.xxhash64(_text(text_col)).alias("row"))
    rows = rows.join(bitmaps, rows.doc.eqNullSafe(bitmaps.doc) & (rows.row == bitmaps.row), "left")
    by_word = F.map_from_entries("bitmap")
    rows = rows.select("of", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.transform(
        F.sequence(F.lit(0), F.element_at("bitmap", -1)["word"]),
        lambda w: F.coalesce(F.try_element_at(by_word, w), F.lit(0).cast("long"))).alias("words"))
    lines = F.split(text, "\n")

    def stays(_: Column, at: Column) -> Column:
        word = F.coalesce(F.get("words", F.shiftright(at, 6)), F.lit(0).cast("long"))
        return F.getbit(word, at.bitwiseAND(63)) == 0

    kept = F.when(F.col("words").isNull(), text).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return rows.select(*[F.col(f"of.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")],
                       F.size(lines).cast("long").alias("n_lines"), "n_dropped", kept.alias("kept_text"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                min_docs: int = 3) -> DataFrame:
    """``docs`` without repeated lines; see ``apply_bitmaps``."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)
