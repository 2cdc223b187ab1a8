import random
import re

from pyspark.sql import functions as F

from tests.llm.helpers import documents
from ledgerloom.llm import line_dedup

BLANK = "\x20\t\n\x0b\x0c\r"


def plain(rows, min_chars=20, min_docs=3):
    """Per row the kept text and the number of dropped lines, from the definition."""
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANK))

    low = float("-inf")
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(low if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs
                and max(holders[key(x)]) != (low if i is None else i) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[3], r[2])
    assert sorted(map(tuple, got), key=order) == sorted(plain(rows), key=order)


def test_against_the_definition(spark):
    rng = random.Random(3)
    pool = [f"a line that many pages share no. {i}" for i in range(30)] + ["short", "", "  ", "é" * 19, "é" * 20]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t\r"]) + rng.choice([str.upper, str.lower, str])(rng.choice(pool))
                          + rng.choice(["", "\x0b", " \x0c"]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    check(spark, rows)


def test_nulls_repeated_rows_and_one_id_with_two_texts(spark):
    line = "the line of at least twenty characters"
    check(spark, [(None, line), (None, line + "\nown"), (1, line), (1, line), (2, None), (3, ""), (3, line + "\n" + line),
                  (3, "other\n" + line), (-5, line.upper()), (-5, line)])
    check(spark, [(1, line), (1, line + "\nx"), (None, line)])


def test_frequent_lines_and_a_very_long_text(spark):
    rng = random.Random(4)
    hot = ["a line that stands in nearly every document", "another one of that kind, in half of them"]
    rows = [(i, "\n".join([hot[0]] * rng.randint(0, 2) + [hot[1]] * (i % 2) + [f"own line of document number {i}"]))
            for i in range(1500)]
    rows.append((9_000, "\n".join(rng.choice([*hot, f"long text, line {n % 700} of it, repeated"]) for n in range(20_000))))
    rows += [(10_000 + k, "\n".join(f"long text, line {n} of it, repeated" for n in range(300, 900))) for k in range(2)]
    lines = line_dedup.line_keys(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 20)
    assert line_dedup.hot_keys(lines).count() >= 2
    check(spark, rows)


def test_hot_and_cold_path_agree_on_few_documents(spark):
    line = "frequent, but in two documents only"
    rows = [(1, "\n".join([line] * 2000)), (2, "\n".join([line] * 2000)), (None, "one more line of enough characters")]
    check(spark, rows)
    check(spark, [*rows, (None, line)])


def test_empty_table_and_clashing_names(spark):
    empty = line_dedup.dedup_lines(documents(spark, []))
    assert empty.count() == 0
    docs = documents(spark, ["shared line of twenty characters\nmine %d" % i for i in range(4)])
    docs = docs.withColumnsRenamed({"lang": "row", "source": "bitmap", "n_chars": "n_dropped"}).withColumn("key", F.lit(7))
    out = line_dedup.dedup_lines(docs).orderBy("doc_id")
    assert out.columns == ["doc_id", "text", "row", "bitmap", "key", "n_lines", "n_dropped", "kept_text"]
    assert [(r["bitmap"], r["key"], r["n_dropped"], r["kept_text"]) for r in out.collect()] == [
        ("src", 7, 1, f"mine {i}") for i in range(3)] + [("src", 7, 0, "shared line of twenty characters\nmine 3")]
