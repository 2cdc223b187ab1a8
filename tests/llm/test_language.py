import random

from ledgerloom.llm import language as x
from tests.llm.helpers import documents

SYLLABLES = {"aa": ["the", "ing", "and", "er"], "bb": ["ción", "el", "os", "ñas"], "cc": ["ung", "der", "sch", "ö"]}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_learns_and_tells_languages_apart(spark):
    rng = random.Random(1)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(120)]
    docs = documents(spark, [text(rng, g) for g in langs], langs)
    learnt = x.learn(docs.where("doc_id < 60"), texts_per_lang=10, excerpt_chars=200)
    assert sorted(learnt) == sorted(SYLLABLES)
    got = {r["doc_id"]: r for r in x.classify(docs, learnt).collect()}
    assert sum(got[i]["lang_pred"] == g for i, g in enumerate(langs) if i >= 60) >= 58
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_the_smallest_wins_by_brute_force(spark):
    rng = random.Random(2)
    learnt = {g: text(rng, g, 300).encode() for g in SYLLABLES}
    rows = [text(rng, g, n) for g in SYLLABLES for n in (1, 30, 3000)]
    got = {r["doc_id"]: r for r in x.classify(documents(spark, rows), learnt).collect()}
    for i, t in enumerate(rows):
        by = dict(zip(sorted(learnt), x.sizes(learnt)(x.letters(t))))
        assert by[got[i]["lang_pred"]] == min(by.values())


def test_odd_texts_labels_and_columns(spark):
    rows = [None, "", "123 !?", "  ", "the the", "日本", "x" * 300_000]
    docs = documents(spark, rows, [None, "aa", "aa", None, "aa", "bb", "bb"]).selectExpr("*", "7 as score", "'q' as h")
    learnt = x.learn(docs)
    got = {r["doc_id"]: r for r in x.classify(docs, learnt).collect()}
    assert [got[i]["lang_pred"] == "und" for i in range(7)] == [True] * 4 + [False] * 3
    assert got[0]["score"] == 0.0 and got[0]["rejected"] and got[0]["h"] == "q"
    kept = x.drop_unknown(docs, learnt)
    assert kept.columns == docs.columns and kept.where("score <> 7").count() == 0
    assert x.learn(docs.where("lang is null")) == {}
    assert {r["lang_pred"] for r in x.classify(docs, {}).collect()} == {"und"}
    assert x.classify(docs.limit(0), learnt).count() == 0


def test_conflicting_and_wrong_labels_are_left_out(spark):
    rng = random.Random(3)
    same = text(rng, "aa")
    wrong = text(rng, "bb")
    rows = [same, same, wrong] + [text(rng, g) for g in ("aa", "bb") for _ in range(20)]
    langs = ["aa", "bb", "aa"] + ["aa"] * 20 + ["bb"] * 20
    learnt = x.learn(documents(spark, rows, langs))
    assert same.encode() not in learnt["aa"] and same.encode() not in learnt["bb"]
    assert x.letters(wrong).encode() not in learnt["aa"]


def test_a_language_of_a_few_large_groups_of_copies(spark):
    rng = random.Random(5)
    few = [text(rng, "aa") for _ in range(4)]
    few.append("1 " * 400 + text(rng, "aa"))
    rows = few * 400 + ["12 !?"] * 500 + [text(rng, "bb") for _ in range(40)]
    learnt = x.learn(documents(spark, rows, ["aa"] * 2500 + ["bb"] * 40), texts_per_lang=10)
    assert sorted(learnt) == ["aa", "bb"]
    assert all(x.letters(t)[1:500].encode() in learnt["aa"] for t in few)
    # Copies do not take the places of other texts.
    mixed = few[:1] * 2000 + [text(rng, "aa") for _ in range(30)]
    learnt = x.learn(documents(spark, mixed, ["aa"] * len(mixed)), texts_per_lang=20)
    assert len(learnt["aa"].split(b"\n")) == 20
