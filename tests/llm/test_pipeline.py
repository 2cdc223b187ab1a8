"""The pipeline on planted cases, and its stages on odd tables."""

import random

import corpus_pipeline
from tests.llm.helpers import documents, prose


def test_stages_in_order_on_planted_cases(spark, tmp_path):
    rng = random.Random(1)
    english = lambda n: " ".join(rng.choice(["the", "and", "thing", "with", "other", "hand"]) + rng.choice(["", "ing", "er", "ly"]) + prose(rng, 1)[:2] for _ in range(n))  # noqa: E731,E501
    spanish = lambda n: " ".join(rng.choice(["el", "los", "ción", "para", "mente"]) + rng.choice(["o", "as", "ñ"]) + prose(rng, 1)[:2] for _ in range(n))
    texts = [english(150) for _ in range(30)] + [spanish(150) for _ in range(30)]
    langs = ["en"] * 30 + ["es"] * 30
    passage = english(80)
    planted = {60: "12345 !!!", 61: None, 62: texts[0], 63: texts[1] + " one more word", 64: f"{english(50)} {passage} {english(50)}",
               65: f"{english(60)} {passage} {english(40)}"}
    texts += [planted[i] for i in range(60, 66)]
    langs += [None, None, "en", "en", "en", "en"]
    documents(spark, texts, langs).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns or name == "packing"
    assert set(kept["language"]) == set(range(66)) - {60, 61}
    assert set(kept["exact_dedup"]) == set(kept["language"]) - {0}
    assert set(kept["ngram_join"]) == set(kept["exact_dedup"]) - {63}
    cut = kept["suffix_dedup"]
    assert set(cut) == set(kept["ngram_join"]) and passage not in cut[64]["text"] and passage not in cut[65]["text"]
    assert all(cut[i]["text"] == texts[i] for i in cut if i not in (64, 65))
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())
    assert set(kept["packing"]) == set(cut)
    run = {r["doc_id"]: r["batch_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert run == {i: r["batch_id"] for i, r in kept["packing"].items()}


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
