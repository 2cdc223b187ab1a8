"""Licence lookup, edit-aware counts and archives."""

import os
import random
import textwrap
import zstandard
import pytest

from ledgerloom.llm import license_scan, token_counts, warc
from tests.llm.helpers import documents

RANKS = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def test_licenses_by_canonical_digest(spark):
    known = license_scan.known_licenses(spark, spark.createDataFrame(
        [("X", "Copyright (c) 1999 Someone\n\nThe LICENCE of the organisation."), ("Y", None), ("Z", "the license of the organization")],
        "license string, text string"))
    texts = ["released UNDER the  MIT\nlicence!!", "Copyright 2024 Me\n© You\nReleased under the MIT License", None, "", "...",
             "Released under the MIT License. And more", "the license -- of the Organization", "a\nReleased under the MIT License.\nb"]
    odd = documents(spark, texts).selectExpr("*", "'q' as license", "'w' as digest")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(odd, known).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: None, 3: None, 4: None, 5: None, 6: "X", 7: None}
    lines = {(r["doc_id"], r["line"], r["license"]) for r in license_scan.scan_lines(odd, known).collect()}
    assert lines == {(1, 3, "MIT"), (6, 1, "X"), (7, 2, "MIT")}
    assert license_scan.scan(documents(spark, []), known).count() == 0


HEADERS = ["Copyright (c) Jane Doe", "Copyright Example Ltd 2020", "Copyright The Authors", "Copyright © Jane Doe",
           "(c) 2020 Jane Doe", "(C) Jane Doe, 2020", "(c) Example Ltd.", "© Jane", "Copyright Jane Doe. All rights reserved.",
           "Copyright (C) 1999-2020 One\nCopyright Two and Three\n * Copyright (c) Four"]


def test_copyright_lines_of_all_kinds(spark):
    known = license_scan.known_licenses(spark)
    clauses = ["(c) You must retain the notice", "(c) You may drop the notice", "x",
               "by the\ncopyright holders and others", "by the copyright\nholders and others", "by the and others"]
    rows = [f"{h}\n\nReleased under the MIT License" for h in HEADERS] + [
        f"Licence text:\n\n{h}\r\n\r\nx" for h in HEADERS] + clauses
    got = [r for r in sorted(license_scan.scan(documents(spark, rows), known).collect(), key=lambda r: r["doc_id"])]
    n = len(HEADERS)
    assert [rows[i] for i in range(n) if got[i]["license"] != "MIT"] == []
    assert len({r["digest"] for r in got[n:2 * n]}) == 1
    # Clauses and wrapped sentences stay.
    a, b, c, d, e, f = [r["digest"] for r in got[2 * n:]]
    assert len({a, b, c}) == 3 and None not in (a, b, c) and d == e != f


def test_full_licence_texts(spark):
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT",
             "MPL-2.0"]
    rows, want = [], []
    for name in names:
        text = (license_scan.FULL_TEXTS / f"{name}.txt").read_text("utf-8")
        title, body = text.split("\n\n", 1)
        for width in (50, 200):
            # Paragraphs wrapped anew, but for those with a line of their own for the copyright.
            parts = [p if "opyright (C)" in p else textwrap.fill(p, width) for p in text.split("\n\n")]
            rows.append("Copyright (c) Some One\n\n" + "\n\n".join(parts))
            want.append(name)
        if name in license_scan.UNTITLED:
            rows += [f"{title}\n\nCopyright 2031 Other People\nAll rights reserved.\n\n{body}", f"(c) Example Ltd\n\n{body}"]
            want += [name] * 2
        rows.append(text.replace(" and ", " or ", 1))
        want.append(None)
    known = license_scan.known_licenses(spark)
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(documents(spark, rows), known).collect()}
    assert [got[i] for i in range(len(rows))] == want


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return f.read()


def test_counts_after_any_edits(monkeypatch, ranks):
    monkeypatch.setattr(token_counts, "LEAF", 3)
    counter = token_counts.Counter(ranks, cached=500)
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("ab \n  '.sré1日\t") for _ in range(n))
    for _ in range(800):
        text = some(rng.randint(0, 120))
        tree = token_counts.build_tree(text, counter)
        for _ in range(3):
            cuts = sorted(rng.randint(0, len(text)) for _ in range(2 * rng.randint(1, 3)))
            edits = [(a, b, some(rng.choice([0, 1, 5, 40]))) for a, b in zip(cuts[::2], cuts[1::2])]
            want = text
            for a, b, new in sorted(edits, key=lambda e: e[:2], reverse=True):
                want = want[:a] + new + want[b:]
            text, tree, again = token_counts.edited(text, tree, edits, counter)
            assert text == want and tree.chars[1] == len(want)
            assert tree.tokens[1] == len(counter.coder.encode_ordinary(want))
    long = "some words and 12 numbers. " * 4000
    tree = token_counts.build_tree(long, counter)
    assert token_counts.edited(long, tree, [(50_000, 50_003, "xyz")], counter)[2] < 200
    with pytest.raises(ValueError):
        token_counts.edited("abcdef", token_counts.build_tree("abcdef", counter), [(0, 4, ""), (3, 5, "")], counter)


def test_counts_in_frames(spark, ranks):
    rows = ["Hello world", None, "", "x" * 10_000]
    docs = documents(spark, rows).selectExpr("*", "5 as n_tokens",
                                             "array(struct(0 as start, 2 as end, 'Q' as text), null)[0] as e").selectExpr(
        "* except (e)", "case when doc_id = 0 then array(e) end as edits")
    done = token_counts.apply_edits(token_counts.count_tokens(docs, ranks), ranks)
    got = {r["doc_id"]: (r["n_tokens"], r["new_text"]) for r in done.collect()}
    counter = token_counts.Counter(ranks)
    size = lambda t: len(counter.coder.encode_ordinary(t))
    assert got == {0: (size("Qllo world"), "Qllo world"), 1: (0, ""), 2: (0, ""), 3: (size("x" * 10_000), "x" * 10_000)}
    assert token_counts.count_tokens(docs.limit(0), ranks).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}" if i % 3 else None, h) for i, h in enumerate(rows)],
                                 "page_id long, url string, html string")


def test_archives_round_trip(spark, tmp_path):
    body = "<html>" + "é" * 200
    rows = [body, "short", None, "", body, "short", "z" * 100, "z" * 100, "z" * 99, "z" * 99, "\r\n\r\nWARC/1.1\r\n" * 20]
    folder = str(tmp_path / "archives")
    manifest = warc.write_archives(pages(spark, rows).repartition(3).selectExpr("*", "1 as digest", "2 as payload"),
                                   folder, archive_bytes=600)
    got = {r["page_id"]: r for r in warc.read_archives(spark, manifest).collect()}
    assert len(got) == len(rows)
    for i, h in enumerate(rows):
        first = rows.index(h) if h and len(h.encode()) >= 100 else i
        r = got[i]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", first))
        assert r["payload_bytes"] == len((h or "").encode())
        assert r["payload"] == ((h or "").encode() if first == i else None)
    name = manifest.first()["archive"]
    with open(f"{folder}/{name}", "rb") as f:
        content = f.read()
    dictionary, at = warc.dictionary_of(content)
    frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompressobj()
    frame.decompress(content[at:])
    size = len(content) - at - len(frame.unused_data)
    assert warc.read_record(folder, name, at, size)[0] == warc.parsed(next(warc.frames(content)))[0]
    # A file of an attempt that did not finish is not in the manifest and is not read.
    with open(f"{folder}/lost.warc.zst", "wb") as f:
        f.write(content[:-5])
    assert warc.read_archives(spark, manifest).count() == len(rows)


def test_no_pages_and_damaged_archives(spark, tmp_path):
    assert warc.read_archives(spark, warc.write_archives(pages(spark, []), str(tmp_path / "none"))).count() == 0
    with pytest.raises(ValueError):
        warc.dictionary_of(b"not an archive")


def test_lines_are_brought_to_canonical_form_once(spark):
    """No filter inferred from the known digests repeats the steps ahead of them."""
    docs = documents(spark, ["a\nReleased under the MIT License.\nb"])
    plan = license_scan.scan_lines(docs, license_scan.known_licenses(spark))._jdf.queryExecution().optimizedPlan().toString()
    of_lines = plan.split("Aggregate [digest")[0]
    assert "Generate" in of_lines and of_lines.count("RLIKE") == 1
