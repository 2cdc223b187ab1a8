"""One query per operator over its whole table, and the SQL that checks it where SQL can express it."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import (
    exact_dedup, language, license_scan, line_dedup, ngram_join, packing, pieces, prefix_trie, resampling, suffix_dedup,
    token_counts, vector_graph, warc)
from ledgerloom.llm.common import table

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language.learn(docs.where(language.remainder() != 1))
    return language.classify(docs, dictionaries).select(
        "doc_id", (language.remainder() == 1).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.model_bytes(f"{TOKENIZERS}/piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = pieces.encode(docs, model).select("doc_id", "ids", F.element_at("ends", -1).cast("long").alias("spanned_bytes"))
    return pieces.decode(ids, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "spanned_bytes")


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op7_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
     s AS (SELECT doc_id, unnest(range(0, length(x) // 2 - 199)) AS p, x FROM d WHERE length(x) >= 400),
     w AS (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 400)) AS k FROM s),
     r AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
     g AS (SELECT *, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 AS opens FROM r),
     i AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g),
     spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY doc_id, span),
     gaps AS (SELECT doc_id, span, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b, b - a AS cut FROM spans),
     kept AS (SELECT doc_id, string_agg(substr(x, 2 * gaps.a + 1, 2 * (gaps.b - gaps.a)), '' ORDER BY gaps.a) AS front,
                     max(gaps.b + cut) AS tail, sum(cut) AS n_removed, count(*) AS n_spans
              FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


ORACLES["op8_ngram_join"] = r"""
WITH RECURSIVE
     w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
           FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id
           GROUP BY x.doc_id, y.doc_id),
     l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
     r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(r.b) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""


@query
def op2_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op2_vector_graph"] = """
WITH RECURSIVE
     v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
     l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
           AND list_cosine_similarity(x.e, y.e) >= 0.9),
     r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
     c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
     n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.a AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.a = c.component_id AS kept
FROM c LEFT JOIN n ON n.a = c.a
"""


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of each whole document, and how many of its lines are a known licence as a whole."""
    docs, known = table(spark, sf_dir, "documents"), license_scan.known_licenses(spark)
    lines = license_scan.scan_lines(docs, known).groupBy("doc_id").agg(
        F.count("*").alias("license_lines"), F.min("license").alias("first_license"))
    return license_scan.scan(docs, known).join(lines, "doc_id", "left").select(
        "doc_id", "digest", "license", F.coalesce("license_lines", F.lit(0)).cast("long").alias("license_lines"),
        "first_license")


def canonical_sql(text: str) -> str:
    line = license_scan.COPYRIGHT_LINE.removeprefix("(?m)")
    words = (f"' ' || trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '(?m){line}', '', 'g'), "
             r"'[^\p{L}\p{N}]+', ' ', 'g')) || ' '")
    for one, other in license_scan.EQUIVALENT:
        words = f"replace({words}, ' {one.replace('-', ' ')} ', ' {other.replace('-', ' ')} ')"
    return f"trim({words})"


KNOWN_SQL = ", ".join(f"""('{name}', '{text.replace("'", "''")}')""" for name, text in license_scan.KNOWN)
ORACLES["op3_license_scan"] = f"""
WITH k AS (SELECT {canonical_sql('t')} AS form, min(l) AS license FROM (VALUES {KNOWN_SQL}) v(l, t) GROUP BY 1),
     d AS (SELECT doc_id, {canonical_sql('text')} AS form FROM documents),
     x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
     n AS (SELECT doc_id, count(*) AS n, min(license) AS first_license
           FROM (SELECT doc_id, {canonical_sql('t')} AS form FROM x) JOIN k USING (form) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.form <> '' THEN sha256(d.form) END AS digest, k.license,
       coalesce(n.n, 0) AS license_lines, n.first_license
FROM d LEFT JOIN k USING (form) LEFT JOIN n USING (doc_id)
"""


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after three edits of each: a replacement, a removal and an insertion."""
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = f.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    at = lambda part: F.floor(n * part / 5).cast("int")
    edit = lambda start, end, new: F.struct(
        start.alias("start"), end.alias("end"), F.lit(new).alias("text"))
    edits = F.when(n < 40, F.array(edit(at(5), at(5), " appended"))).otherwise(F.array(
        edit(at(1), at(1) + 7, "edited"), edit(at(3), at(3) + 5, ""), edit(at(4), at(4), ". New words 42!")))
    counted = token_counts.count_tokens(docs, ranks).withColumnRenamed("n_tokens", "tokens_before")
    done = token_counts.apply_edits(counted.withColumn("edits", edits), ranks)
    return done.select("doc_id", "tokens_before", F.col("n_tokens").alias("tokens_after"), "encoded_chars",
                       F.length("new_text").cast("long").alias("chars_after"))


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op11_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
     k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
     m AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes in DuckDB, bit by bit: it has no function of its own."""
    byte = f"list_transform(range(strlen({text})), lambda i: instr('0123456789ABCDEF', hex(encode({text}))[2 * i + 1]) * 16 " \
           f"+ instr('0123456789ABCDEF', hex(encode({text}))[2 * i + 2]) - 17)"
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    whole = f"list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda a, b: list_reduce(" \
            f"list_prepend(xor(a, b)::BIGINT, range(8)), lambda c, j: {step}))"
    return f"xor({whole}, 4294967295)"


ORACLES["op12_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS ts
           FROM t GROUP BY conv_id),
     c AS (SELECT conv_id, ts, ({crc32_sql('conv_id::VARCHAR')} % 6)::INT AS h FROM o),
     b AS (SELECT c.conv_id, coalesce(k.ts, [])[1:c.h] || c.ts[c.h + 1:] AS ts
           FROM c LEFT JOIN o k ON k.conv_id = c.conv_id - c.conv_id % 100),
     p AS (SELECT conv_id, d, ts[1:d] AS node, len(ts) AS whole FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM b)),
     n AS (SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole = d), '') AS ends,
                  node[:-2] AS parent, CASE WHEN any_value(d) > 0 THEN (count(*) - 1) * length(node[-1].t) ELSE 0 END AS own
           FROM p GROUP BY node),
     k AS (SELECT parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
     x AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, u.conv_id AS parent_conv_id
           FROM n LEFT JOIN k ON k.parent = n.node LEFT JOIN n u ON n.depth > 0 AND u.node = n.parent),
     a AS (SELECT node[1:k] AS top, own, (n_children = 0)::INT AS leaf FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM x)),
     s AS (SELECT top, sum(own)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM a GROUP BY top)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
FROM x JOIN s ON s.top = x.node
"""


@query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op13_resampling"] = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
     w AS (SELECT doc_id, unnest(ws) AS f FROM d), v AS (SELECT unnest({WORDS}) AS f FROM benchmark),
     c AS (SELECT f, ({crc32_sql('f')} % 10000)::INT AS b FROM (SELECT f FROM w UNION SELECT f FROM v)),
     s AS (SELECT b, count(*) AS s FROM w JOIN c USING (f) GROUP BY b),
     t AS (SELECT b, count(*) AS t FROM v JOIN c USING (f) GROUP BY b),
     n AS (SELECT (SELECT count(*) FROM w)::DOUBLE AS s_all, (SELECT count(*) FROM v)::DOUBLE AS t_all),
     g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)
                                     / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
           FROM s LEFT JOIN t USING (b), n),
     x AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM w JOIN c USING (f) JOIN g USING (b) GROUP BY doc_id),
     h AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                  ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN x USING (doc_id)),
     y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h),
     r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
           FROM y WHERE n_features >= 20)
SELECT y.*, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (doc_id)
"""
