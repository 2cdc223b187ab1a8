"""Encoding and decoding against the library, and offsets against the text."""

import os
import random

import pytest
import sentencepiece
from pyspark.sql import Row

from ledgerloom.llm import pieces

PATH = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "   x   y", "\n\n a\tb", "▁", "a▁b", "▁▁ x ▁", "é퟿a", "\x00x", "日本 語",
       "x" * 5000, "😀 😀😀", "ab " * 300 + " ", "​ 　x", "1234 5.6,7", None]


def texts():
    rng = random.Random(3)
    signs = "ab  \n.é▁日😀0"
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def model():
    return pieces.model_bytes(PATH)


def test_same_ids_and_text_as_the_library(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = texts()
    df = spark.createDataFrame([Row(doc_id=i, text=t, ids="clash") for i, t in enumerate(rows)],
                               "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in pieces.decode(pieces.encode(df, model), model).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        ids = library.encode(t or "", add_eos=True)
        assert got[i]["ids"] == ids, t
        assert got[i]["decoded"] == library.decode(ids)


def test_offsets_cover_the_text_in_order(model):
    encoder = pieces.Encoder(model, cached_words=50)
    rows = texts()
    offsets, ids, ends = encoder.encode(rows)
    for i, t in enumerate(rows):
        raw = (t or "").encode()
        own, at = ends[offsets[i]:offsets[i + 1]].tolist(), 0
        assert own == sorted(own) and own[-1] == len(raw)
        for piece, end in zip(ids[offsets[i]:offsets[i + 1]].tolist(), own):
            shown = encoder.library.id_to_piece(piece)
            if encoder.library.is_byte(piece):
                assert end - at == 1 and f"<0x{raw[at]:02X}>" == shown
            elif piece != encoder.end_id:
                said = raw[at:end].decode().replace(" ", "▁")
                assert said == shown or at == 0 and "▁" + said == shown
            at = end


def test_empty_table_and_null_ids(spark, model):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decode(pieces.encode(none, model), model).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(null, model).first()["decoded"] == ""


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_character_map_as_the_library_walks_it(rule):
    from sentencepiece import sentencepiece_model_pb2 as pb
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = pb.NormalizerSpec.FromString(library.serialized_normalizer_spec())
    ours = pieces.Normaliser(spec)
    for t in ["ﬁne ﬀ", "  Ⅷ  x ", "Ａ　Ｂ", "éé", "㍿ 株", "ı İ ß", "a\tb\r\nc", "①②", "x" * 300, "ＡＢＣ ﾊﾟ", ""]:
        text, source = ours(t)
        said = library.normalize(t)
        assert text.replace("▁", " ").strip() == said.replace("▁", " ").strip(), t
        assert len(source) == len(text.encode()) + 1 and source == sorted(source)
        assert source[-1] <= len(t.encode())
