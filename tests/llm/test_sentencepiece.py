"""The transducer against the public library, on its BPE file and a hand-made unigram model."""

import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from tessera.llm import sentencepiece_fst as S

ODD = ["", " ", "  ", "a", " a", "a ", "Hello  world", "\n", "a\n b\t\tc\r", "日本語 text", "😀 x😀😀", "x" * 60, "aaaaaaaaaaaa", " " * 37 + "z", "▁ mark▁", "ÀÉ́ ñ", "\x00\x01", "1234567 890.12", "http://a.b/c?d=e&f", "))))((((!!!!", "the the  the   the    the"]


def texts(n=1500, seed=1):
    rng = random.Random(seed)
    syll = ["th", "er", "tion", "ing", "é", "ü", "a", "0", ".", ",", "-", "St", "ß", "中", " ", " ", " ", "  ", "\n", "ll", "ou", "!", "'s"]
    return ODD + ["".join(rng.choice(syll) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_bpe_equals_the_library():
    model = S.read_model()
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    fst = S.Transducer.load(model)
    for t in texts():
        ids = lib.encode(t)
        assert fst.encode(t) == ids, t
        assert fst.decode(ids) == lib.decode(ids), t


def test_unigram_equals_the_library():
    m = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{b:02X}>", 0, 6) for b in range(256))]:
        m.pieces.add(piece=piece, score=score, type=kind)
    rng = random.Random(2)
    known = set()
    for piece in ["▁", "t", "h", "e", "r", "i", "n", "g", "o", "a", "th", "er", "ing", "the", "▁the", "▁t", "tion", "ti", "on", "in"]:
        known.add(piece)
        m.pieces.add(piece=piece, score=-rng.uniform(1, 9), type=1)
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = True
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.remove_extra_whitespaces = False
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    fst = S.Transducer.load(m.SerializeToString())
    for t in texts(400, 3):
        assert fst.encode(t) == lib.encode(t), t


def test_query(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts(60))] + [(None, None, None, None), (3, "a", None, None), (3, "a", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_pieces long")
    lib = sentencepiece.SentencePieceProcessor(model_proto=S.read_model())
    got = S.encode(d)
    want = sorted(((i, lib.encode(t or "")) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=str) == want
    assert all(r.n_pieces == len(r.ids) and r.round_trip == (MARK_FREE(rows, r.doc_id)) for r in got.collect() if r.doc_id not in (None, 3))
    back = {r.doc_id: r.text for r in S.decode(got).collect()}
    assert all(back[i] == t for i, t, *_ in rows if i not in (None, 3) and "▁" not in t)
    assert S.encode(d.limit(0)).count() == 0


def MARK_FREE(rows, doc_id):
    return "▁" not in next(t for i, t, *_ in rows if i == doc_id)


def test_unsupported_models_are_refused():
    with pytest.raises(ValueError):
        S.Transducer([("x", 0.0, 4)], True)
