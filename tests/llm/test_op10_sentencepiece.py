"""Pieces against the public library, and round trips."""

from __future__ import annotations

import pytest
from tessera.llm import op10_sentencepiece as sp
from tessera.llm.queries import SENTENCEPIECE_MODEL


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)


def test_against_the_library(odd_docs, odd_rows, library):
    got = sp.encode(odd_docs, SENTENCEPIECE_MODEL).collect()
    wanted = sorted((str(k), library.encode(t or "")) for k, t in odd_rows)
    assert sorted((str(r.doc_id), list(r.pieces)) for r in got) == wanted
    assert all(r.n_pieces == len(r.pieces) and r.round_trip for r in got)


def test_byte_fallback_spaces_and_signs(library):
    t = sp.compiled(sp.read_model(SENTENCEPIECE_MODEL))
    texts = ["  two  spaces ", "\x00\x01", "漢字かな交じり文", "😀😀", "a▁b", "ÀÉÎõü", "\n\n\t", "x" * 500, "https://a.b/c?d=e&f", "▁", " "]
    for text in texts:
        ids = sp.np.frombuffer(t.encode([text])[0], sp.np.int32).tolist()
        assert ids == library.encode(text), text
        assert t.decode(ids) == library.decode(ids)


def test_decode(spark, odd_docs):
    encoded = sp.encode(odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"]), SENTENCEPIECE_MODEL)
    back = {r.doc_id: r.text for r in sp.decode(encoded, SENTENCEPIECE_MODEL).collect()}
    texts = {r.doc_id: r.text or "" for r in odd_docs.where("doc_id is not null").collect()}
    assert back == texts


def test_empty_table(no_docs):
    assert sp.encode(no_docs, SENTENCEPIECE_MODEL).collect() == []


def _tiny(merges, byte_fallback, rule="nmt_nfkc"):
    """A model of a few dozen pieces written by hand, with a public normaliser."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    kinds = pb.ModelProto.SentencePiece
    model.pieces.add(piece="<unk>", score=0, type=kinds.UNKNOWN)
    for name in ("<s>", "</s>"):
        model.pieces.add(piece=name, score=0, type=kinds.CONTROL)
    if byte_fallback:
        for value in range(256):
            model.pieces.add(piece=f"<0x{value:02X}>", score=0, type=kinds.BYTE)
    words = ["▁the", "▁re", "▁in", "ing", "tion", "er", "th", "he", "re", "in", "ou", "▁t", "▁a", "▁", "fi", "ABC", "ab", "abc", *"abcdefghijklmnopqrstuvwxyzABCé1"]
    for k, w in enumerate(words):
        model.pieces.add(piece=w, score=-1.0 - (k * 7 % 23) / 3, type=kinds.NORMAL)
    model.trainer_spec.model_type = 2 if merges else 1
    model.trainer_spec.byte_fallback = byte_fallback
    if rule:
        model.normalizer_spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = True
    return model.SerializeToString(), sentencepiece


ODD_TEXTS = ["the rethinking of abc", "ＡＢＣ ﬁnd　x ①", "  spaces\t and\nlines ", "e\u0301 \u212b \u1e9b\u0323 ﷺ", "漢字 😀😀 the", "", " ", "\x00\x01ab\u200b", "ｶﾞ ㌀ ½", "aaaaabcabcab " * 30]


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_a_unigram_model_with_a_normaliser(byte_fallback):
    raw, sentencepiece = _tiny(False, byte_fallback)
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    t = sp.Transducer(raw)
    for text in ODD_TEXTS:
        got = sp.np.frombuffer(t.encode([text])[0], sp.np.int32).tolist()
        assert got == library.encode(text), text
        assert t.normalise(text) == library.normalize(text), text


def test_the_character_map_is_read_whole():
    raw, sentencepiece = _tiny(False, True, "nfkc")
    characters = sp.Transducer(raw).characters
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name="nfkc", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    assert len(characters.by) > 1000
    for k, text in enumerate(characters.by):
        if k % 37 == 0 and not text.isspace():
            assert characters.mapped(f"a{text}b") == normaliser.normalize(f"a{text}b"), repr(text)
