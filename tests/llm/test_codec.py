import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import sentencepiece_codec as sc

SP = sentencepiece.SentencePieceProcessor(model_file=sc.vocabulary())


def encoded(texts):
    return [np.frombuffer(x, "<i4").tolist() for x in sc.codec().encode(texts)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), min_size=1, max_size=8))
def test_ids_equal_the_library(texts):
    assert encoded(texts) == SP.encode(texts)


def test_long_and_odd_texts():
    texts = ["", " ", "  a   b ", "\n\n", "日本語 한국어", "x" * 5000, "ab" * 900, "▁a▁▁b", "\0a", "<s> <0x41>", "    " * 50]
    assert encoded(texts) == SP.encode(texts)


def test_round_trip_frames(spark, odd, none):
    ids = sc.encode(odd)
    back = {(r.doc_id, r.text) for r in sc.decode(ids).collect()}
    assert back == {(r.doc_id, r.text) for r in odd.collect()}
    assert sc.decode(sc.encode(none)).count() == 0


def test_decode_takes_the_place_of_a_clashing_column(spark, odd):
    ids = sc.encode(odd).selectExpr("doc_id", "ids", "'old' as text")
    assert {(r.doc_id, r.text) for r in sc.decode(ids).collect()} == {(r.doc_id, r.text) for r in odd.collect()}
