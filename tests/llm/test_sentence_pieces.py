"""Encoding and decoding against the library itself."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from emberline.llm import queries
from emberline.llm import sentence_pieces as S

PATH = S.public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "  a  b   ", "\n", "\n\n a\t\tb ", "▁", "▁▁a ▁b▁ c", "a▁b", "a▁", "日本語 テキスト", "😀 😀😀", "a\x00b", "ﬁ ①  x²", "é é",
    "<s> </s> <unk> <0x0A>", "​　x", "   " * 50, "x" * 300_000, " ,,, ...", "مرحبا بالعالم", "� a", "word " * 30_000, "a b", "a b",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def drawn(n):
    rng = random.Random(5)
    return ["".join(rng.choice(" ▁ab,\n\té日😀1²") for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("most", [S.MOST, 100])
def test_every_text_as_the_library_does(library, monkeypatch, most):
    monkeypatch.setattr(S, "MOST", most)
    m = S.Model(PATH)
    assert m.apart
    texts = TEXTS + drawn(2000)
    for lo in range(0, len(texts), 500):
        some = texts[lo : lo + 500]
        ids = [library.encode(t or "", add_bos=True, add_eos=True) for t in some]
        got = m.encode(some)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == ids
        assert m.decode(got) == [library.decode(i) for i in ids]


def test_any_ids_decode_as_in_the_library(library):
    rng = random.Random(6)
    ids = [[rng.randrange(0, top) for _ in range(rng.randrange(12))] for top in (32_000, 300) for _ in range(2000)]
    assert S.Model(PATH).decode([np.array(i, "<u4").tobytes() for i in ids]) == [library.decode(i) for i in ids]


def test_other_models_get_whole_texts(library):
    m = S.Model(PATH)
    m.apart = False
    texts = TEXTS[:20]
    assert [np.frombuffer(x, "<u4").tolist() for x in m.encode(texts)] == [library.encode(t or "", add_bos=True, add_eos=True) for t in texts]


def test_columns_and_empty_tables(spark, library):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, `a.b` string, word string").repartition(3)
    made = S.round_trip(df)
    assert made.columns == ["doc_id", "text", "a.b", "word", "ids", "decoded"]
    for r in made.collect():
        want = library.encode(TEXTS[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["decoded"] == library.decode(want) and r["text"] == TEXTS[r["doc_id"]]
    again = S.decode(S.encode(df).drop("text"))
    assert {r["doc_id"]: r["decoded"] for r in again.collect()} == {r["doc_id"]: r["decoded"] for r in made.collect()}
    assert S.round_trip(df.limit(0)).collect() == []


def test_query_over_all_documents(spark, sf, docs, library):
    got = {r["doc_id"]: r for r in queries.op12_sentence_pieces(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
