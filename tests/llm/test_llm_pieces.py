"""SentencePiece encoding against the library."""

import random

import public_tokenizers
import pytest
import sentencepiece

from modwarden.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    r = random.Random(3)
    alphabet = ["a", "e", "t", "h", "n", " ", " ", "\n", "\t", "é", "ß", "▁", "漢", "🙂", "​", "Z", "1", ".", "</s>", "<0x41>", "\x00", "the", "ing", "́"]
    out = ["", " ", "  ", "   a", "a  ", "▁", "a▁b", " ▁ ", "x" * 500, "ab" * 300 + " tail", "end\n", "<s> </s> <unk>", " hard space", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    return out + ["".join(r.choices(alphabet, k=r.randint(0, 120))) for _ in range(400)]


def test_every_text_equals_the_library(library):
    got = pieces.Encoder(PATH).run(texts())
    for t, (ids, decoded) in zip(texts(), got, strict=True):
        want = [*library.encode(t), library.eos_id()]
        assert ids == " ".join(map(str, want)), repr(t)
        assert decoded == library.decode(want), repr(t)


def test_both_agendas_agree():
    v = pieces.vocabulary(PATH)
    units = [u for t in texts() for u in pieces.units_of(t)]
    assert v.merge_all(units) == [v.to_ids(v.heap_merge(u)) for u in units]


def test_a_small_memory_changes_nothing():
    some = texts()[:120]
    small = pieces.Encoder(PATH, kept=3)
    assert [small.run([t])[0] for t in some] == pieces.Encoder(PATH).run(some)


def test_a_difference_raises(monkeypatch):
    v = pieces.Vocabulary(PATH)
    monkeypatch.setattr(v, "merge_all", lambda units: [[5] for _ in units])
    with pytest.raises(ValueError, match="differs"):
        v.encode_units(["▁hello"])
    monkeypatch.undo()
    monkeypatch.setattr(v, "to_text", lambda ids: "▁jello")
    with pytest.raises(ValueError, match="another text"):
        v.encode_units(["▁hello"])


def test_rows(spark, library):
    rows = [(1, "hello  world", 7), (2, None, 8), (3, "", 9), (3, "", 9), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = pieces.encode(df, PATH).collect()
    assert len(out) == 5
    for r in out:
        want = [*library.encode(r.text or ""), 2]
        assert (r.n_tokens, r.ids, r.decoded) == (len(want), " ".join(map(str, want)), library.decode(want))
    assert pieces.encode(df.limit(0), PATH).count() == 0
