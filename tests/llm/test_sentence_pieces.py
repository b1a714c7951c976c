import random
import zlib

import numpy as np
import pytest

from fieldlens.llm import sentence_pieces as S

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")
BITS = ["word", " word", "  ", " ", "\n", "\n\n", "\t", "é", "ß", "😀", "▁", "<0x0A>", "<s>", "<unk>", "12", "...", "中文", "\x00", "tion", "The", "\r", " "]


def reference(path=PATH):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def made_model(path, kind="unigram", byte_fallback=False, extra_spaces=False, charsmap=b""):
    """A small model written by hand; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.pieces.add(piece="<unk>", score=0.0, type=2)
    m.pieces.add(piece="<s>", score=0.0, type=3)
    if byte_fallback:
        for b in range(256):
            m.pieces.add(piece=f"<0x{b:02X}>", score=0.0, type=6)
    for k, p in enumerate(["▁", "a", "b", "c", "d", "▁a", "ab", "cd", "▁ab", "abc", "▁abc", "dd", "▁▁", "bcd", "▁d"]):
        m.pieces.add(piece=p, score=-1.0 - 0.37 * k if kind == "unigram" else -float(k), type=1)
    m.trainer_spec.model_type = 1 if kind == "unigram" else 2
    m.trainer_spec.unk_id, m.trainer_spec.byte_fallback = 0, byte_fallback
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = extra_spaces
    m.normalizer_spec.precompiled_charsmap = charsmap
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_parity_of_random_texts():
    r, model, ref = random.Random(11), S.piece_model(PATH), reference()
    texts = ["".join(r.choices(BITS, k=r.randrange(30))) for _ in range(2000)] + ["", " ", "\n", "x" * 20_000, "lorem ipsum " * 5000]
    for text, (normal, ids, _) in zip(texts, model.encode(texts)):
        assert ids.tolist() == ref.encode(text), repr(text)
        if "▁" not in text:
            assert model.decode(ids) == text == ref.decode(ids.tolist())


def test_library_decoder_agrees():
    model = S.piece_model(PATH)
    for text in ("some words, é 中文😀\nnext  line", "a", " leading"):
        ids = next(iter(model.encode([text])))[1].tolist()
        assert model.tokenizer.decode(ids, skip_special_tokens=False) == text == model.decode(np.array(ids))


def test_most_parts_agree_without_help():
    model = S.piece_model(PATH)
    words = [w for i in range(3000) for w in ("▁" + "".join(random.Random(i).choices("etaoinshrdlu", k=6)),)]
    assert np.mean([same for _, same in model._encode(words)]) > 0.99


@pytest.mark.parametrize("kind", ["unigram", "bpe"])
@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("extra_spaces", [True, False])
def test_models_of_both_kinds(tmp_path, kind, byte_fallback, extra_spaces):
    path = made_model(tmp_path / "m.model", kind, byte_fallback, extra_spaces)
    r, model, ref = random.Random(12), S.PieceModel(path), reference(path)
    texts = ["".join(r.choices(["a", "b", "c", "d", " ", "  ", "x", "é", "\n", "abc"], k=r.randrange(14))) for _ in range(400)]
    same = 0
    for text, (_, ids, parity) in zip(texts, model.encode(texts)):
        assert ids.tolist() == ref.encode(text), repr(text)
        same += parity
    assert same > 0.9 * len(texts)


def test_encode_and_decode_tables(spark):
    rows = [(1, "Some text.", "x"), (1, "Some text.", "x"), (2, None, None), (3, "", None), (None, "no id", None), (4, "words and\nlines " * 9000, None),
            (5, "a▁b", None)]
    got = S.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    ref = reference()
    assert [g.ids for g in got] == [ref.encode(r[1] or "") for r in rows]
    assert all(g.n_ids == len(g.ids) and g.ids_crc32 == zlib.crc32(np.array(g.ids, dtype="<u4").tobytes()) and g.parity for g in got)
    assert [g.round_trip for g in got] == [True] * 6 + [False]
    back = S.decode(spark.createDataFrame([(g.doc_id, g.ids) for g in got] + [(9, None)], "doc_id long, ids array<int>"), PATH).collect()
    assert [b.text for b in back][:6] == [r[1] or "" for r in rows[:6]] and back[-1].text is None
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.encode(empty, PATH).count() == 0
