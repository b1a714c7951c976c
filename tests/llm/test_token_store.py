import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldlens.llm import common as C
from fieldlens.llm import token_store as T

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def whole(text):
    from tokenizers import Tokenizer

    if not hasattr(whole, "tok"):
        whole.tok = Tokenizer.from_file(PATH)
    return whole.tok.encode(text or "", add_special_tokens=False).ids + [T.END_ID]


@given(st.lists(st.integers(0, 2 ** 32 - 1)))
def test_pack_round_trip(values):
    v = np.array(values, dtype="<u4")
    control, data = T.pack(v)
    assert len(control) == -(-len(v) // 4)
    assert T.unpack(control, data, len(v)).tolist() == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB'’sé́ \n\t\r\x0b\x1c  .,<|>endoftx123Σς")) | st.characters(codec="utf-8"), max_size=40), max_size=6))
def test_pieces_equal_whole_texts(texts):
    assert [i.tolist() for i in T.encode_texts(texts, PATH)] == [whole(t) for t in texts]


def test_special_token_strings():
    texts = ["<|endoftext|>", "a<|startoftext|>b <|startoftext|><|startoftext|> c", "<|startoftext|>"]
    assert [i.tolist() for i in T.encode_texts(texts, PATH)] == [whole(t) for t in texts]


def test_a_full_memo_loses_nothing():
    memo = C.PieceMemo(lambda ps: [p.upper() for p in ps], limit=3)
    for words in (["a", "b"], ["c", "d", "e"], ["a", "f", "d"]):
        known = memo.lookup(set(words))
        assert [known[w] for w in words] == [w.upper() for w in words]
    assert len(memo.known) == 3


def test_word_numbers_survive_a_full_memo():
    """Words that come again after the memo was cleared get the same ids; other alphabets too."""
    store = T._words(PATH)
    old, store.limit = store.limit, 40
    try:
        for k in range(12):
            texts = [f"Wort{j} näh{j % 5}, {'x' * j} ÄÖ! don't 12ab" for j in range(k, k + 9)] + ["", " \x0b\x0c lone"]
            assert [i.tolist() for i in T.encode_texts(texts, PATH)] == [whole(t) for t in texts]
            assert len(store.known) <= 80
    finally:
        store.limit = old
        store.clear()


def test_plain_letters_come_straight_from_the_model():
    words = ["Straße", "ÀÉÎÕÜ", "naïve", "ÿ", "A", "word", "..,;", "-", "LÉ?!", "abc***"]
    assert T._pretoken_ids(whole("a") and whole.tok) is not None
    assert [i.tolist() for i in T.encode_texts(words, PATH)] == [whole(t) for t in words]


def test_a_word_is_kept_once_whatever_its_case_and_punctuation():
    """Encoding cost follows the different words, not their spellings with punctuation."""
    stems = ["haus", "été", "naïve", "tion"]
    texts = [" ".join(f"{case(w)}{tail}" for w in stems for tail in ["", *T.TAIL, "...", "?!"]) for case in (str.lower, str.upper, str.title)]
    store = T._words(PATH)
    store.clear()
    assert [i.tolist() for i in T.encode_texts(texts, PATH)] == [whole(t) for t in texts]
    assert len(store.known) <= len(stems) + len(T.TAIL) + 3
    store.clear()


def test_words_that_come_again_outlive_a_full_memo():
    store = T._words(PATH)
    old, store.limit = store.limit, 40
    letters = "abcdefghijklmnopqrstuvwxyz"
    try:
        store.clear()
        for k in range(4):
            texts = [("alpha beta, " if k < 2 else "") + " ".join(f"{letters[k]}{c}x" for c in letters[:10])]
            assert [i.tolist() for i in T.encode_texts(texts, PATH)] == [whole(t) for t in texts]
            assert len(store.known) <= 40
        assert "alpha" in store.known and "aax" not in store.known  # the last batch, for which room was made, had neither
    finally:
        store.limit = old
        store.clear()


def test_ids_are_counted_many_documents_at_a_time(monkeypatch):
    """A count is as long as the vocabulary, so its cost must not come once a document."""
    docs = [np.array([k % 7, 49_000, 1] * 10 if k % 5 else [70_000 + k], dtype="<u4") for k in range(200)] + [np.zeros(0, dtype="<u4")]
    press, calls, bincount = T.zstandard.ZstdCompressor(), [], np.bincount
    blobs = [press.compress(T._narrow(d)) for d in docs]
    batches = [T.pa.RecordBatch.from_pydict({"ids": T.pa.array(blobs[k:k + 64], T.pa.binary())}) for k in range(0, len(blobs), 64)]
    monkeypatch.setattr(T, "COUNT_IDS", 600, raising=False)
    monkeypatch.setattr(T.np, "bincount", lambda *a, **b: calls.append(1) or bincount(*a, **b))
    got = [r for b in T._count_job(iter(batches)) for r in b.to_pylist()]
    assert {r["id"]: r["n"] for r in got} == Counter(np.concatenate(docs).tolist())
    assert 2 < len(calls) < 20


def test_a_piece_without_ids_alone():
    store = T._words(PATH)
    store.clear()
    assert store.gather(store.numbers([""], []))[0].tolist() == []


def test_store_round_trip(spark):
    rows = [(5, "Some words", "x"), (2, None, None), (2, "tie one", None), (2, "tie two, longer", None), (9, "", "y"), (None, "no id", None),
            (7, "long " * 60_000, None), (5, "Some words", "x")] + [(k, f"doc {k} text{k % 7}", None) for k in range(100, 160)]
    path = C.shared_path(spark, "test-store")
    T.write_store(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5), path, PATH)
    got = T.read_store(spark, path, with_ids=True).orderBy("start").collect()
    want = sorted(((-1 if r[0] is None else r[0], len(whole(r[1])), whole(r[1])) for r in rows))
    assert [(-1 if g.doc_id is None else g.doc_id, g.n_tokens, g.ids) for g in got] == want
    assert [g.start for g in got] == np.cumsum([0] + [w[1] for w in want[:-1]]).tolist()
    assert all(g.ids_crc32 == zlib.crc32(np.array(g.ids, dtype="<u4").tobytes()) for g in got)
    ranks = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    assert ranks[0] == max(ranks, key=lambda i: (sum(w[2].count(i) for w in want), -i))


def test_empty_store(spark):
    path = C.shared_path(spark, "test-store")
    T.write_store(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert T.read_store(spark, path).count() == 0
