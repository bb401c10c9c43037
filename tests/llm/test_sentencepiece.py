import hashlib
import random
from pathlib import Path

import pytest

from tallyforge.llm import sentencepiece_bpe as sp
from tallyforge.llm.queries import PIECES

pytestmark = pytest.mark.skipif(not Path(PIECES).exists(), reason="vocabulary files are not here")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def texts():
    rng = random.Random(1)
    out = ["", " ", "   a", "a  b ", "▁", "▁a▁", "<s>", "</s>", "<0x41>", "\x00a", "ﬁ é 日本語 ゼ 😀", " " * 700 + "x", "=" * 600, "a" * 1300, "\n" * 40]
    for alphabet in (" ▁  aetionshABC09.,\n\t<>/0xéñß日本語中国ゼ한글😀\x00ＡＢﬁ", "abtionser ", "ab ", "x= "):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.choice([3, 9, 30, 90]))) for _ in range(400)]
    return out


def test_equals_the_library(library):
    model, given = sp.load(PIECES), texts()
    for start in range(0, len(given), 97):
        part = given[start : start + 97]
        for t, (named, n, ids) in zip(part, model.encode(part)):
            want = library.encode(t, add_eos=True)
            assert ids.tolist() == want and n == len(want) and named == " ".join(map(str, want)), repr(t)
            assert model.decode(ids) == library.decode(want), repr(t)


def test_rounds_equal_the_heap():
    model = sp.load(PIECES)
    rng = random.Random(9)
    for _ in range(200):
        w = "".join(rng.choice("ation ers".replace(" ", "")) for _ in range(rng.randrange(2, 60)))
        symbols = [int(model.symbol_of[ord(c)]) for c in w]
        import numpy as np

        merged, _ = model._rounds(np.array(symbols), np.zeros(len(w), np.int64))
        assert merged.tolist() == model._heap(symbols)


def long_words():
    rng = random.Random(3)
    draw = lambda some, n: "".join(rng.choice(some) for _ in range(n))
    words = ["ation", "er", "the", "ing", "abc", "tion", "ss", "in", "ter", "on"]
    yield from ("a" * 100_000, "ab" * 20_001, "abc" * 7_000, "=-" * 5_000, "e" * 5_000 + "s" * 5_001)
    yield draw("abcdefghijklmnopqrstuvwxyz", 100_000)
    yield draw("0123456789abcdef", 100_000)
    yield draw("日本語中国한글ゼñß", 20_000)
    for n in (513, 700, 2_000):
        for some in ("ab", "aetions", "abcdefghijklmnopqrstuvwxyz", "ABCDEFabcdef+/0189", "=- x".replace(" ", ""), words):
            yield from (draw(some, n) for _ in range(6))


def test_long_words_equal_the_library(library, monkeypatch):
    model, given = sp.Model(PIECES), list(long_words())
    monkeypatch.setattr(model, "_heap", None)  # all of them by arrays
    for t, (_, n, ids) in zip(given, model.encode(given)):
        assert ids.tolist() == library.encode(t, add_eos=True), t[:60]


@pytest.mark.parametrize("rounds", [1, 3])
def test_words_that_need_more_rounds(library, monkeypatch, rounds):
    monkeypatch.setattr(sp, "ROUNDS", rounds)
    given = [t for t in long_words() if len(t) < 10_000]
    for t, (_, n, ids) in zip(given, sp.Model(PIECES).encode(given)):
        assert ids.tolist() == library.encode(t, add_eos=True), t[:60]


def test_windows_equal_the_heap_on_short_words():
    import numpy as np

    model, rng = sp.load(PIECES), random.Random(5)
    for _ in range(300):
        some = rng.choice(["ations", "ab", "er", "abcdefghijklmnopqrstuvwxyz"])
        ws = ["".join(rng.choice(some) for _ in range(rng.randrange(1, 300))) for _ in range(5)]
        symbols = [[int(model.symbol_of[ord(c)]) for c in w] for w in ws]
        merged, word = model._windows(np.array(sum(symbols, [])), np.repeat(np.arange(5), [len(w) for w in ws]))
        assert [merged[word == i].tolist() for i in range(5)] == [model._heap(s) for s in symbols]


def test_tables(spark, library):
    rows = [(1, "Hello  wörld\n"), (1, "Hello  wörld\n"), (2, None), (3, ""), (None, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as ids", "1 as n_tokens")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(((d, library.encode(t or "", add_eos=True)) for d, t in rows), key=str)
    coded = sp.encode(df, PIECES)
    assert sorted(((r.doc_id, list(r.ids)) for r in coded.collect()), key=str) == want
    assert sorted(((r.doc_id, r.text) for r in sp.decode(coded, PIECES).collect()), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sp.digests(df, PIECES).collect()), key=str)
    assert got == sorted(((d, len(i), sha(" ".join(map(str, i))), sha(library.decode(i))) for d, i in want), key=str)
    assert sp.encode(df.limit(0), PIECES).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert sp.decode(none, PIECES).collect()[0].text == ""
