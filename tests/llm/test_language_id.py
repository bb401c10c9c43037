import random
import zlib

import numpy as np
import pytest

from tallyforge.llm import language_id as li

SYLLABLES = {"aa": "ka mo ti re", "bb": "schu ver ung kei", "cc": "que eau oi ment", "dd": "ción ado ñe rra", "ee": "жи ла мо ст", "ff": "oo yy uu ww"}


def text(rng, lang, n=40):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.mark.parametrize("langs", ["aa bb cc dd", "aa bb cc dd ee ff", "aa bb"])
def test_held_out_accuracy(spark, langs):
    rng = random.Random(4)
    rows = [(i, text(rng, lang := rng.choice(langs.split())), lang) for i in range(400)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, " 12 ,.\n", None), (1003, text(rng, "aa"), None), (1004, "Ka MO tire " * 300_000, "aa"),
             (None, text(rng, "bb"), "bb"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "lang as lang_pred", "1 as score")
    out = li.held_out(df.doc_id)
    assert {r.doc_id for r in df.where(out).collect()} == {d for d, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 3 == 1}
    got = li.predict(df, li.learn(df.where(~out))).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    right = [by_id[d].lang_pred == lang for d, _, lang in rows[:400] if zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum(right) >= 0.97 * len(right) > 100
    for d in (1000, 1001, 1002):
        assert (by_id[d].lang_pred, by_id[d].score, by_id[d].ambiguous) == ("und", 0.0, True)
    assert by_id[1004].lang_pred == by_id[1003].lang_pred == "aa" and by_id[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in li.predict(df, li.learn(df)).collect()] == ["und"]
    one = spark.createDataFrame([(1, "abc", "xx"), (2, "zzz", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in li.predict(one, li.learn(one)).collect()] == ["xx", "xx"]
    assert li.predict(df.limit(0), li.learn(df)).count() == 0


def test_codes_are_apart():
    for n in (3, 4, 5, 9, 40):
        c = li.codewords(n)
        apart = min((c[i] != c[j]).sum() for i in range(n) for j in range(i))
        assert apart >= 2 and (np.abs(c.sum(axis=0)) < n).all()


def test_a_wrong_bit_is_corrected():
    codes = li.codewords(4)
    model = li.Model(("a", "b", "c", "d"), codes, np.zeros((1, codes.shape[1])), np.full(codes.shape[1], 1 / codes.shape[1]))
    for k in range(4):
        margins = codes[k].astype(float)
        margins[2] *= -1
        assert li.decode(model, margins)[0] == "abcd"[k]


def brute_features(text):
    """Counts of hashed n-grams by a plain loop over the whole text."""
    low = text.lower()
    symbols = [32]
    for i, c in enumerate(low):
        if c.isalpha():
            symbols.append(ord(c))
        elif i and low[i - 1].isalpha():
            symbols.append(32)
    symbols.append(32)
    counts = np.zeros(li.FEATURES, np.int64)
    if not any(c.isalpha() for c in low):
        return counts
    for n in range(1, li.ORDER + 1):
        for i in range(len(symbols) - n + 1):
            h = n
            for s in symbols[i : i + n]:
                h = (h ^ s) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            counts[h >> 50] += 1
    return counts


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 20])
def test_cuts_change_nothing(monkeypatch, piece):
    monkeypatch.setattr(li, "PIECE", piece)
    rng = random.Random(piece)
    given = ["", "a", " ", "12", "a.", ".a", "1 2 a", "ΣΑΣ ΣΑΣ.", "İx", "日本 語", "a" * 9 + "1" * 9 + "b"]
    given += ["".join(rng.choice("aB 1.éΣ") for _ in range(rng.randrange(40))) for _ in range(60)]
    for t in given:
        got = sum((np.bincount(f, minlength=li.FEATURES) for f in li.pieces(t)), np.zeros(li.FEATURES, np.int64))
        assert (got == brute_features(t)).all(), repr(t)


def test_predictions_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, lang := rng.choice("aa bb cc dd".split())), lang) for i in range(60)]
    rows += [(100, text(rng, "bb", 200_000), "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.learn(df)
    got = {r.doc_id: r for r in li.predict(df, model).collect()}
    for d, t, _ in rows:
        counts = brute_features(t)
        name, score, gap = li.decode(model, counts @ model.weights.astype(float) / counts.sum())
        assert got[d].lang_pred == name and got[d].score == pytest.approx(score, abs=1e-5) and got[d].ambiguous == (gap < 0.05)
