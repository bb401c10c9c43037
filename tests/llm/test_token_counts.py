import random
from pathlib import Path

import numpy as np
import pytest

from tallyforge.llm import token_counts as tc
from tallyforge.llm.queries import RANKS, TOKENIZERS

pytestmark = pytest.mark.skipif(not Path(RANKS).exists(), reason="vocabulary files are not here")


def by_offsets(text, bounds):
    """The rule on the offsets of another implementation of the vocabulary."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    counts = [0] * len(bounds)
    ends = [*bounds[1:], len(text)]
    for a, b in t.encode(text, add_special_tokens=False).offsets:
        counts[max(range(len(bounds)), key=lambda i: (min(b, ends[i]) - max(a, bounds[i]), -i))] += 1
    return counts


def test_against_offsets(spark):
    rng = random.Random(2)
    alpha = "aei th ing\n\n  \t.,日本é😀1"
    rows = [(i, "".join(rng.choice(alpha) for _ in range(rng.randrange(1, 200))), rng.choice(["ti\ntle", "", None, "t "])) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "x" * 20000 + "\n" + "é" * 5000, "t"), (103, "a\nb", "t"), (103, "a\nb", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string").selectExpr("*", "title as field", "doc_id as n_tokens", "1 as _whole")
    got = {}
    for r in tc.token_counts(df, RANKS, fields=("title", "text")).collect():
        got.setdefault(r.doc_id, []).append((r.start_char, r.end_char, r.field, r.n_tokens))
    assert len(got.pop(103)) == 2 * 3
    for i, text, title in rows[:-2]:
        whole = (title or "") + "\n" + (text or "")
        mine = sorted(got.get(i, []))
        assert [m[0] for m in mine] == [0, *[m[1] for m in mine[:-1]]] and mine[-1][1] == len(whole)
        assert [m[3] for m in mine] == by_offsets(whole, [m[0] for m in mine]), i
        assert all(m[2] == ("title" if m[0] <= len(title or "") else "text") for m in mine)
    assert tc.token_counts(df.limit(0), RANKS).count() == 0
    assert tc.token_counts(df.where("doc_id in (100, 101)"), RANKS).count() == 0


def test_rule():
    begin, end = np.array([0, 2, 6, 9, 10]), np.array([2, 6, 9, 10, 20])
    counts, crossing = tc.attribute(begin, end, np.array([0, 4, 8, 12, 13]))
    # 2-6 is halved: the first; 6-9 has two of three before 8; 10-20 has most behind 13.
    assert counts.tolist() == [2, 1, 1, 0, 1] and crossing.tolist() == [1, 1, 0, 0, 1]


@pytest.mark.parametrize("around", [("a", "b"), ("a", ""), ("", "b"), ("a\n", "\u3000b"), ("", "")])
def test_long_blank_runs(around):
    for blank in (" ", "\n", " \t", "\xa0"):
        text = around[0] + blank * 3000 + around[1]
        assert tc.encode(text, RANKS).tolist() == tc.load(RANKS)[0].encode_ordinary(text)
    text = (around[0] + " " * 2000 + around[1] + "\x1c" * 2000) * 3
    assert tc.encode(text, RANKS).tolist() == tc.load(RANKS)[0].encode_ordinary(text)


def test_very_long_runs(spark):
    n = 10_000_000
    df = spark.createDataFrame([(c,) for c in " a7"], "c string").repartition(3, "c").selectExpr("ascii(c) as doc_id", f"repeat(c, {n}) as text")
    got = {r.doc_id: r for r in tc.token_counts(df, RANKS).collect()}
    assert {r.end_char for r in got.values()} == {n} and len(got) == 3
    assert got[ord(" ")].n_tokens == len(tc.load(RANKS)[1].encode_ordinary(" " * 1000)) * n // 1000
