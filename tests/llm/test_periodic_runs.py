import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tallyforge.llm import periodic_runs as pr
from tallyforge.llm.queries import recurring


def brute(words, least=6, times=4):
    """Every period on its own; of equal stretches the smallest period."""
    out = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            a = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - a + q >= max(least, times * q):
                out.setdefault((a, i - a + q), q)
            i += 1
    return sorted((a, q, n) for (a, n), q in out.items())


def stitched(found):
    out = []
    for q in {f[0] for f in found}:
        reach = -1
        for _, a, b in sorted(f for f in found if f[0] == q):
            if a > reach:
                out.append([a, q, b - a + q])
                reach = b
            else:
                reach = max(reach, b)
                out[-1][2] = reach - out[-1][0] + q
    return sorted(map(tuple, out))


def by_tiles(words, least=6, times=4):
    ids, n = np.array(words, np.int32), len(words)
    found = set()
    for g, u, v in pr.stretches(ids, np.zeros(n, np.int64), np.full(n, n), least, times):
        for s, e in pr.tiles(u, v, g, least, times):
            found |= {(q, s + a, s + b - q) for q, a, b in pr.solve(words[s:e], g, least, times)}
    return stitched(found)


def some_words(rng, size):
    words = []
    while len(words) < size:
        if rng.random() < 0.4:
            words += [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(1, 30))]
        else:
            p = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, 40))]
            words += (p * 12)[: rng.randrange(len(p), len(p) * 12)]
    return words


@pytest.mark.parametrize("least,times", [(6, 4), (6, 3), (2, 5), (40, 4)])
def test_tiles_against_brute_force(least, times):
    rng = random.Random(11)
    for _ in range(150):
        words = some_words(rng, rng.randrange(1, 400))
        assert by_tiles(words, least, times) == brute(words, least, times)


def test_long_runs_over_many_tiles():
    assert by_tiles([7] * 50_000) == [(0, 1, 50_000)]
    p = list(range(3000))
    assert by_tiles([-1, *p * 5, *p[:10], -2]) == [(1, 3000, 15_010)]
    assert by_tiles([*[1, 2] * 3000, 3, *[1, 2] * 4]) == [(0, 2, 6000), (6001, 2, 8)]


def staged(doc_id, text):
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 0
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = staged(doc_id, text)
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
    gone = {i for a, q, n in runs for i in range(a + q, a + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{a},{n},{q}\n" for a, q, n in runs)
    return (doc_id, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else [None] * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), len(words))


def rows():
    rng = random.Random(12)
    out = [(i, " ".join(f"w{x}" for x in some_words(rng, rng.randrange(0, 250)))) for i in range(120)]
    text = " ".join(f"w{i}" for i in range(300))
    return out + [(i, text) for i in range(200, 240)] + [
        (500, None), (501, ""), (502, " \t\n"), (None, "a " * 7), (None, "a " * 7), (503, "é é é é " * 5), (503, "x y " * 9),
        (504, "ha ha\nha\tha\x0bha\x0cha"), (505, "ha ha ha ha ha"), (506, "a b c d " * 500), (506, "a b c d " * 500)]


def test_query_against_brute_force(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr(
        "*", "doc_id as rid", "text as plain", "1 as row", "2 as runs", "3 as octave", "4 as n_words")
    got = pr.digests(recurring(df)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted((expected(*r) for r in rows()), key=key)
    assert pr.digests(recurring(df.limit(0))).count() == 0


def test_collapsed_text(spark):
    df = spark.createDataFrame([(1, "so  ha ha ha ha ha ha\nend", "n"), (1, None, None)], "doc_id long, text string, note string")
    got = pr.find_runs(df, keep=("note", "doc_id")).orderBy("n_words").collect()
    assert got[0].runs == [] and got[0].collapsed == "" and got[0].row.note is None
    assert got[1].collapsed == "so ha end" and got[1].runs[0].asDict() == {"start": 1, "period": 1, "length": 6}
    assert got[1].row.note == "n"
