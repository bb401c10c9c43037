import re

import pytest

from tallyforge.llm import ngram_join as nj
from tallyforge.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n=4, percent=85):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    owners = {}
    for i, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(i)
    seen = set()
    for members in owners.values():
        for k, i in enumerate(members):
            for j in members[:k]:
                if (i, j) not in seen and rows[i][0] is not None and rows[j][0] is not None:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * len(sets[i] | sets[j]):
                        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near_copies(n, edits):
    """A base text and copies of it with growing numbers of edits; far copies link through nearer ones only."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(n):
        w = list(base)
        for e in range(k % edits):
            w[(k * 7 + e * 11) % 120] = f"x{k}_{e}"
        rows.append((k, " ".join(w)))
    return rows


def test_against_brute_force(spark):
    rows = near_copies(90, 9)
    rows += [(200 + i, " ".join(f"p{j}" for j in range(60)) + " " + " ".join(f"q{i}_{j}" for j in range(40))) for i in range(40)]
    rows += [(300, "A b C"), (301, "a B c"), (302, "a b"), (303, None), (304, ""), (305, " \t\n"), (306, "one"), (307, "ONE"),
             (308, "É é"), (309, "é é"), (310, "long " * 5000), (311, "long " * 6000), (None, "A b C"), (305, "a b c"), (300, "A b C")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(nj.similar_components(df.withColumn("size", df.doc_id).withColumn("cls", df.text))) == brute(rows)


def test_bounds_keep_every_link(spark):
    rows = []
    for k in range(60):  # windows that slide over one long text
        rows.append((k, " ".join(f"s{j}" for j in range(k, k + 45 + k % 3))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(nj.similar_components(df)) == brute(rows)


def test_empty(spark):
    assert got(nj.similar_components(spark.createDataFrame([], "doc_id long, text string"))) == []


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_leading_columns(percent):
    for size in range(1, 200):
        least = (percent * size + 99) // 100
        assert nj.lead(size, percent) == size - least + 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)]
    found = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert {found[i] for i in range(51)} == {0} and {found[i] for i in (100, 200, 300)} == {100}


def test_all_links(spark):
    rows = near_copies(40, 9) + [(300, "A b C"), (301, "a B c"), (302, None), (303, "x y"), (None, "a b c"), (0, near_copies(1, 9)[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links, members = nj.similar_pairs(df.withColumn("cls", df.text))
    of = {}
    for r in members.collect():
        of.setdefault(r.cls, set()).add(r.doc_id)
    text = {d: t for d, t in rows if d is not None}
    assert {frozenset(d) for d in of.values() if len(d) > 1} >= {frozenset({300, 301})}
    mine = {frozenset((min(of[r.a]), min(of[r.b]))): (r.size_a + r.size_b, r.overlap) for r in links.collect()}
    want = {}
    ids = sorted(min(d) for d in of.values())
    for i in ids:
        for j in ids:
            a, b = shingles(text[i]), shingles(text[j])
            if i < j and 100 * len(a & b) >= 85 * len(a | b):
                want[frozenset((i, j))] = (len(a) + len(b), len(a & b))
    assert mine == want and len(want) > 20
