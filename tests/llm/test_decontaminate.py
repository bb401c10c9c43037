import random

import numpy as np

from tallyforge.llm import decontaminate as dc
from tallyforge.llm.common import words_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, items):
    """Documents and items with any span within the allowed distance."""
    found = set()
    for d, t in docs:
        w = words_of(t)
        for i, q in items:
            q = words_of(q)
            most = dc.allowed(len(q))
            if q and any(distance(q, w[a : a + n]) <= most for a in range(len(w)) for n in range(len(q) - most, len(q) + most + 1) if a + n <= len(w)):
                found.add((d, i))
    return found


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        p = rng.randrange(len(w))
        if rng.random() < 0.4:
            w[p] = f"z{rng.randrange(10**6)}"
        elif rng.random() < 0.5:
            del w[p]
        else:
            w.insert(p, f"y{rng.randrange(10**6)}")
    return w


def cases():
    rng = random.Random(3)
    pool = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(12, 40)))) for i in range(25)]
    docs = []
    for d in range(50):
        body = [rng.choice(pool) if d % 3 else f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 90))]
        if d % 2:
            q = items[d % 25][1].split()
            at = rng.randrange(len(body))
            body[at:at] = edited(rng, q, rng.randrange(dc.allowed(len(q)) + 2))
        docs.append((d, " ".join(body)))
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    docs += [(100, None), (101, ""), (102, " \n"), (103, items[0][1].upper()), (103, items[0][1])]
    items += [(90, None), (91, ""), (92, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as item_id", "1 as distance")
    hits = dc.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, [x for x in items if x[1]])
    got = {(r.doc_id, r.item_id) for r in hits}
    assert got <= want
    assert len(got) >= 0.95 * len(want) > 10
    text, query = dict(docs), dict(items)
    for r in hits:
        assert distance(words_of(query[r.item_id]), words_of(text[r.doc_id])[r.start_word : r.end_word]) == r.distance
    clean = {r.doc_id for r in dc.cleaned(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}


def test_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(some, items).count() == 0
    assert dc.contaminated(none, items).count() == 0
    assert dc.cleaned(some, items).collect() == some.collect()


def test_distance_to_a_prefix():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 20))]
        want = min(distance(a, b[:n]) for n in range(len(b) + 1))
        got, end = dc.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), len(a))
        assert got == want and distance(a, b[:end]) == got


def clustered(rng, words, edits, kind, where):
    """All edits next to each other, at the head, in the middle or at the end."""
    at = {"head": 0, "middle": (len(words) - edits) // 2, "end": len(words) - edits}[where]
    new = [f"z{rng.randrange(10**9)}" for _ in range(edits)]
    if kind == "insert":
        at = {"head": 1, "middle": len(words) // 2, "end": len(words) - 1}[where]
        return words[:at] + new + words[at:]
    return words[:at] + (new if kind == "change" else []) + words[at + edits :]


def test_edits_in_one_place():
    rng = random.Random(8)
    cases = [(size, kind, where) for size in (20, 21, 25, 32, 40, 59, 100, 200) for kind in ("change", "delete", "insert")
             for where in ("head", "middle", "end") for _ in range(12)]
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(size))) for i, (size, *_) in enumerate(cases)]
    known, flat, sizes = dc.WordHashes(), [], []
    for (_, q), (size, kind, where) in zip(items, cases):
        body = [f"w{rng.randrange(500)}" for _ in range(60)]
        body[30:30] = clustered(rng, q.split(), dc.allowed(size), kind, where)
        flat += words_of(" ".join(body))
        sizes.append(len(body))
    hits = dc.Index(items, dc.repetitions()).find(known.of(flat, len(flat)), np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes))
    found = {doc for doc, item, *_ in hits if doc == item}
    missed = {}
    for i, case in enumerate(cases):
        missed[case] = missed.get(case, 0) + (i not in found)
    assert sum(missed.values()) <= 0.02 * len(cases) and max(missed.values()) <= 2, missed


def test_nearest_span():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 10))]
        b = [rng.randrange(4) for _ in range(rng.randrange(1, 20))]
        starts = rng.randrange(1, len(b) + 1)
        want = min((distance(a, b[s:e]), s, e) for s in range(starts) for e in range(s, len(b) + 1))
        assert dc.nearest(np.array(a, np.uint64), np.array(b, np.uint64), len(a), starts) == want
