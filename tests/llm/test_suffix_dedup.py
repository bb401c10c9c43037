import random
from collections import defaultdict

import numpy as np

from tallyforge.llm import suffix_dedup as sd
from tallyforge.llm.common import WordHashes, words_of


def brute(rows):
    owners, covered = defaultdict(set), defaultdict(set)
    texts = [(d, words_of(t)) for d, t in rows if d is not None]
    for d, w in texts:
        for i in range(len(w) - sd.MIN_WORDS + 1):
            owners[tuple(w[i : i + sd.MIN_WORDS])].add(d)
    for d, w in texts:
        for i in range(len(w) - sd.MIN_WORDS + 1):
            if len(owners[tuple(w[i : i + sd.MIN_WORDS])]) > 1:
                covered[d] |= set(range(i, i + sd.MIN_WORDS))
    out = {}
    for d, words in covered.items():
        ws = sorted(words)
        begins = [x for i, x in enumerate(ws) if i == 0 or ws[i - 1] != x - 1]
        ends = [x + 1 for i, x in enumerate(ws) if i == len(ws) - 1 or ws[i + 1] != x + 1]
        out[d] = list(zip(begins, ends))
    return out


def found(df):
    rows = sd.repeated_spans(df).collect()
    assert all(r.n_repeated_words == sum(b - a for a, b in r.spans) for r in rows)
    return {r.doc_id: [tuple(s) for s in r.spans] for r in rows}


def test_against_brute_force(spark):
    rng = random.Random(5)
    passages = [[f"p{k}_{rng.randrange(40)}" for _ in range(n)] for k, n in enumerate((49, 50, 51, 55, 70, 120, 260))]
    rows = []
    for d in range(80):
        w = [f"d{d}_{rng.randrange(300)}" for _ in range(rng.randrange(0, 120))]
        for _ in range(d % 4):
            p = rng.choice(passages)
            a = rng.randrange(0, 12)
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a : len(p) - rng.randrange(0, 8)]
        rows.append((d, " ".join(w)))
    common = " ".join(passages[5])
    rows += [(200 + i, f"own{i} {common}") for i in range(150)]  # one key of many rows
    rows += [(500, "same " * 400), (501, "Same\n" * 90), (502, "lone " * 300), (503, None), (504, ""), (505, common.upper()),
             (None, common), (506, "u v w x y z " * 30), (506, "u v w x y z " * 30), (507, "a b"), (508, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as pos", "text as key", "text as places")
    want = brute(rows)
    assert found(df.repartition(7)) == want
    assert {500, 501, 505, 200} <= set(want) and not {502, 506, 507} & set(want)


def test_runs_over_partition_edges(spark):
    rows = [(d, d % 3, k) for k in range(6) for d in range(k * 20)] + [(1000, p, 77) for p in range(50)] + [(1, 0, 99), (2, 0, 98)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, key long")
    want = sorted(r for r in rows if len({x[0] for x in rows if x[2] == r[2]}) > 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(map(tuple, sd._repeated(df).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_runs_over_small_batches(spark):
    rng = random.Random(4)
    rows = sorted({(rng.randrange(4) if k % 3 else 0, p, k) for k in range(25) for p in range(12)} | {(d, p, 50) for d, n in ((1, 1), (2, 1), (3, 90)) for p in range(n)}
                  | {(d, p, 51) for d, n in ((1, 45), (2, 1)) for p in range(n)})
    df = spark.createDataFrame(rows, "doc_id long, pos int, key long")
    want = sorted(r for r in rows if len({x[0] for x in rows if x[2] == r[2]}) > 1)
    adaptive, partitions, records = (
        "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {c: spark.conf.get(c) for c in (adaptive, partitions, records)}
    try:
        spark.conf.set(adaptive, "false")
        for size in ("2", "3"):
            for n in ("5", "40", "90"):
                spark.conf.set(records, size)
                spark.conf.set(partitions, n)
                assert sorted(map(tuple, sd._repeated(df).collect())) == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_empty(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == {}


def test_window_hashes():
    words = [f"w{i % 17}".encode() for i in range(300)]
    hashes, windows = WordHashes().of(words, 300), sd.Windows()
    for size in (1, 3, 50):
        h = windows.of(hashes, size)
        place = {}
        for i, x in enumerate(h.tolist()):
            assert place.setdefault(tuple(words[i : i + size]), x) == x
        assert len(set(place.values())) == len(place)
    grams = np.array([5, 3, 3, 9, 1] * 30, np.uint64)
    assert (sd.minimiser_of(grams) == [i + int(np.argmin(grams[i : i + sd.REACH])) for i in range(len(grams) - sd.REACH + 1)]).all()
