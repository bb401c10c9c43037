import re
from collections import Counter

import duckdb

from tallyforge.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    m = dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=len(re.findall(r"[#*$%&|<>]", t)),
             n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered), n_lines=len(lines))
    failed = [m["n_words"] < 50, 100 * m["n_repeat_words"] > 50 * m["n_words"], 100 * m["n_symbols"] > 10 * m["word_chars"],
              100 * m["n_dup_lines"] > 50 * m["n_lines"], m["word_chars"] < 2 * m["n_words"], m["word_chars"] > 40 * m["n_words"]]
    return tuple(m.values()) + (sum(f << i for i, f in enumerate(failed)),)


def rows():
    prose = " ".join(f"word{i}" for i in range(60))
    return [(1, prose), (2, "a b c " * 30), (3, "a a a a"), (4, "a b"), (5, None), (6, ""), (7, " \t\n\x0b\f\r "), (8, prose + "\n" + prose),
            (9, "x " * 80), (10, "### $$$ " * 40), (11, f"{prose}\nend\nend\n\nend \n"), (12, "日本 é😀 b " * 20), (13, "long" * 9000),
            (14, " ".join(f"t{i % 700}" for i in range(20000))), (1, prose), (None, prose), (15, "a b c d a b c"), (16, "a\x1cb c d")]


def test_against_brute_force(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "text as n_words", "doc_id as _m", "1 as fail_bits", "2 as row")
    got = qr.apply_policy(qr.ledger(df)).collect()
    want = sorted((str(d), *brute(t)) for d, t in rows())
    assert sorted((str(r[0]), *r[1:8]) for r in got) == want
    assert all(r.base_failed == (r.fail_bits & 3 != 0) and r.kept == (r.fail_bits == 0) for r in got)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r for r in rows() if r[0] not in (1, None)])
    sql = con.execute(qr.SQL).fetchall()
    assert sorted((str(r[0]), *r[1:8]) for r in sql) == [w for w in want if w[0] not in ("1", "None")]


def test_ablations(spark):
    df = qr.ledger(spark.createDataFrame(rows(), "doc_id long, text string"))
    bits = [r.fail_bits for r in df.collect()]
    for version, mask in qr.POLICIES.items():
        found = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in qr.ablations(df, version).collect()}
        want = {}
        for r in qr.RULES:
            one = 1 << r.bit
            if mask & one:
                b = [x & mask for x in bits]
                want[r.name] = (sum(x & one > 0 for x in b), sum(x == one for x in b), sum(x & ~one == 0 for x in b))
        assert found == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert qr.apply_policy(qr.ledger(df)).count() == qr.ablations(qr.ledger(df)).count() == 0
