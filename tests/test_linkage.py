"""Linkage passes, residual pairs and reconciliation policies."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import linkage, scan
from tallyforge.plans import quality as q


def link(spark, left, right):
    l = spark.createDataFrame(left, "lid long, block string, party string, shown string, legal string")
    r = spark.createDataFrame(right, "rid long, block string, party string, name string")
    found = linkage.link(
        l, r, "lid", "rid",
        [([F.col("party"), F.col("shown")], [F.col("party"), F.col("name")]),
         ([F.col("party"), F.col("legal")], [F.col("party"), F.col("name")])],
        ([F.col("block"), F.col("party")], [F.col("block"), F.col("party")]))
    return (sorted(map(tuple, found.pairs.select("lid", "rid", "pass_no").collect())),
            [x.lid for x in found.left_rest.orderBy("lid").collect()], [x.rid for x in found.right_rest.orderBy("rid").collect()])


def test_passes(spark):
    pairs, left, right = link(
        spark,
        [(1, "X", "a", "taro", None), (2, "X", "a", "jiro", "JIRO"), (3, "X", "a", "odd", None), (4, "Y", "a", "p", None), (5, "Y", "a", "q", None)],
        [(11, "X", "a", "taro"), (12, "X", "a", "JIRO"), (13, "X", "a", "other"), (14, "Y", "a", "r"), (15, "Y", "b", "taro")])
    assert pairs == [(1, 11, 1), (2, 12, 2), (3, 13, 3)]
    assert (left, right) == ([4, 5], [14, 15])


@pytest.mark.parametrize("rows", [2, 1000])
def test_equal_names_pair_in_order(spark, rows, monkeypatch):
    monkeypatch.setattr(linkage, "ordered_rank", lambda *args: scan.ordered_rank(*args, limits=scan.Limits(rows)))
    n, m = 9, 6
    pairs, left, right = link(
        spark, [(i, f"b{i}", "a", "same", None) for i in range(n)], [(100 + i, "z", "a", "same") for i in range(m)])
    assert pairs == [(i, 100 + i, 1) for i in range(m)]
    assert (left, right) == ([6, 7, 8], [])


def test_ambiguous(spark):
    l = spark.createDataFrame([(1, "x", "y"), (2, "y", None), (3, "z", "z")], "lid long, shown string, legal string")
    got = linkage.ambiguous_keys(l, [F.col("shown")], [F.col("legal")], "lid").collect()
    assert [r.lid for r in got] == [1]


def totals(spark, rows):
    return spark.createDataFrame(rows, "k string, value int")


@pytest.mark.parametrize("policy,bad", [(q.STRICT, {"b", "c", "d", "z"}), (q.NULL_IS_ZERO, {"b", "d"}), (q.PRINTED, {"b", "d", "c"})])
def test_policies(spark, policy, bad):
    # a equal, b different, c printed 0 but not computed, d computed but never printed, z computed zero
    got = q.reconcile(totals(spark, [("a", 1), ("b", 2), ("d", 5), ("z", 0)]), totals(spark, [("a", 1), ("b", 3), ("c", 0)]), ["k"], policy=policy)
    assert {r.k for r in got.where("NOT ok").collect()} == bad


def test_shortfall(spark):
    a = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0)], "k string, value double")
    b = spark.createDataFrame([("a", 1.9), ("b", 2.0), ("c", 1.5)], "k string, value double")
    assert {r.k for r in q.reconcile(a, b, ["k"], shortfall=True).where("ok").collect()} == {"a"}


def test_close(spark):
    df = spark.createDataFrame([(1.0, 1.005), (1.0, 1.02), (None, None), (None, 1.0)], "a double, b double")
    assert [r.x for r in df.select(q.close(F.col("a"), F.col("b"), 0.01).alias("x")).collect()] == [True, False, True, False]


def test_grade_counts_and_samples(spark):
    rows = spark.range(20).select(F.col("id").cast("string").alias("s"), F.col("id").alias("v"))
    checks = [
        q.row_check("T1", "T", "small", rows, F.col("s"), F.col("v") < 5, F.col("v")),
        q.row_check("T2", "T", "all", rows, F.col("s"), F.col("v") >= 0, F.col("v")),
        q.row_check("T3", "T", "known", rows, F.col("s"), F.col("v") != 7, F.col("v")),
        q.row_check("T4", "T", "never excused", rows, F.col("s"), F.col("v") != 7, F.col("v"), allow=False),
    ]
    register = spark.createDataFrame([("T3", "7"), ("T4", "7"), ("T1", "9")], "check_id string, subject string")
    got = {r.check_id: r for r in q.grade(checks, register).collect()}
    assert (got["T1"].status, got["T1"].fail_count, got["T1"].known_count, len(got["T1"].samples.split("; "))) == ("FAIL", 14, 1, 8)
    assert (got["T2"].status, got["T2"].subject_count) == ("PASS", 20)
    assert got["T3"].status == "WARN" and got["T4"].status == "FAIL"


def test_checks_of_a_table_share_a_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([("x", 1, 2), ("x", 1, 2), (None, 3, 2), ("y", 2, None), ("z", 2, 2)], "k string, a int, b int").write.parquet(path)
    rows = spark.read.parquet(path)
    checks = [
        q.row_check("T1", "T", "small", rows, F.col("k"), F.col("a") < 2, F.col("a")),
        q.row_check("T2", "T", "given", rows, F.col("k"), F.col("b") == 2, F.col("b"), per_row=2),
        q.row_check("T3", "T", "any", rows, F.col("k"), F.lit(True), F.col("b")),
    ]
    plan = q.outcomes(checks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    got = {r.check_id: (r.status, r.subject_count, r.fail_count, r.samples) for r in q.grade(checks).collect()}
    assert got == {"T1": ("FAIL", 5, 3, "y; z"), "T2": ("FAIL", 10, 1, "y"), "T3": ("PASS", 5, 0, "")}
    twice = q.row_check("T4", "T", "never", rows.where("k = 'x'"), F.col("k"), F.lit(None).cast("boolean"), F.col("a"))
    none = q.row_check("T5", "T", "no rows", rows.where("k = '?'"), F.col("k"), F.lit(False), F.col("a"))
    got = {r.check_id: (r.status, r.subject_count, r.fail_count, r.samples) for r in q.grade([twice, none]).collect()}
    assert got == {"T4": ("FAIL", 2, 2, "x; x"), "T5": ("PASS", 0, 0, "")}


def test_contiguous_and_ascending(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 2, 0), ("b", 3, 1), ("c", 1, 0), ("c", 1, 1), ("d", 1, 0), ("d", 3, 1), ("d", 2, 2)],
                               "k string, n int, o long")
    assert {r.k for r in q.contiguous(df, ["k"], "n").where("ok").collect()} == {"a", "d"}
    assert {r.k for r in q.ascending(df, ["k"], "n", "o").where("ok").collect()} == {"a", "c"}


def test_expected_totals(spark):
    got = spark.createDataFrame([("a", None, 3), ("a", "x", 1), ("a", "x", 1), ("b", "x", 5), ("c", "x", 5), ("d", "x", 0)], "m string, s string, value long")
    want = spark.createDataFrame(
        [("a", None, 3), ("a", "x", 2), ("a", "y", 0), ("a", "z", 4), ("d", "x", None), ("e", None, None), ("f", "x", 0), ("f", "x", 1), ("g", "x", 0), ("g", "x", None)],
        "m string, s string, value long")

    def rows(**more):
        return {(r.m, r.s): (r.computed, r.expected, r.asked, r.ok) for r in q.expected_totals(got, want, ["m", "s"], optional=F.col("m") == "b", **more).collect()}

    plain, zero = rows(), rows(absent=0)
    assert plain[("a", None)] == (3, 3, True, True) and plain[("a", "x")] == (2, 2, True, True)
    assert plain[("b", "x")] == (5, None, False, True) and plain[("c", "x")] == (5, None, False, False)
    assert plain[("a", "y")] == (None, 0, True, False) and zero[("a", "y")] == (None, 0, True, True)
    assert not plain[("a", "z")][3] and not zero[("a", "z")][3] and not plain[("d", "x")][3]
    assert plain[("e", None)][3] and not zero[("e", None)][3]
    assert not any(r[k][3] for r in (plain, zero) for k in (("f", "x"), ("g", "x")))
    assert len(plain) == 10 and q.expected_totals(got.limit(0), want.limit(0), ["m", "s"]).count() == 0
