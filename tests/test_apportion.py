"""Apportionment against a seat-by-seat award written from the rules."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import lists
from tallyforge.operators import apportion as ap


def divisor(method, k, tenths):
    if method == ap.DHONDT:
        return Fraction(k)
    if method == ap.SAINTE_LAGUE:
        return Fraction(2 * k - 1)
    return Fraction(tenths, 10) if k == 1 else Fraction(2 * k - 1)


def award_one_by_one(case):
    """Award seats singly; returns [(party, seat_no, filled)] and whether a tie occurred."""
    votes, cap, smd = case["votes"], case["cap"], case["smd"]
    heiyo, renyo = case["linkage"] == "heiyo", case["linkage"] == "renyo"
    held = dict.fromkeys(votes, 0)
    pool = case["seats"] + (sum(smd.values()) if heiyo else 0)
    out, tie = [], False
    for _ in range(pool):
        if heiyo and case["overhang"] == "truncate" and len(out) == case["seats"]:
            break
        room = [
            p for p in votes
            if case["exhaustion"] == "vacant"
            or held[p] < cap[p] + (smd[p] if heiyo else 0)
        ]
        if not room:
            break
        q = {
            p: votes[p] / divisor(case["method"], held[p] + 1 + (smd[p] if renyo else 0), case["tenths"])
            for p in room
        }
        best = max(q.values())
        level = [p for p in room if q[p] == best]
        tie |= len(level) > 1
        win = min(level, key=lambda p: (-votes[p], p))
        held[win] += 1
        own = held[win] - (smd[win] if heiyo else 0)
        if own > 0:
            out.append((win, held[win], own <= cap[win]))
    return out, tie


def random_case(rng):
    n = rng.randint(1, 6)
    top = rng.choice([3, 20, 5000])
    parties = [f"p{i}" for i in range(n)]
    return {
        "votes": {p: rng.randint(0, top) for p in parties},
        "cap": {p: rng.randint(0, 6) for p in parties},
        "smd": {p: rng.randint(0, 4) for p in parties},
        "seats": rng.randint(0, 15),
        "method": rng.choice(ap.METHODS),
        "tenths": rng.randint(10, 30),
        "exhaustion": rng.choice(["reallocate", "vacant"]),
        "linkage": rng.choice(["parallel", "renyo", "heiyo"]),
        "overhang": rng.choice(["truncate", "expand"]),
    }


@pytest.mark.parametrize("salts", [1, 3])
def test_matches_seat_by_seat(spark, salts):
    rng = random.Random(5)
    cases = [random_case(rng) for _ in range(1500)]
    rows = [
        (i, p, v, c["seats"], c["cap"][p], c["smd"][p], c["method"], c["tenths"],
         c["exhaustion"], c["linkage"], c["overhang"])
        for i, c in enumerate(cases) for p, v in c["votes"].items()
    ]
    df = spark.createDataFrame(
        rows,
        "contest int, party string, votes long, seats int, cap int, smd int, method string,"
        " tenths int, exh string, link string, over string",
    )
    got = ap.apportion(
        df, ["contest"], method=F.col("method"), first_tenths=F.col("tenths"),
        exhaustion=F.col("exh"), capacity="cap", linkage=F.col("link"),
        district_wins="smd", overhang=F.col("over"), salts=salts,
    ).collect()
    by_contest = {}
    for r in sorted(got, key=lambda r: (r.contest, r.award_no)):
        by_contest.setdefault(r.contest, []).append(r)
    for i, c in enumerate(cases):
        want, tie = award_one_by_one(c)
        rows_i = by_contest.get(i, [])
        assert [r.award_no for r in rows_i] == list(range(1, len(rows_i) + 1))
        assert [(r.party, r.seat_no, r.filled) for r in rows_i] == want, c
        if rows_i:
            assert rows_i[0].tie == tie, c


def literal(spark, votes, seats, cap=None):
    rows = [("c", p, v, seats, (cap or {}).get(p, 99)) for p, v in votes.items()]
    df = spark.createDataFrame(rows, "contest string, party string, votes long, seats int, cap int")
    return ap.apportion(df, ["contest"], capacity="cap" if cap else None).orderBy("award_no").collect()


def test_dhondt_order(spark):
    got = literal(spark, {"A": 1000, "B": 600, "C": 350}, 5)
    assert "".join(r.party for r in got) == "ABACA"
    assert [r.divisor for r in got] == [1, 1, 2, 1, 3]
    assert not got[0].tie


def test_dhondt_capacity(spark):
    got = literal(spark, {"A": 1000, "B": 600, "C": 350}, 5, {"A": 1, "B": 3, "C": 3})
    assert "".join(r.party for r in got) == "ABCBB"


def test_dhondt_tie(spark):
    assert literal(spark, {"A": 100, "B": 100}, 1)[0].tie


def adams_seats(spark, pops, total):
    df = spark.createDataFrame(
        [("x", u, p, total) for u, p in pops.items()], "c string, unit string, population long, seats int"
    )
    return {r.unit: r.seats for r in ap.adams(df, ["c"]).collect()}


@pytest.mark.parametrize("total", [4, 5, 10, 50, 131])
def test_adams_totals(spark, total):
    assert sum(adams_seats(spark, {"a": 1000, "b": 700, "c": 300, "d": 90}, total).values()) == total


def test_adams_floor(spark):
    assert adams_seats(spark, {"a": 1000000, "b": 1}, 10) == {"a": 9, "b": 1}


def test_adams_too_few(spark):
    with pytest.raises(Exception, match="fewer seats than units"):
        adams_seats(spark, {"a": 5, "b": 1}, 1)


def test_modified_divisors(spark):
    df = spark.range(1, 5).select(ap.divisor(ap.MODIFIED, F.col("id"), 14).alias("d"))
    assert [r.d for r in df.collect()] == [14, 30, 50, 70]


@pytest.mark.parametrize("bad", [9, 31])
def test_first_divisor_range(spark, bad):
    with pytest.raises(Exception, match="first divisor"):
        spark.range(1, 3).select(ap.divisor(ap.MODIFIED, F.col("id"), bad)).collect()


def test_exact_order_of_close_quotients(spark):
    # 2^61 / 2147483629 and its neighbour differ far below double precision.
    big = 1 << 61
    df = spark.createDataFrame([("a", big, 2147483629), ("b", big - 1, 2147483629)], "p string, v long, d long")
    got = ap.with_quotient(df, "v", "d").orderBy(F.col("__q").desc(), F.col("__qf").desc()).collect()
    assert [r.p for r in got] == ["a", "b"]


def test_wide_contest_explodes_few_rows(spark):
    df = spark.range(5000).select(
        F.lit("c").alias("contest"), F.col("id").cast("string").alias("party"),
        (F.col("id") % 97 + 1).alias("votes"), F.lit(3000).alias("seats"),
    )
    got = ap.apportion(df, ["contest"])
    assert got.count() == 3000
    want = sorted(
        (-Fraction(i % 97 + 1, k), -(i % 97 + 1), str(i), k) for i in range(5000) for k in range(1, 60)
    )[:3000]
    assert [(r.party, r.seat_no) for r in got.orderBy("award_no").collect()] == [(w[2], w[3]) for w in want]


def test_a_list_too_short_is_an_error(spark):
    marked = spark.createDataFrame(
        [("x", i, 1, None, i != 2) for i in range(4)] + [("y", 9, 1, None, False)], "party string, ordinal int, list_rank int, rate double, eligible boolean")
    seats = spark.createDataFrame([("s1", "x", 3), ("s2", "x", 1), ("s3", "y", 0)], "scenario string, party string, seats int")
    got = lists.fill_lists(marked, seats, ["party"], ["scenario"]).collect()
    assert sorted((r.scenario, r.ordinal, r.fill_no) for r in got) == [("s1", 0, 1), ("s1", 1, 2), ("s1", 3, 3), ("s2", 0, 1)]
    for short in (("s1", "x", 4), ("s3", "y", 1)):
        with pytest.raises(Exception, match="too short"):
            lists.fill_lists(marked, spark.createDataFrame([short], "scenario string, party string, seats int"), ["party"], ["scenario"]).collect()


def test_closing_price_bounds_the_rows_of_capped_contests(spark):
    """10,000 parties, 10,000 seats: a few parties with most votes and little room push the price far down."""
    rng = random.Random(5)
    rows = [("c", p, rng.randint(10**8, 10**9) if p < 40 else rng.randint(0, 5000), rng.randint(0, 30) if p < 40 else rng.randint(0, 12_000))
            for p in range(10_000)]
    df = spark.createDataFrame(rows, "contest string, party int, votes long, __room long").selectExpr(
        "*", "10000L as __target", "0L as __head").where("__room > 0")
    heap, want = [], {}
    for _, p, v, room in rows:
        if room and v:
            heap.append((-v / 1, -v, p, 1, room))
    import heapq

    heapq.heapify(heap)
    for _ in range(10_000):
        _, v, p, k, room = heapq.heappop(heap)
        want[p] = k
        if k < room:
            heapq.heappush(heap, (v / (k + 1), v, p, k + 1, room))
    for method in ap.METHODS:
        limits = ap.closing_limits(
            df.withColumn("__method", F.lit(method)).withColumn("__tenths", F.lit(14)), ["contest"], F.lit(method), F.lit(14))
        total = limits.agg(F.sum("__limit")).first()[0]
        assert 10_000 <= total <= 1.4 * 10_000 + 2 * 10_000
    capped = df.withColumnRenamed("__room", "cap").withColumn("seats", F.lit(10_000))
    awards = ap.apportion(capped, ["contest"], capacity="cap").groupBy("party").agg(F.max("seat_no").alias("n"), F.count(F.lit(1)).alias("m"))
    got = {r.party: (r.n, r.m) for r in awards.collect()}
    assert got == {p: (k, k) for p, k in want.items()}
