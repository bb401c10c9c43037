"""Scenario simulation against a plain-Python run of the same rules."""

import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from test_apportion import award_one_by_one
from test_ranked import random_profile, tabulate
from tallyforge.operators import lists, profiles, ranked
from tallyforge.plans import compare, scenarios
from tallyforge.plans.scenarios import PRESETS, Scenario
from tallyforge.plans.simulate import Election, simulate

PARTIES = ["a", "b", "c", "d"]
BLOCKS = {"X": 6, "Y": 9, "Z": 5}


def make(seed):
    rng = random.Random(seed)
    e = {"candidates": [], "entries": [], "votes": {}, "electors": {}, "valid": {}}
    for b in BLOCKS:
        e["electors"][b] = rng.randint(1000, 9000)
        e["votes"][b] = {p: rng.randint(50, 4000) for p in PARTIES}
        for d in range(1, 5):
            did = f"{b}{d}"
            people = [(f"{did}-{p}", p, rng.randint(0, 900)) for p in [*PARTIES, "ind"] if rng.random() < 0.8]
            e["candidates"] += [(did, b, n, p, v) for n, p, v in people]
            e["valid"][did] = sum(v for *_, v in people)
        for p in PARTIES:
            rank = 0
            for did, bb, n, pp, v in e["candidates"]:
                if bb == b and pp == p and rng.random() < 0.7:
                    rank += rng.random() < 0.6
                    e["entries"].append((b, p, len(e["entries"]), max(rank, 1), "L" + n, True, did, n, v))
            for k in range(rng.randint(0, 2)):
                rank += 1
                e["entries"].append((b, p, len(e["entries"]), rank, f"L{b}{p}{k}", False, None, None, None))
    return e


def adams(pops, total):
    seats = dict.fromkeys(pops, 1)
    for _ in range(total - len(pops)):
        seats[min(pops, key=lambda u: (-Fraction(pops[u], seats[u]), -pops[u], u))] += 1
    return seats


def plain(e, s: Scenario, rates, orders):
    by_d = defaultdict(dict)
    block_of = {}
    for did, b, n, p, v in e["candidates"]:
        by_d[did][n] = (p, v)
        block_of[did] = b
    winner = {}
    for did, people in by_d.items():
        if s.smd_voting == "rcv":
            winner[did] = tabulate(people, rates, orders)[0]
        else:
            winner[did] = min(people, key=lambda n: (-people[n][1], n))
    smd = defaultdict(lambda: defaultdict(int))
    for did, n in winner.items():
        smd[block_of[did]][by_d[did][n][0]] += 1
    total = sum(BLOCKS.values()) + s.pr_seat_delta
    seats = BLOCKS if s.pr_seat_delta == 0 else adams(e["electors"], total)
    out, names, vacancies = defaultdict(int), set(), 0
    for b in BLOCKS:
        able = defaultdict(list)
        for bb, p, o, rank, name, dual, did, sn, v in e["entries"]:
            if bb != b:
                continue
            ok, rate = True, Fraction(0)
            if dual:
                top = by_d[did][winner[did]][1]
                rate = Fraction(v, top) * 100 if v and top else None
                ok = winner[did] != sn and v * s.share_den >= e["valid"][did] * s.share_num
                if s.rate_floor is not None:
                    ok = ok and rate is not None and rate >= s.rate_floor
            if ok:
                able[p].append((rank, -(rate or 0), o, name))
        case = {
            "votes": e["votes"][b], "cap": {p: len(able[p]) for p in PARTIES}, "smd": {p: smd[b][p] for p in PARTIES},
            "seats": seats[b], "method": s.divisor_method, "tenths": s.first_divisor_tenths, "exhaustion": s.list_exhaustion,
            "linkage": s.tier_linkage, "overhang": s.heiyo_overhang,
        }
        won = defaultdict(int)
        for p, _, filled in award_one_by_one(case)[0]:
            won[p] += filled
            vacancies += not filled
        for p, n in won.items():
            out[p] += n
            names |= {x[3] for x in sorted(able[p])[:n]}
    for b in smd:
        for p, n in smd[b].items():
            out[p] += n
    return {p: n for p, n in out.items() if n}, names, vacancies


def election_frames(spark, e):
    lit = F.lit("e").alias("election")

    def df(rows, ddl):
        return spark.createDataFrame(rows, ddl).select(lit, "*")

    return Election(
        df(list(e["valid"].items()), "district string, valid_votes long"),
        df(e["candidates"], "district string, block string, name string, party string, votes long"),
        df(e["entries"], "block string, party string, ordinal long, list_rank int, name string, dual boolean, district string, smd_name string, smd_votes long"),
        df([(b, p, v) for b, vs in e["votes"].items() for p, v in vs.items()], "block string, party string, votes long"),
        df([(b, n, e["electors"][b]) for b, n in BLOCKS.items()], "block string, seats int, electors long"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_presets(spark, seed):
    e = make(seed)
    rates, orders = random_profile(random.Random(seed))
    # Seat totals here are small: scale the presets' change of seats.
    rules = {k: scenarios.replace(s, pr_seat_delta=-4 if s.pr_seat_delta else 0) for k, s in PRESETS.items()}
    rate_df = spark.createDataFrame([(v, t, r) for v, row in rates.items() for t, r in row.items()], "voter string, target string, rate int")
    order_df = spark.createDataFrame([(v, i, t) for v, o in orders.items() for i, t in enumerate(o)], "voter string, pos int, target string")
    data = election_frames(spark, e)

    def ranked_winners(c):
        result = ranked.runoff(c, profiles.layers(rate_df), order_df, ["election", "district"])
        blocks = c.select("election", "district", "block").distinct()
        return ranked.as_outcome(result, c, ["election", "district"]).join(blocks, ["election", "district"])

    out = simulate(data, lambda df: scenarios.attach(df, rules), ranked_winners)
    seats, names, empty = defaultdict(dict), defaultdict(set), defaultdict(int)
    for r in out.seats.collect():
        if r.seats:
            seats[r.scenario_id][r.party] = r.seats
        empty[r.scenario_id] += r.vacancies
    for r in out.winners.collect():
        names[r.scenario_id].add(r.name)
    for k, s in rules.items():
        want_seats, want_names, want_empty = plain(e, s, rates, orders)
        assert (seats[k], names[k], empty[k]) == (want_seats, want_names, want_empty), k


@pytest.mark.parametrize("votes,valid,num,den,floor,top,want", [
    (1000, 6000, 1, 6, None, 3000, True), (999, 6000, 1, 6, None, 3000, False),
    (1500, 3000, 1, 10, 50, 3000, True), (1500, 3000, 1, 10, 51, 3000, False), (0, 0, 1, 10, 5, 3000, False),
])
def test_eligibility_boundaries(spark, votes, valid, num, den, floor, top, want):
    df = spark.createDataFrame([(votes, valid, num, den, floor, top)], "v long, valid long, n int, d int, f int, top long")
    got = df.select(lists.eligible(F.lit(True), F.lit(False), F.col("v"), F.col("valid"), F.col("top"), F.col("n"), F.col("d"), F.col("f")).alias("x"))
    assert got.first().x is want


def test_solo_entries_always_qualify(spark):
    got = spark.range(1).select(lists.eligible(
        F.lit(False), F.lit(None).cast("boolean"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"),
        F.lit(1), F.lit(6), F.lit(50)).alias("x"))
    assert got.first().x is True


@pytest.mark.parametrize("members,want", [(465, [233, 244, 261]), (475, [238, 249, 266]), (411, [206, 216, 231])])
def test_majority_lines(spark, members, want):
    rows = compare.majority_lines(spark.createDataFrame([(members,)], "members int"), "members").orderBy("line_no").collect()
    assert [r.needed for r in rows] == want
    assert [r.exact for r in rows] == [True, members != 411, members != 411]


@pytest.mark.parametrize("held,line", [(232, None), (233, "majority"), (244, "stable"), (261, "absolute")])
def test_strictest_line(spark, held, line):
    seats = spark.createDataFrame([(1, "us", held), (1, "them", 465 - held)], "k int, party string, seats long")
    coalition = spark.createDataFrame([(1, "us"), (1, "gone")], "k int, party string")
    row = compare.coalition_summary(seats, coalition, ["k"]).first()
    assert (row.held, row.reached) == (held, line)


def test_steps_skip_unchanged_and_inert_rules(spark):
    one = spark.createDataFrame([(1,)], "x int")
    target = {"t": Scenario("dhondt", 21, -5, 1, 6, None, "vacant", "renyo", "expand")}
    rows = scenarios.expand_steps(scenarios.attach(one, target)).orderBy("step_no").collect()
    assert [r.step_id for r in rows] == ["start", "tier_linkage", "pr_seat_delta", "min_share", "list_exhaustion"]
    assert [r.first_divisor_tenths for r in rows] == [14] * 5
    assert rows[-1].heiyo_overhang == "truncate"
    assert (rows[2].share_den, rows[3].share_num, rows[3].share_den) == (10, 1, 6)
    assert [r.list_exhaustion for r in rows] == ["reallocate"] * 4 + ["vacant"]


def test_grid_size(spark):
    one = spark.createDataFrame([(1,)], "x int")
    grid = scenarios.attach_grid(one, first_divisor=scenarios.GRID_FIRST_DIVISOR, shares=scenarios.GRID_SHARES,
                                 rate_floor=scenarios.GRID_RATE_FLOOR, methods=["modifiedSainteLague"])
    assert grid.count() == 21 * 4 * 19 == grid.select("scenario_id").distinct().count()


def test_fifteen_presets():
    assert len(PRESETS) == 15 and len(set(PRESETS.values())) == 15
