"""All 35 checks pass on a consistent election, and each notices a planted fault."""

import copy

import pytest
from pyspark.sql import functions as F

from election_fixture import ELECTION, MINOR, PARTIES, build
from tallyforge.plans import election_checks as ec
from tallyforge.sources.dimensions import register
from tallyforge.sources.schemas import TABLES
from tallyforge.sources.tables import typed

SEED = 4


def frames(spark, rows):
    out = {}
    for name, body in rows.items():
        columns = list(body[0])
        df = spark.createDataFrame([tuple(r[c] for c in columns) + (i,) for i, r in enumerate(body)],
                                   ", ".join(f"{c} string" for c in columns) + ", file_ordinal long").coalesce(1)
        out[name] = typed(df, TABLES[name])
    return out


def config(spark, cfg):
    return spark.createDataFrame([cfg], "election_id string, ordinal int, election_date string, smd_seats int, pr_seats int, has_gender_column boolean")


def known(spark):
    return spark.createDataFrame([(ELECTION, p) for p in [*PARTIES, "無所属", MINOR, "泡沫会"]], "election_id string, party string")


@pytest.fixture(scope="module")
def clean():
    return build(SEED)


def results(spark, rows, cfg, only=None, reg=None):
    graded = ec.run(frames(spark, rows), config(spark, cfg), known(spark), reg, only)
    return {r.check_id: r for r in graded.collect()}


def test_registry_is_complete():
    assert len(ec.REGISTRY) == 35


def test_clean_election_passes(spark, clean):
    rows, cfg = clean
    assert set(rows) == set(TABLES)
    for part in (["A1", "A2", "A3", "A4", "A5", "A6", "A7", "A8", "B1", "B2", "B3", "B4", "B5"],
                 ["C1", "C2", "C3", "C4", "C5", "C6", "C7", "C7b", "C8", "C9", "C11", "C12"],
                 ["C10", "D1", "D2", "D3", "E1", "E2", "E3", "E4", "E5", "E6"]):
        got = results(spark, rows, cfg, part)
        assert {k: (r.status, r.samples) for k, r in got.items()} == {k: ("PASS", "") for k in part}


def pick(rows, table, **where):
    return next(r for r in rows[table] if all(r[k] == v for k, v in where.items()))


def bump(row, column, by=1):
    row[column] = str(int(row[column] or 0) + by)


FAULTS = {
    "A1": lambda t: bump(t["electorate"][0], "electors_male"),
    "A2": lambda t: bump(t["electorate"][0], "voters_total"),
    "A3": lambda t: bump(t["ballots_smd_by_pref"][0], "invalid_votes", 500),
    "A4": lambda t: t["turnout"][0].update(rate_total="99.00"),
    "A5": lambda t: t["turnout"][0].update(diff_total="3.33"),
    "A6": lambda t: bump(pick(t, "electorate", prefecture="合計"), "electors_total"),
    "A7": lambda t: bump(pick(t, "party_votes_by_block_pref", prefecture="計"), "votes"),
    "A8": lambda t: bump(t["party_votes_by_pref_smd"][0], "votes_total"),
    "B1": lambda t: t["smd_districts"][0].update(deposit_forfeit_point="5"),
    "B2": lambda t: pick(t, "smd_candidates", elected="true").update(elected="false"),
    "B3": lambda t: next(r for r in t["smd_candidates"] if r["sekihai_rate"]).update(sekihai_rate="1.000"),
    "B4": lambda t: pick(t, "smd_candidates", sekihai_excluded="false").update(sekihai_excluded="true"),
    "B5": lambda t: t["smd_districts"][-1].update(district_no="9"),
    "C1": lambda t: bump(t["party_votes_smd_total"][0], "votes"),
    "C2": lambda t: bump(t["party_votes_by_pref_smd"][0], "votes_total"),
    "C3": lambda t: bump(t["ballots_smd_by_pref"][0], "valid_votes"),
    "C4": lambda t: bump(t["party_votes_by_block"][0], "votes"),
    "C5": lambda t: bump(t["party_votes_pr_total"][0], "votes"),
    "C6": lambda t: bump(pick(t, "ballots_pr_by_block_pref", prefecture="計"), "valid_votes"),
    "C7": lambda t: bump(pick(t, "winners_by_pref_party", party="__TOTAL__"), "total"),
    "C7b": lambda t: bump(t["winners_by_pref_party"][0], "total"),
    "C8": lambda t: bump(t["pr_party_blocks"][0], "seats"),
    "C9": lambda t: bump(t["pr_party_blocks"][0], "votes"),
    "C10": lambda t: pick(t, "pr_list_entries", smd_result="落").update(smd_result="当"),
    "C11": lambda t: t["party_votes_by_block"][0].update(share_pct="0.50"),
    "C12": lambda t: bump(t["candidacy_by_pref_age"][0], "count"),
    "D1": lambda t: t["dhondt_quotients"][0].update(quotient="1.000"),
    "D2": lambda t: bump(t["pr_party_blocks"][0], "seats"),
    "D3": lambda t: next(r for r in t["dhondt_quotients"] if r["seat_rank"] == "1").update(seat_rank="99"),
    "E1": lambda t: t["party_votes_by_block"].append({**t["party_votes_by_block"][0], "block": "海外"}),
    "E2": lambda t: t["party_votes_by_block"][0].update(party="謎の党"),
    "E3": lambda t: t["smd_candidates"][0].update(age="17"),
    "E4": lambda t: next(r for r in t["pr_list_entries"] if r["list_rank"] == "2").update(list_rank="7"),
    "E5": lambda t: t["smd_candidates"][0].update(gender="男"),
    "E6": lambda t: [r.update(religion="x") for r in t["smd_candidates"]],
}


def test_every_check_has_a_fault():
    assert set(FAULTS) == set(ec.REGISTRY)


@pytest.mark.parametrize("group", ["A", "B", "C", "D", "E"])
def test_faults_are_noticed(spark, clean, group):
    rows, cfg = clean
    for check_id, plant in FAULTS.items():
        if not check_id.startswith(group):
            continue
        broken = {k: [dict(r) for r in v] if k in ec.REGISTRY[check_id][0] or not ec.REGISTRY[check_id][0] else v for k, v in rows.items()}
        plant(broken)
        needed = ec.REGISTRY[check_id][0] or tuple(broken)
        [check] = ec.checks(frames(spark, {k: broken[k] for k in needed}), config(spark, cfg), known(spark), [check_id])
        assert not check.violations.isEmpty(), check_id


def test_fractional_shortfall_needs_a_fraction(spark, clean):
    rows, cfg = clean
    t = copy.deepcopy({k: rows[k] for k in ("smd_districts", "smd_candidates")})
    first = t["smd_districts"][0]
    people = [r for r in t["smd_candidates"] if (r["prefecture"], r["district_no"]) == (first["prefecture"], first["district_no"])]
    people[0]["votes"] = str(int(people[0]["votes"]) - 1) + ".4"
    assert results(spark, t, cfg, ["B1"])["B1"].status == "PASS"
    people[0]["votes"] = people[0]["votes"].split(".")[0]
    assert results(spark, t, cfg, ["B1"])["B1"].status == "FAIL"


def test_registered_discrepancy_warns(spark, clean):
    rows, cfg = clean
    t = copy.deepcopy({k: rows[k] for k in ("smd_districts", "smd_candidates")})
    t["smd_districts"][0]["deposit_forfeit_point"] = "5"
    subject = t["smd_districts"][0]["prefecture"] + t["smd_districts"][0]["district_no"]
    reg = register(spark, [(ELECTION, "B1", subject, "as printed")])
    row = results(spark, t, cfg, ["B1"], reg)["B1"]
    assert (row.status, row.fail_count, row.known_count) == ("WARN", 0, 1)


def test_gender_must_be_filled_where_printed(spark, clean):
    rows, cfg = clean
    t = {"smd_candidates": rows["smd_candidates"]}
    assert results(spark, t, (*cfg[:5], True), ["E5"])["E5"].status == "FAIL"
    filled = {"smd_candidates": [{**r, "gender": "女"} for r in rows["smd_candidates"]]}
    assert results(spark, filled, (*cfg[:5], True), ["E5"])["E5"].status == "PASS"


def test_verdict(spark, clean):
    from tallyforge.plans.quality import verdict

    rows, cfg = clean
    graded = ec.run(frames(spark, {"electorate": rows["electorate"]}), config(spark, cfg), None, None, ["A1", "A2"])
    row = verdict(graded, ["election_id"]).first()
    assert (row.verdict, row.checks) == ("PASS", 2)
    assert graded.where(F.col("subject_count") == 0).isEmpty()
