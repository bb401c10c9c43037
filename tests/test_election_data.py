"""From source tables to simulator input, self-check, documents and back."""

import pytest

from election_fixture import build
from test_election_checks import SEED, config, frames
from tallyforge.plans import election_data as ed
from tallyforge.plans import scenarios
from tallyforge.plans.simulate import simulate


@pytest.fixture(scope="module")
def world(spark):
    rows, cfg = build(SEED)
    t = {k: v.cache() for k, v in frames(spark, rows).items()}
    data = ed.from_tables(t)
    baseline = simulate(data, lambda df: scenarios.attach(df, {"baseline": scenarios.BASELINE}))
    return rows, t, config(spark, cfg), data, baseline


def test_input_has_no_problems(world):
    _, t, _, data, _ = world
    assert ed.input_problems(t).isEmpty()
    assert data.entries.where("dual AND district IS NULL").isEmpty()


def test_baseline_reproduces_history(world):
    _, t, cfg, data, baseline = world
    assert [r.asDict() for r in ed.self_check(t, cfg, data, baseline).collect()] == []


def test_self_check_notices_a_changed_seat(spark, world):
    rows, t, cfg, data, baseline = world
    from pyspark.sql import functions as F

    broken = dict(t)
    first = t["pr_party_blocks"].first()
    hit = (F.col("block") == first.block) & (F.col("party") == first.party)
    broken["pr_party_blocks"] = t["pr_party_blocks"].withColumn("seats", F.col("seats") + F.when(hit, 1).otherwise(0))
    problems = {r.problem for r in ed.self_check(broken, cfg, data, baseline).collect()}
    assert problems == {"seats"}


def test_documents_round_trip(world):
    rows, t, cfg, _, _ = world
    docs = ed.documents(t, cfg)
    got = ed.roundtrip(t, docs).collect()
    assert len(got) == 7 and all(r.ok for r in got)
    doc = docs.first()
    assert [b.block for b in doc.blocks][:3] == ["北海道", "東北", "北関東"]
    assert doc.districts[0].prefecture == "北海道" and len(doc.districts) == len(rows["smd_districts"])
    votes = [c.votes for c in doc.districts[0].candidates]
    assert votes == sorted(votes, reverse=True)
    assert len(doc.electorate) == 47 == len(doc.ballots)


def test_publication(spark, world, tmp_path):
    from tallyforge.sources.documents import write_checked

    rows, t, cfg, data, baseline = world
    docs = ed.publication(t, cfg, data, baseline)
    doc = docs.first()
    assert doc.voteScale == 1000 and doc.meta.smd_seats == len(rows["smd_districts"]) == len(doc.smd.districts)
    assert sum(p.seats for p in doc.smd.seatsByParty) == doc.meta.smd_seats
    first = doc.smd.districts[0]
    assert (first.pref, first.topVotes, first.winner) == ("北海道", first.candidates[0].votes, first.candidates[0].name)
    listed = [x for b in doc.blocks for p in b.parties for x in p.list or []]
    assert len(listed) == len(rows["pr_list_entries"])
    assert sum(x.actualElected for x in listed) == doc.meta.pr_seats == sum(b.seats for b in doc.blocks)
    assert all((x.districtId is not None) == x.dual for x in listed)
    write_checked(docs, ed.self_check(t, cfg, data, baseline), str(tmp_path / "pub"))
    assert spark.read.json(str(tmp_path / "pub")).count() == 1
