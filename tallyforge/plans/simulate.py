"""Re-run elections under many rule sets in one plan.

Keys everywhere: election, block (multi-member contest), district, party and
scenario. Work is done at the coarsest key that determines it: district outcomes
once per voting rule, eligibility once per distinct (share, floor, voting rule), and
only allocation once per scenario.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import apportion as ap
from ..operators import lists
from ..operators.scan import join_null_safe
from ..session import cut_lineage

RULE_KEYS = ["share_num", "share_den", "rate_floor", "smd_voting"]


def contest_seats(
    contests: DataFrame, keys: Sequence[str], contest: str, electors: str, printed: str, delta: str
) -> DataFrame:
    """List seats per contest: as printed, or Adams over the electorate once the total moves.

    ``keys`` identify one body whose contests share the total (scenario, election).
    """
    keys = list(keys)
    totals = contests.groupBy(*keys).agg(F.sum(printed).alias("__printed_total"))
    base = join_null_safe(contests, totals, keys, "inner").withColumn(
        "__total", F.col("__printed_total") + F.col(delta)
    )
    moved = ap.adams(
        base.where(F.col(delta) != 0), keys, unit=contest, population=electors, seats="__total"
    ).select(*keys, contest, F.col("seats").alias("__adams"))
    return join_null_safe(base, moved, [*keys, contest], "left").select(
        *keys, contest,
        F.when(F.col(delta) == 0, F.col(printed).cast("bigint")).otherwise(F.col("__adams")).alias("seats"),
    )


@dataclass
class Election:
    """Input tables; every one also has ``election``.

    districts: district, block, valid_votes (threshold base) ·
    candidates: district, block, name, party, votes ·
    entries: block, party, ordinal, list_rank, name, dual, district, smd_name, smd_votes ·
    list_votes: block, party, votes · blocks: block, seats, electors
    """

    districts: DataFrame
    candidates: DataFrame
    entries: DataFrame
    list_votes: DataFrame
    blocks: DataFrame


@dataclass
class Outcome:
    """districts: winner per (smd_voting, election, district) · marked: entries with win,
    ratio, eligibility per distinct rule · awards: one row per list seat ·
    winners: persons on list seats · seats: per (scenario, election, party)."""

    districts: DataFrame
    marked: DataFrame
    awards: DataFrame
    winners: DataFrame
    seats: DataFrame
    block_seats: DataFrame


def simulate(
    data: Election,
    attach: Callable[[DataFrame], DataFrame],
    ranked: Callable[[DataFrame], DataFrame] | None = None,
    scenario_keys: Sequence[str] = ("scenario_id",),
) -> Outcome:
    """Run all scenarios. ``attach`` repeats a row per scenario (see ``scenarios``);
    ``ranked`` maps candidates to ranked-choice winners and is needed only when a
    scenario asks for it. ``scenario_keys`` identify one scenario row.
    """
    sk = list(scenario_keys)
    place = ["election", "district"]
    by_votes = lists.plurality(data.candidates, [*place, "block"]).withColumn("smd_voting", F.lit("plurality"))
    outcome = by_votes
    if ranked is not None:
        outcome = by_votes.unionByName(ranked(data.candidates).withColumn("smd_voting", F.lit("rcv")), True)
    # Three small results feed several later steps: one row per district, per
    # (scenario, block, party) and per seat. They are written once, not recomputed.
    outcome = cut_lineage(outcome)
    wins = outcome.groupBy("smd_voting", "election", "block", F.col("winner_party").alias("party")).agg(
        F.count(F.lit(1)).alias("smd")
    )

    # Eligibility depends on four rule fields only; their combinations are listed by the caller, and
    # every entry is repeated for each of them in its own row, without a join.
    rules = attach(data.blocks.sparkSession.range(1)).select(*RULE_KEYS).distinct().collect()
    types = {f.name: f.dataType for f in attach(data.blocks).schema.fields}
    listed_rules = F.array(*[F.struct(*[F.lit(r[k]).cast(types[k]).alias(k) for k in RULE_KEYS]) for r in rules])
    entries = join_null_safe(
        data.entries, lists.small(data.districts.select("election", "district", "valid_votes")), place, "left"
    )
    marked = lists.mark_entries(
        entries.select("*", F.explode(listed_rules).alias("__r")).select("*", "__r.*").drop("__r"),
        outcome.select("smd_voting", *place, "winner", "winner_votes"), ["smd_voting", *place],
    )
    capacity = lists.capacities(marked, [*RULE_KEYS, "election", "block", "party"])

    blocks = attach(data.blocks)
    seats_by_block = contest_seats(
        blocks, [*sk, "election"], "block", "electors", "seats", "pr_seat_delta"
    )
    votes = attach(data.list_votes)
    votes = join_null_safe(votes, seats_by_block, [*sk, "election", "block"], "inner")
    votes = join_null_safe(votes, capacity, [*RULE_KEYS, "election", "block", "party"], "left")
    votes = join_null_safe(votes, wins, ["smd_voting", "election", "block", "party"], "left")
    votes = cut_lineage(votes)
    contest = [*sk, *RULE_KEYS, "election", "block"]
    awards = ap.apportion(
        votes, contest,
        method=F.col("divisor_method"), first_tenths=F.col("first_divisor_tenths"),
        exhaustion=F.col("list_exhaustion"), capacity="capacity",
        linkage=F.col("tier_linkage"), district_wins="smd", overhang=F.col("heiyo_overhang"),
    )
    awards = cut_lineage(awards)
    filled = ap.seat_counts(awards, [*contest, "party"])
    winners = lists.fill_lists(marked, filled, [*RULE_KEYS, "election", "block", "party"], sk)
    listed = filled.groupBy(*sk, "election", "party").agg(
        F.sum("seats").alias("list_seats"), F.sum("vacancies").alias("vacancies")
    )
    direct = (
        attach(data.blocks.select("election").distinct())
        .select(*sk, "election", "smd_voting")
        .join(wins.groupBy("smd_voting", "election", "party").agg(F.sum("smd").alias("district_seats")),
              ["smd_voting", "election"])
        .drop("smd_voting")
    )
    keys = [*sk, "election", "party"]
    seats = direct.join(listed, keys, "full_outer").select(
        *keys,
        F.coalesce("district_seats", F.lit(0)).alias("district_seats"),
        F.coalesce("list_seats", F.lit(0)).alias("list_seats"),
        F.coalesce("vacancies", F.lit(0)).alias("vacancies"),
        (F.coalesce("district_seats", F.lit(0)) + F.coalesce("list_seats", F.lit(0))).alias("seats"),
    )
    return Outcome(outcome, marked, awards, winners, seats, filled)
