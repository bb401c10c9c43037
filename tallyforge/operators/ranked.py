"""Ranked-choice tabulation of all contests at once, one round per job.

State: one row per (contest, candidate, source party, layer), so its size is bounded
by candidates x sources x layers of a contest and shrinks as contests are decided.
Each round is a few keyed aggregates and joins; the state is checkpointed so the plan
does not grow. No contest is ever gathered into one row or window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import join_null_safe

VOTES = "decimal(28,10)"
#: The same as whole units of 10^-10 votes, and what one digit of a quotient counts: a product of both has 38 places.
_UNITS, _DIGIT = "decimal(28,0)", 10**10
_SEQ_STEP = 1 << 32


@dataclass
class Runoff:
    """standings: keys, round, name, party, votes, share, leader, loser, decided ·
    transfers: keys, round, target party, parcels, first_seen, votes ·
    exhausted: keys, round, votes."""

    keys: list[str]
    standings: DataFrame
    transfers: DataFrame
    exhausted: DataFrame

    def winners(self) -> DataFrame:
        return self.standings.where("decided AND leader").select(
            *self.keys, F.col("name").alias("winner"), F.col("party").alias("winner_party"), F.col("round").alias("rounds")
        )

    def exhausted_votes(self) -> DataFrame:
        return self.exhausted.groupBy(*self.keys).agg(F.sum("votes").alias("exhausted"))

    def log(self) -> DataFrame:
        """Per round: who was eliminated with how many votes, and the modal target party.

        The mode counts parcels; the party met first wins a tie.
        """
        best = F.min(F.struct((-F.col("parcels")).alias("n"), F.col("first_seen").alias("s"), F.col("target").alias("t")))
        modal = self.transfers.groupBy(*self.keys, "round").agg(best.alias("__b")).select(
            *self.keys, "round", F.col("__b.t").alias("moved_to")
        )
        rounds = self.standings.groupBy(*self.keys, "round").agg(
            F.count(F.lit(1)).alias("standing"),
            F.max(F.when(F.col("loser") & ~F.col("decided"), F.struct("name", "votes"))).alias("__l"),
        )
        return join_null_safe(rounds, modal, [*self.keys, "round"], "left").select(
            *self.keys, "round", "standing", F.col("__l.name").alias("eliminated"),
            F.col("__l.votes").alias("eliminated_votes"), "moved_to",
        )


def first_parcels(candidates: DataFrame, keys: Sequence[str], layers: DataFrame, orderings: DataFrame) -> DataFrame:
    """Votes split over the layers of the candidate's party; one parcel without layers.

    ``route`` says what happens on elimination: by ``layers``, ``even`` over everyone
    left (an ordering but no rates), or ``none``.
    """
    known = orderings.select(F.col("voter").alias("party")).distinct().withColumn("__known", F.lit(True))
    joined = candidates.select(*keys, "name", "party", "votes").join(
        layers.select(F.col("voter").alias("party"), "layer", "weight"), "party", "left"
    ).join(known, "party", "left")
    hundred = F.lit(100).cast("decimal(3,0)")
    weighted = F.col("votes").cast("decimal(26,8)") * F.coalesce(F.col("weight").cast("decimal(5,0)"), hundred) / hundred
    return joined.select(
        *keys, F.lit(1).alias("round"), "name", "party", F.col("party").alias("src"), F.coalesce("layer", F.lit(0)).alias("layer"),
        F.when(F.col("layer").isNotNull(), "layers").when(F.col("__known"), "even").otherwise("none").alias("route"),
        weighted.cast(VOTES).alias("votes"), F.lit(1).cast("bigint").alias("pieces"),
        F.coalesce("layer", F.lit(0)).cast("bigint").alias("seq"),
    )


def _standing(parcels: DataFrame, keys: Sequence[str]) -> DataFrame:
    by = [*keys, "round"]
    totals = parcels.groupBy(*by, "name", "party").agg(F.sum("votes").cast(VOTES).alias("votes"))
    verdict = totals.groupBy(*by).agg(
        F.sum("votes").alias("__all"), F.count(F.lit(1)).alias("__n"),
        F.min(F.struct((-F.col("votes")).alias("v"), "name")).alias("__lead"),
        F.min(F.struct("votes", "party", "name")).alias("__lose"),
    )
    decided = (F.col("__n") == 1) | (-F.col("__lead.v") * 2 > F.col("__all"))
    return join_null_safe(totals, verdict, by, "inner").select(
        *by, "name", "party", "votes",
        F.when(F.col("__all") > 0, F.col("votes").cast("double") / F.col("__all").cast("double") * 100).otherwise(0.0).alias("share"),
        (F.col("name") == F.col("__lead.name")).alias("leader"),
        ((F.col("name") == F.col("__lose.name")) & (F.col("party") == F.col("__lose.party"))).alias("loser"),
        decided.alias("decided"),
    )


def _units(votes: Column) -> Column:
    return (votes.cast(VOTES) * F.lit(_DIGIT)).cast(_UNITS)


def _quotient(part: Column, whole: Column) -> Column:
    """``part / whole`` of units, at most 1, to 30 places: three digits to the base 10^10 by long division."""
    digits = []
    for _ in range(3):
        ahead = part * F.lit(_DIGIT)
        digits.append(F.call_function("div", ahead, whole))
        part = (ahead % whole).cast(_UNITS)
    return F.array(*digits)


def _portion(units: Column, digits: Column) -> Column:
    """Votes that ``digits`` of a quotient are of ``units``, rounded down to a unit."""
    carry = F.lit(0)
    for i in (2, 1, 0):
        product = units * digits[i] + carry
        carry = ((product - product % F.lit(_DIGIT)) / F.lit(_DIGIT)).cast(_UNITS)
    return (carry * F.lit(Decimal("1e-10"))).cast(VOTES)


def _redistribute(parcels: DataFrame, standing: DataFrame, accepts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All parcels of the open contests after this round, marked kept, moved or gone."""
    columns = [*keys, "round", "name", "party", "src", "layer", "route", "votes", "pieces", "seq"]
    open_rows = standing.where("NOT decided")
    live = open_rows.where("NOT loser").select(*keys, F.col("name"), "party", F.col("votes").alias("total"))
    losers = open_rows.where("loser").select(*keys, "name")
    kept = join_null_safe(parcels, live.select(*keys, "name"), [*keys, "name"], "left_semi")
    bag = join_null_safe(parcels, losers, [*keys, "name"], "left_semi").drop("name", "party")
    parties = live.groupBy(*keys, F.col("party").alias("target")).agg(
        F.sum("total").alias("__base"), F.count(F.lit(1)).alias("__same")
    )
    choice = (
        join_null_safe(
            bag.where("route = 'layers'").select(*keys, "src", "layer").join(accepts, ["src", "layer"]),
            parties.select(*keys, "target"), [*keys, "target"], "left_semi",
        )
        .groupBy(*keys, "src", "layer")
        .agg(F.min(F.struct("pos", "target"))["target"].alias("target"))
    )
    # A bag is one candidate's parcels (sources x layers), numbered in order of arrival.
    moved = join_null_safe(bag, choice, [*keys, "src", "layer"], "left").withColumn(
        "seq", F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "src", "layer")).cast("bigint")
    )
    # Receivers: those of the chosen party, or everyone left on the even route.
    shares = join_null_safe(live.withColumnRenamed("party", "target"), parties, [*keys, "target"], "inner")
    everyone = live.groupBy(*keys).agg(F.count(F.lit(1)).alias("__same"))
    even = join_null_safe(live, everyone, keys, "inner").select(
        *keys, F.lit(None).cast("string").alias("target"), F.lit("even").alias("route"), "name", "party",
        F.lit(1).cast(VOTES).alias("total"), F.col("__same").cast(VOTES).alias("__base"),
    )
    # Receivers without any votes share evenly.
    some = F.col("__base") > 0
    receivers = shares.select(
        *keys, "target", F.lit("layers").alias("route"), "name", F.col("target").alias("party"),
        F.when(some, F.col("total")).otherwise(1).cast(VOTES).alias("total"),
        F.when(some, F.col("__base")).otherwise(F.col("__same")).cast(VOTES).alias("__base"),
    ).unionByName(even)
    # A receiver gets what lies between two points of the bag. The last point is all of it, so no vote is lost.
    upto, base = F.sum("total").over(Window.partitionBy(*keys, "target", "route").orderBy("name")), _units(F.col("__base"))
    receivers = receivers.select(
        *keys, "target", "route", "name", "party",
        _quotient(_units(upto - F.col("total")), base).alias("__from"), _quotient(_units(upto), base).alias("__to"))
    units = _units(F.col("votes"))
    part = F.when(F.col("__to").isNull(), F.col("votes")).otherwise(
        _portion(units, F.col("__to")) - _portion(units, F.col("__from"))).cast(VOTES)
    arrived = join_null_safe(moved, receivers, [*keys, "target", "route"], "left").withColumn("votes", part)
    return kept.select(*columns, F.lit("kept").alias("state")).unionByName(
        arrived.select(*columns, F.when(F.col("name").isNull(), "gone").otherwise("moved").alias("state"))
    )


def _next_parcels(after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parcels of one source and layer held by a candidate become one."""
    arrival = F.when(F.col("state") == "moved", F.col("round") * F.lit(_SEQ_STEP)).otherwise(F.lit(0).cast("bigint"))
    return after.where("state <> 'gone'").groupBy(
        *keys, (F.col("round") + 1).alias("round"), "name", "party", "src", "layer", "route"
    ).agg(
        F.sum("votes").cast(VOTES).alias("votes"), F.sum("pieces").alias("pieces"),
        F.min(F.col("seq") + arrival).alias("seq"),
    )


def runoff(candidates: DataFrame, layers: DataFrame, orderings: DataFrame, keys: Sequence[str]) -> Runoff:
    """Instant runoff per contest until a majority of continuing votes or one is left.

    candidates: keys, name (unique in a contest), party, votes · layers: voter, layer,
    weight, rejects · orderings: voter, pos, target. The votes of a contest are below 10^18.

    Two small tables are written per round. The round number is a column, so every
    round runs the same generated code.
    """
    keys = list(keys)
    # (source, layer) -> targets it would accept, in order: as small as the profile.
    accepts = cut_lineage(
        layers.join(orderings, "voter")
        .where(~F.array_contains("rejects", F.col("target")))
        .select(F.col("voter").alias("src"), "layer", "pos", "target")
    )
    parcels = cut_lineage(first_parcels(candidates, keys, layers, orderings))
    standings, after = [], []
    while True:
        standing = cut_lineage(_standing(parcels, keys))
        standings.append(standing)
        if standing.where("NOT decided").isEmpty():
            break
        state = cut_lineage(_redistribute(parcels, standing, accepts, keys))
        after.append(state)
        parcels = _next_parcels(state, keys)
    everything = standings[0]
    for s in standings[1:]:
        everything = everything.unionByName(s)
    steps = after[0] if after else _redistribute(parcels, standings[0].where("false"), accepts, keys)
    for s in after[1:]:
        steps = steps.unionByName(s)
    by_parcel = steps.where("state = 'moved' AND route = 'layers'").groupBy(
        *keys, "round", F.col("party").alias("target"), "src", "layer"
    ).agg(F.max("pieces").alias("pieces"), F.min("seq").alias("seq"), F.sum("votes").alias("votes"))
    transfers = by_parcel.groupBy(*keys, "round", "target").agg(
        F.sum("pieces").alias("parcels"), F.min("seq").alias("first_seen"), F.sum("votes").alias("votes")
    )
    gone = steps.where("state = 'gone'").groupBy(*keys, "round").agg(F.sum("votes").alias("votes"))
    return Runoff(keys, everything, transfers, gone)


def as_outcome(result: Runoff, candidates: DataFrame, place: Sequence[str]) -> DataFrame:
    """Winners in the shape of ``lists.plurality``: votes are first preferences."""
    first = candidates.select(*result.keys, F.col("name").alias("winner"), F.col("votes").alias("winner_votes"))
    totals = candidates.groupBy(*result.keys).agg(F.sum("votes").alias("total_votes"))
    return result.winners().drop("rounds").join(first, [*result.keys, "winner"]).join(totals, result.keys).select(
        *place, "winner", "winner_party", "winner_votes", "total_votes"
    )


def secured(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether the first preferences alone decide a contest."""
    return candidates.groupBy(*keys).agg((F.max("votes") * 2 > F.sum("votes")).alias("secured"))


def flips(result: Runoff, plurality: DataFrame) -> DataFrame:
    """Contests whose winner differs from the plurality winner, and the rounds taken."""
    now = result.winners().withColumnsRenamed({"winner": "to_name", "winner_party": "to_party"})
    was = plurality.select(*result.keys, F.col("winner").alias("from_name"), F.col("winner_party").alias("from_party"))
    return now.join(was, result.keys).where("to_name <> from_name")


def unordered_parties(candidates: DataFrame, orderings: DataFrame, minor_below: float = 1.0) -> DataFrame:
    """Parties without an ordering: votes, share of all votes, minor below a share."""
    votes = candidates.groupBy("party").agg(F.sum("votes").alias("votes"))
    everything = votes.agg(F.sum("votes")).scalar()
    known = orderings.select(F.col("voter").alias("party")).distinct()
    share = F.coalesce(F.col("votes") / F.nullif(everything, F.lit(0)) * 100, F.lit(0))
    return votes.join(known, "party", "left_anti").select(
        "party", "votes", share.alias("share"), (share < minor_below).alias("minor")
    )
