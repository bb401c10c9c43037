"""District results, list eligibility, capacities and filling seats from lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import join_null_safe, top_by_group

#: District tables up to this size are broadcast; a row has a few short fields, so that is some ten MB.
SMALL_ROWS = 200_000


def plurality(candidates: DataFrame, keys: Sequence[str], name="name", party="party", votes="votes") -> DataFrame:
    """Winner per district: most votes, then name. One map-side-combined aggregate."""
    best = F.min(F.struct((-F.col(votes)).alias("n"), F.col(name).alias("w"), F.col(party).alias("p")))
    return candidates.groupBy(*keys).agg(best.alias("__b"), F.sum(votes).alias("total_votes")).select(
        *keys,
        F.col("__b.w").alias("winner"),
        F.col("__b.p").alias("winner_party"),
        (-F.col("__b.n")).alias("winner_votes"),
        "total_votes",
    )


def loser_ratio(dual: Column, votes: Column, winner_votes: Column) -> Column:
    """Votes as a percentage of the current winner's; null for list-only entries or zero votes."""
    return F.when(
        dual & (votes > 0) & (winner_votes > 0),
        votes.cast("decimal(20,0)") / winner_votes.cast("decimal(20,0)") * 100,
    )


def eligible(
    dual: Column, won: Column, votes: Column, valid: Column, winner_votes: Column,
    share_num: Column, share_den: Column, rate_floor: Column,
) -> Column:
    """Whether a listed person can take a list seat; thresholds by cross-multiplication.

    Only entries that also stood in a district can fail.
    """
    share = votes * share_den >= valid * share_num
    rate = F.coalesce(
        (votes > 0)
        & (winner_votes > 0)
        & (votes.cast("decimal(20,0)") * 100 >= rate_floor.cast("decimal(5,2)") * winner_votes.cast("decimal(20,0)")),
        F.lit(False),
    )
    can = ~F.coalesce(won, F.lit(False)) & F.coalesce(share, F.lit(False)) & (rate_floor.isNull() | rate)
    return F.when(dual, can).otherwise(F.lit(True))


def small(df: DataFrame) -> DataFrame:
    """Broadcast a table of districts if it has no more than SMALL_ROWS rows; a longer one is joined by key."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def mark_entries(entries: DataFrame, outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the district outcome to each entry and decide win, ratio and eligibility.

    ``entries``: keys (incl. ``district``), dual, smd_name, smd_votes, valid_votes and the
    rule columns share_num, share_den, rate_floor. ``outcomes``: keys, winner,
    winner_votes. A listed person won when the district-side name is the winner's.
    """
    joined = join_null_safe(entries, small(outcomes.select(*keys, "winner", "winner_votes")), keys, "left")
    dual = F.coalesce(F.col("dual"), F.lit(False))
    won = dual & F.col("winner").isNotNull() & F.col("winner").eqNullSafe(F.col("smd_name"))
    return joined.withColumn("won", won).select(
        "*",
        loser_ratio(dual, F.col("smd_votes"), F.col("winner_votes")).alias("rate"),
        eligible(
            dual, F.col("won"), F.col("smd_votes"), F.col("valid_votes"), F.col("winner_votes"),
            F.col("share_num"), F.col("share_den"), F.col("rate_floor"),
        ).alias("eligible"),
    )


def capacities(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Eligible entries per (contest, party)."""
    return marked.groupBy(*keys).agg(F.count_if("eligible").alias("capacity"))


def fill_lists(
    marked: DataFrame, seats: DataFrame, keys: Sequence[str], extra_keys: Sequence[str] = (), ordinal: str = "ordinal"
) -> DataFrame:
    """The first ``seats`` eligible entries per (contest, party).

    Order: list rank, then ratio (none counts as zero) descending, then file order.
    ``extra_keys`` are further keys of ``seats`` (scenarios) that share one entry table:
    entries are ranked once, as far as the largest number of seats, and each scenario
    takes from the top. A list with fewer eligible entries than seats is an error.
    """
    wanted = seats.where("seats > 0").select(*keys, *extra_keys, "seats")
    able = marked.where("eligible")
    most = join_null_safe(
        wanted.groupBy(*keys).agg(F.max("seats").alias("__most")),
        able.groupBy(*keys).agg(F.count(F.lit(1)).alias("__able")), keys, "left",
    )
    # Left and checked afterwards: a list without any eligible entry is met, too.
    enough = F.coalesce("__able", F.lit(0)) >= F.col("__most")
    short = F.raise_error(F.concat(F.lit("a list is too short for its seats: "), F.col("__most").cast("string")))
    pool = join_null_safe(most, able, keys, "left").where(
        F.when(enough, F.col(ordinal).isNotNull()).otherwise(short.cast("boolean"))).drop("__able")
    ranked = top_by_group(
        pool, keys, [F.col("list_rank"), F.coalesce("rate", F.lit(0)).desc(), F.col(ordinal)],
        F.col("__most"), [ordinal], "fill_no",
    ).drop("__most")
    return join_null_safe(ranked, wanted, keys, "inner").where("fill_no <= seats")


def shortfall(filled: DataFrame, seats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(contest, party) rows whose list could not supply the seats: should be empty."""
    got = filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("filled"))
    return join_null_safe(seats, got, keys, "left").withColumn(
        "filled", F.coalesce("filled", F.lit(0))
    ).where(F.col("filled") < F.col("seats"))
