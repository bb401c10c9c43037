"""Highest-averages apportionment as explode, rank, keep.

A party's quotients never increase with its seat number, so awarding seats one at
a time to the best head quotient equals ranking all quotients of a contest by
(quotient desc, votes desc, party, seat number) and keeping the first S. Contests
and scenarios are ordinary key columns, so one job serves any number of both.

Four things keep the job small at scale:

* only quotients that can still win are exploded (`_ceiling`): at most
  S + parties (+ head starts) rows per contest instead of S x parties;
* where capacities bind, that bound does not hold: the price at which the contest closes
  is searched instead (`closing_limits`), by an aggregate over a ladder of prices;
* a contest with more parties than seats is first cut, inside salted parts, to the
  parties that can win, so what is ranked together grows with the seats alone;
* quotients are compared exactly with two 64-bit integers (`with_quotient`), no
  decimal division and no rounding, for divisors below 2^31.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import join_null_safe, salted_cut

DHONDT = "dhondt"
SAINTE_LAGUE = "sainteLague"
MODIFIED = "modifiedSainteLague"
METHODS = (DHONDT, SAINTE_LAGUE, MODIFIED)

REALLOCATE, VACANT = "reallocate", "vacant"
PARALLEL, RENYO, HEIYO = "parallel", "renyo", "heiyo"
TRUNCATE, EXPAND = "truncate", "expand"

#: The first divisor in tenths: outside this range quotients stop being monotone.
FIRST_DIVISOR_RANGE = (10, 30)


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _one_of(value: Column, allowed: Sequence[str], what: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(
        F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null"))))
    )


def divisor(method: str | Column, k: Column, first_tenths: int | Column = 14) -> Column:
    """Divisor for the ``k``-th seat (from 1); the modified family is scaled by ten."""
    m, t = _one_of(_col(method), METHODS, "divisor method"), _col(first_tenths)
    lo, hi = FIRST_DIVISOR_RANGE
    first = F.when(t.between(lo, hi), t.cast("bigint")).otherwise(
        F.raise_error(F.lit(f"first divisor must be {lo}..{hi} tenths"))
    )
    k = k.cast("bigint")
    return (
        F.when(m == DHONDT, k)
        .when(m == SAINTE_LAGUE, k * 2 - 1)
        .when(k == 1, first)
        .otherwise((k * 2 - 1) * 10)
    )


def with_quotient(df: DataFrame, votes: str, div: str) -> DataFrame:
    """Add ``__q`` and ``__qf``: the whole part and 62 fraction bits of votes / div.

    Two unequal fractions with divisors below 2^31 differ in these bits, and equal
    fractions agree in them, so ordering by both is ordering by the rational.
    """
    step = 1 << 31
    return (
        df.withColumn("__q", F.expr(f"{votes} div {div}"))
        .withColumn("__r", F.expr(f"({votes} % {div}) * {step}L"))
        .withColumn("__qf", F.expr(f"(__r div {div}) * {step}L + ((__r % {div}) * {step}L) div {div}"))
        .drop("__r")
    )


def _ceiling(method, votes, head, total_votes, parties, heads, seats) -> Column:
    """Highest seat number of a party that can be among the best ``seats`` quotients.

    At the price V / (S + P + H) the D'Hondt seats sum to at least S, so no quotient
    below that price wins; for odd divisors the price is V / (2S + P + 2H), with 3P
    for a raised first divisor. One seat is added against rounding of the double.
    """
    dh = votes * (seats + parties + heads) / total_votes
    odd_parties = F.when(method == MODIFIED, parties * 3).otherwise(parties)
    odd = (votes * (seats * 2 + odd_parties + heads * 2) / total_votes + 1) / 2
    return (F.floor(F.when(method == DHONDT, dh).otherwise(odd)) + 1 - head).cast("bigint")


#: Steps of the ladder of prices; over a range of 10^12 a step is a factor of 1.3.
PRICES = 105
#: Room for the rounding of doubles, in counts that must not be too high and in limits that must not be too low.
_SLACK = 1e-12


def _seats_at(price: Column, method: Column, first: Column, votes: Column, head: Column, room: Column, slack: float) -> Column:
    """Seats of a party whose quotients are at least ``price``: none before its head start, at most its room."""
    ratio = votes / price * (1 + slack)
    plain = F.floor(F.when(method == DHONDT, ratio).when(method == SAINTE_LAGUE, (ratio + 1) / 2).otherwise((ratio / 10 + 1) / 2))
    # The first divisor of the modified family may be larger than that of a plain first seat.
    plain = F.when((method == MODIFIED) & (plain < 2), F.when(ratio >= first, 1).otherwise(0)).otherwise(plain)
    return F.least(room, F.greatest(plain - head, F.lit(0))).cast("bigint")


def closing_limits(wide: DataFrame, contest: Sequence[str], method: Column, first: Column) -> DataFrame:
    """Add ``__limit``: seats up to which a party's quotients can win when parties hold ``__room`` seats at most.

    Seats at a price are the sum over parties of the least of room and quotients that reach it. The prices of
    a ladder, from the highest quotient to the lowest that any room allows, are tried together; the
    highest price that fills the contest bounds every party. So a contest yields its seats, times a step
    of the ladder, and a row per party, however large the capacities are.
    """
    votes, head, room = F.col("votes").cast("double"), F.col("__head"), F.col("__room")
    last = divisor(F.col("__method"), head + room, F.col("__tenths")).cast("double")
    ends = wide.where("votes > 0").groupBy(*contest).agg(
        F.max(votes / divisor(F.col("__method"), head + 1, F.col("__tenths"))).alias("__high"),
        (F.min(votes / last) * (1 - 1e-9)).alias("__low"))
    ranged = join_null_safe(wide, ends, contest, "left")

    # Steps of equal ratio from the highest price to the lowest.
    price = F.col("__high") * F.pow(F.col("__low") / F.col("__high"), F.col("__step") / F.lit(PRICES - 1))
    tried = ranged.where("votes > 0").withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(PRICES - 1))))
    filled = tried.groupBy(*contest, "__step").agg(
        F.max("__target").alias("__wanted"), F.sum(_seats_at(price, method, first, votes, head, room, -_SLACK)).alias("__filled"))
    closed = filled.where("__filled >= __wanted").groupBy(*contest).agg(F.min("__step").alias("__step"))
    priced = join_null_safe(ranged, closed, contest, "left")
    limit = _seats_at(price, method, first, votes, head, room, _SLACK) + 1
    # Without such a price all parties with votes fill their room, and those without come into play.
    return priced.withColumn(
        "__limit", F.when(F.col("__step").isNull(), room).when(F.col("votes") == 0, 0).otherwise(F.least(room, limit)).cast("bigint")
    ).drop("__high", "__low", "__step")


def apportion(
    df: DataFrame,
    contest: Sequence[str],
    *,
    party: str = "party",
    votes: str = "votes",
    seats: str | Column = "seats",
    method: str | Column = DHONDT,
    first_tenths: int | Column = 14,
    exhaustion: str | Column = REALLOCATE,
    capacity: str | None = None,
    linkage: str | Column = PARALLEL,
    district_wins: str | None = None,
    overhang: str | Column = TRUNCATE,
    salts: int = 32,
) -> DataFrame:
    """One row per awarded seat.

    ``df`` holds one row per (contest, party) with whole-number ``votes``. ``seats``
    and the rule arguments may be columns, constant within a contest.
    ``district_wins`` holds each listed party's district seats in the contest.

    Result: contest columns, ``award_no``, ``party``, ``votes``, ``seat_no`` (the party's
    own count, list and district seats together under compensatory linkage),
    ``divisor``, ``filled`` and ``tie`` (true on every row of a contest in which any
    award was decided between equal quotients).
    """
    contest = list(contest)
    base = df.select(
        *contest,
        F.col(party).alias("party"),
        F.col(votes).cast("bigint").alias("votes"),
        (F.col(seats) if isinstance(seats, str) else seats).cast("bigint").alias("__seats"),
        _one_of(_col(method), METHODS, "divisor method").alias("__method"),
        _col(first_tenths).alias("__tenths"),
        _one_of(_col(exhaustion), (REALLOCATE, VACANT), "exhaustion rule").alias("__exh"),
        (F.col(capacity).cast("bigint") if capacity else F.lit(None).cast("bigint")).alias("__cap"),
        _one_of(_col(linkage), (PARALLEL, RENYO, HEIYO), "tier linkage").alias("__link"),
        (F.coalesce(F.col(district_wins), F.lit(0)).cast("bigint") if district_wins else F.lit(0).cast("bigint")).alias("__smd"),
        _one_of(_col(overhang), (TRUNCATE, EXPAND), "overhang rule").alias("__over"),
    )
    heiyo, renyo = F.col("__link") == HEIYO, F.col("__link") == RENYO
    none = F.lit(0).cast("bigint")
    if district_wins:
        wins = base.groupBy(*contest).agg(F.sum("__smd").alias("__wins"))
        base = join_null_safe(base, wins, contest, "inner")
    else:
        base = base.withColumn("__wins", none)
    # Compensatory: all district and list seats of the contest are ranked together;
    # winners without a list keep their seat outside the ranking.
    bounded = (F.col("__exh") == REALLOCATE) & F.lit(capacity is not None)
    wide = (
        base.withColumn("__target", F.when(heiyo, F.col("__wins") + F.col("__seats")).otherwise(F.col("__seats")))
        .withColumn("__head", F.when(renyo, F.col("__smd")).otherwise(none))
        .withColumn(
            "__room",
            F.when(
                bounded,
                F.least(F.col("__target"), F.coalesce(F.col("__cap"), none) + F.when(heiyo, F.col("__smd")).otherwise(none)),
            ).otherwise(F.col("__target")),
        )
        .where(F.col("__room") > 0)
        .withColumn("divisor", divisor(F.col("__method"), F.col("__head") + 1, F.col("__tenths")))
    )
    # A party behind that many others by its first quotient wins nothing. Two more are
    # kept so that a tie with the last award is still seen.
    wide = salted_cut(
        with_quotient(wide, "votes", "divisor"), contest,
        [F.col("__q").desc(), F.col("__qf").desc(), F.col("votes").desc(), F.col("party")],
        F.col("__target") + 2, ["party"], salts,
    ).drop("__q", "__qf", "divisor")
    totals = wide.groupBy(*contest).agg(
        F.sum("votes").alias("__total"),
        F.count(F.lit(1)).alias("__parties"),
        F.sum("__head").alias("__heads"),
        # All quotients of a party without votes are zero; such parties tie as a group.
        F.count_if(F.col("votes") == 0).alias("__zero"),
    )
    wide = join_null_safe(wide, totals, contest, "inner")
    ceiling = _ceiling(
        F.col("__method"), F.col("votes").cast("double"), F.col("__head"), F.col("__total").cast("double"),
        F.col("__parties"), F.col("__heads"), F.col("__target"),
    )
    ceiling = F.when(F.col("__total") == 0, F.col("__room")).otherwise(F.least(F.col("__room"), ceiling))
    if capacity is None or isinstance(exhaustion, str) and exhaustion == VACANT:
        wide = wide.withColumn("__limit", ceiling)
    else:
        wide = closing_limits(wide, contest, F.col("__method"), F.col("__tenths")).withColumn(
            "__limit", F.when(bounded, F.col("__limit")).otherwise(ceiling))
    steps = wide.where(F.col("__limit") > 0).select(
        "*", F.explode(F.expr("sequence(1L, __limit)")).alias("seat_no")
    )
    steps = with_quotient(
        steps.withColumn(
            "divisor",
            divisor(F.col("__method"), F.col("__head") + F.col("seat_no"), F.col("__tenths")),
        ),
        "votes",
        "divisor",
    )
    order = [F.col("__q").desc(), F.col("__qf").desc(), F.col("votes").desc(), F.col("party"), F.col("seat_no")]
    same_quotient = Window.partitionBy(*contest, "__q", "__qf")
    ranked = (
        steps.withColumn("__rn", F.row_number().over(Window.partitionBy(*contest).orderBy(*order)))
        .withColumn(
            "__shared",
            F.when(F.col("votes") == 0, F.col("__zero") > 1).otherwise(
                F.min("party").over(same_quotient) != F.max("party").over(same_quotient)
            ),
        )
        .where(F.col("__rn") <= F.col("__target"))
    )
    by_rank = Window.partitionBy(*contest).orderBy("__rn")
    is_list = F.when(heiyo, F.col("seat_no") > F.col("__smd")).otherwise(F.lit(True))
    ranked = ranked.withColumn(
        "award_no",
        F.sum(F.when(is_list, 1).otherwise(0)).over(
            by_rank.rowsBetween(Window.unboundedPreceding, 0)
        ).cast("int"),
    ).withColumn("__list", is_list)
    # Truncation stops the ranking as soon as the list seats are used up.
    cut = heiyo & (F.col("__over") == TRUNCATE)
    reached = F.col("award_no") - F.when(F.col("__list"), 1).otherwise(0) >= F.col("__seats")
    ranked = ranked.where(~(cut & reached)).withColumn(
        "tie", F.max("__shared").over(Window.partitionBy(*contest))
    )
    own = F.when(heiyo, F.col("seat_no") - F.col("__smd")).otherwise(F.col("seat_no"))
    filled = F.lit(True) if capacity is None else own <= F.coalesce(F.col("__cap"), F.lit(0).cast("bigint"))
    return ranked.where("__list").select(
        *contest,
        "award_no",
        "party",
        "votes",
        F.col("seat_no").cast("int").alias("seat_no"),
        F.col("divisor").cast("bigint").alias("divisor"),
        filled.alias("filled"),
        "tie",
    )


def seat_counts(awards: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Filled seats, vacancies and all awards per key (keys usually contest + party)."""
    return awards.groupBy(*keys).agg(
        F.count_if("filled").alias("seats"),
        F.count_if(~F.col("filled")).alias("vacancies"),
        F.count(F.lit(1)).alias("awarded"),
    )


def quotient_table(
    df: DataFrame,
    contest: Sequence[str],
    awards: DataFrame,
    least_rows: int,
    *,
    party: str = "party",
    votes: str = "votes",
    method: str = DHONDT,
    first_tenths: int = 14,
) -> DataFrame:
    """Every quotient up to ``least_rows`` seats, or up to the most seats a party of the contest won.

    Quotients that won carry their award rank, so no award is left out.
    """
    most = awards.groupBy(*contest).agg(F.max("seat_no").alias("__most"))
    grid = join_null_safe(df, most, contest, "left").select(
        *contest,
        F.col(party).alias("party"),
        F.col(votes).cast("bigint").alias("votes"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.lit(least_rows), F.coalesce("__most", F.lit(0))))).alias("seat_no"),
    ).withColumn("divisor", divisor(method, F.col("seat_no"), first_tenths))
    keys = [*contest, "party", "seat_no"]
    return join_null_safe(
        grid, awards.select(*keys, F.col("award_no").alias("seat_rank")), keys, "left"
    )


def adams(
    df: DataFrame,
    contest: Sequence[str],
    *,
    unit: str = "unit",
    population: str = "population",
    seats: str = "seats",
    salts: int = 32,
) -> DataFrame:
    """Adams seats per unit: one each, the rest by population / seats already held.

    That is D'Hondt over the remaining seats, so the same job serves both. Fewer seats
    than units is an error. A unit whose share is only the first seat is kept.
    """
    contest = list(contest)
    units = df.groupBy(*contest).agg(F.count(F.lit(1)).alias("__units"))
    base = join_null_safe(df, units, contest, "inner").withColumn(
        "__rest",
        F.when(F.col(seats) >= F.col("__units"), F.col(seats) - F.col("__units")).otherwise(
            F.raise_error(F.lit("fewer seats than units"))
        ),
    )
    extra = apportion(
        base, contest, party=unit, votes=population, seats="__rest", salts=salts
    ).groupBy(*contest, F.col("party").alias(unit)).agg(F.count(F.lit(1)).alias("__extra"))
    return join_null_safe(base, extra, [*contest, unit], "left").select(
        *contest,
        unit,
        population,
        (F.lit(1) + F.coalesce(F.col("__extra"), F.lit(0)) + F.col("__rest") * 0).cast("bigint").alias("seats"),
    )
