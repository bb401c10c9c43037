"""Divisor methods, capacities, head starts, linkage, ties, Adams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import apportion as ap
from ..plans.simulate import contest_seats
from ..plans.votes import geography, regional_votes
from ..session import cut_lineage
from ..sources.testdata import table
from .base import CAP_SQL, V_SQL, query

SEATS = 40


def capacities(spark, sf):
    """Per nation: list capacity (customers mod 12)."""
    per_key = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return geography(spark, sf).join(per_key, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("nation").alias("party"), (F.coalesce("n", F.lit(0)) % 12).alias("capacity")
    )


def district_wins(spark, sf):
    """Per nation: district wins (suppliers)."""
    per_key = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return geography(spark, sf).join(per_key, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        F.col("nation").alias("party"), F.coalesce("n", F.lit(0)).alias("wins")
    )


def voted(spark, sf):
    """The vote table written once: a row per (region, nation) that several steps read,
    so that the lines are scanned a single time."""
    return cut_lineage(regional_votes(spark, sf))


def regional_lists(spark, sf, seats=SEATS):
    """Votes with capacity and district wins per (region, nation)."""
    return (
        voted(spark, sf)
        .join(capacities(spark, sf), "party")
        .join(district_wins(spark, sf), "party")
        .withColumn("seats", F.lit(seats))
    )


def seats_by_party(awards):
    return awards.groupBy("contest", "party").agg(F.count(F.lit(1)).alias("seats"))


def divisor_sql(method: str) -> str:
    return {"dhondt": "k", "sainteLague": "2 * k - 1",
            "modifiedSainteLague": "CASE WHEN k = 1 THEN 14 ELSE 10 * (2 * k - 1) END"}[method]


ORDER = "ORDER BY CAST(votes AS DOUBLE) / d DESC, votes DESC, party, k"


def rank_sql(method: str = "dhondt", seats: int = SEATS) -> str:
    return f"""q AS (SELECT contest, party, votes, k, {divisor_sql(method)} AS d
  FROM v, (SELECT UNNEST(range(1, {seats + 1})) AS k)),
a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY contest {ORDER}) AS rn FROM q)"""


def _plain(method):
    def run(spark, sf):
        votes = regional_votes(spark, sf).withColumn("seats", F.lit(SEATS))
        return seats_by_party(ap.apportion(votes, ["contest"], method=method))

    return run


for _name, _method in (
    ("apportion_dhondt", ap.DHONDT),
    ("apportion_sainte_lague", ap.SAINTE_LAGUE),
    ("apportion_modified", ap.MODIFIED),
):
    query(
        _name,
        f"WITH {V_SQL}, {rank_sql(_method)} SELECT contest, party, COUNT(*) AS seats FROM a "
        f"WHERE rn <= {SEATS} GROUP BY 1, 2",
    )(_plain(_method))


@query(
    "apportion_award_order",
    f"WITH {V_SQL}, {rank_sql()} SELECT contest, CAST(rn AS INTEGER) AS award_no, party, "
    f"CAST(k AS BIGINT) AS divisor FROM a WHERE rn <= {SEATS}",
)
def award_order(spark, sf):
    votes = regional_votes(spark, sf).withColumn("seats", F.lit(SEATS))
    return ap.apportion(votes, ["contest"]).select("contest", "award_no", "party", "divisor")


@query(
    "apportion_capacity_reallocate",
    f"""WITH {V_SQL}, {CAP_SQL},
q AS (SELECT contest, v.party, votes, k, k AS d FROM v JOIN cap USING (party),
      (SELECT UNNEST(range(1, {SEATS + 1})) AS k) WHERE k <= capacity),
a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY contest {ORDER}) AS rn FROM q)
SELECT contest, CAST(rn AS INTEGER) AS award_no, party FROM a WHERE rn <= {SEATS}""",
)
def capacity_reallocate(spark, sf):
    awards = ap.apportion(regional_lists(spark, sf), ["contest"], capacity="capacity")
    return awards.select("contest", "award_no", "party")


@query(
    "apportion_capacity_vacant",
    f"""WITH {V_SQL}, {CAP_SQL}, {rank_sql()}
SELECT contest, a.party, COUNT(*) FILTER (k <= capacity) AS seats,
       COUNT(*) FILTER (k > capacity) AS vacancies
FROM a JOIN cap USING (party) WHERE rn <= {SEATS} GROUP BY 1, 2""",
)
def capacity_vacant(spark, sf):
    awards = ap.apportion(
        regional_lists(spark, sf), ["contest"], capacity="capacity", exhaustion=ap.VACANT
    )
    return ap.seat_counts(awards, ["contest", "party"]).select("contest", "party", "seats", "vacancies")


@query(
    "apportion_head_start",
    f"""WITH {V_SQL}, {CAP_SQL},
q AS (SELECT contest, v.party, votes, k, wins + k AS d FROM v JOIN head USING (party),
      (SELECT UNNEST(range(1, {SEATS + 1})) AS k)),
a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY contest {ORDER}) AS rn FROM q)
SELECT contest, CAST(rn AS INTEGER) AS award_no, party, CAST(d AS BIGINT) AS divisor
FROM a WHERE rn <= {SEATS}""",
)
def head_start(spark, sf):
    awards = ap.apportion(
        regional_lists(spark, sf), ["contest"], linkage=ap.RENYO, district_wins="wins",
        exhaustion=ap.VACANT,
    )
    return awards.select("contest", "award_no", "party", "divisor")


def compensatory_sql(overhang: str) -> str:
    cut = f"WHERE award_no <= {SEATS}" if overhang == "truncate" else ""
    return f"""WITH {V_SQL}, {CAP_SQL},
w AS (SELECT v.*, wins, SUM(wins) OVER (PARTITION BY contest) + {SEATS} AS pool
      FROM v JOIN head USING (party)),
q AS (SELECT contest, party, votes, wins, pool, k, k AS d
      FROM (SELECT *, UNNEST(range(1, CAST(pool AS BIGINT) + 1)) AS k FROM w)),
a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY contest {ORDER}) AS rn FROM q),
l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY contest ORDER BY rn) AS award_no
      FROM a WHERE rn <= pool AND k > wins)
SELECT contest, party, COUNT(*) AS seats FROM l {cut} GROUP BY 1, 2"""


def _compensatory(overhang):
    def run(spark, sf):
        return seats_by_party(
            ap.apportion(
                regional_lists(spark, sf), ["contest"], linkage=ap.HEIYO, district_wins="wins",
                exhaustion=ap.VACANT, overhang=overhang,
            )
        )

    return run


for _over in (ap.TRUNCATE, ap.EXPAND):
    query(f"apportion_compensatory_{_over}", compensatory_sql(_over))(_compensatory(_over))


TIE_VOTES_SQL = f"""{V_SQL},
tv AS (SELECT contest, party, votes FROM v UNION ALL
       SELECT p_type, p_brand, COUNT(*) FROM part GROUP BY 1, 2)"""


@query(
    "apportion_tie_flag",
    f"""WITH {TIE_VOTES_SQL},
q AS (SELECT contest, party, votes, k, k AS d FROM tv, (SELECT UNNEST(range(1, 31)) AS k)),
a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY contest {ORDER}) AS rn,
             MIN(party) OVER (PARTITION BY contest, CAST(votes AS DOUBLE) / d)
          <> MAX(party) OVER (PARTITION BY contest, CAST(votes AS DOUBLE) / d) AS shared FROM q)
SELECT contest, BOOL_OR(shared) AS tie, COUNT(*) AS seats FROM a WHERE rn <= 30 GROUP BY 1""",
)
def tie_flag(spark, sf):
    brands = table(spark, sf, "part").groupBy(
        F.col("p_type").alias("contest"), F.col("p_brand").alias("party")
    ).agg(F.count(F.lit(1)).alias("votes"))
    votes = regional_votes(spark, sf).unionByName(brands).withColumn("seats", F.lit(30))
    return ap.apportion(votes, ["contest"]).groupBy("contest").agg(
        F.bool_or("tie").alias("tie"), F.count(F.lit(1)).alias("seats")
    )


ADAMS_SEATS = 131


@query(
    "adams_seats",
    f"""WITH p AS (SELECT n.n_name AS unit, COUNT(*) AS population
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1),
q AS (SELECT unit, population, k FROM p, (SELECT UNNEST(range(1, {ADAMS_SEATS + 1})) AS k)),
a AS (SELECT *, ROW_NUMBER() OVER (ORDER BY CAST(population AS DOUBLE) / k DESC, population DESC, unit) AS rn
      FROM q)
SELECT p.unit, p.population, 1 + COUNT(a.k) AS seats
FROM p LEFT JOIN a ON a.unit = p.unit AND a.rn <= {ADAMS_SEATS} - (SELECT COUNT(*) FROM p)
GROUP BY 1, 2""",
)
def adams_seats(spark, sf):
    per_key = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("population"))
    units = per_key.join(geography(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")).select(
        # A column rather than a constant, so that joins on the contest stay keyed.
        F.when(F.col("population") > 0, "all").alias("contest"), F.col("nation").alias("unit"), "population",
        F.lit(ADAMS_SEATS).alias("seats"),
    )
    return ap.adams(units, ["contest"]).drop("contest")


@query(
    "adams_contest_seats",
    f"""WITH {V_SQL}, t AS (SELECT contest AS unit, SUM(votes) AS electors FROM v GROUP BY 1),
q AS (SELECT unit, electors, k FROM t, (SELECT UNNEST(range(1, 200)) AS k)),
a AS (SELECT *, ROW_NUMBER() OVER (ORDER BY CAST(electors AS DOUBLE) / k DESC, electors DESC, unit) AS rn FROM q),
ds AS (SELECT UNNEST([0, -45]) AS delta)
SELECT delta, t.unit AS contest,
  CASE WHEN delta = 0 THEN {SEATS}
       ELSE 1 + (SELECT COUNT(*) FROM a WHERE a.unit = t.unit
                 AND rn <= {SEATS} * (SELECT COUNT(*) FROM t) + delta - (SELECT COUNT(*) FROM t)) END AS seats
FROM t, ds""",
)
def adams_contest_seats(spark, sf):
    electors = voted(spark, sf).groupBy("contest").agg(F.sum("votes").alias("electors"))
    rows = electors.select(
        F.explode(F.array(F.lit(0), F.lit(-45))).alias("delta"), "contest", "electors",
        F.lit(SEATS).alias("printed"),
    )
    return contest_seats(rows, ["delta"], "contest", "electors", "printed", "delta")


@query(
    "quotient_table",
    f"""WITH {V_SQL}, {rank_sql()}
SELECT contest, party, CAST(k AS INTEGER) AS seat_no, CAST(d AS BIGINT) AS divisor,
       votes // d AS quotient, CASE WHEN rn <= {SEATS} THEN CAST(rn AS INTEGER) END AS seat_rank
FROM a WHERE k <= greatest(20, (SELECT MAX(k) FROM a b WHERE b.contest = a.contest AND rn <= {SEATS}))""",
)
def quotients(spark, sf):
    votes = regional_votes(spark, sf).withColumn("seats", F.lit(SEATS))
    grid = ap.quotient_table(votes, ["contest"], ap.apportion(votes, ["contest"]), 20)
    return grid.select(
        "contest", "party", "seat_no", "divisor", F.expr("votes div divisor").alias("quotient"), "seat_rank"
    )
