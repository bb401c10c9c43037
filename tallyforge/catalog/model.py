"""An election derived from the shared tables.

Block = region, district = nation, party = market segment. District candidates are
the segments (votes: order value in cents); listed persons are customers (votes:
account balance in cents), two in three of whom also stand in their nation. A
nation's threshold base is ten times the mean vote of its standing customers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lists
from ..plans.simulate import Election
from ..plans.votes import geography, segment_cents
from ..session import cut_lineage
from ..sources.testdata import table

BLOCK_SEATS = 120


def one_election(present):
    """The single election as a column, not a constant, so that joins on it stay keyed."""
    return F.when(present, "e").alias("election")


def list_entries(spark, sf):
    cents = F.greatest(F.round(F.col("c_acctbal") * 100).cast("bigint"), F.lit(0))
    return table(spark, sf, "customer").join(
        geography(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        one_election(F.col("c_custkey") >= 0),
        F.col("region").alias("block"),
        F.col("nation").alias("district"),
        F.col("c_mktsegment").alias("party"),
        F.col("c_custkey").alias("ordinal"),
        F.col("c_name").alias("name"),
        F.col("c_name").alias("smd_name"),
        (F.col("c_custkey") % 5 + 1).alias("list_rank"),
        (F.col("c_custkey") % 3 != 0).alias("dual"),
        cents.alias("smd_votes"),
    )


def person_districts(entries):
    """Threshold base per nation."""
    return entries.where("dual").groupBy("election", "district").agg(
        (F.expr("sum(smd_votes) div count(1)") * 10).alias("valid_votes")
    )


def person_outcomes(entries):
    return lists.plurality(
        entries.where("dual"), ["election", "district"], name="name", party="party", votes="smd_votes"
    )


def election(spark, sf) -> Election:
    """District candidates are persons: the standing customers."""
    entries = list_entries(spark, sf)
    seg = segment_cents(spark, sf)
    list_votes = cut_lineage(seg.groupBy(
        one_election(F.col("votes") >= 0), F.col("region").alias("block"), F.col("segment").alias("party")
    ).agg(F.sum("votes").alias("votes")))
    blocks = list_votes.groupBy("election", "block").agg(F.sum("votes").alias("electors")).withColumn(
        "seats", F.lit(BLOCK_SEATS)
    )
    candidates = entries.where("dual").select(
        "election", "district", "block", "name", "party", F.col("smd_votes").alias("votes")
    )
    return Election(person_districts(entries), candidates, entries, list_votes, blocks)


#: Listed persons with their district outcome.
ENTRY_SQL = """e0 AS (
  SELECT r.r_name AS block, n.n_name AS district, c.c_mktsegment AS party, c.c_custkey AS ordinal,
         c.c_name AS name, c.c_custkey % 5 + 1 AS list_rank, c.c_custkey % 3 <> 0 AS dual,
         GREATEST(CAST(ROUND(c.c_acctbal * 100) AS BIGINT), 0) AS votes
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
dist AS (SELECT district, CAST((SUM(votes) // COUNT(*)) * 10 AS BIGINT) AS valid FROM e0 WHERE dual GROUP BY 1),
win AS (SELECT district, name AS winner, party AS winner_party, votes AS top FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY district ORDER BY votes DESC, name) AS rn FROM e0 WHERE dual) WHERE rn = 1),
rules(rule, num, den, floor) AS (VALUES ('current', 1, 10, CAST(NULL AS INTEGER)), ('strict', 1, 6, 50)),
e AS (
  SELECT rule, e0.*, dual AND name = winner AS won, winner, winner_party, top, valid,
    CASE WHEN dual AND votes > 0 AND top > 0 THEN votes * 100000 // top END AS rate_milli,
    NOT dual OR (name <> winner AND votes * den >= valid * num
      AND (floor IS NULL OR (votes > 0 AND top > 0 AND votes * 100 >= floor * top))) AS eligible
  FROM e0 JOIN dist USING (district) JOIN win USING (district), rules)"""
