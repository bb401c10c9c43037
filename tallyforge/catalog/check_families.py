"""One query per family of checks, over published figures with a few deliberate faults each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lists
from ..plans import quality as q
from ..plans.votes import segment_cents
from ..sources.testdata import table
from .base import SEG_SQL, query


def lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("qty", F.col("l_quantity").cast("bigint"))


@query(
    "check_rates",
    """WITH s AS (SELECT l_suppkey AS k, SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS part,
  SUM(CAST(l_quantity AS BIGINT)) AS total FROM lineitem GROUP BY 1),
r AS (SELECT k, CAST(part * 10000 // total AS BIGINT) AS rate FROM s)
SELECT k, rate + CASE WHEN k % 19 = 4 THEN 2 WHEN k % 19 = 5 THEN 1 ELSE 0 END AS printed, rate AS recomputed, k % 19 <> 4 AS ok FROM r""",
)
def check_rates(spark, sf):
    """Printed rates against recomputed ones, one unit of the last place apart at most."""
    sums = lines(spark, sf).groupBy(F.col("l_suppkey").alias("k")).agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("qty")).otherwise(0)).alias("part"), F.sum("qty").alias("total"))
    rate = F.expr("part * 10000 div total")
    off = F.when(F.col("k") % 19 == 4, 2).when(F.col("k") % 19 == 5, 1).otherwise(0)
    rows = sums.select("k", (rate + off).alias("printed"), rate.alias("recomputed"))
    return rows.withColumn("ok", q.close(F.col("printed"), F.col("recomputed"), 1))


@query(
    "check_printed_difference",
    """WITH s AS (SELECT l_suppkey AS k, SUM(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS now,
  SUM(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS before FROM lineitem GROUP BY 1)
SELECT CAST(k AS VARCHAR) AS subject, CAST(now - before + 1 AS VARCHAR) AS detail FROM s WHERE k % 23 = 1""",
)
def check_printed_difference(spark, sf):
    """Current less previous must be the printed difference."""
    sums = lines(spark, sf).groupBy(F.col("l_suppkey").alias("k")).agg(*[
        F.sum(F.when(F.col("l_linestatus") == s, F.col("qty")).otherwise(0)).alias(n) for s, n in (("F", "now"), ("O", "before"))])
    rows = sums.withColumn("printed", F.col("now") - F.col("before") + F.when(F.col("k") % 23 == 1, 1).otherwise(0))
    return q.row_check("A5", "A", "differences", rows, F.col("k"), F.col("now") - F.col("before") == F.col("printed"), F.col("printed")).violations


@query(
    "check_blank_subtotals",
    """WITH s AS (SELECT l_suppkey AS k, l_linenumber AS n, SUM(CASE WHEN l_quantity > 45 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS v FROM lineitem GROUP BY 1, 2)
SELECT k, n, CAST(v AS BIGINT) AS computed, CASE WHEN v > 0 AND k % 11 <> 2 THEN CAST(v AS BIGINT) END AS published, v = 0 OR k % 11 <> 2 AS ok FROM s""",
)
def check_blank_subtotals(spark, sf):
    """A blank subtotal stands for zero and for nothing else."""
    sums = lines(spark, sf).groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("n")).agg(
        F.sum(F.when(F.col("l_quantity") > 45, F.col("qty")).otherwise(0)).alias("value"))
    printed = sums.select("k", "n", F.when((F.col("value") > 0) & (F.col("k") % 11 != 2), F.col("value")).alias("value"))
    return q.reconcile(sums, printed, ["k", "n"], policy=q.PRINTED)


@query(
    "check_winner_is_maximum",
    f"""WITH {SEG_SQL}, w AS (SELECT nation, MAX(votes) AS top, MIN(votes) AS low FROM seg GROUP BY 1)
SELECT nation AS subject, CAST(low AS VARCHAR) AS detail FROM w WHERE nation LIKE '%7' AND low < top""",
)
def check_winner_is_maximum(spark, sf):
    """The marked winner has the most votes; where the nation's name ends in 7, the last one is marked."""
    seg = segment_cents(spark, sf)
    first = lists.plurality(seg, ["nation"], name="segment", party="segment").select("nation", F.col("winner_votes").alias("top"))
    last = seg.groupBy("nation").agg(F.min("votes").alias("low"))
    marked = first.join(last, "nation").withColumn("votes", F.when(F.col("nation").endswith("7"), F.col("low")).otherwise(F.col("top")))
    return q.row_check("B2", "B", "winner", marked, F.col("nation"), F.col("votes") == F.col("top"), F.col("votes")).violations


@query(
    "check_mark_if_and_only_if",
    """SELECT CAST(o_orderkey AS VARCHAR) AS subject, CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 'x' END AS detail FROM orders WHERE o_orderkey % 97 = 5""",
)
def check_mark_if_and_only_if(spark, sf):
    """A mark stands where its reason holds and nowhere else."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    rows = table(spark, sf, "orders").select("o_orderkey", urgent.alias("reason"), F.when(urgent != (F.col("o_orderkey") % 97 == 5), "x").otherwise("").alias("mark"))
    return q.row_check("B4", "B", "mark", rows, F.col("o_orderkey"), (F.col("mark") == "x") == F.col("reason"), F.col("mark")).violations


@query(
    "check_shortfall",
    f"""WITH {SEG_SQL}, s AS (SELECT nation, CAST(SUM(votes) AS BIGINT) AS cents FROM seg GROUP BY 1)
SELECT nation, cents, (cents + 99) // 100 + CASE WHEN nation LIKE '%3' THEN 1 ELSE 0 END AS whole, nation NOT LIKE '%3' AS ok FROM s""",
)
def check_shortfall(spark, sf):
    """A total printed without fractions exceeds the sum by less than one."""
    cents = segment_cents(spark, sf).groupBy("nation").agg(F.sum("votes").alias("cents"))
    sums = cents.select("nation", (F.col("cents").cast("decimal(20,0)") / 100).cast("decimal(20,2)").alias("value"))
    whole = F.expr("(cents + 99) div 100") + F.when(F.col("nation").endswith("3"), 1).otherwise(0)
    printed = cents.select("nation", whole.cast("decimal(20,2)").alias("value"))
    return q.reconcile(sums, printed, ["nation"], shortfall=True).select(
        "nation", (F.col("computed") * 100).cast("bigint").alias("cents"), F.col("published").cast("bigint").alias("whole"), "ok")


@query(
    "check_left_side",
    """WITH c AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT k, n AS computed, CASE WHEN k % 7 = 3 THEN NULL WHEN k % 7 = 4 THEN n + 1 ELSE n END AS published, k % 7 NOT IN (3, 4) AS ok FROM c""",
)
def check_left_side(spark, sf):
    """Only keys of the computed side are asked for; what is published beside them does not count."""
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("value"))
    given = counts.where("k % 7 <> 3").select("k", (F.col("value") + F.when(F.col("k") % 7 == 4, 1).otherwise(0)).alias("value"))
    beside = counts.select((-F.col("k") - 1).alias("k"), "value")
    return q.reconcile(counts, given.unionByName(beside), ["k"], how="left")


@query(
    "check_configured_totals",
    """WITH c AS (SELECT l_returnflag AS k, COUNT(*) AS n FROM lineitem GROUP BY 1)
SELECT k, n, n >= CASE k WHEN 'A' THEN 1 WHEN 'N' THEN 0 ELSE 1000000000000 END AS ok FROM c""",
)
def check_configured_totals(spark, sf):
    """Totals against a configuration: the least number of lines per flag; what is asked of R is out of reach."""
    least = F.when(F.col("k") == "A", 1).when(F.col("k") == "N", 0).otherwise(1_000_000_000_000)
    rows = lines(spark, sf).groupBy(F.col("l_returnflag").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("k", "n", (F.col("n") >= least).alias("ok"))


@query(
    "check_expected_totals",
    """WITH c AS (
  SELECT 'orders' AS measure, NULLIF(l_orderkey % 10, 9) AS block, COUNT(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 'parts', NULLIF(l_partkey % 10, 9), COUNT(DISTINCT l_partkey) FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 'suppliers', NULLIF(l_suppkey % 10, 9), COUNT(DISTINCT l_suppkey) FROM lineitem GROUP BY 1, 2),
e AS (
  SELECT 'orders' AS measure, NULLIF(o_orderkey % 10, 9) AS block, COUNT(*) + MAX(CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END) AS n
  FROM orders GROUP BY 1, 2
  UNION ALL SELECT 'parts', NULLIF(p_partkey % 10, 9), COUNT(*) FROM part WHERE p_partkey % 10 <> 5 GROUP BY 1, 2
  UNION ALL SELECT 'suppliers', NULLIF(s_suppkey % 10, 9), COUNT(*) FROM supplier WHERE s_suppkey % 10 <> 4 GROUP BY 1, 2
  UNION ALL SELECT 'regions', NULL, COUNT(*) FROM region)
SELECT COALESCE(c.measure, e.measure) AS measure, COALESCE(c.block, e.block) AS block, c.n AS computed, e.n AS expected,
  e.measure IS NOT NULL AS asked, CASE WHEN e.measure IS NULL THEN c.measure = 'suppliers' ELSE c.n IS NOT DISTINCT FROM e.n END AS ok
FROM c FULL JOIN e ON c.measure = e.measure AND c.block IS NOT DISTINCT FROM e.block""",
)
def check_expected_totals(spark, sf):
    """Orders, parts and suppliers met in the lines, per block, against what their own tables say.

    Block 9 is null. Faults: one order too many is expected in block 3, the parts of block 5 are not
    expected and regions are not in the lines. What is not expected of suppliers (block 4) is optional.
    """

    def per_block(measure, df, key, n):
        return df.groupBy(F.expr(f"nullif({key} % 10, 9)").alias("block")).agg(n.alias("value")).select(F.lit(measure).alias("measure"), "block", "value")

    def own(measure, name, key, leave=-1):
        return per_block(measure, table(spark, sf, name).where(F.col(key) % 10 != leave), key, F.count(F.lit(1)))

    met = table(spark, sf, "lineitem")
    computed = [per_block(m, met, k, F.count_distinct(k)) for m, k in (("orders", "l_orderkey"), ("parts", "l_partkey"), ("suppliers", "l_suppkey"))]
    orders = own("orders", "orders", "o_orderkey").withColumn("value", F.expr("value + if(block <=> 3, 1, 0)"))
    regions = table(spark, sf, "region").agg(F.count(F.lit(1)).alias("value")).selectExpr("'regions' AS measure", "CAST(NULL AS bigint) AS block", "value")
    expected = [orders, own("parts", "part", "p_partkey", 5), own("suppliers", "supplier", "s_suppkey", 4), regions]
    return q.expected_totals(reduce(DataFrame.unionByName, computed), reduce(DataFrame.unionByName, expected), ["measure", "block"],
                             optional=F.col("measure") == "suppliers")


@query(
    "check_filled_where_given",
    """SELECT CAST(event_id AS VARCHAR) AS subject, event_type AS detail FROM events WHERE event_id % 101 = 7""",
)
def check_filled_where_given(spark, sf):
    """A purchase has an amount and nothing else has one; the rows at 7 of 101 are the other way round."""
    given = F.col("event_type") == "purchase"
    rows = table(spark, sf, "events").select(
        "event_id", "event_type", F.when(given != (F.col("event_id") % 101 == 7), F.abs("value") + 1).alias("amount"))
    ok = F.col("amount").isNotNull() == given
    return q.row_check("E5", "E", "amount", rows, F.col("event_id"), ok, F.col("event_type")).violations
