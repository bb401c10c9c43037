"""Lookups, totals, shares, modes, samples, set operations, linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import full_kana, squash
from ..operators import aggregates as ag
from ..operators import linkage
from ..plans.votes import geography, segment_cents
from ..sources.testdata import table
from .base import SEG_SQL, query


@query(
    "lookup_inner",
    """SELECT p_brand, s_nationkey, COUNT(*) AS lines, CAST(SUM(l_quantity) AS BIGINT) AS qty
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
)
def lookup_inner(spark, sf):
    """Lines are summed per (part, supplier) first, so the joins see one row per pair."""
    lines = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("p_brand", "s_nationkey").agg(F.sum("lines").alias("lines"), F.sum("qty").alias("qty"))


@query(
    "lookup_left",
    """SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) c ON o_custkey = c_custkey""",
)
def lookup_left(spark, sf):
    some = table(spark, sf, "customer").where("c_custkey % 7 <> 0").select("c_custkey", "c_name")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(
        some, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


ORDER_SEG = """os AS (SELECT c_mktsegment AS segment, o_orderpriority AS priority, o_orderkey, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents,
  o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey)"""


def order_groups(spark, sf):
    """Orders summed per (segment, priority, status).

    They are summed per customer first, so a customer with very many orders meets the
    customer table as a few rows.
    """
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    keys = [F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")]
    per_customer = table(spark, sf, "orders").groupBy("o_custkey", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents"), F.max(cents).alias("largest"), F.min("o_orderkey").alias("first_order"))
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("segment", "priority", "status").agg(
        F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.max("largest").alias("largest"), F.min("first_order").alias("first_order"))


def open_orders():
    return F.sum(F.when(F.col("status") == "O", F.col("n")).otherwise(0))


@query(
    "grouped_totals",
    f"""WITH {ORDER_SEG} SELECT COALESCE(segment, '__TOTAL__') AS segment, COALESCE(priority, '__TOTAL__') AS priority,
  COUNT(*) AS orders, CAST(SUM(cents) AS BIGINT) AS cents, COUNT(*) FILTER (status = 'O') AS open_orders, MAX(cents) AS largest,
  COUNT(DISTINCT status) AS states FROM os GROUP BY ROLLUP (segment, priority)""",
)
def grouped_totals(spark, sf):
    return ag.totals_with_grand(
        order_groups(spark, sf), ["segment", "priority"],
        [F.sum("n").alias("orders"), F.sum("cents").alias("cents"), open_orders().alias("open_orders"),
         F.max("largest").alias("largest"), F.size(F.collect_set("status")).cast("bigint").alias("states")])


@query(
    "geo_rollup",
    f"""WITH {SEG_SQL} SELECT COALESCE(region, '__TOTAL__') AS region, COALESCE(nation, '__TOTAL__') AS nation,
  CAST(SUM(votes) AS BIGINT) AS votes FROM seg GROUP BY ROLLUP (region, nation)""",
)
def geo_rollup(spark, sf):
    return ag.totals_with_grand(segment_cents(spark, sf), ["region", "nation"], [F.sum("votes").alias("votes")])


@query(
    "share_of_total",
    f"""WITH {ORDER_SEG}, g AS (SELECT segment, priority, SUM(cents) AS c FROM os GROUP BY 1, 2)
SELECT segment, priority, CAST(FLOOR(c * 10000 / SUM(c) OVER (PARTITION BY segment)) AS BIGINT) AS share_bp FROM g""",
)
def share_of_total(spark, sf):
    grouped = order_groups(spark, sf).groupBy("segment", "priority").agg(F.sum("cents").alias("c"))
    return ag.share_of(grouped, ["segment"], "c").select(
        "segment", "priority", F.floor(F.col("share_pct") * 100).cast("bigint").alias("share_bp"))


@query(
    "mode_first_seen",
    f"""WITH {ORDER_SEG}, g AS (SELECT segment, priority, COUNT(*) AS n, MIN(o_orderkey) AS f FROM os GROUP BY 1, 2)
SELECT segment, priority, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY n DESC, f) AS rn FROM g) WHERE rn = 1""",
)
def mode_first_seen(spark, sf):
    return ag.mode_first_seen(order_groups(spark, sf), ["segment"], "priority", "first_order", F.col("n"))


@query(
    "mean_by_column",
    f"""WITH {ORDER_SEG} SELECT priority, CAST(SUM(cents) // COUNT(*) AS BIGINT) AS mean_cents, CAST(ROUND(AVG(CASE WHEN status = 'O' THEN 100 ELSE 0 END)) AS BIGINT) AS open_pct
FROM os GROUP BY 1""",
)
def mean_by_column(spark, sf):
    return order_groups(spark, sf).groupBy("priority").agg(
        F.expr("sum(cents) div sum(n)").alias("mean_cents"),
        F.round(open_orders() * 100 / F.sum("n")).cast("bigint").alias("open_pct"))


@query(
    "top_party",
    f"""WITH {SEG_SQL} SELECT nation, segment, votes FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY nation ORDER BY votes DESC, segment) AS rn FROM seg) WHERE rn = 1""",
)
def top_party(spark, sf):
    return ag.argmax(segment_cents(spark, sf), ["nation"], "segment", "votes")


@query(
    "union_tables",
    """SELECT nationkey, kind, COUNT(*) AS n FROM (SELECT c_nationkey AS nationkey, 'customer' AS kind FROM customer
  UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY 1, 2""",
)
def union_tables(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("kind"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nationkey"))
    return c.unionByName(s).groupBy("nationkey", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "key_difference",
    """SELECT COALESCE(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side
FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 11 <> 0) b ON a.k = b.k""",
)
def key_difference(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("k"))
    return ag.key_difference(a, b, ["k"])


@query(
    "contest_filter",
    """WITH u AS (SELECT user_id, COUNT(*) FILTER (event_type = 'click') AS clicks, COUNT(*) FILTER (event_type = 'view') AS views FROM events GROUP BY 1),
s AS (SELECT *, CASE WHEN clicks > views THEN 'flipped' WHEN clicks = views THEN 'contested' ELSE 'kept' END AS state FROM u)
SELECT user_id, state FROM s WHERE state <> 'kept' AND contains(CAST(user_id AS VARCHAR), '1')""",
)
def contest_filter(spark, sf):
    """Name contains a text and the state is one of those asked for."""
    per_user = table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views"))
    state = F.when(F.col("clicks") > F.col("views"), "flipped").when(F.col("clicks") == F.col("views"), "contested").otherwise("kept")
    return per_user.select("user_id", state.alias("state")).where(
        F.col("state").isin("flipped", "contested") & F.col("user_id").cast("string").contains("1"))


@query(
    "seeded_sample",
    """SELECT nation, c_custkey, CAST(rn AS INTEGER) AS sample_no FROM (SELECT n_name AS nation, c_custkey,
  ROW_NUMBER() OVER (PARTITION BY n_name ORDER BY md5('20260208' || c_custkey), c_custkey) AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE rn <= 5""",
)
def seeded_sample(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(
        geography(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    return ag.seeded_sample(rows, ["nation"], "c_custkey", 5, "20260208").select("nation", "c_custkey", "sample_no")


def roster_pair(spark, sf):
    """Customers and a second list of them with other spellings.

    Every third name has small kana and spaces, some are replaced by a legal name known
    on the left, a few by a name found nowhere, and some entries are absent.
    """
    k = F.col("c_custkey")
    left = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("left_id"), F.col("c_mktsegment").alias("party"), F.col("c_nationkey").alias("nation"),
        F.concat(F.lit("キャ"), F.substring("c_name", 10, 9)).alias("shown"),
        F.when(k % 4 == 1, F.concat(F.lit("Legal"), k.cast("string"))).alias("legal"),
        F.floor("c_acctbal").cast("bigint").alias("amount"))
    shown = F.concat(F.lit("キャ"), F.substring("c_name", 10, 9))
    name = (
        F.when(k % 4 == 1, F.concat(F.lit("Legal"), k.cast("string")))
        .when(k % 251 == 2, F.concat(F.lit("?"), k.cast("string")))
        .when(k % 3 == 0, F.concat(F.lit("キヤ　"), F.substring("c_name", 10, 9)))
        .otherwise(shown))
    right = table(spark, sf, "customer").where("c_custkey % 50 <> 7").select(
        (F.col("c_custkey") + 1_000_000_000).alias("right_id"), F.col("c_mktsegment").alias("party"),
        F.col("c_nationkey").alias("nation"), name.alias("name"),
        (F.floor("c_acctbal").cast("bigint") + F.when(k % 90 == 1, 1).otherwise(0)).alias("amount"))
    return left, right


def linked(spark, sf):
    left, right = roster_pair(spark, sf)

    def key(c):
        return full_kana(squash(F.col(c)))

    return left, right, linkage.link(
        left, right, "left_id", "right_id",
        [([F.col("party"), key("shown")], [F.col("party"), key("name")]),
         ([F.col("party"), key("legal")], [F.col("party"), key("name")])],
        ([F.col("nation"), F.col("party")], [F.col("nation"), F.col("party")]))


LINK_SQL = """l AS (SELECT c_custkey AS lid, c_mktsegment AS party, c_nationkey AS nation, CAST(FLOOR(c_acctbal) AS BIGINT) AS amount,
   c_custkey % 4 = 1 AS has_legal, c_custkey % 251 = 2 AS lost, c_custkey % 50 = 7 AS absent FROM customer),
p12 AS (SELECT lid, lid + 1000000000 AS rid, CASE WHEN has_legal THEN 2 ELSE 1 END AS pass_no FROM l WHERE NOT absent AND (has_legal OR NOT lost)),
lr AS (SELECT * FROM l WHERE lid NOT IN (SELECT lid FROM p12)), rr AS (SELECT * FROM lr WHERE NOT absent),
p3 AS (SELECT a.lid, b.rid, 3 AS pass_no FROM (SELECT nation, party, MIN(lid) AS lid FROM lr GROUP BY 1, 2 HAVING COUNT(*) = 1) a
   JOIN (SELECT nation, party, MIN(lid) + 1000000000 AS rid FROM rr GROUP BY 1, 2 HAVING COUNT(*) = 1) b USING (nation, party)),
p AS (SELECT * FROM p12 UNION ALL SELECT * FROM p3)"""


@query(
    "link_multi_pass",
    f"""WITH {LINK_SQL} SELECT lid AS left_id, rid AS right_id, CAST(pass_no AS INTEGER) AS pass_no FROM p
UNION ALL SELECT lid, NULL, NULL FROM lr WHERE lid NOT IN (SELECT lid FROM p3)
UNION ALL SELECT NULL, lid + 1000000000, NULL FROM rr WHERE lid + 1000000000 NOT IN (SELECT rid FROM p3)""",
)
def link_multi_pass(spark, sf):
    """Pairs with the pass that found them, and what is left on either side."""
    _, _, found = linked(spark, sf)
    none_int, none_long = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    return found.pairs.select("left_id", "right_id", "pass_no").unionByName(
        found.left_rest.select("left_id", none_long.alias("right_id"), none_int.alias("pass_no"))
    ).unionByName(found.right_rest.select(none_long.alias("left_id"), "right_id", none_int.alias("pass_no")))


@query(
    "link_disagreements",
    f"""WITH {LINK_SQL}, v AS (SELECT p.lid, p.rid, l.amount AS a, r.amount + CASE WHEN r.lid % 90 = 1 THEN 1 ELSE 0 END AS b
  FROM p JOIN l ON l.lid = p.lid JOIN l r ON r.lid + 1000000000 = p.rid)
SELECT lid AS left_id, rid AS right_id, 'amount' AS attribute, CAST(a AS VARCHAR) AS left_value, CAST(b AS VARCHAR) AS right_value FROM v WHERE a <> b""",
)
def link_disagreements(spark, sf):
    left, right, found = linked(spark, sf)
    return linkage.disagreements(
        found.pairs, left, right, "left_id", "right_id",
        [(F.col("amount"), F.col("amount"), "amount"), (F.col("party"), F.col("party"), "party")]).drop("pass_no")
