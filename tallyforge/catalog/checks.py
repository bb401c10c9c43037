"""Reconciliation checks over totals published with a few deliberate faults.

The published side is the tables' own grouped totals; one supplier (or order) in
a fixed number carries a fault, and some of the faults are registered as known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import quality as q
from ..plans.simulate import simulate
from ..plans import scenarios
from ..session import cut_lineage
from ..sources.testdata import SCHEMAS, table
from .base import query
from .elections import FILL_SQL, RULES
from .model import election


def qty():
    return F.col("l_quantity").cast("bigint")


def supplier_totals(spark, sf):
    """Per supplier: quantity by return flag, total with a fault at key 3 of 17."""
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        *[F.sum(F.when(F.col("l_returnflag") == f, qty()).otherwise(0)).alias(f"qty_{f.lower()}") for f in "ANR"],
        F.sum(qty()).alias("qty"),
    )
    faulty = sums.withColumn("total", F.col("qty") + F.when(F.col("l_suppkey") % 17 == 3, 1).otherwise(0)).drop("qty")
    # One row per supplier, read for the subjects and again for the violations.
    return cut_lineage(faulty)


SUPPLIER_SQL = """st AS (
  SELECT l_suppkey, SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS qty_a,
    SUM(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS qty_n,
    SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS qty_r,
    SUM(CAST(l_quantity AS BIGINT)) + CASE WHEN l_suppkey % 17 = 3 THEN 1 ELSE 0 END AS total
  FROM lineitem GROUP BY l_suppkey)"""


def identity_check(spark, sf):
    return q.row_check(
        "A1", "A", "parts add up to the total", supplier_totals(spark, sf), F.col("l_suppkey"),
        F.col("qty_a") + F.col("qty_n") + F.col("qty_r") == F.col("total"), F.col("total"),
    )


@query(
    "check_identity",
    f"""WITH {SUPPLIER_SQL} SELECT CAST(l_suppkey AS VARCHAR) AS subject, CAST(total AS VARCHAR) AS detail
FROM st WHERE qty_a + qty_n + qty_r <> total""",
)
def check_identity(spark, sf):
    return identity_check(spark, sf).violations


FLAG_SQL = """ft AS (SELECT l_returnflag, l_linestatus, SUM(CAST(l_quantity AS BIGINT)) AS qty FROM lineitem GROUP BY 1, 2),
pt AS (SELECT l_returnflag, SUM(qty) + CASE WHEN l_returnflag = 'N' THEN 2 ELSE 0 END AS total, COUNT(*) AS members FROM ft GROUP BY 1)"""


def total_row_pairs(spark, sf):
    members = cut_lineage(
        table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(qty()).alias("qty"))
    )
    printed = members.groupBy("l_returnflag").agg(
        (F.sum("qty") + F.when(F.col("l_returnflag") == "N", 2).otherwise(0)).alias("value")
    )
    sums = members.groupBy("l_returnflag").agg(F.sum("qty").alias("value"))
    return q.reconcile(sums, printed, ["l_returnflag"])


@query(
    "check_total_row",
    f"""WITH {FLAG_SQL} SELECT pt.l_returnflag, CAST(SUM(qty) AS BIGINT) AS computed,
  CAST(total AS BIGINT) AS published, SUM(qty) = total AS ok FROM pt JOIN ft USING (l_returnflag) GROUP BY 1, total""",
)
def check_total_row(spark, sf):
    return total_row_pairs(spark, sf)


@query(
    "check_tolerance",
    """WITH s AS (SELECT l_suppkey, SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS cents,
    BOOL_OR(CAST(ROUND(l_extendedprice * 100) AS BIGINT) % 100 <> 0) AS has_fraction FROM lineitem GROUP BY 1),
p AS (SELECT *, CASE WHEN l_suppkey % 5 = 0 THEN cents WHEN l_suppkey % 11 = 4 THEN cents + 150
        ELSE ((cents + 99) // 100) * 100 END AS published FROM s)
SELECT l_suppkey, CAST(published - cents AS BIGINT) AS diff_cents,
  CASE WHEN published = cents THEN 'exact' WHEN has_fraction AND published - cents > 0 AND published - cents < 100 THEN 'approx'
       ELSE 'bad' END AS class FROM p""",
)
def check_tolerance(spark, sf):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sum(cents).alias("cents"), F.bool_or(cents % 100 != 0).alias("has_fraction")
    ).withColumn(
        "published",
        F.when(F.col("l_suppkey") % 5 == 0, F.col("cents"))
        .when(F.col("l_suppkey") % 11 == 4, F.col("cents") + 150)
        .otherwise(F.expr("((cents + 99) div 100) * 100")),
    ).withColumn("diff_cents", F.col("published") - F.col("cents"))
    d = F.col("diff_cents")
    kind = F.when(d == 0, "exact").when(F.col("has_fraction") & (d > 0) & (d < 100), "approx").otherwise("bad")
    return sums.select("l_suppkey", "diff_cents", kind.alias("class"))


COUNTS_SQL = """lc AS (SELECT l_orderkey AS k, COUNT(*) AS n FROM lineitem GROUP BY 1),
pc AS (SELECT o.o_orderkey AS k, COALESCE(lc.n, 0) + CASE WHEN o.o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS n
       FROM orders o LEFT JOIN lc ON lc.k = o.o_orderkey WHERE o.o_orderkey % 101 <> 0)"""


def published_counts(spark, sf, lines):
    """Lines per order as published: orders at 0 of 101 are left out, those at 0 of 97 are one too many."""
    orders = table(spark, sf, "orders").where("o_orderkey % 101 <> 0").select(F.col("o_orderkey").alias("k"))
    return orders.join(lines, "k", "left").select(
        "k", (F.coalesce("value", F.lit(0)) + F.when(F.col("k") % 97 == 0, 1).otherwise(0)).alias("value")
    )


def line_counts(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("value"))
    return lines, published_counts(spark, sf, lines)


def _policy_sql(policy):
    test = {
        "strict": "lc.n IS NOT DISTINCT FROM pc.n",
        "null_is_zero": "COALESCE(lc.n, 0) = COALESCE(pc.n, 0)",
        "printed": "CASE WHEN pc.n IS NULL THEN COALESCE(lc.n, 0) = 0 ELSE COALESCE(lc.n = pc.n, FALSE) END",
    }[policy]
    return f"""SELECT '{policy}' AS policy, COALESCE(lc.k, pc.k) AS k, lc.n AS computed, pc.n AS published
FROM lc FULL JOIN pc ON lc.k = pc.k WHERE NOT ({test})"""


@query(
    "reconcile_full_outer",
    f"WITH {COUNTS_SQL} " + " UNION ALL ".join(_policy_sql(p) for p in ("strict", "null_is_zero", "printed")),
)
def reconcile_full_outer(spark, sf):
    lines, published = line_counts(spark, sf)
    out = None
    for policy in (q.STRICT, q.NULL_IS_ZERO, q.PRINTED):
        part = q.reconcile(lines, published, ["k"], policy=policy).where("NOT ok").select(
            F.lit(policy).alias("policy"), "k", "computed", "published"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "check_contiguity",
    """SELECT l_orderkey, COUNT(*) AS n, MIN(l_linenumber) = 1 AND MAX(l_linenumber) = COUNT(*)
  AND COUNT(DISTINCT l_linenumber) = COUNT(*) AS ok FROM lineitem GROUP BY 1""",
)
def check_contiguity(spark, sf):
    return q.contiguous(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber").select("l_orderkey", "n", "ok")


@query(
    "check_ascending",
    """SELECT o_custkey, MIN(d) AS low, COUNT(*) FILTER (d < p) AS falls FROM (
  SELECT o_custkey, CAST(YEAR(o_orderdate) AS INTEGER) AS d,
    LAG(CAST(YEAR(o_orderdate) AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
GROUP BY 1""",
)
def check_ascending(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("d"))
    return q.ascending(rows, ["o_custkey"], "d", "o_orderkey").select(
        "o_custkey", "low", "falls"
    )


@query(
    "check_domain",
    """SELECT 'lineitem' AS subject, l_returnflag AS value, COUNT(*) AS n FROM lineitem
WHERE l_returnflag NOT IN ('A', 'N') GROUP BY 2
UNION ALL SELECT 'orders', o_orderpriority, COUNT(*) FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 2""",
)
def check_domain(spark, sf):
    known = spark.createDataFrame(
        [("lineitem", v) for v in "AN"] + [("orders", v) for v in ("1-URGENT", "2-HIGH", "3-MEDIUM")],
        "subject string, value string",
    )

    def used(name, col):
        return table(spark, sf, name).groupBy(F.lit(name).alias("subject"), F.col(col).alias("value")).agg(
            F.count(F.lit(1)).alias("n")
        )

    values = used("lineitem", "l_returnflag").unionByName(used("orders", "o_orderpriority"))
    return values.join(known, ["subject", "value"], "left_anti")


@query(
    "check_schema",
    """WITH found AS (SELECT column_name FROM (DESCRIBE customer)),
want(column_name) AS (VALUES ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_mktsegment'), ('c_phone'))
SELECT 'customer' AS table_name, side, column_name, (SELECT COUNT(*) FROM customer) AS n FROM (
  SELECT 'extra' AS side, column_name FROM found WHERE column_name NOT IN (SELECT column_name FROM want)
  UNION ALL SELECT 'missing', column_name FROM want WHERE column_name NOT IN (SELECT column_name FROM found))""",
)
def check_schema(spark, sf):
    customer = table(spark, sf, "customer")
    expected = [c.split()[0] for c in SCHEMAS["customer"].split(", ") if "acctbal" not in c] + ["c_phone"]
    extra, missing = q.schema_difference(customer, expected)
    rows = F.array(*[
        F.struct(F.lit("customer").alias("table_name"), F.lit(side).alias("side"), F.lit(c).alias("column_name"))
        for side, cols in (("extra", extra), ("missing", missing)) for c in cols
    ])
    return customer.agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(rows).alias("r")).select("r.*", "n")


GRADED_SQL = f"""WITH {SUPPLIER_SQL}, {FLAG_SQL}, {COUNTS_SQL},
bad AS (SELECT 'A1' AS check_id, CAST(l_suppkey AS VARCHAR) AS subject, l_suppkey % 2 = 1 AS known FROM st
   WHERE qty_a + qty_n + qty_r <> total
 UNION ALL SELECT 'A6', l_returnflag, l_returnflag = 'N' FROM pt WHERE total <> (SELECT SUM(qty) FROM ft WHERE ft.l_returnflag = pt.l_returnflag)
 UNION ALL SELECT 'C1', CAST(COALESCE(lc.k, pc.k) AS VARCHAR), FALSE FROM lc FULL JOIN pc ON lc.k = pc.k WHERE COALESCE(lc.n, 0) <> COALESCE(pc.n, 0)),
subj AS (SELECT 'A1' AS check_id, COUNT(*) AS n FROM st UNION ALL SELECT 'A6', COUNT(*) FROM pt
 UNION ALL SELECT 'C1', COUNT(*) FROM (SELECT k FROM lc UNION SELECT k FROM pc)
 UNION ALL SELECT 'E1', COUNT(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)),
g AS (SELECT check_id, COUNT(*) FILTER (NOT known) AS fail_count, COUNT(*) FILTER (known) AS known_count FROM bad GROUP BY 1),
s AS (SELECT check_id, STRING_AGG(subject, '; ' ORDER BY rn) AS samples FROM (
   SELECT *, ROW_NUMBER() OVER (PARTITION BY check_id ORDER BY subject) AS rn FROM bad WHERE NOT known) WHERE rn <= 8 GROUP BY 1)
SELECT check_id, CASE WHEN COALESCE(fail_count, 0) > 0 THEN 'FAIL' WHEN COALESCE(known_count, 0) > 0 THEN 'WARN' ELSE 'PASS' END AS status,
  n AS subject_count, COALESCE(fail_count, 0) AS fail_count, COALESCE(known_count, 0) AS known_count, COALESCE(samples, '') AS samples
FROM subj LEFT JOIN g USING (check_id) LEFT JOIN s USING (check_id)"""


def lineitem_totals(spark, sf):
    """Totals of suppliers, of flag and status groups and of orders from one scan, written once.

    Partial sums of the three groupings share a shuffle; ``level`` tells them apart.
    """
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_orderkey", qty().alias("qty"))
    level = F.grouping_id().cast("int")
    sets = [[F.col("l_suppkey")], [F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_orderkey")]]
    parts = [F.sum(F.when(F.col("flag") == f, F.col("qty")).otherwise(0)).alias(f"qty_{f.lower()}") for f in "ANR"]
    keys = ["l_suppkey", "l_returnflag", "l_linestatus", "l_orderkey"]
    return cut_lineage(lines.withColumn("flag", F.col("l_returnflag")).groupingSets(sets, *keys).agg(
        level.alias("level"), F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), *parts))


@query("graded_report", GRADED_SQL)
def graded_report(spark, sf):
    """A failing check, one whose only fault is registered, and a clean one; lineitem is read once."""
    totals = lineitem_totals(spark, sf)
    # Bits of absent keys: suppkey 8, returnflag 4, linestatus 2, orderkey 1.
    suppliers, members, lines = (totals.where(F.col("level") == x) for x in (7, 9, 14))
    total = F.col("qty") + F.when(F.col("l_suppkey") % 17 == 3, 1).otherwise(0)
    parts = F.col("qty_a") + F.col("qty_n") + F.col("qty_r")
    flags = members.groupBy("l_returnflag").agg(F.sum("qty").alias("sums"), (
        F.sum("qty") + F.when(F.col("l_returnflag") == "N", 2).otherwise(0)).alias("printed"))
    counted = lines.select(F.col("l_orderkey").alias("k"), F.col("n").alias("value"))
    counts = q.reconcile(counted, published_counts(spark, sf, counted), ["k"], policy=q.NULL_IS_ZERO)
    empty = F.lit("")
    checks = [
        q.row_check("A1", "A", "parts add up to the total", suppliers, F.col("l_suppkey"), parts == total, total),
        q.row_check("A6", "A", "members add up to the total row", flags, F.col("l_returnflag"), F.col("sums") == F.col("printed"), empty),
        q.row_check("C1", "C", "line counts agree", counts, F.col("k"), F.col("ok"), empty),
        q.row_check("E1", "E", "groups are filled", members, F.col("l_returnflag"), F.col("n") > 0, F.col("n")),
    ]
    keys = table(spark, sf, "supplier").where("s_suppkey % 2 = 1").select(
        F.lit("A1").alias("check_id"), F.col("s_suppkey").cast("string").alias("subject"))
    register = keys.unionByName(spark.createDataFrame([("A6", "N")], "check_id string, subject string"))
    return q.grade(checks, register).drop("category", "title")


@query(
    "report_verdict",
    f"SELECT CASE WHEN BOOL_OR(status = 'FAIL') THEN 'FAIL' WHEN BOOL_OR(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS verdict, COUNT(*) AS checks FROM ({GRADED_SQL})",
)
def report_verdict(spark, sf):
    return q.verdict(graded_report(spark, sf))


@query(
    "self_check",
    f"""WITH {FILL_SQL}, p AS (SELECT block, party, COUNT(*) FILTER (fill_no > 0) AS published FROM f WHERE rule = 'current' GROUP BY 1, 2)
SELECT 'seats' AS problem, block, party FROM p WHERE party = 'MACHINERY' AND block = 'ASIA'
UNION ALL SELECT 'vacancies', block, party FROM s WHERE rule = 'current' AND vacancies > 0""",
)
def self_check(spark, sf):
    """Recomputed seats against a published table with one fault, and no vacancies."""
    out = simulate(election(spark, sf), lambda df: scenarios.attach(df, {"current": RULES["current"]}))
    got = out.block_seats.select("block", "party", F.col("seats").alias("value"))
    listed = out.winners.groupBy("block", "party").agg(F.count(F.lit(1)).alias("n"))
    fault = (F.col("block") == "ASIA") & (F.col("party") == "MACHINERY")
    published = listed.select("block", "party", (F.col("n") + F.when(fault, 1).otherwise(0)).alias("value"))
    wrong = q.reconcile(got, published, ["block", "party"], policy=q.NULL_IS_ZERO).where("NOT ok")
    vacant = out.block_seats.where("vacancies > 0")
    return wrong.select(F.lit("seats").alias("problem"), "block", "party").unionByName(
        vacant.select(F.lit("vacancies").alias("problem"), "block", "party")
    )
