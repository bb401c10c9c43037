"""Vote tables derived from order lines, aggregated before every shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.testdata import table


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation with its region; two tiny dimensions joined once."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )


def customer_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity per customer. Lines are summed per order before they meet the orders,
    and orders per customer before they meet the customers, so a hot order or
    customer shrinks to one row per map task before it is shuffled."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy("o_custkey")
        .agg(F.sum("quantity").alias("quantity"))
    )


def regional_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contest = region, party = nation, votes = ordered quantity)."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    per_nation = (
        customer_quantity(spark, sf_dir)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.sum("quantity").alias("votes"))
    )
    geo = geography(spark, sf_dir)
    return (
        per_nation.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("region").alias("contest"), F.col("nation").alias("party"))
        .agg(F.sum("votes").alias("votes"))
    )


def segment_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, nation, segment, votes = order value in cents)."""
    per_customer = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    per_nation = (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "c_mktsegment")
        .agg(F.sum("cents").alias("votes"))
    )
    return per_nation.join(
        geography(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("region", "nation", F.col("c_mktsegment").alias("segment"), "votes")
