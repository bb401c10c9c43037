"""Text keys, printed numbers, labels, categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, numbers, text
from ..plans.votes import geography
from ..sources.testdata import table
from .base import query

SQL_SPACES = text.SPACES.replace("'", "''")


@query(
    "clean_text_key",
    f"""WITH t AS (SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, url FROM pages),
k AS (SELECT kind, id, translate(regexp_replace(regexp_replace(text, '[\\x{{FE00}}-\\x{{FE0F}}]|[\\x{{E0100}}-\\x{{E01EF}}]', '', 'g'),
        '{SQL_SPACES}', '', 'g'), '{text.SMALL_KANA}', '{text.FULL_KANA}') AS key FROM t)
SELECT kind, id, md5(key) AS key_md5, CAST(length(key) AS INTEGER) AS key_chars FROM k""",
)
def clean_text_key(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("text"))
    key = text.full_kana(text.squash(text.strip_selectors(F.col("text"))))
    return docs.unionByName(pages).select("kind", "id", key.alias("key")).select(
        "kind", "id", F.md5("key").alias("key_md5"), F.length("key").alias("key_chars")
    )


@query(
    "nfkc_key",
    f"""SELECT doc_id, md5(translate(regexp_replace(nfc_normalize(text), '{SQL_SPACES}', '', 'g'), '{text.SMALL_KANA}', '{text.FULL_KANA}')) AS key_md5
FROM documents""",
)
def nfkc_key(spark, sf):
    """Keys of documents of which every other one is printed in full width: both forms have the key of the plain text."""
    printed = F.when(F.col("doc_id") % 2 == 0, F.translate("text", text.NARROW, text.WIDE)).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.name_key(printed)).alias("key_md5"))


def printed_prices(spark, sf):
    """Order prices as they would be printed, in six styles."""
    price = F.format_number("o_totalprice", 2)
    style = F.col("o_orderkey") % 6
    wide = F.translate(price, text.NARROW, text.WIDE)
    cell = (
        F.when(style == 0, price)
        .when(style == 1, F.concat(F.lit("△"), price))
        .when(style == 2, F.concat(price, F.lit("票")))
        .when(style == 3, wide)
        .when(style == 4, F.concat(F.lit("　"), price, F.lit(" %")))
        .otherwise(F.when(F.col("o_orderkey") % 12 == 5, "△").otherwise("－"))
    )
    return table(spark, sf, "orders").select("o_orderkey", cell.alias("cell"))


@query(
    "parse_printed_number",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL
  WHEN o_orderkey % 6 = 1 THEN -CAST(ROUND(o_totalprice * 100) AS BIGINT)
  ELSE CAST(ROUND(o_totalprice * 100) AS BIGINT) END AS cents,
  CASE WHEN o_orderkey % 6 = 5 THEN 'null' ELSE 'number' END AS state FROM orders""",
)
def parse_printed_number(spark, sf):
    cells = printed_prices(spark, sf)
    return cells.select(
        "o_orderkey",
        numbers.scaled(numbers.parse_decimal(F.col("cell")), 100).alias("cents"),
        numbers.number_state(F.col("cell")).alias("state"),
    )


@query(
    "render_plain_number",
    """SELECT l_suppkey, CASE WHEN cents % 100 = 0 THEN CAST(cents // 100 AS VARCHAR)
  ELSE (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS plain
FROM (SELECT l_suppkey, SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1)""",
)
def render_plain_number(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents")
    )
    return sums.select("l_suppkey", numbers.plain_decimal((F.col("cents") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)")).alias("plain"))


@query(
    "label_parse",
    """SELECT c_custkey, n_name AS area, CAST(c_custkey % 99 + 1 AS INTEGER) AS number,
  CAST(ROUND(ABS(c_acctbal) * 100) AS BIGINT) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def label_parse(spark, sf):
    """District header lines, printed and read back; the area must be a known one."""
    places = geography(spark, sf)
    line = F.concat(
        F.col("nation"), F.lit("第"), (F.col("c_custkey") % 99 + 1).cast("string"), F.lit("区（供託物没収点"),
        F.format_number(F.abs("c_acctbal"), 2),
    )
    lines = table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", line.alias("line")
    )
    parsed = lines.select("c_custkey", labels.parse_header(text.squash(F.col("line"))).alias("h"))
    known = places.select(F.col("nation").alias("area"))
    return parsed.select(
        "c_custkey", F.col("h.area").alias("area"), F.col("h.number").alias("number"),
        numbers.scaled(F.col("h.amount"), 100).alias("cents"),
    ).join(known, "area", "left_semi")


@query(
    "label_bands",
    """SELECT label, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, COUNT(*) AS parts FROM (
  SELECT CASE WHEN p_size % 10 = 0 THEN '計' WHEN p_size >= 45 THEN (p_size - p_size % 5) || '歳以上'
     ELSE (p_size - p_size % 5) || '歳～' || (p_size - p_size % 5 + 4) || '歳' END AS label,
   CASE WHEN p_size % 10 <> 0 THEN p_size - p_size % 5 END AS lo,
   CASE WHEN p_size % 10 <> 0 AND p_size < 45 THEN p_size - p_size % 5 + 4 END AS hi FROM part) GROUP BY 1, 2, 3""",
)
def label_bands(spark, sf):
    lo = F.col("p_size") - F.col("p_size") % 5
    tilde = F.when(F.col("p_partkey") % 2 == 0, "～").otherwise("")
    printed = (
        F.when(F.col("p_size") % 10 == 0, F.when(F.col("p_partkey") % 2 == 0, "合計").otherwise("計"))
        .when(F.col("p_size") >= 45, F.concat(lo.cast("string"), F.lit("歳以上")))
        .otherwise(F.concat(lo.cast("string"), F.lit("歳"), tilde, (lo + 4).cast("string"), F.lit("歳")))
    )
    wide = F.when(F.col("p_partkey") % 3 == 0, F.translate(printed, text.NARROW, text.WIDE)).otherwise(printed)
    return table(spark, sf, "part").select(labels.canonical_band(wide).alias("b")).groupBy("b").agg(
        F.count(F.lit(1)).alias("parts")
    ).select("b.label", "b.lo", "b.hi", "parts")


@query(
    "label_marks",
    """SELECT p_partkey, p_brand AS category, p_partkey % 3 <> 1 AS certified,
  CAST(p_size AS BIGINT) AS main, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 50 AS BIGINT) END AS inner_count,
  p_name AS rest FROM part""",
)
def label_marks(spark, sf):
    """Bracketed categories, cells with an inner count, labels with a known prefix."""
    brand = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("（ "), F.col("p_brand"), F.lit(")"))).otherwise(F.col("p_brand"))
    cell = F.concat(
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("("), (F.col("p_partkey") % 50).cast("string"), F.lit(")\n"))).otherwise(""),
        F.col("p_size").cast("string"), F.lit("人"),
    )
    label = F.concat(F.when(F.col("p_partkey") % 2 == 0, "党派名").otherwise("党派"), F.col("p_name"))
    cells = table(spark, sf, "part").select("p_partkey", brand.alias("brand"), cell.alias("cell"), label.alias("label"))
    return cells.select(
        "p_partkey", labels.bracketed(F.col("brand")).alias("b"), labels.main_and_inner(F.col("cell")).alias("c"),
        text.strip_prefix(F.col("label"), labels.PARTY_COLUMN_LABELS).alias("rest"),
    ).select(
        "p_partkey", F.col("b.value").alias("category"), "b.certified", "c.main",
        F.col("c.inner").alias("inner_count"), "rest",
    )


@query(
    "label_list_header",
    """SELECT s_suppkey, replace(s_name, '#', '＃') AS party, CAST(ROUND(s_acctbal * 100) AS BIGINT) AS cents,
  s_suppkey % 40 AS seats, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 7 AS INTEGER) END AS male,
  CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 5 AS INTEGER) END AS female FROM supplier""",
)
def label_list_header(spark, sf):
    """Header cells of a list: wrapped name, votes, seats, men and women."""
    def s(c):
        return c.cast("string")

    key = F.col("s_suppkey")
    lines = F.array(
        F.concat(F.lit("政党等名"), F.substring("s_name", 1, 8)),
        F.concat(F.lit("＃"), F.substring_index("s_name", "#", -1)),
        F.concat(F.lit("名簿届出 "), s(key % 9), F.lit("人")),
        F.concat(F.lit("得票数 "), F.when(F.col("s_acctbal") < 0, "▲").otherwise(""), F.format_number(F.abs("s_acctbal"), 2), F.lit("票")),
        F.concat(F.lit("当選人数"), s(key % 40), F.lit("人")),
        F.when(key % 3 > 0, F.concat(F.lit("男"), s(key % 7), F.lit("人 女"), s(key % 5), F.lit("人"))).otherwise(""),
    )
    return table(spark, sf, "supplier").select("s_suppkey", labels.list_header(lines).alias("h")).select(
        "s_suppkey", "h.party", numbers.scaled(F.col("h.votes"), 100).alias("cents"), "h.seats", "h.male", "h.female"
    )


@query(
    "row_labels",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '合計' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN '計' ELSE '合計' END
  WHEN 2 THEN NULL WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN '計' ELSE '合計' END ELSE o_orderpriority END AS label FROM orders""",
)
def row_labels(spark, sf):
    key = F.col("o_orderkey") % 5
    raw = F.when(key == 0, "合計").when(key == 1, "計").when(key == 2, "注").when(key == 3, "総計").otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf, "orders").select(
        "o_orderkey", raw.alias("raw"), F.when(F.col("o_orderkey") % 2 == 0, "b").otherwise("").alias("block"))
    # The members are a fixed list, as the places of a printed table are.
    is_member = F.col("raw").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return rows.select("o_orderkey", labels.row_label(F.col("raw"), is_member, F.col("block")).alias("label"))


@query(
    "category_fold",
    """WITH p AS (SELECT CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN p_brand WHEN p_brand = 'Brand#4' THEN '無所属' ELSE '諸派' END AS category,
  p_size FROM part)
SELECT category, COUNT(*) AS parts, CAST(SUM(p_size) AS BIGINT) AS size_total FROM p GROUP BY 1""",
)
def category_fold(spark, sf):
    brand = labels.canonical_category(
        F.concat(F.col("p_brand"), F.lit(" ※１")), {**labels.ALIASES, "Brand#4": "無所属"}, [f"Brand#{i}" for i in range(1, 26)]
    )
    rows = table(spark, sf, "part").select(brand.alias("party"), "p_size")
    certified = F.col("party").isin("Brand#1", "Brand#2", "Brand#3")
    return rows.select(labels.fold_uncertified(F.col("party"), certified).alias("category"), "p_size").groupBy(
        "category"
    ).agg(F.count(F.lit(1)).alias("parts"), F.sum("p_size").alias("size_total"))


@query(
    "allowed_values",
    """SELECT n_name AS nation, COUNT(*) AS customers, COUNT(*) FILTER (c_acctbal IS NULL OR c_mktsegment = '' OR NOT (c_acctbal BETWEEN 0 AND 9000)) AS implausible
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""",
)
def allowed_values(spark, sf):
    """Rows restricted to known members, labelled from the geography, screened for plausible values."""
    rows = table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(
        geography(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    odd = labels.any_required_missing([F.col("c_acctbal"), F.col("c_mktsegment")]) | ~labels.within(F.col("c_acctbal"), 0, 9000)
    return rows.groupBy("nation").agg(F.count(F.lit(1)).alias("customers"), F.count_if(odd).alias("implausible"))
