"""Reshaping report-shaped rows: clusters, bins, carried labels, headers, overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, reshape, scan
from ..plans.votes import geography
from ..sources.documents import flatten, nest, nest_in_parts
from ..sources.manifest import verify_manifest
from ..sources.testdata import table
from .base import SEG_SQL, query

GAP = 30 * 60 * 1_000_000
#: Microseconds of a wall-clock time, whatever the session zone.
MICROS = (
    "cast(datediff(cast(ts as date), date'1970-01-01') as bigint) * 86400000000"
    " + hour(ts) * 3600000000L + minute(ts) * 60000000L + cast(extract(second from ts) * 1000000 as bigint)"
)


def events(spark, sf):
    return table(spark, sf, "events").select(
        "user_id", "event_id", "event_type", "value", "props", F.expr(MICROS).alias("at")
    )


ISLAND_SQL = f"""ev AS (SELECT *, epoch_us(ts) AS us FROM events),
i1 AS (SELECT *, CASE WHEN us - LAG(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= {GAP} THEN 0 ELSE 1 END AS s FROM ev),
isl AS (SELECT *, SUM(s) OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM i1)"""


#: Keys of so many rows are cut into ranges in the ``…_split`` queries, so that those paths are compared, too.
FEW_ROWS = scan.Limits(rows=8, ranges=16)
GAP_SQL = f"""WITH {ISLAND_SQL} SELECT user_id, CAST(n AS BIGINT) AS cluster_no, COUNT(*) AS size,
  CAST(MAX(us) - MIN(us) AS BIGINT) AS extent, CAST((SUM(us - 1704067200000000) // COUNT(*)) AS BIGINT) AS center FROM isl GROUP BY 1, 2"""


@query("gap_cluster", GAP_SQL)
def gap_cluster(spark, sf, limits=scan.LIMITS):
    rows = events(spark, sf).select("user_id", "event_id", (F.col("at") - 1704067200000000).alias("at"))
    islands = scan.islands(rows, ["user_id"], ["at", "event_id"], "at", GAP, "cluster_no", limits)
    return islands.groupBy("user_id", F.col("cluster_no").cast("bigint").alias("cluster_no")).agg(
        F.count(F.lit(1)).alias("size"), (F.max("at") - F.min("at")).alias("extent"),
        F.expr("sum(at) div count(1)").alias("center"),
    )


@query("gap_cluster_split", GAP_SQL)
def gap_cluster_split(spark, sf):
    return gap_cluster(spark, sf, FEW_ROWS)


@query(
    "ordered_windows_split",
    """SELECT event_id, ROW_NUMBER() OVER w AS place, LAG(event_type) OVER w AS before,
  CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) OVER w AS BIGINT) AS so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def ordered_windows_split(spark, sf):
    """Rank, lag and running sum of users whose events are cut into ranges of a few."""
    rows = events(spark, sf).select("user_id", "event_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    args = (["user_id"], ["event_id"])
    rows = scan.ordered_rank(rows, *args, "place", FEW_ROWS)
    rows = scan.ordered_lag(rows, *args, "event_type", "before", FEW_ROWS)
    rows = scan.ordered_running_sum(rows, *args, "cents", "so_far", FEW_ROWS)
    return rows.select("event_id", F.col("place").cast("bigint").alias("place"), "before", "so_far")


@query(
    "range_bin",
    """WITH b AS (SELECT l_returnflag AS f, CAST(UNNEST([1, 11, 21, 31, 46]) AS BIGINT) + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END AS lo
   FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
r AS (SELECT f, lo, LEAD(lo) OVER (PARTITION BY f ORDER BY lo) AS hi, ROW_NUMBER() OVER (PARTITION BY f ORDER BY lo) - 1 AS bin_no FROM b)
SELECT l_returnflag, CAST(r.bin_no AS INTEGER) AS bin_no, COUNT(*) AS lines, CAST(SUM(l_quantity) AS BIGINT) AS qty
FROM lineitem LEFT JOIN r ON r.f = l_returnflag AND l_quantity >= lo AND l_quantity < hi GROUP BY 1, 2""",
)
def range_bin(spark, sf):
    """Lines are counted by flag and quantity first: what is binned does not grow with the table."""
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_quantity").cast("bigint").alias("qty")).agg(
        F.count(F.lit(1)).alias("lines"))
    offset = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(4)
    bounds = counts.select("l_returnflag").distinct().select(
        "l_returnflag", F.explode(F.array(*[F.lit(b) + offset for b in (1, 11, 21, 31, 46)])).alias("bound")
    )
    return grid.bin_by_bounds(counts, bounds, ["l_returnflag"], F.col("qty")).groupBy("l_returnflag", "bin_no").agg(
        F.sum("lines").alias("lines"), F.sum(F.col("qty") * F.col("lines")).alias("qty")
    )


@query(
    "subdivide_columns",
    """WITH b AS (SELECT DISTINCT l_returnflag AS f, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
l AS (SELECT *, LAG(q) OVER (PARTITION BY f ORDER BY q) AS p FROM b)
SELECT f, CAST(ROUND(q * 1000) AS BIGINT) AS bound FROM l WHERE p IS NULL
UNION ALL SELECT f, CAST(ROUND((p + (q - p) * k / 4.0) * 1000) AS BIGINT) FROM l, (SELECT UNNEST([1, 2, 3, 4]) AS k) WHERE p IS NOT NULL""",
)
def subdivide_columns(spark, sf):
    bounds = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("f"), F.col("l_quantity").cast("bigint").alias("bound")
    ).distinct()
    cut = grid.subdivide(bounds, ["f"], 4)
    return cut.select("f", F.round(F.col("bound") * 1000).cast("bigint").alias("bound"))


CARRY_SQL = """WITH e AS (SELECT *, SUM(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)
SELECT event_id, CASE WHEN g = 0 THEN NULL ELSE FIRST_VALUE(CASE WHEN event_type = 'purchase' THEN 'p' || event_id END)
    OVER (PARTITION BY user_id, g ORDER BY event_id) END AS label FROM e"""


@query("carry_forward", CARRY_SQL)
def carry_forward(spark, sf, limits=scan.LIMITS):
    """A label opens at each purchase and is cleared by an error."""
    rows = events(spark, sf).select("user_id", "event_id", "event_type")
    label = F.when(F.col("event_type") == "purchase", F.concat(F.lit("p"), F.col("event_id").cast("string")))
    return scan.carry_forward(
        rows, ["user_id"], ["event_id"], label, "label", F.col("event_type") == "error", limits
    ).select("event_id", "label")


@query("carry_forward_split", CARRY_SQL)
def carry_forward_split(spark, sf):
    return carry_forward(spark, sf, FEW_ROWS)


@query(
    "unpivot_groups",
    """SELECT l_returnflag, category, CAST(SUM(lo) AS BIGINT) AS lo, CAST(SUM(hi) AS BIGINT) AS hi FROM (
  SELECT l_returnflag, 'size' AS category, CAST(l_quantity AS BIGINT) AS lo, CAST(l_linenumber AS BIGINT) AS hi FROM lineitem
  UNION ALL SELECT l_returnflag, 'rate', CAST(ROUND(l_discount * 100) AS BIGINT), CAST(ROUND(l_tax * 100) AS BIGINT) FROM lineitem) GROUP BY 1, 2""",
)
def unpivot_groups(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"), F.col("l_linenumber").cast("bigint").alias("n"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("d"), F.round(F.col("l_tax") * 100).cast("bigint").alias("t"),
    )
    long = reshape.unpivot_groups(
        wide, ["l_returnflag"], {"size": {"lo": "q", "hi": "n"}, "rate": {"lo": "d", "hi": "t"}, "": {"lo": "q", "hi": "q"}}
    )
    return long.groupBy("l_returnflag", "category").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))


GROUP_SQL = """c AS (SELECT *, SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations)"""


def wrapped(spark, sf, part_rows=None):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    merged = reshape.merge_wrapped(
        rows, ["conv_id"], "turn", "text", F.col("role") == "user", part_rows=part_rows
    )
    return merged.withColumns({"group_no": F.col("group_no").cast("bigint"), "label_md5": F.md5("label")}).drop("label")


@query(
    "merge_wrapped",
    f"""WITH {GROUP_SQL}
SELECT conv_id, CAST(g AS BIGINT) AS group_no, COUNT(*) AS rows, MIN(turn) AS first_row,
  md5(STRING_AGG(text, '' ORDER BY turn)) AS label_md5 FROM c GROUP BY 1, 2""",
)
def merge_wrapped(spark, sf):
    """One label per user turn: its text and that of the turns up to the next user turn."""
    return wrapped(spark, sf)


@query(
    "merge_wrapped_parts",
    f"""WITH {GROUP_SQL},
p AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY conv_id, g ORDER BY turn) - 1) // 16 + 1 AS part FROM c)
SELECT conv_id, CAST(g AS BIGINT) AS group_no, CAST(part AS BIGINT) AS part_no, COUNT(*) AS rows, MIN(turn) AS first_row,
  md5(STRING_AGG(text, '' ORDER BY turn)) AS label_md5 FROM p GROUP BY 1, 2, 3""",
)
def merge_wrapped_parts(spark, sf):
    """The same for groups of any length: consecutive parts of 16 rows, all of them kept."""
    return wrapped(spark, sf, 16)


@query(
    "ordinal_restart",
    """WITH e AS (SELECT *, SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS h FROM events)
SELECT event_id, CAST(h AS BIGINT) AS header_no,
  ROW_NUMBER() OVER (PARTITION BY user_id, h ORDER BY event_id) - CASE WHEN h > 0 THEN 1 ELSE 0 END AS ordinal FROM e""",
)
def ordinal_restart(spark, sf):
    rows = events(spark, sf).select("user_id", "event_id", "event_type")
    out = reshape.ordinal_in_group(
        rows, ["user_id"], "event_id", F.col("event_type") == "purchase"
    )
    return out.select("event_id", F.col("header_no").cast("bigint").alias("header_no"), "ordinal")


@query(
    "attach_rates",
    """WITH e AS (SELECT *, LEAD(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nt,
    LEAD(value) OVER (PARTITION BY user_id ORDER BY event_id) AS nv FROM events)
SELECT event_id, CASE WHEN nt = 'view' THEN CAST(ROUND(nv * 100) AS BIGINT) END AS rate_cents FROM e WHERE event_type = 'click'""",
)
def attach_rates(spark, sf):
    """A click takes the value of a view that directly follows it."""
    rows = events(spark, sf).select("user_id", "event_id", "event_type", "value")
    out = reshape.attach_following(
        rows, ["user_id"], "event_id", F.col("event_type") == "click", F.col("event_type") == "view", "value", "rate"
    )
    return out.select("event_id", F.round(F.col("rate") * 100).cast("bigint").alias("rate_cents"))


@query(
    "override_join",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 2 = 0 THEN 'checked' WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS status,
  o_orderkey % 13 = 0 AND o_orderkey % 2 = 1 AS unresolved FROM orders""",
)
def override_join(spark, sf):
    """Blanks are filled from a register; what it lacks stays visible as unresolved."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")).alias("status"))
    register = table(spark, sf, "orders").where("o_orderkey % 26 = 0").select("o_orderkey", F.lit("checked").alias("status"))
    filled = reshape.with_overrides(orders, register, ["o_orderkey"], ["status"])
    open_rows = reshape.unresolved(orders, register, ["o_orderkey"], F.col("status").isNull()).select(
        "o_orderkey", F.lit(True).alias("open"))
    return filled.join(open_rows, "o_orderkey", "left").select(
        "o_orderkey", "status", F.coalesce("open", F.lit(False)).alias("unresolved"))


SECTIONS, LABELS = ["a", "b", "c"], ["x", "y"]


@query(
    "section_positions",
    """WITH e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, COUNT(*) OVER (PARTITION BY user_id) = 6 AS complete FROM events),
l AS (SELECT *, ['a', 'b', 'c'][CAST(p // 2 AS INTEGER) + 1] AS section, CASE WHEN p < 6 THEN ['x', 'y'][CAST(p % 2 AS INTEGER) + 1] END AS label,
   CASE WHEN event_type IN ('click', 'view') THEN 'x' ELSE 'y' END AS printed FROM e)
SELECT event_id, section, label, label IS NOT DISTINCT FROM printed AS ok, complete FROM l""",
)
def section_positions(spark, sf):
    rows = events(spark, sf).select(
        "user_id", "event_id", F.when(F.col("event_type").isin("click", "view"), "x").otherwise("y").alias("printed"))
    out = reshape.positional_labels(
        rows, ["user_id"], "event_id", SECTIONS, LABELS, "printed")
    return out.select("event_id", "section", "label", "ok", "complete")


@query(
    "classify_sections",
    """WITH c AS (SELECT page_id, CASE WHEN contains(html, '<article') AND contains(html, '<nav') THEN 'full' WHEN contains(html, '<article') THEN 'article'
   WHEN contains(html, '<p') THEN 'plain' END AS kind FROM pages),
n AS (SELECT kind, COUNT(*) AS n FROM c GROUP BY 1)
SELECT k.kind, COALESCE(n.n, 0) AS n FROM (VALUES ('full'), ('article'), ('plain'), ('other')) k(kind) LEFT JOIN n ON n.kind = k.kind WHERE COALESCE(n.n, 0) <> 1""",
)
def classify_sections(spark, sf):
    kinds = reshape.classify(
        table(spark, sf, "pages"), F.col("html"),
        [("full", ["<article", "<nav"]), ("article", ["<article"]), ("plain", ["<p"])],
    )
    expected = spark.createDataFrame([("full",), ("article",), ("plain",), ("other",)], "kind string")
    return reshape.expected_once(kinds, expected, ["kind"])


#: Tokens of a page: a fixed run of event ids, so a page stays small however large the tables.
PAGE = 256


@query(
    "token_lines",
    f"""WITH t AS (SELECT event_id // {PAGE} AS page, event_id AS x, CAST(ROUND(value * 100) AS BIGINT) AS top, substr(event_type, 1, 1) AS c FROM events),
i AS (SELECT *, CASE WHEN top - LAG(top) OVER (PARTITION BY page ORDER BY top, x) <= 10 THEN 0 ELSE 1 END AS s FROM t),
b AS (SELECT *, SUM(s) OVER (PARTITION BY page ORDER BY top, x) AS line_no FROM i)
SELECT page, CAST(line_no AS BIGINT) AS line_no, COUNT(*) AS tokens, STRING_AGG(c, '' ORDER BY x) AS text FROM b GROUP BY 1, 2""",
)
def token_lines(spark, sf):
    tokens = table(spark, sf, "events").select(
        F.expr(f"event_id div {PAGE}").alias("page"), F.col("event_id").alias("x"),
        F.round(F.col("value") * 100).cast("bigint").alias("top"), F.substring("event_type", 1, 1).alias("c"),
    )
    out = grid.token_lines(tokens, ["page"], "top", "x", "c", 10)
    return out.withColumn("line_no", F.col("line_no").cast("bigint"))


@query(
    "cell_lines",
    f"""WITH RECURSIVE t AS (
  SELECT event_id // {PAGE} AS page, event_id % 16 AS cell, event_id AS x, value AS top, substr(event_type, 1, 1) AS c FROM events),
d AS (SELECT DISTINCT page, cell, top FROM t),
n AS (SELECT a.page, a.cell, a.top, MIN(b.top) AS beyond
  FROM d a LEFT JOIN d b ON a.page = b.page AND a.cell = b.cell AND b.top > a.top + 3.0 GROUP BY 1, 2, 3),
s AS (
  SELECT page, cell, 1 AS line_no, MIN(top) AS top FROM t GROUP BY 1, 2
  UNION ALL
  SELECT s.page, s.cell, s.line_no + 1, n.beyond FROM s JOIN n ON s.page = n.page AND s.cell = n.cell AND s.top = n.top
  WHERE n.beyond IS NOT NULL)
SELECT t.page, t.cell, s.line_no, s.top, string_agg(t.c, '' ORDER BY t.x, t.top, t.c) AS text
FROM t ASOF JOIN s ON t.page = s.page AND t.cell = s.cell AND t.top >= s.top GROUP BY 1, 2, 3, 4""",
)
def cell_lines(spark, sf):
    """Lines inside the cells of a page; a cell is a few of the page's tokens."""
    tokens = table(spark, sf, "events").select(
        F.expr(f"event_id div {PAGE}").alias("page"), (F.col("event_id") % 16).alias("cell"), F.col("event_id").alias("x"), "value",
        F.substring("event_type", 1, 1).alias("c"),
    )
    return grid.cell_lines(tokens, ["page", "cell"], "value", "x", "c", 3.0)


def name_grid(spark, sf):
    """One page per customer segment and region: nation names printed over two rows.

    Rows 0 (title) and 1-2 (wrapped names); column = nation's place in its region.
    """
    geo = geography(spark, sf)
    customers = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct()
    rows = customers.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_mktsegment").alias("page"), "region", (F.col("n_nationkey") / 5).cast("int").alias("col"), "nation"
    )
    title = rows.where("col = 0").select("page", "region", F.lit(0).alias("row"), "col", F.concat(F.lit("Table "), F.col("page")).alias("text"))
    upper = rows.select("page", "region", F.lit(1).alias("row"), "col", F.substring("nation", 1, 4).alias("text"))
    lower = rows.select("page", "region", F.lit(2).alias("row"), "col", F.expr("substring(nation, 5)").alias("text"))
    return title.unionByName(upper).unionByName(lower), geo.select(F.col("nation").alias("name"))


@query(
    "header_span",
    """SELECT DISTINCT c_mktsegment AS page, r_name AS region, 1 AS start_row, 2 AS end_row, CAST(n_nationkey // 5 AS INTEGER) AS group_no, n_name AS name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def header_span(spark, sf):
    cells, names = name_grid(spark, sf)
    return grid.header_span(cells, names, ["page", "region"], "row", "col", "text", 2)


@query(
    "locate_key_column",
    """WITH c AS (SELECT o_custkey AS doc, CAST(o_orderkey % 4 AS INTEGER) AS col, CASE WHEN (o_orderkey // 4) % 3 = 0 THEN '2-HIGH' ELSE o_orderpriority END AS txt FROM orders),
h AS (SELECT doc, col, COUNT(*) AS hits FROM c WHERE txt IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2)
SELECT doc, col, hits FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc ORDER BY hits DESC, col) AS rn FROM h) WHERE rn = 1""",
)
def locate_key_column(spark, sf):
    text = F.when(F.expr("(o_orderkey div 4) % 3 = 0"), "2-HIGH").otherwise(F.col("o_orderpriority"))
    cells = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 4).cast("int").alias("col"), text.alias("txt"))
    return grid.locate_column(cells, ["1-URGENT", "2-HIGH"], ["doc"], "col", "txt")


@query(
    "column_roles",
    """WITH h AS (SELECT DISTINCT o_custkey AS doc, CASE o_orderpriority WHEN '1-URGENT' THEN 'result' WHEN '2-HIGH' THEN 'name' WHEN '3-MEDIUM' THEN 'rate' END AS role,
    o_orderkey AS col FROM orders),
n AS (SELECT doc, role, COUNT(*) AS n FROM h WHERE role IS NOT NULL GROUP BY 1, 2)
SELECT doc, role, 'duplicate' AS problem FROM n WHERE n > 1
UNION ALL SELECT d.doc, r.role, 'missing' FROM (SELECT DISTINCT doc FROM h) d, (VALUES ('result'), ('name')) r(role)
WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc = d.doc AND n.role = r.role)""",
)
def column_roles(spark, sf):
    header = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("col"), F.col("o_orderpriority").alias("label"))
    return grid.column_roles(
        header, ["doc"], "col", "label", {"1-URGENT": "result", "2-HIGH": "name"}, [("3-", "rate")], ["result", "name"])[1]


@query(
    "manifest_check",
    """WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 31 <> 5),
r AS (SELECT doc_id, CASE WHEN doc_id % 29 = 3 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 37 <> 7)
SELECT COALESCE(a.doc_id, r.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'missing' WHEN r.h IS NULL THEN 'unregistered'
  WHEN a.h = r.h THEN 'ok' ELSE 'mismatch' END AS status FROM a FULL JOIN r ON a.doc_id = r.doc_id""",
)
def manifest_check(spark, sf):
    docs = table(spark, sf, "documents")
    contents = docs.where("doc_id % 31 <> 5").select("doc_id", F.col("text").cast("binary").alias("content"))
    registered = docs.where("doc_id % 37 <> 7").select(
        "doc_id", F.when(F.col("doc_id") % 29 == 3, "x").otherwise(F.sha2("text", 256)).alias("sha256"))
    return verify_manifest(contents, registered, "doc_id").select("doc_id", "status")


@query(
    "nested_document",
    f"""WITH {SEG_SQL}, n AS (SELECT region, nation, '[' || STRING_AGG(segment || ':' || votes, ', ' ORDER BY votes DESC, segment) || ']' AS list,
   CAST(SUM(votes) AS BIGINT) AS votes FROM seg GROUP BY 1, 2)
SELECT region, CAST(SUM(votes) AS BIGINT) AS votes, md5(STRING_AGG(nation || list, ';' ORDER BY nation)) AS body_md5 FROM n GROUP BY 1""",
)
def nested_document(spark, sf):
    """Region -> nations -> segments as nested rows, summarised for comparison."""
    regions = region_documents(spark, sf)
    text = F.array_join(F.transform("nations", lambda n: F.concat(
        n["nation"], F.lit("["), F.array_join(F.transform(n["segments"], lambda s: F.concat(s["segment"], F.lit(":"), s["votes"].cast("string"))), ", "), F.lit("]"))), ";")
    total = F.aggregate("nations", F.lit(0).cast("bigint"), lambda a, n: a + F.aggregate(n["segments"], F.lit(0).cast("bigint"), lambda b, s: b + s["votes"]))
    return regions.select("region", total.alias("votes"), F.md5(text).alias("body_md5"))


def region_documents(spark, sf):
    from ..plans.votes import segment_cents

    seg = segment_cents(spark, sf).withColumn("down", -F.col("votes"))
    nations = nest(seg, ["region", "nation"], ["down", "segment"], ["segment", "votes"], "segments")
    return nest(nations, ["region"], ["nation"], ["nation", "segments"], "nations")


@query(
    "roundtrip_check",
    f"""WITH {SEG_SQL} SELECT 'rows' AS total, COUNT(*) AS nested, COUNT(*) AS flat FROM seg
UNION ALL SELECT 'votes', CAST(SUM(votes) AS BIGINT), CAST(SUM(votes) AS BIGINT) FROM seg
UNION ALL SELECT 'nations', COUNT(DISTINCT nation), COUNT(DISTINCT nation) FROM seg""",
)
def roundtrip_check(spark, sf):
    """Totals of the nested documents, flattened again, beside those of the source."""
    from ..plans.votes import segment_cents

    def totals(df, side):
        return df.agg(
            F.count(F.lit(1)).alias("rows"), F.sum("votes").alias("votes"), F.count_distinct("nation").alias("nations")
        ).select(F.lit(side).alias("side"), F.explode(F.create_map(
            F.lit("rows"), F.col("rows"), F.lit("votes"), F.col("votes"), F.lit("nations"), F.col("nations"))).alias("total", "n"))

    back = flatten(flatten(region_documents(spark, sf), "nations"), "segments")
    both = totals(back, "nested").unionByName(totals(segment_cents(spark, sf), "flat"))
    return both.groupBy("total").agg(
        F.max(F.when(F.col("side") == "nested", F.col("n"))).alias("nested"),
        F.max(F.when(F.col("side") == "flat", F.col("n"))).alias("flat"))


@query(
    "nested_lists",
    f"""WITH {SEG_SQL} SELECT region, nation, COUNT(*) AS items,
  STRING_AGG(segment || '=' || votes, ',' ORDER BY votes DESC, segment) AS body FROM seg GROUP BY 1, 2""",
)
def nested_lists(spark, sf):
    """One ordered list per nation: its segments, a closed set, so a list stays short."""
    from ..plans.votes import segment_cents

    seg = segment_cents(spark, sf).withColumn("down", -F.col("votes"))
    lists = nest(seg, ["region", "nation"], ["down", "segment"], ["segment", "votes"], "items")
    body = F.array_join(F.transform("items", lambda x: F.concat(x["segment"], F.lit("="), x["votes"].cast("string"))), ",")
    return lists.select("region", "nation", F.size("items").cast("bigint").alias("items"), body.alias("body"))


@query(
    "nested_list_parts",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p FROM orders)
SELECT o_custkey, CAST(p // 4 + 1 AS BIGINT) AS part_no, COUNT(*) AS items, STRING_AGG(o_orderkey || '=' || o_orderpriority, ',' ORDER BY p) AS body
FROM r GROUP BY 1, 2""",
)
def nested_list_parts(spark, sf):
    """Lists of any length, in consecutive parts."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    parts = nest_in_parts(
        orders, ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderpriority"], "items", 4)
    body = F.array_join(F.transform("items", lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit("="), x["o_orderpriority"])), ",")
    return parts.select("o_custkey", "part_no", F.size("items").cast("bigint").alias("items"), body.alias("body"))
