"""Eligibility, capacities, list filling, scenarios and their comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import signed_text
from ..operators import apportion as ap
from ..operators import lists
from ..plans import compare, scenarios
from ..plans.scenarios import Scenario
from ..plans.simulate import simulate
from ..plans.votes import geography, segment_cents
from ..sources.testdata import table
from .apportionment import SEATS, district_wins, regional_lists, voted
from .base import CAP_SQL, SEG_SQL, V_SQL, query
from .model import BLOCK_SEATS, ENTRY_SQL, election, list_entries, person_districts, person_outcomes

RULES = {
    "current": Scenario(),
    "strict": Scenario(share_num=1, share_den=6, rate_floor=50, list_exhaustion="vacant"),
}


def marked_entries(spark, sf):
    entries = list_entries(spark, sf)
    with_base = entries.join(person_districts(entries), ["election", "district"])
    return lists.mark_entries(
        scenarios.attach(with_base, RULES), person_outcomes(entries), ["election", "district"]
    )


def rate_milli():
    return F.expr("case when rate is not null then (smd_votes * 100000) div winner_votes end").alias("rate_milli")


@query(
    "list_eligibility",
    f"WITH {ENTRY_SQL} SELECT rule, ordinal, dual, won, eligible, rate_milli FROM e",
)
def list_eligibility(spark, sf):
    return marked_entries(spark, sf).select(
        F.col("scenario_id").alias("rule"), "ordinal", "dual", "won", "eligible", rate_milli()
    )


@query(
    "list_capacity",
    f"WITH {ENTRY_SQL} SELECT rule, block, party, COUNT(*) FILTER (eligible) AS capacity FROM e GROUP BY 1, 2, 3",
)
def list_capacity(spark, sf):
    marked = marked_entries(spark, sf)
    return lists.capacities(marked, ["scenario_id", "block", "party"]).withColumnRenamed("scenario_id", "rule")


#: Seats of the two rule sets: capacities, D'Hondt with reallocation or vacancies, list fill.
FILL_SQL = f"""{SEG_SQL}, {ENTRY_SQL},
lv AS (SELECT region AS block, segment AS party, CAST(SUM(votes) AS BIGINT) AS votes FROM seg GROUP BY 1, 2),
c AS (SELECT rule, block, party, COUNT(*) FILTER (eligible) AS capacity FROM e GROUP BY 1, 2, 3),
q AS (SELECT rule, block, party, votes, capacity, k, k AS d
      FROM lv JOIN c USING (block, party), (SELECT UNNEST(range(1, {BLOCK_SEATS + 1})) AS k)
      WHERE rule = 'strict' OR k <= capacity),
a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rule, block
        ORDER BY CAST(votes AS DOUBLE) / d DESC, votes DESC, party, k) AS rn FROM q),
s AS (SELECT rule, block, party, COUNT(*) FILTER (k <= capacity) AS seats,
             COUNT(*) FILTER (k > capacity) AS vacancies FROM a WHERE rn <= {BLOCK_SEATS} GROUP BY 1, 2, 3),
f AS (SELECT * FROM (SELECT e.*, seats, ROW_NUMBER() OVER (PARTITION BY rule, block, party
        ORDER BY list_rank, CASE WHEN dual AND votes > 0 THEN CAST(votes AS DOUBLE) / top ELSE 0 END DESC, ordinal) AS fill_no
      FROM e JOIN s USING (rule, block, party) WHERE eligible) WHERE fill_no <= seats)"""


def simulated(spark, sf, rules=None):
    rules = rules or RULES
    return simulate(election(spark, sf), lambda df: scenarios.attach(df, rules))


@query(
    "list_fill",
    f"WITH {FILL_SQL} SELECT rule, block, party, CAST(fill_no AS INTEGER) AS fill_no, name FROM f",
)
def list_fill(spark, sf):
    return simulated(spark, sf).winners.select(
        F.col("scenario_id").alias("rule"), "block", "party", "fill_no", "name"
    )


@query(
    "scenario_totals",
    f"""WITH {FILL_SQL},
dw AS (SELECT rule, winner_party AS party, COUNT(*) AS district_seats FROM win, rules GROUP BY 1, 2),
ls AS (SELECT rule, party, CAST(SUM(seats) AS BIGINT) AS list_seats, CAST(SUM(vacancies) AS BIGINT) AS vacancies FROM s GROUP BY 1, 2)
SELECT rule, party, COALESCE(district_seats, 0) AS district_seats, COALESCE(list_seats, 0) AS list_seats,
       COALESCE(vacancies, 0) AS vacancies, COALESCE(district_seats, 0) + COALESCE(list_seats, 0) AS seats
FROM dw FULL JOIN ls USING (rule, party)""",
)
def scenario_totals(spark, sf):
    return simulated(spark, sf).seats.select(
        F.col("scenario_id").alias("rule"), "party", "district_seats", "list_seats", "vacancies", "seats"
    )


@query(
    "winner_changes",
    f"""WITH {FILL_SQL}
SELECT block, party, name, 'lost' AS change FROM f WHERE rule = 'current' AND name NOT IN (SELECT name FROM f WHERE rule = 'strict')
UNION ALL
SELECT block, party, name, 'gained' FROM f WHERE rule = 'strict' AND name NOT IN (SELECT name FROM f WHERE rule = 'current')""",
)
def winner_changes(spark, sf):
    winners = simulated(spark, sf).winners
    return compare.winner_changes(
        winners.where("scenario_id = 'current'"), winners.where("scenario_id = 'strict'"), ["block", "party", "name"]
    )


@query(
    "list_shortfall",
    f"""WITH {FILL_SQL}, w AS (SELECT rule, block, party, COUNT(*) AS n FROM a WHERE rn <= {BLOCK_SEATS} GROUP BY 1, 2, 3)
SELECT rule, block, party, n AS wanted, seats AS filled, n - seats AS shortfall
FROM w JOIN s USING (rule, block, party)""",
)
def list_shortfall(spark, sf):
    return simulated(spark, sf).block_seats.select(
        F.col("scenario_id").alias("rule"), "block", "party", F.col("awarded").alias("wanted"),
        F.col("seats").alias("filled"), F.col("vacancies").alias("shortfall"),
    )


@query(
    "headline_figures",
    f"""WITH {FILL_SQL},
dw AS (SELECT rule, winner_party AS party, COUNT(*) AS n FROM win, rules GROUP BY 1, 2),
t AS (SELECT rule, party, SUM(d) AS d, SUM(l) AS l, SUM(x) AS x FROM (
        SELECT rule, party, n AS d, 0 AS l, 0 AS x FROM dw UNION ALL
        SELECT rule, party, 0, seats, vacancies FROM s) GROUP BY 1, 2)
SELECT rule, CAST(SUM(d) + GREATEST(SUM(l) + SUM(x), {BLOCK_SEATS} * 5) AS BIGINT) AS legal_total,
       CAST(SUM(d + l) AS BIGINT) AS filled, CAST(SUM(x) AS BIGINT) AS vacancies,
       (ARRAY_AGG(party ORDER BY d + l DESC, party))[1] AS top_party, CAST(MAX(d + l) AS BIGINT) AS top_seats,
       CAST(FLOOR(MAX(d + l) * 1000 / SUM(d + l)) AS BIGINT) AS top_permille
FROM t GROUP BY 1""",
)
def headline_figures(spark, sf):
    rows = compare.headline(
        simulated(spark, sf).seats, ["scenario_id"], F.lit(BLOCK_SEATS * 5)
    )
    return rows.select(
        F.col("scenario_id").alias("rule"), "legal_total", "filled", "vacancies", "top_party", "top_seats",
        F.expr("(top_seats * 1000) div filled").alias("top_permille"),
    )


@query(
    "roster_view",
    f"""WITH {ENTRY_SQL} SELECT rule, ordinal, block, party,
  CASE WHEN valid > 0 AND dual THEN votes * 10000 // valid END AS share_bp, rate_milli,
  CASE WHEN won THEN 'district winner' WHEN eligible THEN 'can be elected' ELSE 'not eligible' END AS status FROM e""",
)
def roster_view(spark, sf):
    status = F.when(F.col("won"), "district winner").when(F.col("eligible"), "can be elected").otherwise("not eligible")
    return marked_entries(spark, sf).select(
        F.col("scenario_id").alias("rule"), "ordinal", "block", "party",
        F.expr("case when dual and valid_votes > 0 then (smd_votes * 10000) div valid_votes end").alias("share_bp"),
        rate_milli(), status.alias("status"),
    )


@query(
    "plurality_winner",
    f"""WITH {SEG_SQL} SELECT region, nation, segment AS winner, votes FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY region, nation ORDER BY votes DESC, segment) AS rn FROM seg) WHERE rn = 1""",
)
def plurality_winner(spark, sf):
    seg = segment_cents(spark, sf)
    return lists.plurality(seg, ["region", "nation"], name="segment", party="segment").select(
        "region", "nation", "winner", F.col("winner_votes").alias("votes")
    )


@query(
    "district_seats_by_party",
    f"""WITH {SEG_SQL}, w AS (SELECT region, segment FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY region, nation ORDER BY votes DESC, segment) AS rn FROM seg) WHERE rn = 1)
SELECT COALESCE(region, '__TOTAL__') AS region, segment, COUNT(*) AS seats FROM w
GROUP BY GROUPING SETS ((region, segment), (segment))""",
)
def district_seats_by_party(spark, sf):
    won = lists.plurality(segment_cents(spark, sf), ["region", "nation"], name="segment", party="segment")
    by_region = won.groupBy("region", F.col("winner_party").alias("segment")).agg(F.count(F.lit(1)).alias("seats"))
    national = by_region.groupBy(F.lit("__TOTAL__").alias("region"), "segment").agg(F.sum("seats").alias("seats"))
    return by_region.unionByName(national)


GRID = f"""WITH {V_SQL},
g AS (SELECT t, s FROM (SELECT UNNEST(range(10, 31)) AS t), (SELECT UNNEST([20, 40]) AS s)),
q AS (SELECT t, s, contest, party, votes, k, CASE WHEN k = 1 THEN t ELSE 10 * (2 * k - 1) END AS d
      FROM v, g, (SELECT UNNEST(range(1, 41)) AS k) WHERE k <= s),
a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY t, s, contest
        ORDER BY CAST(votes AS DOUBLE) / d DESC, votes DESC, party, k) AS rn FROM q),
seats AS (SELECT t, s, contest, party, COUNT(*) FILTER (rn <= s) AS seats FROM a GROUP BY 1, 2, 3, 4)"""


def grid_seats(spark, sf):
    votes = voted(spark, sf)
    swept = scenarios.attach_grid(
        votes, Scenario("modifiedSainteLague"), first_divisor=(10, 30, 1), seat_delta=(-20, 0, 20)
    ).withColumn("contest_seats", F.lit(SEATS) + F.col("pr_seat_delta"))
    keys = ["first_divisor_tenths", "contest_seats", "contest"]
    awards = ap.apportion(
        swept, keys, seats="contest_seats", method=F.col("divisor_method"), first_tenths=F.col("first_divisor_tenths")
    )
    got = awards.groupBy(*keys, "party").agg(F.count(F.lit(1)).alias("seats"))
    return swept.select(*keys, "party").join(got, [*keys, "party"], "left").select(
        *keys, "party", F.coalesce("seats", F.lit(0)).alias("seats")
    )


@query(
    "scenario_grid_seats",
    f"{GRID} SELECT CAST(t AS INTEGER) AS first_divisor_tenths, CAST(s AS INTEGER) AS contest_seats, contest, party, seats FROM seats",
)
def scenario_grid_seats(spark, sf):
    return grid_seats(spark, sf)


@query(
    "scenario_spread",
    f"""{GRID} SELECT contest, party, MIN(seats) AS min_seats, MAX(seats) AS max_seats,
  CAST(ROUND(STDDEV_POP(seats) * 1000) AS BIGINT) AS sd_milli, COUNT(*) AS scenarios FROM seats GROUP BY 1, 2""",
)
def scenario_spread(spark, sf):
    return compare.spread(grid_seats(spark, sf), ["contest", "party"]).select(
        "contest", "party", "min_seats", "max_seats",
        F.round(F.col("sd_seats") * 1000).cast("bigint").alias("sd_milli"), "scenarios",
    )


TARGET = {
    "target": Scenario(
        "modifiedSainteLague", 21, tier_linkage="renyo", list_exhaustion="vacant"
    )
}


def _step(no, head, method, tenths, vacant):
    div = {"dhondt": "h + k", "mod": f"CASE WHEN h + k = 1 THEN {tenths} ELSE 10 * (2 * (h + k) - 1) END"}[method]
    keep = "TRUE" if vacant else "k <= capacity"
    return f"""SELECT {no} AS step_no, party, CAST(SUM(CASE WHEN rn <= {SEATS} AND k <= capacity THEN 1 ELSE 0 END) AS BIGINT) AS seats
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY contest ORDER BY CAST(votes AS DOUBLE) / ({div}) DESC, votes DESC, party, k) AS rn
      FROM (SELECT v.*, capacity, {'wins' if head else '0'} AS h, k FROM v JOIN cap USING (party) JOIN head USING (party),
            (SELECT UNNEST(range(1, {SEATS + 1})) AS k)) WHERE {keep}) GROUP BY 2"""


STEPS = " UNION ALL ".join([
    _step(0, False, "dhondt", 14, False), _step(1, True, "dhondt", 14, False), _step(2, True, "mod", 14, False),
    _step(3, True, "mod", 21, False), _step(4, True, "mod", 21, True)])
DECOMPOSE_SQL = f"""WITH {V_SQL}, {CAP_SQL}, st AS ({STEPS}),
st2 AS (SELECT p.party, n.step_no, COALESCE(st.seats, 0) AS seats FROM (SELECT DISTINCT party FROM st) p
        CROSS JOIN (SELECT UNNEST([0, 1, 2, 3, 4]) AS step_no) n LEFT JOIN st ON st.party = p.party AND st.step_no = n.step_no),
dl AS (SELECT *, seats - LAG(seats) OVER (PARTITION BY party ORDER BY step_no) AS delta FROM st2)"""


def path_deltas(spark, sf):
    rows = scenarios.expand_steps(scenarios.attach(regional_lists(spark, sf), TARGET))
    awards = ap.apportion(
        rows, ["scenario_id", "step_no", "step_id", "contest"],
        method=F.col("divisor_method"), first_tenths=F.col("first_divisor_tenths"),
        exhaustion=F.col("list_exhaustion"), capacity="capacity", linkage=F.col("tier_linkage"),
        district_wins="wins", overhang=F.col("heiyo_overhang"),
    )
    seats = awards.groupBy("scenario_id", "step_no", "party").agg(F.count_if("filled").alias("seats"))
    every = rows.select("scenario_id", "step_no", "party").distinct().join(
        seats, ["scenario_id", "step_no", "party"], "left"
    ).select("scenario_id", "step_no", "party", F.coalesce("seats", F.lit(0)).alias("seats"))
    return compare.step_deltas(every, ["scenario_id"])


@query("decompose_steps", f"{DECOMPOSE_SQL} SELECT CAST(step_no AS INTEGER) AS step_no, party, seats, delta FROM dl")
def decompose_steps(spark, sf):
    return path_deltas(spark, sf).select("step_no", "party", "seats", "delta")


@query(
    "decompose_net",
    f"""{DECOMPOSE_SQL} SELECT party, CAST(SUM(delta) AS BIGINT) AS net, BOOL_OR(delta <> 0) AS moved,
  BOOL_OR(delta <> 0) AND SUM(delta) = 0 AS reverted FROM dl GROUP BY 1""",
)
def decompose_net(spark, sf):
    return compare.net_changes(path_deltas(spark, sf), ["scenario_id"]).select("party", "net", "moved", "reverted")


TWO_SQL = f"""WITH {V_SQL},
q AS (SELECT m, contest, party, votes, k, CASE WHEN m = 'a' THEN k ELSE 2 * k - 1 END AS d
      FROM v, (SELECT UNNEST(['a', 'b']) AS m), (SELECT UNNEST(range(1, {SEATS + 1})) AS k)),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY m, contest ORDER BY CAST(votes AS DOUBLE) / d DESC, votes DESC, party, k) AS rn FROM q),
two AS (SELECT contest, party, COUNT(*) FILTER (m = 'a' AND rn <= {SEATS}) AS before,
               COUNT(*) FILTER (m = 'b' AND rn <= {SEATS}) AS after FROM r GROUP BY 1, 2)"""


def two_allocations(spark, sf):
    votes = voted(spark, sf).withColumn("seats", F.lit(SEATS))

    def one(method):
        return ap.apportion(votes, ["contest"], method=method).groupBy("contest", "party").agg(
            F.count(F.lit(1)).alias("seats")
        )

    return one(ap.DHONDT), one(ap.SAINTE_LAGUE)


@query(
    "compare_allocations",
    f"""{TWO_SQL} SELECT contest, COALESCE(party, '__TOTAL__') AS party, CAST(SUM(before) AS BIGINT) AS before,
  CAST(SUM(after) AS BIGINT) AS after, CAST(SUM(after - before) AS BIGINT) AS delta
FROM two WHERE before + after > 0 GROUP BY GROUPING SETS ((contest, party), (contest))""",
)
def compare_allocations(spark, sf):
    a, b = two_allocations(spark, sf)
    return compare.side_by_side(a, b, ["contest"])


@query("allocation_distance", f"{TWO_SQL} SELECT contest, CAST(SUM(ABS(after - before)) AS BIGINT) AS distance FROM two GROUP BY 1")
def allocation_distance(spark, sf):
    a, b = two_allocations(spark, sf)
    return compare.distance(a, b, ["contest", "party"], ["contest"])


@query(
    "display_values",
    f"""{TWO_SQL} SELECT contest, party,
  CASE WHEN after > before THEN '+' || (after - before) WHEN after < before THEN '−' || (before - after) ELSE '±0' END AS delta_text,
  CAST(ROUND_EVEN(after * 100.0 / {SEATS}, 1) AS DOUBLE) AS share_pct FROM two WHERE before + after > 0""",
)
def display_values(spark, sf):
    a, b = two_allocations(spark, sf)
    return compare.side_by_side(a, b, ["contest"]).where("party <> '__TOTAL__'").select(
        "contest", "party", signed_text(F.col("delta")).alias("delta_text"),
        F.bround(F.col("after") * 100 / SEATS, 1).cast("double").alias("share_pct"),
    )


SIZE_SQL = """WITH s AS (SELECT n.n_name AS party, COUNT(*) AS seats FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1),
m AS (SELECT SUM(seats) AS members FROM s UNION SELECT 465 UNION SELECT 475),
l AS (SELECT CAST(members AS BIGINT) AS members, line, line_no,
  CASE line WHEN 'majority' THEN members // 2 + 1
   WHEN 'stable' THEN CASE members WHEN 465 THEN 244 WHEN 475 THEN 249 ELSE (244 * members + 464) // 465 END
   ELSE CASE members WHEN 465 THEN 261 WHEN 475 THEN 266 ELSE (261 * members + 464) // 465 END END AS needed,
  line = 'majority' OR members IN (465, 475) AS exact
 FROM m, (VALUES ('majority', 1), ('stable', 2), ('absolute', 3)) t(line, line_no))"""


def nation_seats(spark, sf):
    per_key = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("seats"))
    return per_key.join(geography(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("nation").alias("party"), "seats"
    )


@query("majority_lines", f"{SIZE_SQL} SELECT members, line, CAST(needed AS BIGINT) AS needed, exact FROM l")
def majority_lines(spark, sf):
    total = nation_seats(spark, sf).agg(F.sum("seats").alias("total"))
    sizes = total.select(F.explode(F.array(F.col("total"), F.lit(465), F.lit(475))).alias("members")).distinct()
    return compare.majority_lines(sizes, "members").select("members", "line", "needed", "exact")


@query(
    "coalition_summary",
    f"""{SIZE_SQL}, co AS (SELECT c, p FROM (VALUES ('small', 'NATION_1'), ('small', 'NATION_2'), ('small', 'NATION_3')) t(c, p)
  UNION ALL SELECT 'large', party FROM s WHERE party <> 'NATION_4'),
h AS (SELECT c, CAST(SUM(seats) AS BIGINT) AS held FROM co JOIN s ON s.party = co.p GROUP BY 1)
SELECT c AS coalition, members, held, (ARRAY_AGG(line ORDER BY line_no DESC) FILTER (held >= needed))[1] AS reached,
       held * 1000 // members AS permille
FROM h, l WHERE members = (SELECT SUM(seats) FROM s) GROUP BY c, members, held""",
)
def coalition_summary(spark, sf):
    seats = nation_seats(spark, sf).select(
        F.explode(F.array(F.lit("small"), F.lit("large"))).alias("coalition"), "party", "seats"
    )
    member = F.when(
        F.col("coalition") == "small", F.col("party").isin("NATION_1", "NATION_2", "NATION_3")
    ).otherwise(F.col("party") != "NATION_4")
    rows = compare.coalition_summary(seats, seats.where(member).select("coalition", "party"), ["coalition"])
    return rows.select("coalition", "members", "held", "reached", F.expr("(held * 1000) div members").alias("permille"))


@query(
    "linkage_equivalence",
    f"WITH {V_SQL} SELECT DISTINCT contest, CAST(0 AS BIGINT) AS distance FROM v",
)
def linkage_equivalence(spark, sf):
    """Compensatory linkage cut at the list seats equals the head start: no contest is apart."""
    votes = voted(spark, sf).join(district_wins(spark, sf), "party").withColumn("seats", F.lit(SEATS))

    def one(linkage):
        return ap.apportion(
            votes, ["contest"], linkage=linkage, district_wins="wins", exhaustion=ap.VACANT
        ).groupBy("contest", "party").agg(F.count(F.lit(1)).alias("seats"))

    return compare.distance(one(ap.HEIYO), one(ap.RENYO), ["contest", "party"], ["contest"])
