"""Preference profiles and ranked choice.

Profile: segments as voter groups and targets. The rate of voter s for target t is
the order value (cents, modulo 101) of s's orders with t's priority, rounded to 5.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lists, profiles, ranked
from ..plans.votes import segment_cents
from ..session import cut_lineage
from .base import SEG_SQL, query
from .relations import ORDER_SEG, order_groups

TARGETS = {
    "1-URGENT": "AUTOMOBILE", "2-HIGH": "BUILDING", "3-MEDIUM": "FURNITURE",
    "4-NOT SPECIFIED": "HOUSEHOLD", "5-LOW": "MACHINERY",
}
DERIVED = {"TWIN": "BUILDING"}
UNPLACED, POSITION = "INDEPENDENT", 0.75

_CASE = " ".join(f"WHEN '{p}' THEN '{t}'" for p, t in TARGETS.items())
RATES_SQL = f"""{ORDER_SEG},
raw AS (SELECT segment AS voter, CASE priority {_CASE} END AS target, CAST(SUM(cents) % 101 AS INTEGER) AS raw FROM os GROUP BY 1, 2),
rt AS (SELECT voter, target, CAST(ROUND_EVEN(raw / 5.0, 0) * 5 AS INTEGER) AS rate FROM raw)"""
ORD_SQL = """bo AS (SELECT voter, target, CAST(ROW_NUMBER() OVER (PARTITION BY voter ORDER BY target <> voter, rate, target) - 1 AS INTEGER) AS pos FROM rt)"""
LAYER_SQL = """ly0 AS (SELECT voter, ROW_NUMBER() OVER w AS no, LAG(rate, 1, 100) OVER w - rate AS weight,
   LIST(target) OVER (PARTITION BY voter ORDER BY rate DESC, target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rejects
   FROM rt WINDOW w AS (PARTITION BY voter ORDER BY rate DESC, target)
 UNION ALL SELECT voter, COUNT(*) + 1, MIN(rate), LIST(target ORDER BY rate DESC, target) FROM rt GROUP BY 1),
ly AS (SELECT voter, CAST(ROW_NUMBER() OVER (PARTITION BY voter ORDER BY no) - 1 AS INTEGER) AS layer, CAST(weight AS INTEGER) AS weight,
   COALESCE(rejects, []) AS rejects FROM ly0 WHERE weight > 0)"""


def rates(spark, sf):
    target = F.lit(None).cast("string")
    for priority, name in TARGETS.items():
        target = F.when(F.col("priority") == priority, name).otherwise(target)
    raw = order_groups(spark, sf).groupBy(F.col("segment").alias("voter"), target.alias("target")).agg(
        (F.sum("cents") % 101).cast("int").alias("rate"))
    # A row per (voter, target), read by several steps: the orders are scanned once.
    return cut_lineage(profiles.rounded_rates(raw, 5))


@query("rejection_rates", f"WITH {RATES_SQL} SELECT voter, target, rate FROM rt")
def rejection_rates(spark, sf):
    return rates(spark, sf)


@query(
    "rejection_layers",
    f"WITH {RATES_SQL}, {LAYER_SQL} SELECT voter, layer, weight, array_to_string(rejects, ',') AS rejects FROM ly",
)
def rejection_layers(spark, sf):
    return profiles.layers(rates(spark, sf)).select("voter", "layer", "weight", F.array_join("rejects", ",").alias("rejects"))


@query("base_orderings", f"WITH {RATES_SQL}, {ORD_SQL} SELECT voter, pos, target FROM bo")
def base_orderings(spark, sf):
    return profiles.to_rows(profiles.base_orderings(rates(spark, sf)))


PROFILE_SQL = f"""{RATES_SQL}, {ORD_SQL},
sv AS (SELECT voter, LIST(target ORDER BY pos) AS o FROM bo GROUP BY 1),
mn AS (SELECT target, SUM(rate) AS m FROM rt GROUP BY 1),
al AS (SELECT voter, o FROM sv UNION ALL SELECT 'TWIN', list_prepend('TWIN', o) FROM sv WHERE voter = 'BUILDING'
  UNION ALL SELECT 'INDEPENDENT', list_prepend('INDEPENDENT', LIST(target ORDER BY m, target)) FROM mn),
tw AS (SELECT voter, CASE WHEN voter = 'TWIN' THEN o ELSE list_concat(o[1:list_position(o, 'BUILDING')], ['TWIN'], o[list_position(o, 'BUILDING') + 1:]) END AS o FROM al),
pf AS (SELECT voter, CASE WHEN voter = 'INDEPENDENT' THEN o ELSE
   list_concat(o[1:1 + CAST(ROUND_EVEN((len(o) - 1) * 0.75, 0) AS INTEGER)], ['INDEPENDENT'], o[2 + CAST(ROUND_EVEN((len(o) - 1) * 0.75, 0) AS INTEGER):]) END AS o FROM tw)"""


@query("profile_build", f"WITH {PROFILE_SQL} SELECT voter, array_to_string(o, ',') AS ordering FROM pf")
def profile_build(spark, sf):
    built = profiles.build_profile(rates(spark, sf), DERIVED, UNPLACED, POSITION)
    return built.select("voter", F.array_join("ordering", ",").alias("ordering"))


@query(
    "profile_matrix",
    f"""WITH {RATES_SQL}, c AS (SELECT voter, target, rate FROM rt UNION ALL SELECT voter, 'TWIN', rate FROM rt WHERE target = 'BUILDING')
SELECT voter, target, rate FROM c UNION ALL SELECT 'TWIN', target, rate FROM c WHERE voter = 'BUILDING'""",
)
def profile_matrix(spark, sf):
    return profiles.complete_matrix(rates(spark, sf), DERIVED)


@query(
    "profile_check",
    """SELECT DISTINCT c_mktsegment AS voter, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'own group is not first'
  WHEN 'BUILDING' THEN 'not a permutation of all groups' ELSE 'rate matrix is not square' END AS problem
FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')""",
)
def profile_check(spark, sf):
    """The built profile with one fault of each kind put in: these and no others are found."""
    r = rates(spark, sf)
    ordering = F.when(F.col("voter") == "AUTOMOBILE", F.reverse("ordering")).when(
        F.col("voter") == "BUILDING", F.slice("ordering", F.lit(1), F.size("ordering") - 1)).otherwise(F.col("ordering"))
    matrix = profiles.complete_matrix(r, DERIVED).where("NOT (voter = 'MACHINERY' AND target = 'TWIN')")
    return profiles.profile_problems(
        profiles.build_profile(r, DERIVED, UNPLACED, POSITION).withColumn("ordering", ordering), matrix)


OVERRIDE_SQL = f"""{PROFILE_SQL},
ov(voter, target, rate) AS (VALUES ('AUTOMOBILE', 'BUILDING', 0), ('AUTOMOBILE', 'MACHINERY', 100), ('BUILDING', 'FURNITURE', 50),
  ('MACHINERY', 'TWIN', 35), ('TWIN', 'HOUSEHOLD', 95)),
c1 AS (SELECT voter, target, rate FROM rt UNION ALL SELECT voter, 'TWIN', rate FROM rt WHERE target = 'BUILDING'),
mx AS (SELECT voter, target, rate FROM c1 UNION ALL SELECT 'TWIN', target, rate FROM c1 WHERE voter = 'BUILDING'),
r2 AS (SELECT mx.voter, mx.target, COALESCE(ov.rate, mx.rate) AS rate FROM mx LEFT JOIN ov ON ov.voter = mx.voter AND ov.target = mx.target)"""


def overridden(spark, sf):
    changes = spark.createDataFrame(
        [("AUTOMOBILE", "BUILDING", 0), ("AUTOMOBILE", "MACHINERY", 100), ("BUILDING", "FURNITURE", 50),
         ("MACHINERY", "TWIN", 35), ("TWIN", "HOUSEHOLD", 95)], "voter string, target string, rate int")
    return profiles.override_rates(profiles.complete_matrix(rates(spark, sf), DERIVED), changes)


@query("rate_override", f"WITH {OVERRIDE_SQL} SELECT voter, target, CAST(rate AS INTEGER) AS rate FROM r2")
def rate_override(spark, sf):
    return overridden(spark, sf)


@query(
    "orderings",
    f"""WITH {OVERRIDE_SQL}, rk AS (SELECT voter, LIST(target ORDER BY target <> voter, rate, target) AS o FROM r2 GROUP BY 1),
j AS (SELECT pf.voter, pf.o AS stored, rk.o AS o, list_position(pf.o, 'INDEPENDENT') AS p FROM pf LEFT JOIN rk ON rk.voter = pf.voter)
SELECT voter, array_to_string(CASE WHEN o IS NULL THEN stored ELSE list_concat(o[1:p - 1], ['INDEPENDENT'], o[p:]) END, ',') AS ordering FROM j""",
)
def orderings(spark, sf):
    """Orderings rebuilt after single rates changed; the unrated group keeps its place."""
    stored = profiles.build_profile(rates(spark, sf), DERIVED, UNPLACED, POSITION)
    return profiles.orderings_from_rates(stored, overridden(spark, sf)).select(
        "voter", F.array_join("ordering", ",").alias("ordering"))


def _rounds_sql() -> str:
    """Four eliminations of five candidates, unrolled. Votes are scaled by 100."""
    out = [
        f"WITH {SEG_SQL}, {RATES_SQL}, {ORD_SQL}, {LAYER_SQL}",
        "ac AS (SELECT ly.voter AS src, layer, pos, target FROM ly JOIN bo USING (voter) WHERE NOT list_contains(rejects, target))",
        "s1 AS (SELECT nation, segment AS cand, segment AS src, layer, CAST(votes * weight AS HUGEINT) AS w FROM seg JOIN ly ON ly.voter = segment)",
    ]
    for r in range(1, 6):
        out += [
            f"t{r} AS (SELECT nation, cand, SUM(w) AS v FROM s{r} GROUP BY 1, 2)",
            f"""d{r} AS (SELECT nation, SUM(v) AS total, COUNT(*) AS n, (ARRAY_AGG(cand ORDER BY v DESC, cand))[1] AS leader, MAX(v) AS top,
   (ARRAY_AGG(cand ORDER BY v, cand))[1] AS loser FROM t{r} GROUP BY 1)""",
            f"x{r} AS (SELECT *, n = 1 OR top * 2 > total AS decided FROM d{r})",
        ]
        if r < 5:
            out += [
                f"""b{r} AS (SELECT s.nation, s.src, s.layer, SUM(w) AS w, COUNT(*) AS n FROM s{r} s JOIN x{r} x ON x.nation = s.nation AND NOT decided AND s.cand = loser GROUP BY 1, 2, 3)""",
                f"""c{r} AS (SELECT b.nation, b.src, b.layer, b.w, (SELECT ac.target FROM ac JOIN t{r} t ON t.nation = b.nation AND t.cand = ac.target
   WHERE ac.src = b.src AND ac.layer = b.layer AND t.cand <> x.loser ORDER BY pos LIMIT 1) AS target FROM b{r} b JOIN x{r} x ON x.nation = b.nation)""",
                f"""s{r + 1} AS (SELECT s.nation, s.cand, s.src, s.layer, s.w FROM s{r} s JOIN x{r} x ON x.nation = s.nation AND NOT decided AND s.cand <> loser
   UNION ALL SELECT nation, target, src, layer, w FROM c{r} WHERE target IS NOT NULL)""",
            ]
    return ", ".join(out)


ROUNDS_SQL = _rounds_sql()
_WIN = " UNION ALL ".join(f"SELECT nation, leader AS winner, {r} AS rounds FROM x{r} WHERE decided" for r in range(1, 6))
_EXH = " UNION ALL ".join(f"SELECT nation, w FROM c{r} WHERE target IS NULL" for r in range(1, 5))


def tabulated(spark, sf):
    r = rates(spark, sf)
    seg = cut_lineage(segment_cents(spark, sf)).select(
        "region", "nation", F.col("segment").alias("name"), F.col("segment").alias("party"), "votes")
    order = profiles.to_rows(profiles.base_orderings(r))
    return seg, order, ranked.runoff(seg, profiles.layers(r), order, ["nation"])


@query(
    "instant_runoff",
    f"""{ROUNDS_SQL}, win AS ({_WIN}), ex AS ({_EXH}), e AS (SELECT nation, SUM(w) AS w FROM ex GROUP BY 1)
SELECT win.nation, winner, CAST(rounds AS INTEGER) AS rounds, CAST(COALESCE(w, 0) AS BIGINT) AS exhausted_hundredths FROM win LEFT JOIN e USING (nation)""",
)
def instant_runoff(spark, sf):
    _, _, result = tabulated(spark, sf)
    return result.winners().join(result.exhausted_votes(), "nation", "left").select(
        "nation", "winner", "rounds",
        (F.coalesce("exhausted", F.lit(0)) * 100).cast("bigint").alias("exhausted_hundredths"))


_STAND = " UNION ALL ".join(
    f"SELECT t.nation, {r} AS round, t.cand AS name, t.v, x.total, x.decided, t.cand = x.leader AS leader FROM t{r} t JOIN x{r} x ON x.nation = t.nation" for r in range(1, 6))


@query(
    "runoff_standings",
    f"""{ROUNDS_SQL}, st AS ({_STAND}) SELECT nation, CAST(round AS INTEGER) AS round, name, CAST(v AS BIGINT) AS vote_hundredths,
  CAST(v * 1000 // total AS BIGINT) AS permille, decided, leader FROM st""",
)
def runoff_standings(spark, sf):
    _, _, result = tabulated(spark, sf)
    return result.standings.select(
        "nation", "round", "name", (F.col("votes") * 100).cast("bigint").alias("vote_hundredths"),
        F.floor(F.col("share") * 10 + 1e-9).cast("bigint").alias("permille"), "decided", "leader")


_LOG = " UNION ALL ".join(
    f"""SELECT x.nation, {r} AS round, x.n AS standing, CASE WHEN NOT decided THEN loser END AS eliminated,
  (SELECT COUNT(*) FROM c{r} c WHERE c.nation = x.nation AND target IS NOT NULL) AS moved_parcels FROM x{r} x""" for r in range(1, 5)
) + " UNION ALL SELECT nation, 5, n, NULL, 0 FROM x5"


@query("runoff_log", f"{ROUNDS_SQL}, lg AS ({_LOG}) SELECT nation, CAST(round AS INTEGER) AS round, standing, eliminated, moved_parcels FROM lg")
def runoff_log(spark, sf):
    _, _, result = tabulated(spark, sf)
    moved = result.transfers.groupBy("nation", "round").agg(F.sum("parcels").alias("moved_parcels"))
    return result.log().join(moved, ["nation", "round"], "left").select(
        "nation", "round", "standing", "eliminated", F.coalesce("moved_parcels", F.lit(0)).alias("moved_parcels"))


@query(
    "runoff_flips",
    f"""{ROUNDS_SQL}, win AS ({_WIN}) SELECT win.nation, x1.leader AS from_name, winner AS to_name, CAST(rounds AS INTEGER) AS rounds
FROM win JOIN x1 ON x1.nation = win.nation WHERE winner <> x1.leader""",
)
def runoff_flips(spark, sf):
    seg, _, result = tabulated(spark, sf)
    return ranked.flips(result, lists.plurality(seg, ["nation"])).select("nation", "from_name", "to_name", "rounds")


@query(
    "secured_contests",
    f"WITH {SEG_SQL} SELECT nation, MAX(votes) * 2 > SUM(votes) AS secured FROM seg GROUP BY 1",
)
def secured_contests(spark, sf):
    return ranked.secured(segment_cents(spark, sf), ["nation"])


@query(
    "unordered_parties",
    f"""WITH {SEG_SQL}, p AS (SELECT segment AS party, CAST(SUM(votes) AS BIGINT) AS votes FROM seg GROUP BY 1)
SELECT party, votes, CAST(FLOOR(votes * 1000 / (SELECT SUM(votes) FROM p)) AS BIGINT) AS permille, votes * 100.0 / (SELECT SUM(votes) FROM p) < 20 AS minor
FROM p WHERE party IN ('HOUSEHOLD', 'MACHINERY')""",
)
def unordered_parties(spark, sf):
    order = profiles.to_rows(profiles.base_orderings(rates(spark, sf))).where("voter NOT IN ('HOUSEHOLD', 'MACHINERY')")
    seg = segment_cents(spark, sf).select(F.col("segment").alias("party"), "votes")
    return ranked.unordered_parties(seg, order, 20.0).select(
        "party", "votes", F.floor(F.col("share") * 10).cast("bigint").alias("permille"), "minor")
