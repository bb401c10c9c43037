"""The 35 consistency checks over the 20 election tables.

All elections are checked in one job; ``election_id`` is a key everywhere. Checks
whose tables are absent are left out. ``run`` returns the graded results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import BLOCK_TOTAL, GRAND_TOTAL, TOTAL, any_required_missing, fold_uncertified, within
from ..operators import apportion as ap
from ..operators.linkage import disagreements
from ..operators.scan import join_null_safe
from ..sources.dimensions import BLOCKS, PREFECTURES, is_prefecture
from ..sources.schemas import PERSONAL_TABLES, TABLES
from . import quality as q
from .election_data import BLOCK_PARTY, DISTRICT, E, SEATED, UNSEATED, district_id, link_duals
from .quality import Check

NUMBER_OF_PREFECTURES = len(PREFECTURES)
REGISTRY: dict[str, tuple[tuple[str, ...], Callable]] = {}


def check(check_id: str, *needs: str):
    """Register a check function and the tables it needs."""

    def add(fn):
        REGISTRY[check_id] = (needs, fn)
        return fn

    return add


def path(*cols):
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def pct(part, whole, digits):
    return F.bround(part / F.nullif(whole, F.lit(0)) * 100, digits)


def per_election(cfg: DataFrame, n: int) -> DataFrame:
    return cfg.select(*E, F.lit(n).cast("bigint").alias("n"))


def bad_rows(df, subject, detail=None):
    return df.select(
        *E, subject.cast("string").alias("subject"),
        (detail if detail is not None else F.lit("")).cast("string").alias("detail"),
    )


def versus(df, subject):
    """Violations of a ``reconcile`` result."""
    return bad_rows(
        df.where(~F.col("ok")), subject,
        F.concat(F.coalesce(F.col("computed").cast("string"), F.lit("-")), F.lit(" / "),
                 F.coalesce(F.col("published").cast("string"), F.lit("-"))),
    )


def union_checks(*frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- A: identities inside a table -------------------------------------------------

MEASURES = ("electors", "voters", "abstainers")


@check("A1", "electorate")
def a1(t, cfg):
    long = t["electorate"].select(
        *E, "tier", "scope", "prefecture",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("measure"), F.col(f"{m}_male").alias("m"), F.col(f"{m}_female").alias("f"),
                     F.col(f"{m}_total").alias("t")) for m in MEASURES])).alias("x"),
    ).select("*", "x.*")
    return q.row_check("A1", "A", "male + female = total of electors, voters, abstainers", long,
                       path("tier", "scope", "prefecture", "measure"),
                       q.zero(F.col("m")) + q.zero(F.col("f")) == q.zero(F.col("t")), path("m", "f", "t"), E)


@check("A2", "electorate")
def a2(t, cfg):
    e, v, a = (q.zero(F.col(f"{m}_total")) for m in MEASURES)
    return q.row_check("A2", "A", "electors = voters + abstainers", t["electorate"],
                       path("tier", "scope", "prefecture"), v + a == e,
                       path("voters_total", "abstainers_total", "electors_total"), E)


@check("A3", "ballots_smd_by_pref", "ballots_pr_by_block_pref")
def a3(t, cfg):
    rows = t["ballots_smd_by_pref"].unionByName(t["ballots_pr_by_block_pref"])
    total, valid, invalid = F.col("total_ballots"), F.col("valid_votes"), F.col("invalid_votes")
    sums = bad_rows(rows.where(~F.coalesce(valid + invalid == total, F.lit(False))), path("tier", "block", "prefecture"),
                    path("valid_votes", "invalid_votes", "total_ballots"))
    rate = F.abs(pct(invalid, total, 2) - F.col("invalid_rate_pct")) <= 0.01
    rates = bad_rows(rows.where(~F.coalesce(rate, F.lit(False))), F.concat(path("tier", "prefecture"), F.lit(" rate")),
                     F.col("invalid_rate_pct"))
    return Check("A3", "A", "ballots = valid + invalid; invalid rate recomputed", q.count_subjects(rows, E), sums.unionByName(rates))


PLACE = [*E, "tier", "scope", "block", "prefecture"]


@check("A4", "electorate", "turnout")
def a4(t, cfg):
    rows = join_null_safe(t["electorate"].select(*PLACE, "electors_total", "voters_total"),
                          t["turnout"].select(*PLACE, "rate_total"), PLACE, "inner")
    e = F.col("electors_total")
    ok = (q.zero(e) == 0) | F.col("rate_total").isNull() | (F.abs(pct(F.col("voters_total"), e, 2) - F.col("rate_total")) <= 0.01)
    return q.row_check("A4", "A", "turnout = voters / electors x 100", rows, path("tier", "scope", "block", "prefecture"),
                       ok, F.col("rate_total"), E)


@check("A5", "turnout")
def a5(t, cfg):
    a, b, d = F.col("rate_total"), F.col("prev_rate_total"), F.col("diff_total")
    rows = t["turnout"].where(a.isNotNull() & b.isNotNull() & d.isNotNull())
    return q.row_check("A5", "A", "change of turnout = this - previous", rows, path("tier", "scope", "prefecture"),
                       F.abs((a - b) - d) <= 0.01, path("rate_total", "prev_rate_total", "diff_total"), E)


@check("A6", "electorate")
def a6(t, cfg):
    totals = [f"{m}_total" for m in MEASURES]
    groups = cfg.select(*E, F.explode(F.array(F.lit("smd"), F.lit("pr"))).alias("tier")).select(
        "*", F.explode(F.array(F.lit("all"), F.lit("overseas"))).alias("scope"))
    member, grand = is_prefecture("prefecture"), F.col("prefecture") == GRAND_TOTAL
    sums = t["electorate"].groupBy(*E, "tier", "scope").agg(
        F.count_if(member).alias("members"), F.count_if(grand).alias("grands"),
        *[F.sum(F.when(member, q.zero(F.col(c)))).alias(f"s_{c}") for c in totals],
        *[F.min(F.when(grand, F.col(c))).alias(f"g_{c}") for c in totals],
    )
    rows = groups.join(sums, [*E, "tier", "scope"], "left").withColumn(
        "whole", (q.zero(F.col("members")) == NUMBER_OF_PREFECTURES) & (q.zero(F.col("grands")) > 0))
    shape = bad_rows(rows.where("NOT whole"), path("tier", "scope"), path("members", "grands"))
    long = rows.where("whole").select(*E, "tier", "scope", F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(f"s_{c}").alias("s"), F.col(f"g_{c}").alias("g")) for c in totals])).alias("x")
    ).select("*", "x.*")
    sums_bad = bad_rows(long.where(~F.col("s").eqNullSafe(F.col("g"))), path("tier", "scope", "measure"), path("s", "g"))
    return Check("A6", "A", "prefectures add up to the grand total", q.count_subjects(rows.where("whole"), E), shape.unionByName(sums_bad))


@check("A7", "party_votes_by_block_pref")
def a7(t, cfg):
    keys = [*E, "block", "party"]
    rows = t["party_votes_by_block_pref"]
    members = rows.where(is_prefecture("prefecture")).groupBy(*keys).agg(F.sum(q.zero(F.col("votes"))).alias("value"))
    printed = rows.where(F.col("prefecture") == BLOCK_TOTAL).select(*keys, F.col("votes").alias("value"))
    both = q.reconcile(members, printed, keys, policy=q.PRINTED, how="right")
    # A printed subtotal without any member row needs to be zero as well.
    both = both.withColumn("ok", F.col("ok") | (q.zero(F.col("computed")) == q.zero(F.col("published"))))
    return Check("A7", "A", "prefectures add up to the block subtotal", q.count_subjects(printed, E), versus(both, path("block", "party")))


@check("A8", "party_votes_by_pref_smd")
def a8(t, cfg):
    m, f, total = (q.zero(F.col(f"votes_{s}")) for s in ("male", "female", "total"))
    return q.row_check("A8", "A", "male + female = total of party votes", t["party_votes_by_pref_smd"],
                       path("prefecture", "party"), m + f == total, path("votes_male", "votes_female", "votes_total"), E)


# --- B: districts -----------------------------------------------------------------

def district_sums(t):
    return t["smd_candidates"].groupBy(*DISTRICT).agg(
        F.sum("votes").alias("sum_votes"), F.max("votes").alias("top"),
        F.bool_or(F.col("votes") != F.floor("votes")).alias("has_fraction"),
        F.count_if("elected").alias("winners"),
        F.max(F.when(F.col("elected"), F.col("votes"))).alias("winner_votes"),
    )


@check("B1", "smd_districts", "smd_candidates")
def b1(t, cfg):
    rows = t["smd_districts"].join(district_sums(t), DISTRICT, "left")
    diff = F.col("deposit_forfeit_point") * 10 - q.zero(F.col("sum_votes"))
    ok = (diff == 0) | (F.coalesce("has_fraction", F.lit(False)) & (diff > 0) & (diff < 1))
    return q.row_check("B1", "B", "candidate votes = ten times the forfeit point", rows, district_id(), ok, diff, E)


@check("B2", "smd_districts", "smd_candidates")
def b2(t, cfg):
    rows = t["smd_districts"].join(district_sums(t), DISTRICT, "left")
    return q.row_check("B2", "B", "one winner per district, with the most votes", rows, district_id(),
                       (F.col("winners") == 1) & (F.col("winner_votes") == F.col("top")), path("winners", "winner_votes", "top"), E)


@check("B3", "smd_districts", "smd_candidates")
def b3(t, cfg):
    rows = t["smd_candidates"].where("sekihai_rate IS NOT NULL").join(district_sums(t).select(*DISTRICT, "top"), DISTRICT)
    ok = F.abs(pct(F.col("votes"), F.col("top"), 3) - F.col("sekihai_rate")) <= 0.001
    return q.row_check("B3", "B", "loser ratio recomputed", rows, F.concat(district_id(), F.lit(" "), F.col("name_display")),
                       ok, F.col("sekihai_rate"), E)


@check("B4", "smd_districts", "smd_candidates")
def b4(t, cfg):
    rows = t["smd_candidates"].join(t["smd_districts"].select(*DISTRICT, "deposit_forfeit_point"), DISTRICT, "left")
    expect = F.coalesce(F.col("dual_candidacy"), F.lit(False)) & (F.col("votes") < F.col("deposit_forfeit_point"))
    return q.row_check("B4", "B", "excluded mark = dual candidacy below the forfeit point", rows,
                       F.concat(district_id(), F.lit(" "), F.col("name_display")),
                       expect == F.coalesce(F.col("sekihai_excluded"), F.lit(False)), F.col("sekihai_excluded"), E)


@check("B5", "smd_districts", "candidacy_by_pref_party")
def b5(t, cfg):
    d = t["smd_districts"]
    count = d.groupBy(*E).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("prefecture").alias("prefs"))
    total = cfg.join(count, E, "left")
    by_pref = q.contiguous(d, [*E, "prefecture"], "district_no")
    printed = t["candidacy_by_pref_party"].where(is_prefecture("prefecture")).groupBy(*E, "prefecture").agg(
        F.max("seats").alias("printed"))
    seats = by_pref.join(printed, [*E, "prefecture"], "left")
    bad = union_checks(
        bad_rows(total.where(~F.col("n").eqNullSafe(F.col("smd_seats"))), F.lit("districts"), F.col("n")),
        bad_rows(total.where(~F.col("prefs").eqNullSafe(F.lit(NUMBER_OF_PREFECTURES))), F.lit("prefectures"), F.col("prefs")),
        bad_rows(by_pref.where("NOT ok"), F.col("prefecture"), F.lit("numbers are not 1..n")),
        bad_rows(seats.where(~F.col("n").eqNullSafe(F.col("printed"))), F.col("prefecture"), path("n", "printed")),
    )
    return Check("B5", "B", "districts: count, numbering, printed seats", q.count_subjects(d, E), bad)


# --- C: across tables -------------------------------------------------------------

def folded(t):
    return t["smd_candidates"].withColumn("party", fold_uncertified(F.col("party"), F.col("party_is_certified")))


def with_total(sums: DataFrame) -> DataFrame:
    """Per-party sums with the grand total appended."""
    return sums.unionByName(sums.groupBy(*E).agg(F.sum("value").alias("value")).withColumn("party", F.lit(TOTAL)))


def current(df):
    return df.where("period = 'current' AND votes IS NOT NULL").select(*E, "party", F.col("votes").alias("value"))


@check("C1", "smd_candidates", "party_votes_smd_total")
def c1(t, cfg):
    got = with_total(folded(t).groupBy(*E, "party").agg(F.sum("votes").alias("value")))
    both = q.reconcile(got, current(t["party_votes_smd_total"]), [*E, "party"])
    return Check("C1", "C", "candidate votes by party = national table", q.count_subjects(both, E), versus(both, F.col("party")))


@check("C2", "smd_candidates", "party_votes_by_pref_smd")
def c2(t, cfg):
    keys = [*E, "prefecture", "party"]
    got = folded(t).groupBy(*keys).agg(F.sum("votes").alias("value"))
    want = t["party_votes_by_pref_smd"].where(is_prefecture("prefecture") & (F.col("party") != TOTAL)).select(
        *keys, F.col("votes_total").alias("value"))
    both = q.reconcile(got, want, keys, policy=q.NULL_IS_ZERO)
    return Check("C2", "C", "candidate votes by prefecture and party = regional table", q.count_subjects(both, E),
                 versus(both, path("prefecture", "party")))


def all_prefectures(cfg):
    return cfg.select(*E, F.explode(F.array(*[F.lit(p) for p in PREFECTURES])).alias("prefecture"))


@check("C3", "smd_candidates", "ballots_smd_by_pref")
def c3(t, cfg):
    keys = [*E, "prefecture"]
    got = t["smd_candidates"].groupBy(*keys).agg(F.sum("votes").alias("got"))
    want = t["ballots_smd_by_pref"].select(*keys, F.col("valid_votes").alias("want"))
    rows = all_prefectures(cfg).join(got, keys, "left").join(want, keys, "left")
    diff = q.zero(F.col("want")) - q.zero(F.col("got"))
    return q.row_check("C3", "C", "candidate votes = valid votes per prefecture, short by less than one", rows,
                       F.col("prefecture"), (diff >= 0) & (diff < 1), path("got", "want"), E)


def block_votes(t):
    """Printed votes per (block, party), the block total as its own party."""
    return t["party_votes_by_block"].select(
        *E, "block", F.when(F.col("is_total_row"), F.lit(TOTAL)).otherwise(F.col("party")).alias("party"),
        F.col("votes").alias("value"), "share_pct", "is_total_row")


@check("C4", "party_votes_by_block_pref", "party_votes_by_block")
def c4(t, cfg):
    got = t["party_votes_by_block_pref"].where(is_prefecture("prefecture")).groupBy(*BLOCK_PARTY).agg(
        F.sum(q.zero(F.col("votes"))).alias("value"))
    both = q.reconcile(got, block_votes(t), BLOCK_PARTY, policy=q.PRINTED)
    return Check("C4", "C", "prefecture votes = block table", q.count_subjects(both, E), versus(both, path("block", "party")))


@check("C5", "party_votes_by_block", "party_votes_pr_total")
def c5(t, cfg):
    got = with_total(t["party_votes_by_block"].where("NOT is_total_row").groupBy(*E, "party").agg(F.sum("votes").alias("value")))
    both = q.reconcile(got, current(t["party_votes_pr_total"]), [*E, "party"])
    return Check("C5", "C", "block votes by party = national table", q.count_subjects(both, E), versus(both, F.col("party")))


@check("C6", "party_votes_by_block", "ballots_pr_by_block_pref")
def c6(t, cfg):
    keys = [*E, "block"]
    single = [b for b, members in BLOCKS.items() if " " not in members]
    got = block_votes(t).where("is_total_row").select(*keys, "value")
    rows = t["ballots_pr_by_block_pref"]
    want = rows.where(
        (F.col("prefecture") == BLOCK_TOTAL) | (is_prefecture("prefecture") & F.col("block").isin(*single))
    ).groupBy(*keys).agg(F.coalesce(
        F.max(F.when(F.col("prefecture") == BLOCK_TOTAL, F.col("valid_votes"))), F.max("valid_votes")).alias("value"))
    blocks = cfg.select(*E, F.explode(F.array(*[F.lit(b) for b in BLOCKS])).alias("block"))
    both = blocks.join(q.reconcile(got, want, keys, shortfall=True), keys, "left").withColumn(
        "ok", F.coalesce("ok", F.lit(False)))
    return Check("C6", "C", "block totals = valid votes, short by less than one", per_election(cfg, len(BLOCKS)), versus(both, F.col("block")))


@check("C7", "smd_candidates", "winners_by_pref_party")
def c7(t, cfg):
    keys = [*E, "prefecture"]
    got = t["smd_candidates"].where("elected").groupBy(*keys).agg(F.count(F.lit(1)).alias("got"))
    want = t["winners_by_pref_party"].where(F.col("party") == TOTAL).select(*keys, q.zero(F.col("total")).alias("want"))
    rows = all_prefectures(cfg).join(got, keys, "left").join(want, keys, "left")
    return q.row_check("C7", "C", "winners per prefecture = printed totals", rows, F.col("prefecture"),
                       q.zero(F.col("got")) == F.col("want"), path("got", "want"), E)


@check("C7b", "smd_candidates", "winners_by_pref_party")
def c7b(t, cfg):
    keys = [*E, "prefecture", "party"]
    got = folded(t).where("elected").groupBy(*keys).agg(F.count(F.lit(1)).alias("got"))
    want = t["winners_by_pref_party"].where(is_prefecture("prefecture") & (F.col("party") != TOTAL)).select(
        *keys, q.zero(F.col("total")).alias("want"))
    return q.row_check("C7b", "C", "winners per prefecture and party = printed columns", want.join(got, keys, "left"),
                       path("prefecture", "party"), q.zero(F.col("got")) == F.col("want"), path("got", "want"), E)


def totals_against(cfg, frames: list[tuple[str, DataFrame, str]]):
    """Compare computed numbers per election with configured columns."""
    asked = F.explode(F.array(*[
        F.struct(F.lit(label).alias("measure"), F.col(want).cast("bigint").alias("value")) for label, _, want in frames])).alias("a")
    got = [df.select(*E, F.lit(label).alias("measure"), F.col("n").cast("bigint").alias("value")) for label, df, _ in frames]
    both = q.expected_totals(union_checks(*got), cfg.select(*E, asked).select(*E, "a.*"), [*E, "measure"], absent=0)
    bad = both.where("asked AND NOT ok").withColumn("computed", q.zero(F.col("computed")))
    return bad_rows(bad, F.col("measure"), path("computed", "expected"))


@check("C8", "smd_candidates", "pr_party_blocks", "pr_list_entries")
def c8(t, cfg):
    bad = totals_against(cfg, [
        ("district winners", t["smd_candidates"].groupBy(*E).agg(F.count_if("elected").alias("n")), "smd_seats"),
        ("list seats", t["pr_party_blocks"].groupBy(*E).agg(F.sum(q.zero(F.col("seats"))).alias("n")), "pr_seats"),
        ("list marks", t["pr_list_entries"].groupBy(*E).agg(F.count_if("elected_pr").alias("n")), "pr_seats"),
    ])
    return Check("C8", "C", "seat totals = configuration", per_election(cfg, 3), bad)


@check("C9", "pr_party_blocks", "party_votes_by_block")
def c9(t, cfg):
    heads = t["pr_party_blocks"].select(*BLOCK_PARTY, F.col("votes").alias("value"))
    both = q.reconcile(heads, block_votes(t), BLOCK_PARTY, how="left")
    return Check("C9", "C", "list header votes = block table", q.count_subjects(heads, E), versus(both, path("block", "party")))


@check("C10", "smd_candidates", "pr_list_entries")
def c10(t, cfg):
    left, right, found = link_duals(t)
    mark = F.when(F.col("elected"), SEATED).otherwise(UNSEATED)
    wrong = disagreements(found.pairs, left, right, "cid", "lid", [
        (mark, F.col("smd_result"), "result"),
        (F.col("sekihai_rate"), F.col("sekihai_rate"), "rate"),
        (F.col("sekihai_excluded"), F.col("sekihai_excluded"), "excluded"),
    ]).join(left.select(*E, "cid", "name_display"), "cid")
    bad = union_checks(
        bad_rows(found.left_rest, path("prefecture", "district_no", "name_display"), F.lit("not on a list")),
        bad_rows(found.right_rest, path("block", "party", "name"), F.lit("not among the dual candidates")),
        bad_rows(wrong, path("name_display", "attribute"), path("left_value", "right_value")),
    )
    return Check("C10", "C", "dual candidates linked both ways with equal attributes", q.count_subjects(left, E), bad)


@check("C11", "party_votes_by_block")
def c11(t, cfg):
    rows = block_votes(t)
    totals = rows.where("is_total_row").select(*E, "block", F.col("value").alias("total"))
    parts = rows.where("NOT is_total_row AND share_pct IS NOT NULL").join(totals, [*E, "block"], "left")
    return q.row_check("C11", "C", "share of votes recomputed", parts, path("block", "party"),
                       F.abs(pct(F.col("value"), F.col("total"), 2) - F.col("share_pct")) <= 0.01, F.col("share_pct"), E)


@check("C12", "smd_candidates", "candidacy_by_pref_age", "candidacy_by_party", "winners_by_pref_age")
def c12(t, cfg):
    def whole(name):
        return t[name].where((F.col("prefecture") == GRAND_TOTAL) & (F.col("age_band") == BLOCK_TOTAL)).groupBy(*E).agg(
            F.min("count").alias(name))

    people = t["smd_candidates"].groupBy(*E).agg(F.count(F.lit(1)).alias("people"))
    section = t["candidacy_by_party"].where(
        (F.col("section") == "smd") & (F.col("status") == BLOCK_TOTAL) & (F.col("party") == TOTAL)
    ).groupBy(*E).agg(F.min("total").alias("by_party"))
    rows = cfg
    for df in (people, whole("candidacy_by_pref_age"), section, whole("winners_by_pref_age")):
        rows = rows.join(df, E, "left")
    bad = union_checks(
        bad_rows(rows.where(~F.col("candidacy_by_pref_age").eqNullSafe(q.zero(F.col("people")))), F.lit("candidates by age"), path("people", "candidacy_by_pref_age")),
        bad_rows(rows.where(F.col("by_party") != q.zero(F.col("people"))), F.lit("candidates by party"), path("people", "by_party")),
        bad_rows(rows.where(~F.col("winners_by_pref_age").eqNullSafe(F.col("smd_seats"))), F.lit("winners by age"), path("winners_by_pref_age", "smd_seats")),
    )
    return Check("C12", "C", "headline counts agree", per_election(cfg, 3), bad)


# --- D: allocation ----------------------------------------------------------------

def list_votes(t):
    return t["party_votes_by_block"].where("NOT is_total_row").select(*BLOCK_PARTY, "votes")


def allocated(t):
    """Seats recomputed with list capacities; votes scaled to whole numbers."""
    open_entries = t["pr_list_entries"].where(
        ~F.col("smd_result").eqNullSafe(SEATED) & ~F.coalesce("sekihai_excluded", F.lit(False)))
    capacity = open_entries.groupBy(*BLOCK_PARTY).agg(F.count(F.lit(1)).alias("capacity"))
    seats = t["pr_party_blocks"].groupBy(*E, "block").agg(F.sum(q.zero(F.col("seats"))).alias("seats"))
    rows = list_votes(t).join(capacity, BLOCK_PARTY, "left").join(seats, [*E, "block"]).withColumn(
        "votes", (F.col("votes") * 1000).cast("bigint"))
    return ap.apportion(rows, [*E, "block"], capacity="capacity")


@check("D1", "dhondt_quotients", "party_votes_by_block")
def d1(t, cfg):
    rows = t["dhondt_quotients"].join(list_votes(t), BLOCK_PARTY, "left")
    ok = F.abs(F.bround(F.col("votes") / F.col("divisor"), 3) - F.col("quotient")) <= 0.001
    return q.row_check("D1", "D", "printed quotient = votes / divisor", rows, path("block", "party", "divisor"), ok, path("votes", "quotient"), E)


@check("D2", "party_votes_by_block", "pr_party_blocks", "pr_list_entries")
def d2(t, cfg):
    got = allocated(t).groupBy(*BLOCK_PARTY).agg(F.count(F.lit(1)).alias("got"))
    want = t["pr_party_blocks"].select(*BLOCK_PARTY, q.zero(F.col("seats")).alias("want"))
    rows = list_votes(t).join(got, BLOCK_PARTY, "left").join(want, BLOCK_PARTY, "left")
    bad = bad_rows(rows.where(q.zero(F.col("got")) != q.zero(F.col("want"))), path("block", "party"), path("got", "want"))
    blocks = list_votes(t).select(*E, "block").distinct()
    return Check("D2", "D", "recomputed allocation = printed seats", q.count_subjects(blocks, E), bad, allow=False)


@check("D3", "party_votes_by_block", "pr_party_blocks", "pr_list_entries", "dhondt_quotients")
def d3(t, cfg):
    got = allocated(t).select(*E, "block", "award_no", "party", "divisor")
    want = t["dhondt_quotients"].where("seat_rank IS NOT NULL").select(
        *E, "block", F.col("seat_rank").alias("award_no"), F.col("party").alias("w_party"), F.col("divisor").alias("w_divisor"))
    rows = got.join(want, [*E, "block", "award_no"], "left")
    ok = F.col("party").eqNullSafe(F.col("w_party")) & F.col("divisor").eqNullSafe(F.col("w_divisor"))
    return q.row_check("D3", "D", "award order = printed rank", rows, path("block", "award_no"), ok, path("party", "divisor", "w_party", "w_divisor"), E)


# --- E: structure -----------------------------------------------------------------

@check("E1", "smd_districts", "party_votes_by_block")
def e1(t, cfg):
    blocks = cfg.select(*E, F.explode(F.array(*[F.lit(b) for b in BLOCKS])).alias("block"))
    a = q.set_difference(t["smd_districts"], all_prefectures(cfg), [*E, "prefecture"])
    b = q.set_difference(t["party_votes_by_block"], blocks, [*E, "block"])
    bad = bad_rows(a, F.lit("prefectures"), path("side", "prefecture")).unionByName(bad_rows(b, F.lit("blocks"), path("side", "block")))
    return Check("E1", "E", "prefectures and blocks are complete", per_election(cfg, NUMBER_OF_PREFECTURES + len(BLOCKS)), bad)


@check("E2")
def e2(t, cfg):
    known = t["__parties"]
    bad, counts = [], []
    for name, df in t.items():
        if name.startswith("__"):
            continue
        counts.append(df.select(*E).distinct().withColumn("n", F.lit(1).cast("bigint")))
        if "party" in df.columns:
            used = df.where((F.coalesce("party", F.lit("")) != "") & (F.col("party") != TOTAL)).select(*E, "party").distinct()
            bad.append(bad_rows(
                used.join(known, [*E, "party"], "left_anti").groupBy(*E).agg(F.min("party").alias("party")),
                F.lit(name), F.col("party")))
    return Check("E2", "E", "categories are within the known set", union_checks(*counts), union_checks(*bad))


@check("E3", "smd_candidates")
def e3(t, cfg):
    rows = t["smd_candidates"]
    ages = bad_rows(rows.where(~within(F.col("age"), 18, 120)), F.col("name_display"), F.col("age"))
    missing = any_required_missing([F.col("name_display"), F.col("party"), F.col("votes")])
    return Check("E3", "E", "required fields and plausible age", q.count_subjects(rows, E),
                 ages.unionByName(bad_rows(rows.where(missing), district_id(), F.lit("required field empty"))))


@check("E4", "pr_list_entries")
def e4(t, cfg):
    got = q.ascending(t["pr_list_entries"], BLOCK_PARTY, "list_rank", "file_ordinal")
    return q.row_check("E4", "E", "list rank starts at 1 and never falls", got, path("block", "party"), F.col("ok"), path("low", "falls"), E)


@check("E5", "smd_candidates")
def e5(t, cfg):
    gender = F.coalesce("gender", F.lit(""))
    rows = t["smd_candidates"].groupBy(*E).agg(
        F.count_if(gender == "").alias("blank"), F.count_if(gender.isin("男", "女")).alias("given"),
        F.count_if(~gender.isin("", "男", "女")).alias("odd"),
    ).join(cfg.select(*E, "has_gender_column"), E)
    bad = union_checks(
        bad_rows(rows.where("odd > 0"), F.lit("unexpected value"), F.col("odd")),
        bad_rows(rows.where("has_gender_column AND blank > 0"), F.lit("blank although the source has the column"), F.col("blank")),
        bad_rows(rows.where("NOT has_gender_column AND given + odd > 0"), F.lit("filled although the source has no column"), F.col("given")),
    )
    return Check("E5", "E", "attribute filled exactly where the source has it", q.count_subjects(t["smd_candidates"], E), bad)


@check("E6", *PERSONAL_TABLES)
def e6(t, cfg):
    bad = cfg.where("false").select(*E, F.lit("").alias("subject"), F.lit("").alias("detail"))
    for name in PERSONAL_TABLES:
        extra, missing = q.schema_difference(t[name].drop("file_ordinal"), TABLES[name].fieldNames())
        for side, cols in (("extra", extra), ("missing", missing)):
            if cols:
                bad = bad.unionByName(bad_rows(cfg, F.lit(f"{name} {side}"), F.lit(", ".join(cols))))
    return Check("E6", "E", "columns equal the declared schema", per_election(cfg, len(PERSONAL_TABLES)), bad)


def checks(tables: dict[str, DataFrame], config: DataFrame, parties: DataFrame | None = None, only=None) -> list[Check]:
    """The checks whose tables are present. ``config``: one row per election."""
    t = dict(tables)
    if parties is not None:
        t["__parties"] = parties
    out = []
    for check_id, (needs, fn) in REGISTRY.items():
        if only and check_id not in only:
            continue
        if check_id == "E2" and parties is None:
            continue
        if all(n in t for n in needs):
            out.append(fn(t, config))
    return out


def run(tables, config, parties=None, register=None, only=None) -> DataFrame:
    return q.grade(checks(tables, config, parties, only), register, E)
