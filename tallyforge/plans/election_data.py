"""From the 20 source tables to simulator input, nested documents and self-checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import scaled
from ..functions.text import name_key
from ..operators.linkage import Links, link
from ..operators.scan import join_null_safe
from ..sources.dimensions import geography, is_prefecture
from ..sources.documents import nest
from . import quality as q
from .simulate import Election, Outcome

E = ["election_id"]
SEATED, UNSEATED = "当", "落"
DISTRICT = [*E, "prefecture", "district_no"]
BLOCK_PARTY = [*E, "block", "party"]


def district_id():
    return F.concat(F.col("prefecture"), F.col("district_no").cast("string"))


def link_duals(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, Links]:
    """Dual candidates of the district table linked to their list entries.

    Passes: (party, shown name), (party, legal name), then the only ones left on both
    sides of a (block, party). Persons with the same key pair in file order.
    """
    places = geography(t["smd_candidates"].sparkSession).select("prefecture", "block")
    left = t["smd_candidates"].where("dual_candidacy").join(places, "prefecture", "left").withColumn(
        "cid", F.md5(F.to_json(F.struct(*DISTRICT, "order_in_district")))
    )
    right = with_entry_id(t["pr_list_entries"]).where("dual_candidacy")

    def shown(c):
        return [F.col("election_id"), F.col("party"), F.when(F.coalesce(c, F.lit("")) != "", name_key(F.col(c)))]

    rest = [F.col("election_id"), F.col("block"), F.col("party")]
    by_file = "file_ordinal" in left.columns and "file_ordinal" in right.columns
    order = ["file_ordinal"] if by_file else []
    found = link(
        left, right, "cid", "lid",
        [(shown("name_display"), shown("name")), (shown("name_kanji"), shown("name"))], (rest, rest),
        order, order,
    )
    return left, right, found


def with_entry_id(entries: DataFrame) -> DataFrame:
    order = "file_ordinal" if "file_ordinal" in entries.columns else "elected_order"
    return entries.withColumn("lid", F.md5(F.to_json(F.struct(*BLOCK_PARTY, "list_rank", "name", order))))


def from_tables(t: dict[str, DataFrame]) -> Election:
    """Simulator input. Votes become whole numbers (thousandths); keys are ``election``,
    ``block``, ``district``. Duals that cannot be linked stay without a district; see
    ``input_problems``."""
    geo = geography(t["smd_districts"].sparkSession)
    place = geo.select("prefecture", "block")
    election = F.col("election_id").alias("election")
    districts = t["smd_districts"].join(place, "prefecture").select(
        election, district_id().alias("district"), "block",
        scaled(F.col("deposit_forfeit_point") * 10).alias("valid_votes"),
    )
    candidates = t["smd_candidates"].join(place, "prefecture").select(
        election, district_id().alias("district"), "block", F.col("name_display").alias("name"), "party",
        scaled(F.col("votes")).alias("votes"),
    )
    left, _, found = link_duals(t)
    duals = found.pairs.select("cid", "lid").join(
        left.select("cid", district_id().alias("district"), F.col("name_display").alias("smd_name"),
                    scaled(F.col("votes")).alias("smd_votes")), "cid"
    ).drop("cid")
    ordinal = F.col("file_ordinal") if "file_ordinal" in t["pr_list_entries"].columns else F.col("list_rank").cast("bigint")
    entries = with_entry_id(t["pr_list_entries"]).join(duals, "lid", "left").select(
        election, "block", "party", ordinal.alias("ordinal"), "list_rank", "name",
        F.col("dual_candidacy").alias("dual"), "district", "smd_name", "smd_votes",
    )
    list_votes = t["party_votes_by_block"].where("NOT is_total_row").select(
        election, "block", "party", scaled(F.col("votes")).alias("votes")
    )
    seats = t["pr_party_blocks"].groupBy(election, "block").agg(F.sum(q.zero(F.col("seats"))).alias("seats"))
    electors = t["electorate"].where("tier = 'smd' AND scope = 'all'").drop("block").join(place, "prefecture").groupBy(
        election, "block"
    ).agg(F.sum("electors_total").cast("bigint").alias("electors"))
    return Election(districts, candidates, entries, list_votes, seats.join(electors, ["election", "block"]))


def input_problems(t: dict[str, DataFrame]) -> DataFrame:
    """What makes the tables unfit for simulation: (election_id, problem, subject)."""

    def rows(df, problem, *subject):
        return df.select(*E, F.lit(problem).alias("problem"), F.concat_ws("/", *[F.col(c).cast("string") for c in subject]).alias("subject"))

    winners = t["smd_candidates"].groupBy(*DISTRICT).agg(F.count_if("elected").alias("n"))
    _, _, found = link_duals(t)
    heads = t["pr_party_blocks"].select(*BLOCK_PARTY, F.col("votes").alias("value"))
    votes = t["party_votes_by_block"].where("NOT is_total_row").select(*BLOCK_PARTY, F.col("votes").alias("value"))
    compared = q.reconcile(heads, votes, BLOCK_PARTY, how="right")
    return (
        rows(winners.where("n <> 1"), "not one winner", "prefecture", "district_no")
        .unionByName(rows(found.left_rest, "candidate not on a list", "prefecture", "district_no", "name_display"))
        .unionByName(rows(found.right_rest, "entry without a candidate", "block", "party", "name"))
        .unionByName(rows(compared.where("NOT ok"), "list votes differ between tables", "block", "party"))
    )


def self_check(t: dict[str, DataFrame], config: DataFrame, data: Election, baseline: Outcome) -> DataFrame:
    """Does the baseline reproduce history? (election, problem, subject) rows, none if so."""
    printed = t["pr_party_blocks"].select(
        F.col("election_id").alias("election"), "block", "party", q.zero(F.col("seats")).alias("value"))
    keys = ["election", "block", "party"]
    seats = q.reconcile(
        baseline.block_seats.select(*keys, F.col("seats").alias("value")), printed, keys, policy=q.NULL_IS_ZERO)
    actual = t["pr_list_entries"].where("elected_pr").select(F.col("election_id").alias("election"), "block", "party", "name")
    people = q.set_difference(baseline.winners, actual, [*keys, "name"])
    vacant = baseline.block_seats.where("vacancies > 0")
    left, _, _ = link_duals(t)
    marked = left.join(t["smd_districts"].select(*DISTRICT, "deposit_forfeit_point"), DISTRICT)
    wrong_mark = marked.where((F.col("votes") < F.col("deposit_forfeit_point")) != F.col("sekihai_excluded"))
    top = t["smd_candidates"].groupBy(*DISTRICT).agg(F.max("votes").alias("top"))
    rate = F.bround(F.col("votes") / F.nullif(F.col("top"), F.lit(0)) * 100, 3)
    wrong_rate = marked.join(top, DISTRICT).where(
        F.col("sekihai_rate").isNotNull() & ~F.coalesce(F.abs(rate - F.col("sekihai_rate")) <= 0.001, F.lit(False)))
    totals = baseline.seats.groupBy("election").agg(
        F.sum("district_seats").alias("district_seats"), F.sum("list_seats").alias("list_seats")
    ).join(config.select(F.col("election_id").alias("election"), "smd_seats", "pr_seats"), "election")

    def rows(df, problem, *subject, election="election"):
        return df.select(F.col(election).alias("election"), F.lit(problem).alias("problem"),
                         F.concat_ws("/", *[F.col(c).cast("string") for c in subject]).alias("subject"))

    return (
        rows(seats.where("NOT ok"), "seats", "block", "party", "computed", "published")
        .unionByName(rows(people, "list winners", "side", "block", "party", "name"))
        .unionByName(rows(vacant, "vacancy", "block", "party"))
        .unionByName(rows(wrong_mark, "exclusion mark", "prefecture", "district_no", "name_display", election="election_id"))
        .unionByName(rows(wrong_rate, "loser ratio", "prefecture", "district_no", "name_display", election="election_id"))
        .unionByName(rows(totals.where("district_seats <> smd_seats"), "district seat total", "district_seats", "smd_seats"))
        .unionByName(rows(totals.where("list_seats <> pr_seats"), "list seat total", "list_seats", "pr_seats"))
    )


def documents(t: dict[str, DataFrame], config: DataFrame) -> DataFrame:
    """One nested document per election: districts with candidates, blocks with parties
    and lists, electorate and ballots per prefecture.

    Every nested group is bounded by an election (a few hundred districts), and an
    election is one output row, so any number of elections is built in parallel.
    """
    geo = geography(config.sparkSession)
    people = nest(
        t["smd_candidates"].withColumn("__down", -F.col("votes")), DISTRICT, ["__down", "order_in_district"],
        [F.col("name_display").alias("name"), "name_kanji", "name_kana", "age", "party", "party_raw", "party_is_certified",
         "status", "occupation", "votes", "elected", "dual_candidacy", "sekihai_rate", "sekihai_excluded"], "candidates",
    )
    districts = t["smd_districts"].join(people, DISTRICT, "left").join(geo, "prefecture").withColumn(
        "district_id", district_id()
    ).withColumn("valid_votes", F.col("deposit_forfeit_point") * 10)
    smd = nest(districts, E, ["pref_idx", "district_no"],
               ["prefecture", "district_no", "district_id", "block", "deposit_forfeit_point", "valid_votes", "candidates"], "districts")

    entries = t["pr_list_entries"].withColumn("__late", F.coalesce("elected_order", F.lit(9999)))
    order = ["list_rank", "__late"] + (["file_ordinal"] if "file_ordinal" in entries.columns else ["name"])
    lists = nest(entries, BLOCK_PARTY, order,
                 ["list_rank", "name", "elected_order", F.col("elected_pr").alias("elected"), "smd_result", "sekihai_rate",
                  "sekihai_excluded", "dual_candidacy"], "list")
    members = t["party_votes_by_block_pref"].where(is_prefecture("prefecture") & F.col("votes").isNotNull()).join(
        geo.select("prefecture", "pref_idx"), "prefecture")
    by_pref = nest(members, BLOCK_PARTY, ["pref_idx"], ["prefecture", "votes"], "votes_by_prefecture")
    heads = t["pr_party_blocks"].select(*BLOCK_PARTY, "seats", "seats_male", "seats_female")
    rows = t["party_votes_by_block"].where("NOT is_total_row").drop("is_total_row", "source_page")
    for df in (heads, lists, by_pref):
        rows = join_null_safe(rows, df, BLOCK_PARTY, "left")
    rows = rows.withColumn("seats", q.zero(F.col("seats"))).withColumn("__rank", F.coalesce("rank", F.lit(999)))
    parties = nest(rows, [*E, "block"], ["__rank", "party"],
                   ["party", "rank", "votes", "share_pct", "seats", "seats_male", "seats_female", "votes_by_prefecture", "list"], "parties")
    totals = t["party_votes_by_block"].where("is_total_row").select(*E, "block", F.col("votes").alias("total_votes"))
    # Blocks keep the order of the geography: by their first prefecture.
    block_dim = geo.groupBy("block").agg(
        F.min("pref_idx").alias("block_idx"),
        F.transform(F.sort_array(F.collect_list(F.struct("pref_idx", "prefecture"))), lambda x: x["prefecture"]).alias("prefectures"))
    blocks = parties.join(totals, [*E, "block"], "left").join(block_dim, "block").withColumn(
        "seats", F.aggregate("parties", F.lit(0).cast("bigint"), lambda a, p: a + p["seats"]))
    pr = nest(blocks, E, ["block_idx"], ["block", "prefectures", "seats", "total_votes", "parties"], "blocks")

    seat_counts = t["smd_districts"].groupBy(*E, "prefecture").agg(F.count(F.lit(1)).alias("smd_seats"))
    people_by_pref = t["electorate"].where("tier = 'smd' AND scope = 'all'").drop("block").join(geo, "prefecture").join(
        seat_counts, [*E, "prefecture"], "left")
    electorate = nest(people_by_pref, E, ["pref_idx"],
                      ["prefecture", F.col("electors_total").alias("electors"), F.col("voters_total").alias("voters"),
                       q.zero(F.col("smd_seats")).alias("smd_seats"), "block"], "electorate")
    ballots = nest(t["ballots_smd_by_pref"].drop("block").join(geo, "prefecture"), E, ["pref_idx"],
                   ["prefecture", "total_ballots", "valid_votes", "invalid_votes"], "ballots")
    out = config.withColumn("total_seats", F.col("smd_seats") + F.col("pr_seats"))
    for df in (smd, pr, electorate, ballots):
        out = out.join(df, E, "left")
    return out


def publication(t: dict[str, DataFrame], config: DataFrame, data: Election, baseline: Outcome) -> DataFrame:
    """The compact document the simulator publishes: one row per election.

    Votes are whole numbers (thousandths), names follow the published format. Write it
    with ``write_checked`` and the problems of ``self_check``.
    """
    place = ["election", "district"]
    key = F.col("election_id").alias("election")
    known = t["smd_districts"].select(key, district_id().alias("district"), F.col("prefecture").alias("pref"), F.col("district_no").alias("no"))
    geo = geography(config.sparkSession)
    won = baseline.districts.where("smd_voting = 'plurality'").select(*place, "winner", "winner_party", "winner_votes")
    people = nest(data.candidates.withColumn("__down", -F.col("votes")), place, ["__down", "name"], ["name", "party", "votes"], "candidates")
    districts = data.districts.join(known, place).join(won, place).join(people, place).join(
        geo.select(F.col("prefecture").alias("pref"), "pref_idx"), "pref")
    smd = nest(districts, ["election"], ["pref_idx", "no"], [
        F.col("district").alias("id"), "pref", "no", "block", F.col("valid_votes").alias("validVotes"),
        F.col("winner_votes").alias("topVotes"), "winner", F.col("winner_party").alias("winnerParty"), "candidates"], "districts")
    by_block = won.join(data.districts, place).groupBy("election", "block", F.col("winner_party").alias("party")).agg(
        F.count(F.lit(1)).alias("seats"))
    by_party = by_block.groupBy("election", "party").agg(F.sum("seats").alias("seats"))
    won_blocks = nest(by_block, ["election", "block"], ["party"], ["party", "seats"], "seatsByParty")

    printed = with_entry_id(t["pr_list_entries"])
    ordinal = F.col("file_ordinal") if "file_ordinal" in printed.columns else F.col("list_rank").cast("bigint")
    actual = printed.select(key, "block", "party", ordinal.alias("ordinal"), "list_rank", "name",
                            F.col("elected_pr").alias("actualElected"), F.col("elected_order").alias("actualElectedOrder"))
    who = ["election", "block", "party", "ordinal", "list_rank", "name"]
    entries = data.entries.join(actual, who).join(
        data.districts.select(*place, "valid_votes"), place, "left").join(won.drop("winner_party"), place, "left")
    ratio = F.coalesce(F.col("smd_votes") / F.nullif(F.col("winner_votes"), F.lit(0)), F.lit(0.0))
    lists = nest(entries.withColumn("__down", -ratio), ["election", "block", "party"], ["list_rank", "__down", "ordinal"], [
        F.col("list_rank").alias("rank"), "name", "dual", "actualElected", "actualElectedOrder",
        F.col("district").alias("districtId"), F.col("smd_name").alias("smdName"),
        (F.col("dual") & F.col("winner").eqNullSafe(F.col("smd_name"))).alias("smdWon"), F.col("smd_votes").alias("smdVotes"),
        F.col("valid_votes").alias("districtValidVotes"), F.col("winner_votes").alias("districtTopVotes")], "list")
    seats = t["pr_party_blocks"].select(key, "block", "party", q.zero(F.col("seats")).alias("actualSeats"))
    parties = data.list_votes.join(seats, ["election", "block", "party"]).join(lists, ["election", "block", "party"], "left")
    tree = nest(parties.withColumn("__down", -F.col("votes")), ["election", "block"], ["__down", "party"],
                ["party", "votes", "actualSeats", "list"], "parties")
    dim = geo.groupBy("block").agg(
        F.min("pref_idx").alias("block_idx"),
        F.transform(F.sort_array(F.collect_list(F.struct("pref_idx", "prefecture"))), lambda x: x["prefecture"]).alias("prefectures"))
    blocks = nest(data.blocks.join(tree, ["election", "block"]).join(dim, "block"), ["election"], ["block_idx"],
                  ["block", "prefectures", "seats", "electors", "parties"], "blocks")
    out = config.select(
        key, F.struct(*config.columns, (F.col("smd_seats") + F.col("pr_seats")).alias("total_seats")).alias("meta"), F.lit(1000).alias("voteScale"))
    for df in (nest(by_party, ["election"], ["party"], ["party", "seats"], "seatsByParty"),
               nest(won_blocks, ["election"], ["block"], ["block", "seatsByParty"], "byBlock"), smd, blocks):
        out = out.join(df, "election", "left")
    return out.select("meta", "voteScale", F.struct("seatsByParty", "byBlock", "districts").alias("smd"), "blocks")


def roundtrip(t: dict[str, DataFrame], docs: DataFrame) -> DataFrame:
    """Seven totals of the documents against their tables and configuration."""
    cand = docs.select(*E, F.explode("districts").alias("d")).select(*E, F.explode("d.candidates").alias("c"))
    party = docs.select(*E, F.explode("blocks").alias("b")).select(*E, F.explode("b.parties").alias("p"))
    people = party.select(*E, F.explode("p.list").alias("x"))

    def total(name, df, agg):
        return df.groupBy(*E).agg(agg.cast("decimal(30,3)").alias("value")).withColumn("total", F.lit(name))

    def union(frames):
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    one = F.count(F.lit(1))
    got = union([
        total("candidates", cand, one), total("districts", docs.select(*E, F.explode("districts").alias("d")), one),
        total("votes", cand, F.sum("c.votes")), total("district winners", cand, F.count_if("c.elected")),
        total("list seats", party, F.sum("p.seats")), total("list winners", people, F.count_if("x.elected")),
        total("list entries", people, one),
    ])
    c = t["smd_candidates"]
    want = union([
        total("candidates", c, one), total("votes", c, F.sum("votes")), total("list entries", t["pr_list_entries"], one),
        total("districts", docs, F.max("smd_seats")), total("district winners", docs, F.max("smd_seats")),
        total("list seats", docs, F.max("pr_seats")), total("list winners", docs, F.max("pr_seats")),
    ])
    return q.reconcile(got, want, [*E, "total"])


__all__ = ["documents", "from_tables", "input_problems", "link_duals", "publication", "roundtrip", "self_check"]
