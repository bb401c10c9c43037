"""Typed schemas of the 20 election tables (each also has election_id and source_page)."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DecimalType, IntegerType, StringType, StructType

_VOTES, _RATE = "votes", "rate"
_KINDS = {
    "string": StringType(), "int": IntegerType(), "boolean": BooleanType(),
    _VOTES: DecimalType(20, 3), _RATE: DecimalType(9, 3),
}
_SEXES = ("male", "female", "total")
_TOTALS = f"tier string, period string, party string, votes {_VOTES}, share_pct {_RATE}"
_BALLOTS = (
    f"tier string, block string, prefecture string, total_ballots {_VOTES}, valid_votes {_VOTES}, "
    f"invalid_votes {_VOTES}, invalid_rate_pct {_RATE}"
)
_BY_PARTY = (
    "kind string, section string, status string, party string, male int, female int, total int, "
    "dual_male int, dual_female int, dual_total int"
)
_BY_PREF_PARTY = "kind string, prefecture string, seats int, party string, new int, incumbent int, former int, total int"
_BY_PREF_AGE = "kind string, prefecture string, age_band string, count int"


def _grid(names, kind):
    return ", ".join(f"{n}_{s} {kind}" for n in names for s in _SEXES)


_BODY = {
    "smd_districts": f"prefecture string, district_no int, deposit_forfeit_point {_VOTES}",
    "smd_candidates": (
        "prefecture string, district_no int, order_in_district int, elected boolean, result_mark string, "
        "name_display string, name_kanji string, name_kana string, age int, gender string, party_raw string, "
        f"party string, party_is_certified boolean, status string, occupation string, votes {_VOTES}, "
        f"dual_candidacy boolean, sekihai_rate {_RATE}, sekihai_excluded boolean"
    ),
    "party_votes_smd_total": _TOTALS,
    "party_votes_pr_total": _TOTALS,
    "party_votes_by_pref_smd": (
        f"prefecture string, party string, votes_male {_VOTES}, votes_female {_VOTES}, votes_total {_VOTES}"
    ),
    "party_votes_by_block_pref": f"block string, prefecture string, party string, votes {_VOTES}",
    "party_votes_by_block": (
        f"block string, rank int, party string, votes {_VOTES}, share_pct {_RATE}, is_total_row boolean"
    ),
    "ballots_smd_by_pref": _BALLOTS,
    "ballots_pr_by_block_pref": _BALLOTS,
    "electorate": "tier string, scope string, block string, prefecture string, "
    + _grid(("electors", "voters", "abstainers"), _VOTES),
    "turnout": "tier string, scope string, block string, prefecture string, "
    + _grid(("rate", "prev_rate", "diff"), _RATE),
    "pr_party_blocks": f"block string, party string, votes {_VOTES}, seats int, seats_male int, seats_female int",
    "pr_list_entries": (
        "block string, party string, list_rank int, name string, elected_order int, elected_pr boolean, "
        f"smd_result string, sekihai_rate {_RATE}, sekihai_excluded boolean, dual_candidacy boolean"
    ),
    "dhondt_quotients": f"block string, party string, divisor int, quotient {_VOTES}, seat_rank int",
    "candidacy_by_party": _BY_PARTY,
    "winners_by_party": _BY_PARTY,
    "candidacy_by_pref_party": _BY_PREF_PARTY,
    "winners_by_pref_party": _BY_PREF_PARTY,
    "candidacy_by_pref_age": _BY_PREF_AGE,
    "winners_by_pref_age": _BY_PREF_AGE,
}



def _struct(body: str) -> StructType:
    out = StructType()
    for column in f"election_id string, {body}, source_page int".split(", "):
        name, kind = column.split()
        out = out.add(name, _KINDS[kind])
    return out


TABLES = {name: _struct(body) for name, body in _BODY.items()}
#: Tables that name persons: their columns must be exactly these.
PERSONAL_TABLES = ("smd_candidates", "pr_list_entries")
