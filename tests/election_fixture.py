"""A made-up, fully consistent election as the 20 source tables of text cells."""

from __future__ import annotations

import random
from collections import defaultdict
from decimal import Decimal

from tallyforge.sources.dimensions import BLOCKS, PREFECTURES

PARTIES = ["赤党", "青党", "緑党"]
T, INDEPENDENT, MINOR = "__TOTAL__", "無所属", "諸派"
ELECTION = "x1"
BLOCK_OF = {p: b for b, ps in BLOCKS.items() for p in ps.split()}


def q(value, places):
    """Half-even rounding to text."""
    return str(Decimal(value).quantize(Decimal(1).scaleb(-places)))


def dhondt(votes, seats, capacity):
    used, order = dict.fromkeys(votes, 0), []
    for _ in range(seats):
        room = [p for p in votes if used[p] < capacity.get(p, 0)]
        if not room:
            break
        win = min(room, key=lambda p: (-Decimal(votes[p]) / (used[p] + 1), -votes[p], p))
        used[win] += 1
        order.append((win, used[win]))
    return order


def build(seed=1):
    """({table: [row dict]}, configuration tuple)."""
    rng = random.Random(seed)
    t = defaultdict(list)

    def add(table, /, **row):
        t[table].append({"election_id": ELECTION, **{k: "" if v is None else str(v) for k, v in row.items()}, "source_page": "1"})

    def flag(x):
        return "true" if x else "false"

    cands, districts = [], []
    for pref in PREFECTURES:
        for no in range(1, rng.choice([1, 2, 3]) + 1):
            people = []
            for i, party in enumerate(PARTIES + ([INDEPENDENT] if rng.random() < 0.4 else []) + (["泡沫会"] if rng.random() < 0.2 else [])):
                certified = party in PARTIES
                people.append({
                    "pref": pref, "no": no, "order": i + 1, "name": f"{party[0]}{pref[:2]}{no}ッ太郎", "party": party,
                    "certified": certified, "votes": rng.randint(500, 90000), "dual": certified and rng.random() < 0.7
                    # No list, so no dual candidates, of this party in this block.
                    and not (party == "緑党" and BLOCK_OF[pref] == "四国"),
                })
            total = sum(p["votes"] for p in people)
            top = max(people, key=lambda p: p["votes"])
            point = Decimal(total) / 10
            for p in people:
                p["won"] = p is top
                p["excluded"] = p["dual"] and p["votes"] < point
                p["rate"] = None if not p["dual"] or p["excluded"] else q(Decimal(p["votes"]) / top["votes"] * 100, 3)
            districts.append((pref, no, point, total))
            cands += people
    for pref, no, point, _ in districts:
        add("smd_districts", prefecture=pref, district_no=no, deposit_forfeit_point=point)
    for c in cands:
        add("smd_candidates", prefecture=c["pref"], district_no=c["no"], order_in_district=c["order"], elected=flag(c["won"]),
            result_mark="当" if c["won"] else "落", name_display=c["name"], name_kanji="", name_kana="", age=50, gender="",
            party_raw=c["party"], party=c["party"], party_is_certified=flag(c["certified"]), status="新", occupation="",
            votes=c["votes"], dual_candidacy=flag(c["dual"]), sekihai_rate=c["rate"], sekihai_excluded=flag(c["excluded"]))

    def fold(c):
        return c["party"] if c["certified"] or c["party"] == INDEPENDENT else MINOR

    cols = PARTIES + [INDEPENDENT, MINOR]
    nation = {p: sum(c["votes"] for c in cands if fold(c) == p) for p in cols}
    for p in cols:
        if nation[p]:
            add("party_votes_smd_total", tier="smd", period="current", party=p, votes=nation[p], share_pct="")
    add("party_votes_smd_total", tier="smd", period="current", party=T, votes=sum(nation.values()), share_pct="")
    add("party_votes_smd_total", tier="smd", period="previous", party=T, votes=1, share_pct="")
    for pref in PREFECTURES:
        here = [c for c in cands if c["pref"] == pref]
        for p in cols:
            v = sum(c["votes"] for c in here if fold(c) == p)
            add("party_votes_by_pref_smd", prefecture=pref, party=p, votes_male=v // 3 if v else None,
                votes_female=v - v // 3 if v else None, votes_total=v or None)
            n = sum(c["won"] for c in here if fold(c) == p)
            add("winners_by_pref_party", kind="winners", prefecture=pref, seats="", party=p, new=n, incumbent="", former="", total=n or None)
        v, n = sum(c["votes"] for c in here), sum(c["won"] for c in here)
        add("party_votes_by_pref_smd", prefecture=pref, party=T, votes_male=v, votes_female=0, votes_total=v)
        add("winners_by_pref_party", kind="winners", prefecture=pref, seats=n, party=T, new=n, incumbent="", former="", total=n)
        add("candidacy_by_pref_party", kind="candidacy", prefecture=pref, seats=n, party=T, new=len(here), incumbent="", former="", total=len(here))
        add("ballots_smd_by_pref", tier="smd", block="", prefecture=pref, total_ballots=v + 10, valid_votes=v, invalid_votes=10,
            invalid_rate_pct=q(Decimal(1000) / (v + 10), 2))
    total = sum(nation.values())
    add("ballots_smd_by_pref", tier="smd", block="", prefecture="合計", total_ballots=total, valid_votes=total, invalid_votes=0, invalid_rate_pct="0.00")

    # Lists.
    national_pr, order_rows, pr_seats = defaultdict(int), [], 0
    for block, members in BLOCKS.items():
        votes = defaultdict(int)
        for pref in members.split():
            for p in PARTIES:
                v = 0 if p == "緑党" and block == "四国" else rng.randint(1000, 50000)
                votes[p] += v
                add("party_votes_by_block_pref", block=block, prefecture=pref, party=p, votes=v or None)
            add("party_votes_by_block_pref", block=block, prefecture=pref, party=T, votes=None)
        for r in t["party_votes_by_block_pref"]:
            if r["block"] == block and r["party"] == T:
                r["votes"] = str(sum(int(x["votes"] or 0) for x in t["party_votes_by_block_pref"]
                                     if x["block"] == block and x["prefecture"] == r["prefecture"] and x["party"] in PARTIES))
        votes = {p: v for p, v in votes.items() if v}
        whole = sum(votes.values())
        if " " in members:
            for p in PARTIES:
                add("party_votes_by_block_pref", block=block, prefecture="計", party=p, votes=votes.get(p))
            add("party_votes_by_block_pref", block=block, prefecture="計", party=T, votes=whole)
            add("ballots_pr_by_block_pref", tier="pr", block=block, prefecture="計", total_ballots=whole, valid_votes=whole, invalid_votes=0, invalid_rate_pct="0.00")
        for i, pref in enumerate(members.split()):
            here = whole if " " not in members else 100
            add("ballots_pr_by_block_pref", tier="pr", block=block, prefecture=pref, total_ballots=here, valid_votes=here, invalid_votes=0, invalid_rate_pct="0.00")
        for i, (p, v) in enumerate(sorted(votes.items(), key=lambda x: -x[1]), 1):
            national_pr[p] += v
            add("party_votes_by_block", block=block, rank=i, party=p, votes=v, share_pct=q(Decimal(v) / whole * 100, 2), is_total_row="false")
        add("party_votes_by_block", block=block, rank="", party=T, votes=whole, share_pct="", is_total_row="true")
        lists, capacity = {}, {}
        for p in votes:
            duals = [c for c in cands if c["dual"] and c["party"] == p and BLOCK_OF[c["pref"]] == block]
            entries = [("solo", f"{p[0]}{block}単独{k}", None) for k in range(rng.randint(0, 3))] + [("dual", c["name"].replace("ッ", "ツ"), c) for c in duals]
            lists[p] = entries
            capacity[p] = sum(1 for kind, _, c in entries if kind == "solo" or (not c["won"] and not c["excluded"]))
        for c in cands:
            # A party without a list in the block cannot have dual candidates there.
            if c["dual"] and c["party"] not in votes and BLOCK_OF[c["pref"]] == block:
                raise AssertionError("pick another seed")
        seats = min(6, sum(capacity.values()))
        pr_seats += seats
        awards = dhondt(votes, seats, capacity)
        for p, v in votes.items():
            n = sum(1 for w, _ in awards if w == p)
            add("pr_party_blocks", block=block, party=p, votes=v, seats=n, seats_male="", seats_female="")
            ranks = {(w, k): i for i, (w, k) in enumerate(awards, 1) if w == p}
            for k in range(1, 9):
                add("dhondt_quotients", block=block, party=p, divisor=k, quotient=q(Decimal(v) / k, 3), seat_rank=ranks.get((p, k)))
            left = n
            for rank, (kind, name, c) in enumerate(lists[p], 1):
                able = kind == "solo" or (not c["won"] and not c["excluded"])
                take = able and left > 0
                left -= take
                add("pr_list_entries", block=block, party=p, list_rank=rank, name=name, elected_order=rank if take else None,
                    elected_pr=flag(take), smd_result="" if c is None else ("当" if c["won"] else "落"),
                    sekihai_rate=None if c is None else c["rate"], sekihai_excluded=flag(bool(c and c["excluded"])), dual_candidacy=flag(c is not None))
    for p, v in national_pr.items():
        add("party_votes_pr_total", tier="pr", period="current", party=p, votes=v, share_pct="")
    add("party_votes_pr_total", tier="pr", period="current", party=T, votes=sum(national_pr.values()), share_pct="")

    # Electorate and turnout.
    for tier in ("smd", "pr"):
        for scope in ("all", "overseas"):
            sums = defaultdict(int)
            for pref in PREFECTURES:
                m, f, vm, vf = rng.randint(1000, 9000), rng.randint(1000, 9000), rng.randint(1, 900), rng.randint(1, 900)
                row = {"electors_male": m, "electors_female": f, "electors_total": m + f, "voters_male": vm, "voters_female": vf,
                       "voters_total": vm + vf, "abstainers_male": m - vm, "abstainers_female": f - vf, "abstainers_total": m + f - vm - vf}
                for k, v in row.items():
                    sums[k] += v
                block = BLOCK_OF[pref] if tier == "pr" else ""
                add("electorate", tier=tier, scope=scope, block=block, prefecture=pref, **row)
                rate = q(Decimal(vm + vf) / (m + f) * 100, 2)
                add("turnout", tier=tier, scope=scope, block=block, prefecture=pref, rate_male="", rate_female="", rate_total=rate,
                    prev_rate_male="", prev_rate_female="", prev_rate_total="50.00", diff_male="", diff_female="", diff_total=Decimal(rate) - 50)
            add("electorate", tier=tier, scope=scope, block="", prefecture="合計", **sums)
    seats = len(districts)
    for kind, n in (("candidacy", len(cands)), ("winners", seats)):
        add(f"{kind}_by_pref_age", kind=kind, prefecture="合計", age_band="計", count=n)
        add(f"{kind}_by_party", kind=kind, section="smd", status="計", party=T, male=n, female=0, total=n, dual_male="", dual_female="", dual_total="")
    return dict(t), (ELECTION, 60, "2030-01-01", seats, pr_seats, False)
