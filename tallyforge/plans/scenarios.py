"""Rule scenarios as rows: presets, grids, steps from one rule set to another."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scenario:
    divisor_method: str = "dhondt"
    first_divisor_tenths: int = 14
    pr_seat_delta: int = 0
    share_num: int = 1
    share_den: int = 10
    rate_floor: float | None = None
    list_exhaustion: str = "reallocate"
    tier_linkage: str = "parallel"
    heiyo_overhang: str = "truncate"
    smd_voting: str = "plurality"


BASELINE = Scenario()
FIELDS = tuple(f.name for f in fields(Scenario))
TYPES = {
    "first_divisor_tenths": "int", "pr_seat_delta": "int", "share_num": "int",
    "share_den": "int", "rate_floor": "decimal(5,2)",
}

# The named rule sets.
_OVERHAUL = Scenario("sainteLague", pr_seat_delta=-45, share_num=1, share_den=6, rate_floor=30, list_exhaustion="vacant")
_MODIFIED = Scenario("modifiedSainteLague", 14)
PRESETS = {
    "baseline": BASELINE,
    "ldp": _OVERHAUL,
    "ldp_sekihai50": replace(_OVERHAUL, rate_floor=50),
    "mirai": Scenario("sainteLague"),
    "modified_sainte_lague": _MODIFIED,
    "modified_sainte_lague_10": replace(_MODIFIED, first_divisor_tenths=10),
    "modified_sainte_lague_21": replace(_MODIFIED, first_divisor_tenths=21),
    "renyo": Scenario(tier_linkage="renyo"),
    "heiyo": Scenario(tier_linkage="heiyo"),
    "heiyo_expand": Scenario(tier_linkage="heiyo", heiyo_overhang="expand"),
    "renyo_sainte_lague": Scenario("sainteLague", tier_linkage="renyo"),
    "heiyo_vacant_45": Scenario(tier_linkage="heiyo", list_exhaustion="vacant", pr_seat_delta=-45),
    "rcv": Scenario(smd_voting="rcv"),
    "rcv_sainte_lague": Scenario("sainteLague", smd_voting="rcv"),
    "rcv_ldp": replace(_OVERHAUL, smd_voting="rcv"),
}
# What the rule controls offer.
GRID_FIRST_DIVISOR = (10, 30, 1)
GRID_SEAT_STEP = 5
GRID_SHARES = ((1, 10), (1, 8), (1, 6), (1, 4))
GRID_RATE_FLOOR = (5, 95, 5)
#: Order in which rules are switched when a change is decomposed.
STEP_ORDER = (
    "smd_voting", "tier_linkage", "heiyo_overhang", "divisor_method", "first_divisor_tenths",
    "pr_seat_delta", "min_share", "rate_floor", "list_exhaustion",
)


def _value(name: str, value) -> Column:
    return F.lit(value).cast(TYPES.get(name, "string"))


def attach(df: DataFrame, scenarios: dict[str, Scenario]) -> DataFrame:
    """Every row once per scenario, with the rule columns."""
    rows = [
        F.struct(F.lit(i).alias("scenario_id"), *[_value(k, v).alias(k) for k, v in asdict(s).items()])
        for i, s in scenarios.items()
    ]
    return df.select("*", F.explode(F.array(*rows)).alias("__s")).select("*", "__s.*").drop("__s")


def attach_grid(
    df: DataFrame,
    base: Scenario = BASELINE,
    *,
    first_divisor: tuple[int, int, int] | None = None,
    seat_delta: tuple[int, int, int] | None = None,
    shares: Sequence[tuple[int, int]] | None = None,
    rate_floor: tuple[int, int, int] | None = None,
    methods: Iterable[str] | None = None,
) -> DataFrame:
    """Every row once per point of a rule grid; the grid is a chain of explodes.

    Ten thousand scenarios cost ten thousand rows per contest and party, never a loop.
    Ranges are (first, last, step).
    """
    fixed = asdict(base)
    out = df
    axes: list[str] = []

    def spread(name, values: Column):
        nonlocal out
        out = out.withColumn(name, F.explode(values))
        axes.append(name)

    def rng(r):
        return F.sequence(F.lit(r[0]), F.lit(r[1]), F.lit(r[2]))

    if methods:
        spread("divisor_method", F.array(*[F.lit(m) for m in methods]))
    if first_divisor:
        spread("first_divisor_tenths", rng(first_divisor))
    if seat_delta:
        spread("pr_seat_delta", rng(seat_delta))
    if shares:
        spread("__share", F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("d")) for n, d in shares]))
        out = out.withColumn("share_num", F.col("__share.n")).withColumn("share_den", F.col("__share.d")).drop("__share")
        axes[-1:] = ["share_num", "share_den"]
    if rate_floor:
        spread("__floor", rng(rate_floor))
        out = out.withColumn("rate_floor", F.col("__floor").cast("decimal(5,2)")).drop("__floor")
        axes[-1:] = ["rate_floor"]
    label = F.concat_ws("/", *[F.col(a).cast("string") for a in axes]) if axes else F.lit("base")
    rest = [_value(k, v).alias(k) for k, v in fixed.items() if k not in axes]
    return out.select(label.alias("scenario_id"), *df.columns, *axes, *rest)


def inert(field: str, target: Column | None = None) -> Column:
    """Rules that have no effect under the row's other rules."""
    if field == "first_divisor_tenths":
        return F.col("divisor_method") != "modifiedSainteLague"
    if field == "heiyo_overhang":
        return F.col("tier_linkage") != "heiyo"
    return F.lit(False)


def expand_steps(df: DataFrame, start: Scenario = BASELINE) -> DataFrame:
    """Rows carrying a target scenario, once per step of the path from ``start`` to it.

    Rules change one at a time in ``STEP_ORDER``; unchanged and inert rules make no
    step. Adds ``step_no`` (0 = start) and ``step_id``, and replaces the rule columns
    by their value at that step.
    """
    begin = asdict(start)

    def members(step):
        return ("share_num", "share_den") if step == "min_share" else (step,)

    def changed(step):
        diff = F.lit(False)
        for m in members(step):
            diff = diff | ~F.col(m).eqNullSafe(_value(m, begin[m]))
        return diff & ~inert(step)

    active = F.filter(
        F.array(*[F.when(changed(s), F.lit(i)) for i, s in enumerate(STEP_ORDER)]), lambda x: x.isNotNull()
    )
    path = df.withColumn("__active", active).select(
        "*", F.posexplode(F.concat(F.array(F.lit(-1)), F.col("__active"))).alias("step_no", "__last")
    )
    names = F.array(*[F.lit(s) for s in STEP_ORDER])
    now = {}
    for i, step in enumerate(STEP_ORDER):
        on = F.array_contains("__active", i) & (F.col("__last") >= i)
        for m in members(step):
            now[m] = F.when(on, F.col(m)).otherwise(_value(m, begin[m]))
    keep = [c for c in df.columns if c not in FIELDS]
    return path.select(
        *keep, "step_no",
        F.when(F.col("__last") < 0, F.lit("start")).otherwise(F.get(names, F.col("__last"))).alias("step_id"),
        *[now[f].alias(f) for f in FIELDS],
    )
