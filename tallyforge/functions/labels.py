"""Labels found in printed tables: categories, ranges, headers, marks, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import parse_decimal, parse_int
from .text import fold_width, squash, strip_prefix

# Labels and marks as printed.
TOTAL = "__TOTAL__"
BLOCK_TOTAL, GRAND_TOTAL = "計", "合計"
GRAND_LABELS = ("計", "総計")
INDEPENDENT, MINOR = "無所属", "諸派"
ALIASES = {
    "無所属": "無所属", "（無所属）": "無所属", "(無所属)": "無所属", "諸派": "諸派",
    "得票総数": TOTAL, "合計": TOTAL, "計": TOTAL,
}
FOOTNOTE = r"[※＊*][0-9０-９]*$"
PARTY_COLUMN_LABELS = ("届出政党等", "政党等名", "党派名", "党派")
EXCLUDED_MARKS = ("×", "x", "X", "✕")
RESULT_MARKS = ("当", "落")
DUAL_MARK = "重"
HEADER = r"^(.+?)第([0-9]+)区.*?供託物没収点([0-9,]+(?:\.[0-9]+)?)$"
BAND_RANGE = r"^([0-9]+)歳[~～]?([0-9]+)歳$"
BAND_OVER = r"^([0-9]+)歳以上$"
BRACKETED = r"^[（(](.+?)[)）]$"
PAREN_COUNT = r"[（(]([0-9,]+)[)）]"


def canonical_category(raw: Column, aliases: dict[str, str] = ALIASES, known: Sequence[str] | None = None) -> Column:
    """Spaces and footnote mark removed, aliases resolved; a name that is not ``known`` is an error."""
    name = F.regexp_replace(squash(raw), FOOTNOTE, "")
    out = name
    for alias, value in aliases.items():
        out = F.when(name == alias, value).otherwise(out)
    if known is not None:
        allowed = sorted({*known, *aliases.values()})
        out = F.when(out.isNull() | out.isin(allowed), out).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), out)))
    return out


def fold_uncertified(party: Column, certified: Column, independent=INDEPENDENT, minor=MINOR) -> Column:
    """Uncertified categories count as independents or as the minor group."""
    return F.when(certified, party).when(party == independent, F.lit(independent)).otherwise(F.lit(minor))


def row_label(label: Column, is_member: Column, block: Column) -> Column:
    """Member name, block subtotal, grand total, or null for other rows.

    ``計`` is a block subtotal only while a block is open.
    """
    in_block = F.coalesce(block, F.lit("")) != ""
    return (
        F.when(is_member, label)
        .when(label == GRAND_TOTAL, F.lit(GRAND_TOTAL))
        .when(label.isin(*GRAND_LABELS) & in_block, F.lit(BLOCK_TOTAL))
        .when(label.isin(*GRAND_LABELS), F.lit(GRAND_TOTAL))
    )


def canonical_band(label: Column) -> Column:
    """Struct(label, lo, hi) of a range label; unreadable text is an error.

    Only the width of digits and of the tilde varies in print, so folding width is
    all the normalisation needed.
    """
    t = fold_width(label)
    lo, hi = F.regexp_extract(t, BAND_RANGE, 1), F.regexp_extract(t, BAND_RANGE, 2)
    over = F.regexp_extract(t, BAND_OVER, 1)
    total = t.isin(BLOCK_TOTAL, GRAND_TOTAL)
    text = (
        F.when(lo != "", F.concat(lo, F.lit("歳～"), hi, F.lit("歳")))
        .when(over != "", F.concat(over, F.lit("歳以上")))
        .when(total, F.lit(BLOCK_TOTAL))
        .when(t == "", F.lit(""))
        .otherwise(F.raise_error(F.concat(F.lit("not a range label: "), label)))
    )
    return F.struct(
        text.alias("label"),
        F.when(lo != "", lo.cast("int")).when(over != "", over.cast("int")).alias("lo"),
        F.when(hi != "", hi.cast("int")).alias("hi"),
    )


def parse_header(line: Column) -> Column:
    """Struct(area, number, amount) of a district header line, null when it is none."""
    return F.when(
        line.rlike(HEADER),
        F.struct(
            F.regexp_extract(line, HEADER, 1).alias("area"),
            F.regexp_extract(line, HEADER, 2).cast("int").alias("number"),
            parse_decimal(F.regexp_extract(line, HEADER, 3)).alias("amount"),
        ),
    )


def bracketed(raw: Column) -> Column:
    """Struct(value, certified): brackets mark an uncertified category."""
    text = squash(raw)
    inner = F.regexp_extract(text, BRACKETED, 1)
    return F.struct(
        F.when(inner != "", inner).otherwise(text).alias("value"), (inner == "").alias("certified")
    )


def marks(result: Column, dual: Column, rate: Column) -> Column:
    """Struct(elected, dual, excluded, rate) of the mark cells; contradictions are errors."""
    r, d, s = squash(result), squash(dual), squash(rate)
    excluded = s.isin(*EXCLUDED_MARKS)
    value = F.when(~excluded, parse_decimal(s, to="decimal(9,3)"))
    is_dual = d == DUAL_MARK
    problem = (
        F.when(~r.isin(*RESULT_MARKS), F.concat(F.lit("result mark "), r))
        .when(~d.isin("", DUAL_MARK), F.concat(F.lit("dual mark "), d))
        .when(~is_dual & (excluded | value.isNotNull()), F.concat(F.lit("rate without dual mark "), s))
    )
    checked = F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(r == RESULT_MARKS[0])
    return F.struct(checked.alias("elected"), is_dual.alias("dual"), excluded.alias("excluded"), value.alias("rate"))


def list_marks(result: Column, rate: Column) -> Column:
    """Struct(result, dual, excluded, rate) of a list entry's district columns; an unknown mark is an error.

    Any district result makes a dual candidacy; an excluded one has a cross for its ratio.
    """
    r, s = squash(result), squash(rate)
    excluded = s.isin(*EXCLUDED_MARKS)
    checked = F.when(r.isin("", *RESULT_MARKS), r).otherwise(F.raise_error(F.concat(F.lit("district result "), r)))
    return F.struct(
        checked.alias("result"), (checked != "").alias("dual"), excluded.alias("excluded"),
        F.when(~excluded, parse_decimal(s, to="decimal(9,3)")).alias("rate"))


def main_and_inner(cell: Column) -> Column:
    """Struct(main, inner) of a cell with a value line and a bracketed count."""
    lines = F.filter(
        F.transform(F.split(cell, "\n"), squash), lambda x: ~x.rlike(f"^{PAREN_COUNT}$")
    )
    inner = F.regexp_extract(squash(cell), PAREN_COUNT, 1)
    return F.struct(
        parse_int(F.get(lines, F.lit(0))).alias("main"),
        F.when(inner != "", parse_int(inner)).alias("inner"),
    )


def list_header(lines: Column) -> Column:
    """Struct(party, votes, seats, male, female) from an array of header lines.

    A header without a number of votes or seats is an error.
    """
    texts = F.transform(lines, squash)
    stops = ("得票数", "当選人数", "名簿", "男")

    def first(prefix):
        return F.get(F.filter(texts, lambda x: x.startswith(prefix)), F.lit(0))

    def is_name(x):
        out = F.lit(False)
        for p in PARTY_COLUMN_LABELS:
            out = out | x.startswith(p)
        return out

    def is_stop(x):
        out = x == ""
        for p in stops:
            out = out | x.startswith(p)
        return out

    # The name may wrap: take lines after the label until another labelled line.
    start = F.array_position(F.transform(texts, is_name), True)
    after = F.slice(texts, F.greatest(start, F.lit(1)).cast("int") + 1, F.size(texts))
    stop = F.array_position(F.transform(after, is_stop), True)
    count = F.when(stop > 0, stop - 1).otherwise(F.size(after)).cast("int")
    head = strip_prefix(F.get(texts, (F.greatest(start, F.lit(1)) - 1).cast("int")), PARTY_COLUMN_LABELS)
    name = F.when(start > 0, F.concat(head, F.array_join(F.slice(after, F.lit(1), count), "")))
    people = r"^男([0-9]+)人女([0-9]+)人$"
    gender = first("男")

    def tail(prefix):
        return F.substr(first(prefix), F.lit(len(prefix) + 1))

    def needed(prefix, value):
        problem = F.concat(F.lit(f"list header without {prefix}: "), F.array_join(texts, " "))
        return F.when(value.isNull(), F.raise_error(problem)).otherwise(value)

    return F.struct(
        name.alias("party"),
        needed("得票数", parse_decimal(tail("得票数"))).alias("votes"),
        needed("当選人数", parse_int(tail("当選人数"))).alias("seats"),
        F.when(gender.rlike(people), F.regexp_extract(gender, people, 1).cast("int")).alias("male"),
        F.when(gender.rlike(people), F.regexp_extract(gender, people, 2).cast("int")).alias("female"),
    )


def any_required_missing(columns: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c.isNull() | (c.cast("string") == "")
    return out


def within(value: Column, lo: int, hi: int) -> Column:
    return F.coalesce(value.between(lo, hi), F.lit(False))
