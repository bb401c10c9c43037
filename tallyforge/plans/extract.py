"""From cell grids of printed pages to typed rows.

``cells``: page keys, row, col, text (lines of a cell separated by newlines). A page
has a few hundred cells, so a row's cells are kept together as a small map; pages are
processed in parallel and any number of documents goes through one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numbers import parse_decimal, parse_int
from ..functions.text import squash
from ..operators.grid import header_span, locate_column
from ..operators.scan import carry_forward, join_null_safe, ordered_running_sum, ordered_rank
from ..sources.dimensions import BLOCKS, PREFECTURES, is_prefecture

# Header labels of the candidate table and their roles.
COLUMN_ROLES = {
    "当落": "result", "候補者氏名": "name", "性別": "gender", "年齢": "age", "党派": "party", "届出政党等": "party",
    "新前元別": "status", "職業": "occupation", "得票数": "votes", "重複": "dual",
}
PREFIX_ROLES = (("惜敗率", "sekihai"),)
REQUIRED_ROLES = ("result", "name", "age", "party", "status", "occupation", "votes", "dual", "sekihai")
PERIODS = {"今回": "current", "前回": "previous", "差引": "diff"}
HEADER_WORD = "供託物没収点"


def rows_of(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per printed row with its cells as a map col -> text."""
    return cells.groupBy(*keys, "row").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), F.coalesce("text", F.lit(""))))).alias("cells")
    )


def cell(i: Column | int) -> Column:
    at = F.lit(i) if isinstance(i, int) else i
    return F.coalesce(F.try_element_at("cells", at.cast("int")), F.lit(""))


def measures_by_place(
    cells: DataFrame, keys: Sequence[str], measures: Sequence[str], with_block: bool, blanks_allowed: bool = True
) -> DataFrame:
    """Rows of a table "(block) prefecture, n numbers": block, prefecture, measures.

    The prefecture column is located per page. A block label holds for the rows below
    it until the grand total. With ``blanks_allowed`` off, an empty number is an error.
    """
    base = locate_column(
        cells.withColumn("key", squash(F.col("text"))), PREFECTURES, keys, "col", "key"
    ).select(*keys, F.col("col").cast("int").alias("base"))
    rows = join_null_safe(rows_of(cells, keys), base, keys, "inner")
    label, before = squash(cell(F.col("base"))), squash(cell(F.col("base") - 1))
    opens = F.when(before.isin(*BLOCKS), before) if with_block else F.lit(None).cast("string")
    marked = rows.select("*", label.alias("label"), opens.alias("opens"))
    # The grand total itself no longer belongs to a block.
    held = carry_forward(
        marked, keys, ["row"], "opens", "block", F.col("label") == labels.GRAND_TOTAL
    ).withColumn("block", F.coalesce("block", F.lit("")))
    place = labels.row_label(F.col("label"), is_prefecture("label"), F.col("block"))
    kept = held.withColumn("prefecture", place).where("prefecture IS NOT NULL")
    values = [cell(F.col("base") + 1 + i) for i in range(len(measures))]
    if not blanks_allowed:
        values = [F.when(squash(v) == "", F.raise_error(F.concat(F.lit("empty number in row "), F.col("label")))).otherwise(v) for v in values]
    return kept.select(*keys, "row", "block", "prefecture", *[parse_decimal(v).alias(m) for v, m in zip(values, measures)])


def measures_by_party(
    cells: DataFrame, parties: DataFrame, keys: Sequence[str], measures: Sequence[str], last_header_row: int, offset: int = 1,
    whole: bool = False, max_rows: int | None = None, from_bottom: bool = True, known: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of a table "prefecture, then n numbers per party": prefecture, party, measures.

    ``parties`` (name) are the known categories as printed, totals included; their
    header may be wrapped over cells and rows.
    """
    n = len(measures)
    body = cells.where(F.col("col") >= offset).withColumn("col", F.col("col") - offset)
    cleaned = body.withColumn("text", squash(F.coalesce("text", F.lit(""))))
    heads = header_span(cleaned, parties, keys, "row", "col", "text", last_header_row, n, max_rows, from_bottom)
    groups = heads.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("group_no", "name"))).alias("groups"))
    rows = join_null_safe(rows_of(cells, keys), groups, keys, "inner")
    label = squash(cell(0))
    place = F.when(is_prefecture(label), label).when(label.isin(labels.BLOCK_TOTAL, labels.GRAND_TOTAL), labels.GRAND_TOTAL)
    long = rows.withColumn("prefecture", place).where("prefecture IS NOT NULL").select(
        *keys, "row", "prefecture", "cells", F.explode("groups").alias("g"))
    parse = parse_int if whole else parse_decimal
    return long.select(
        *keys, "row", "prefecture", labels.canonical_category(F.col("g.name"), known=known).alias("party"),
        *[parse(cell(F.col("g.group_no") * n + offset + i)).alias(m) for i, m in enumerate(measures)],
    )


def counts_by_band(cells: DataFrame, keys: Sequence[str], last_header_row: int) -> DataFrame:
    """Rows of a table "prefecture, then one count per range": prefecture, age_band, count.

    A range label is printed over several header rows of its column.
    """
    heads = cells.where((F.col("row") <= last_header_row) & (F.col("col") > 0)).groupBy(*keys, "col").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda x: squash(x["text"])), "").alias("label"))
    bands = heads.select(*keys, "col", labels.canonical_band(F.col("label"))["label"].alias("age_band")).where("age_band <> ''")
    name = squash(F.col("text"))
    places = cells.where((F.col("col") == 0) & (F.col("row") > last_header_row)).select(
        *keys, "row", F.when(is_prefecture(name), name).when(name.isin(labels.BLOCK_TOTAL, labels.GRAND_TOTAL), labels.GRAND_TOTAL).alias("prefecture")
    ).where("prefecture IS NOT NULL")
    counts = join_null_safe(cells, places, [*keys, "row"], "inner")
    return join_null_safe(counts, bands, [*keys, "col"], "inner").select(
        *keys, "row", "prefecture", "age_band", parse_int(F.col("text")).alias("count"))


def vote_totals(cells: DataFrame, keys: Sequence[str], known: Sequence[str] | None = None) -> DataFrame:
    """Rows of a table headed "区分" with one row per period and a bracketed share below.

    Result: period, party, votes, share_pct. Names wrapped over several rows, from the
    "区分" row to the next period row, are joined.
    """
    rows = rows_of(cells, keys).withColumn("label", squash(cell(0)))
    period = F.lit(None).cast("string")
    for text, name in PERIODS.items():
        period = F.when(F.col("label") == text, name).otherwise(period)
    kinds = rows.withColumn("period", period).withColumn("is_head", F.when(F.col("label") == "区分", 1).otherwise(0))
    blocks = ordered_running_sum(kinds, keys, ["row"], "is_head", "table_no").where("table_no > 0")
    by = [*keys, "table_no"]
    held = carry_forward(blocks, by, ["row"], "period", "of_period")
    cols = held.select("*", F.explode(F.map_entries("cells")).alias("c")).where("c.key > 0").withColumn(
        "text", squash(F.col("c.value"))).withColumn("col", F.col("c.key"))
    names = cols.where("of_period IS NULL").groupBy(*by, "col").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), "").alias("name")).where("name <> ''")
    share = F.col("label") == ""
    figures = cols.where("of_period IS NOT NULL").groupBy(*by, "of_period", "col").agg(
        F.max(F.when(F.col("period").isNotNull(), F.col("text"))).alias("votes_text"),
        F.max(F.when(share & F.col("text").rlike(r"^[（(]"), F.regexp_replace("text", r"[()（）]", ""))).alias("share_text"))
    return join_null_safe(figures, names, [*by, "col"], "inner").select(
        *keys, F.col("of_period").alias("period"), labels.canonical_category(F.col("name"), known=known).alias("party"),
        parse_decimal(F.col("votes_text")).alias("votes"), parse_decimal(F.col("share_text"), to="decimal(9,3)").alias("share_pct"))


def candidates(
    rows: DataFrame, roles: DataFrame, doc: Sequence[str], page: Sequence[str], known: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(districts, candidates) from the rows of the candidate table.

    ``rows``: doc, page keys, ``pos`` (reading order inside a document), ``cells``.
    ``roles``: page keys, role, col. A district header opens a district; the rows below
    are its candidates, numbered from 1. Contradictory marks, an impossible age, a row
    above the first header or a party that is not among the ``known`` are errors.
    """
    doc, page = list(doc), list(page)
    joined = squash(F.array_join(F.transform(F.array_sort(F.map_entries("cells")), lambda e: e["value"]), ""))
    header = F.when(joined.contains(HEADER_WORD), labels.parse_header(joined))
    marked = rows.withColumn("__joined", joined).where("__joined <> ''").withColumn("header", header)
    placed = carry_forward(marked, doc, ["pos"], "header", "district")
    head = F.col("header").isNotNull()
    districts = placed.where(head).select(
        *doc, *page, F.col("district.area").alias("prefecture"), F.col("district.number").alias("district_no"),
        F.col("district.amount").alias("deposit_forfeit_point"))
    where_roles = roles.groupBy(*page).agg(F.map_from_entries(F.collect_list(F.struct("role", F.col("col").cast("int")))).alias("roles"))
    people = join_null_safe(placed.where(~head), where_roles, page, "inner")
    numbered = ordered_rank(
        people.withColumn("__area", F.coalesce("district.area", F.lit(""))).withColumn("__nr", F.coalesce("district.number", F.lit(0))),
        [*doc, "__area", "__nr"], ["pos"], "order_in_district")

    def of(role):
        return squash(cell(F.coalesce(F.try_element_at("roles", F.lit(role)), F.lit(-1))))

    party = labels.bracketed(of("party"))
    mark = labels.marks(of("result"), of("dual"), of("sekihai"))
    age = parse_int(of("age"))
    checked_age = F.when(labels.within(age, 18, 120), age).otherwise(F.raise_error(F.concat(F.lit("impossible age: "), of("age"))))
    inside = F.when(F.col("district").isNotNull(), F.col("district.area")).otherwise(F.raise_error(F.lit("candidate above the first district header")))
    return districts, numbered.select(
        *doc, *page, inside.alias("prefecture"), F.col("district.number").alias("district_no"),
        F.col("order_in_district").cast("int").alias("order_in_district"), of("result").alias("result_mark"), of("name").alias("name_display"),
        checked_age.cast("int").alias("age"), of("gender").alias("gender"), of("party").alias("party_raw"),
        party.alias("__p"), of("status").alias("status"), of("occupation").alias("occupation"),
        parse_decimal(of("votes")).alias("votes"), mark.alias("__m"),
    ).select(
        "*", labels.canonical_category(F.col("__p.value"), known=known).alias("party"), F.col("__p.certified").alias("party_is_certified"),
        F.col("__m.elected").alias("elected"), F.col("__m.dual").alias("dual_candidacy"),
        F.col("__m.rate").alias("sekihai_rate"), F.col("__m.excluded").alias("sekihai_excluded"),
    ).drop("__p", "__m")


def list_entries(rows: DataFrame, headers: DataFrame, keys: Sequence[str], known: Sequence[str] | None = None) -> DataFrame:
    """Typed entries of printed party lists, numbered in reading order.

    ``rows``: keys (one list, e.g. doc, block, group), ``pos``, ``cells`` with the seven columns rank, name (three),
    order of election, district result and ratio. ``headers``: keys and ``lines``, the list's header as printed. Rows
    without rank are no entries; an entry without a header, without a name, with an unknown party or mark is an error.
    """
    keys = list(keys)
    head = headers.select(*keys, labels.list_header(F.col("lines")).alias("header"))
    name = squash(F.concat(cell(1), cell(2), cell(3)))
    marked = rows.select(*keys, "pos", "cells", squash(cell(0)).alias("rank"), name.alias("name")).where("rank <> '' OR name <> ''")
    placed = join_null_safe(marked, head, keys, "left")

    def need(ok, value, problem):
        return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(problem), F.coalesce("name", F.lit("")))))

    party = labels.canonical_category(F.col("header.party"), known=known)
    typed = placed.select(
        *keys, "pos", need(F.col("header").isNotNull(), party, "list entry without a party header: ").alias("party"),
        parse_int(F.col("rank")).alias("list_rank"), "rank", "name", "cells")
    entries = typed.where("rank <> '' AND party IS NOT NULL").select(
        *keys, "pos", "party", F.col("list_rank").cast("int").alias("list_rank"),
        need(F.col("name") != "", F.col("name"), "list entry without a name").alias("name"),
        parse_int(cell(4)).cast("int").alias("elected_order"), labels.list_marks(cell(5), cell(6)).alias("__m"))
    numbered = ordered_rank(entries, keys, ["pos"], "ordinal")
    return numbered.select(
        *keys, F.col("ordinal").cast("int").alias("ordinal"), "party", "list_rank", "name", "elected_order",
        F.col("elected_order").isNotNull().alias("elected_pr"), F.col("__m.result").alias("smd_result"),
        F.col("__m.rate").alias("sekihai_rate"), F.col("__m.excluded").alias("sekihai_excluded"), F.col("__m.dual").alias("dual_candidacy"))
