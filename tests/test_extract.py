"""Cell grids of printed pages become typed rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.grid import column_roles
from tallyforge.plans import extract


def cells(spark, lines):
    rows = [(1, r, c, text) for r, line in enumerate(lines) for c, text in enumerate(line)]
    return spark.createDataFrame(rows, "page int, row int, col int, text string")


def test_block_is_carried_to_the_grand_total(spark):
    page = cells(spark, [
        ["", "表題", "", ""], ["四国", "徳島県", "1,000", "2.5%"], ["", "香 川県", "２０", "△1"], ["", "計", "1,020", "-"],
        ["東京都", "東京都", "7", "8"], ["", "合計", "1,027", "9"], ["", "計", "1", "1"],
    ])
    got = extract.measures_by_place(page, ["page"], ["total", "rate"], True).orderBy("row").collect()
    assert [(r.block, r.prefecture, r.total, r.rate) for r in got] == [
        ("四国", "徳島県", 1000, Decimal("2.5")), ("四国", "香川県", 20, -1), ("四国", "計", 1020, None),
        ("東京都", "東京都", 7, 8), ("", "合計", 1027, 9), ("", "合計", 1, 1)]


def test_number_column_before_the_prefecture(spark):
    page = cells(spark, [["1", "北海道", "5"], ["2", "青森県", "6"], ["", "計", "11"]])
    got = extract.measures_by_place(page, ["page"], ["v"], False).orderBy("row").collect()
    assert [(r.prefecture, r.v) for r in got] == [("北海道", 5), ("青森県", 6), ("合計", 11)]
    blank = cells(spark, [["1", "北海道", ""]])
    with pytest.raises(Exception, match="empty number"):
        extract.measures_by_place(blank, ["page"], ["v"], False, blanks_allowed=False).collect()


def test_wrapped_party_header(spark):
    page = cells(spark, [
        ["表", "", "", "", "", "", ""], ["", "自由民", "主", "党", "公", "明党", ""], ["", "", "", "", "", "", ""],
        ["都道府県", "男", "女", "計", "男", "女", "計"], ["北海道", "1", "2", "3", "", "4", "4"], ["計", "1", "2", "3", "0", "4", "4"],
    ])
    known = spark.createDataFrame([("自由民主党",), ("公明党",)], "name string")
    got = extract.measures_by_party(page, known, ["page"], ["m", "f", "t"], 2).orderBy("row", "party").collect()
    assert [(r.prefecture, r.party, r.m, r.f, r.t) for r in got] == [
        ("北海道", "公明党", None, 4, 4), ("北海道", "自由民主党", 1, 2, 3), ("合計", "公明党", 0, 4, 4), ("合計", "自由民主党", 1, 2, 3)]


def test_bands(spark):
    page = cells(spark, [["都道府県", "２５歳", "80歳", "計"], ["", "～", "以上", ""], ["", "29歳", "", ""], ["北海道", "3", "", "4"], ["計", "3", "1", "4"]])
    got = extract.counts_by_band(page, ["page"], 2).orderBy("row", "age_band").collect()
    assert {(r.prefecture, r.age_band, r["count"]) for r in got} == {
        ("北海道", "25歳～29歳", 3), ("北海道", "80歳以上", None), ("北海道", "計", 4),
        ("合計", "25歳～29歳", 3), ("合計", "80歳以上", 1), ("合計", "計", 4)}


def test_vote_totals(spark):
    page = cells(spark, [
        ["区分", "自由民", "合計"], ["", "主党", ""], ["今回", "1,000", "3,000"], ["", "(33.3)", "(100.0)"],
        ["前回", "900", "2,900"], ["差引", "△100", "100"],
    ])
    got = {(r.period, r.party): (r.votes, r.share_pct) for r in extract.vote_totals(page, ["page"]).collect()}
    assert got == {
        ("current", "自由民主党"): (1000, Decimal("33.3")), ("current", "__TOTAL__"): (3000, 100),
        ("previous", "自由民主党"): (900, None), ("previous", "__TOTAL__"): (2900, None),
        ("diff", "自由民主党"): (-100, None), ("diff", "__TOTAL__"): (100, None)}


HEAD = ["当落", "候補者 氏名", "年齢", "党派", "新前元別", "職業", "得票数", "重複", "惜敗率(%)"]
BODY = [
    ["北海道第1区", "（定数1）", "", "", "", "供託物没収点", "12,345.600", "", ""],
    ["当", "甲 乙", "50", "自由民主党", "前", "議員", "100,000", "重", ""],
    ["落", "丙 丁", "60", "（無所属）", "新", "", "9,000", "", ""],
    ["落", "戊", "61", "公明党", "新", "", "8,000", "重", "×"],
    ["北海道第2区", "", "", "", "", "供託物没収点", "99", "", ""],
    ["当", "己", "40", "公明党", "元", "", "990.5", "重", "100.000"],
]


def candidate_rows(spark, body):
    grid = cells(spark, body)
    return extract.rows_of(grid, ["page"]).select(F.lit("d").alias("doc"), "page", F.col("row").cast("long").alias("pos"), "cells")


def roles(spark):
    header = cells(spark, [HEAD]).withColumn("label", F.regexp_replace("text", " ", ""))
    return column_roles(header, ["page"], "col", "label", extract.COLUMN_ROLES, extract.PREFIX_ROLES, extract.REQUIRED_ROLES)


def test_candidates(spark):
    found, problems = roles(spark)
    assert problems.isEmpty()
    districts, people = extract.candidates(candidate_rows(spark, BODY), found, ["doc"], ["page"])
    assert [(r.prefecture, r.district_no, r.deposit_forfeit_point) for r in districts.orderBy("district_no").collect()] == [
        ("北海道", 1, Decimal("12345.600")), ("北海道", 2, 99)]
    got = people.orderBy("district_no", "order_in_district").collect()
    assert [(r.district_no, r.order_in_district, r.name_display, r.party, r.party_is_certified, r.votes, r.elected) for r in got] == [
        (1, 1, "甲乙", "自由民主党", True, 100000, True), (1, 2, "丙丁", "無所属", False, 9000, False),
        (1, 3, "戊", "公明党", True, 8000, False), (2, 1, "己", "公明党", True, Decimal("990.5"), True)]
    assert [(r.dual_candidacy, r.sekihai_excluded, r.sekihai_rate) for r in got] == [
        (True, False, None), (False, False, None), (True, True, None), (True, False, 100)]


@pytest.mark.parametrize("row,message", [
    (["当", "x", "17", "公明党", "新", "", "1", "", ""], "impossible age"),
    (["当", "x", "30", "公明党", "新", "", "1", "", "50.0"], "rate without dual"),
    (["当", "x", "30", "公明党", "新", "", "abc", "", ""], "not a number"),
])
def test_bad_candidates_stop_the_job(spark, row, message):
    _, people = extract.candidates(candidate_rows(spark, [BODY[0], row]), roles(spark)[0], ["doc"], ["page"])
    with pytest.raises(Exception, match=message):
        people.collect()


def test_row_above_the_first_header(spark):
    _, people = extract.candidates(candidate_rows(spark, BODY[1:2]), roles(spark)[0], ["doc"], ["page"])
    with pytest.raises(Exception, match="above the first district header"):
        people.collect()


def test_missing_role_is_reported(spark):
    header = cells(spark, [HEAD[:-1] + ["当落"]]).withColumn("label", F.regexp_replace("text", " ", ""))
    _, problems = column_roles(header, ["page"], "col", "label", extract.COLUMN_ROLES, extract.PREFIX_ROLES, extract.REQUIRED_ROLES)
    assert {(r.role, r.problem) for r in problems.collect()} == {("sekihai", "missing"), ("result", "duplicate")}


LISTED = [["1", "甲", "", "乙", "2", "当", "100.0"], ["1", "丙", "丁", "", "", "落", "×"], ["", "", "", "", "", "", ""], ["3", "戊", "", "", "1", "", ""]]
HEADER = ["政党等名 公明", "党", "名簿届出 3人", "得票数 1,000票", "当選人数 2人"]


def listed(spark, rows, header=HEADER, group=0, known=("公明党",)):
    df = spark.createDataFrame([("d", 0, i, {k: c for k, c in enumerate(r)}) for i, r in enumerate(rows)], "doc string, grp int, pos int, cells map<int,string>")
    head = spark.createDataFrame([("d", group, header)], "doc string, grp int, lines array<string>")
    return extract.list_entries(df, head, ["doc", "grp"], known)


def test_list_entries(spark):
    got = listed(spark, LISTED).orderBy("ordinal").collect()
    assert [tuple(r)[2:] for r in got] == [
        (1, "公明党", 1, "甲乙", 2, True, "当", Decimal("100.000"), False, True),
        (2, "公明党", 1, "丙丁", None, False, "落", None, True, True),
        (3, "公明党", 3, "戊", 1, True, "", None, False, False)]


@pytest.mark.parametrize("change,message", [
    (dict(rows=[["1", "", "", "", "", "", ""]]), "without a name"), (dict(rows=[["1", "甲", "", "", "", "可", ""]]), "district result"),
    (dict(rows=LISTED, group=1), "without a party header"), (dict(rows=LISTED, known=["別"]), "unknown category"),
    (dict(rows=[["一", "甲", "", "", "", "", ""]]), "not a number"),
])
def test_bad_list_entries_stop_the_job(spark, change, message):
    with pytest.raises(Exception, match=message):
        listed(spark, **change).collect()
