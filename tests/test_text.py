"""Text, numbers and labels on the forms that occur in print."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import labels, numbers, text


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first().o


@pytest.mark.parametrize("raw,want", [
    ("a　b c\t\n", "abc"), ("", ""), (" x y", "xy"), ("a\x1cb\x85c", "abc"),
])
def test_squash(spark, raw, want):
    assert one(spark, text.squash(F.col("s")), raw) == want


@pytest.mark.parametrize("raw,want", [
    ("大塚\U000e0106拓", "大塚拓"), ("三ッ林 裕巳", "三ツ林裕巳"), ("ｱｲｳ", "アイウ"), ("Ａｂ１", "Ab1"), (None, ""), ("キャ︀", "キヤ"),
])
def test_name_key(spark, raw, want):
    assert one(spark, text.name_key(F.col("s")), raw) == want


@pytest.mark.parametrize("raw,want", [
    ("1,234.567", "1234.567"), ("１２３", "123"), ("△5", "-5"), ("▲1,000", "-1000"), ("12.5%", "12.5"), ("34人", "34"),
    ("　7 票", "7"), ("△", None), ("-", None), ("", None), (None, None), ("－", None), ("-3", "-3"),
])
def test_parse_decimal(spark, raw, want):
    got = one(spark, numbers.parse_decimal(F.col("s")), raw)
    assert got == (None if want is None else Decimal(want))


@pytest.mark.parametrize("raw", ["abc", "1.2.3", "12x", "1-2"])
def test_bad_number(spark, raw):
    with pytest.raises(Exception, match="not a number"):
        one(spark, numbers.parse_decimal(F.col("s")), raw)
    assert one(spark, numbers.parse_decimal(F.col("s"), strict=False), raw) is None
    assert one(spark, numbers.number_state(F.col("s")), raw) == "bad"


def test_parse_int(spark):
    assert one(spark, numbers.parse_int(F.col("s")), "1,200人") == 1200
    with pytest.raises(Exception, match="not whole"):
        one(spark, numbers.parse_int(F.col("s")), "1.5")


def test_scaled(spark):
    assert one(spark, numbers.scaled(F.col("s").cast("decimal(20,4)")), "12.345") == 12345
    with pytest.raises(Exception, match="too many decimals"):
        one(spark, numbers.scaled(F.col("s").cast("decimal(20,4)")), "0.0001")


@pytest.mark.parametrize("raw,want", [("5.000", "5"), ("5.250", "5.250"), ("-1200.000", "-1200")])
def test_plain_decimal(spark, raw, want):
    assert one(spark, numbers.plain_decimal(F.col("s").cast("decimal(20,3)")), raw) == want


@pytest.mark.parametrize("raw,want", [(3, "+3"), (-2, "−2"), (0, "±0")])
def test_signed(spark, raw, want):
    assert one(spark, numbers.signed_text(F.col("n")), raw, "n int") == want


@pytest.mark.parametrize("raw,want", [(12, 10), (13, 15), (2.5, 0), (7.5, 10), (12.5, 10)])
def test_round_step_half_even(spark, raw, want):
    assert one(spark, numbers.round_step(F.col("n")), float(raw), "n double") == want


@pytest.mark.parametrize("raw,want", [
    ("２５歳～２９歳", ("25歳～29歳", 25, 29)), ("25歳29歳", ("25歳～29歳", 25, 29)), ("80歳以上", ("80歳以上", 80, None)),
    ("合計", ("計", None, None)), ("", ("", None, None)),
])
def test_bands(spark, raw, want):
    assert tuple(one(spark, labels.canonical_band(F.col("s")), raw)) == want


def test_bad_band(spark):
    with pytest.raises(Exception, match="not a range label"):
        one(spark, labels.canonical_band(F.col("s")), "若者")


def test_header(spark):
    got = one(spark, labels.parse_header(F.col("s")), "北海道第12区（定数1）供託物没収点15,633.600")
    assert tuple(got) == ("北海道", 12, Decimal("15633.600"))
    assert one(spark, labels.parse_header(F.col("s")), "注記") is None


def test_category(spark):
    assert one(spark, labels.canonical_category(F.col("s")), "立憲 民主党※１") == "立憲民主党"
    assert one(spark, labels.canonical_category(F.col("s")), "（無所属）") == "無所属"
    assert one(spark, labels.canonical_category(F.col("s")), "得票総数") == "__TOTAL__"


def test_bracketed(spark):
    assert tuple(one(spark, labels.bracketed(F.col("s")), "（ 新党 ）")) == ("新党", False)
    assert tuple(one(spark, labels.bracketed(F.col("s")), "新党")) == ("新党", True)


def marks(spark, *cells):
    df = spark.createDataFrame([cells], "r string, d string, s string")
    return tuple(df.select(labels.marks(F.col("r"), F.col("d"), F.col("s")).alias("o")).first().o)


def test_marks(spark):
    assert marks(spark, "当", "重", "95.5") == (True, True, False, Decimal("95.500"))
    assert marks(spark, "落", "重", "×") == (False, True, True, None)
    assert marks(spark, "落", "", "") == (False, False, False, None)
    with pytest.raises(Exception, match="rate without dual"):
        marks(spark, "落", "", "×")
    with pytest.raises(Exception, match="result mark"):
        marks(spark, "?", "", "")


def test_cell_with_inner_count(spark):
    assert tuple(one(spark, labels.main_and_inner(F.col("s")), "123\n(45)")) == (123, 45)
    assert tuple(one(spark, labels.main_and_inner(F.col("s")), "(4)\n7")) == (7, 4)
    assert tuple(one(spark, labels.main_and_inner(F.col("s")), "9")) == (9, None)


def test_row_label(spark):
    df = spark.createDataFrame(
        [("東京都", True, ""), ("計", False, "東海"), ("計", False, ""), ("合計", False, "東海"), ("注", False, "")],
        "s string, hit boolean, b string")
    got = [r.o for r in df.select(labels.row_label(F.col("s"), F.col("hit"), F.col("b")).alias("o")).collect()]
    assert got == ["東京都", "計", "合計", "合計", None]


def test_strip_prefix_longest_first(spark):
    assert one(spark, text.strip_prefix(F.col("s"), ["党派", "党派名"]), "党派名みどり") == "みどり"
    assert one(spark, text.strip_prefix(F.col("s"), ["党派"]), "みどり") is None


def test_expressions_run_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("△1,200",), ("３",)], "s string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string").parquet(str(tmp_path / "in"))
    query = stream.select(numbers.parse_decimal(F.col("s")).alias("v")).writeStream.format("memory").queryName("nums").start()
    query.processAllAvailable()
    query.stop()
    assert {int(r.v) for r in spark.table("nums").collect()} == {-1200, 3}


def test_list_header_stops_at_the_roster_line(spark):
    df = spark.createDataFrame([(["政党等名 赤の", "会", "名簿届出 3人", "得票数 1,234票", "当選人数 2人"],)], "lines array<string>")
    h = df.select(labels.list_header(F.col("lines")).alias("h")).first().h
    assert (h.party, int(h.votes), h.seats) == ("赤の会", 1234, 2)


@pytest.mark.parametrize("lines", [["政党等名 赤", "当選人数 2人"], ["政党等名 赤", "得票数 12票"]])
def test_list_header_needs_votes_and_seats(spark, lines):
    df = spark.createDataFrame([(lines,)], "lines array<string>")
    with pytest.raises(Exception, match="list header without"):
        df.select(labels.list_header(F.col("lines")).alias("h")).collect()


def test_unknown_category_is_an_error(spark):
    df = spark.createDataFrame([("赤 ※１",), ("（無所属）",), (None,)], "c string")
    known = labels.canonical_category(F.col("c"), known=["赤"])
    assert [r[0] for r in df.select(known).collect()] == ["赤", "無所属", None]
    with pytest.raises(Exception, match="unknown category: 青"):
        spark.createDataFrame([("青",)], "c string").select(known).collect()
