"""Sources and sinks: typed cells, round trips, nested documents, manifests, schemas."""

import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import reshape, grid, scan, aggregates
from tallyforge.sources import dimensions, documents, manifest, tables
from tallyforge.sources.schemas import PERSONAL_TABLES, TABLES


def test_schemas_cover_twenty_tables():
    assert len(TABLES) == 20
    assert all(s.fieldNames()[0] == "election_id" and s.fieldNames()[-1] == "source_page" for s in TABLES.values())
    assert set(PERSONAL_TABLES) <= set(TABLES)


def test_typed(spark):
    df = spark.createDataFrame([("e", "東", "a", "1,5", "", "x", "3")], "election_id string, block string, party string, votes string, seats string, extra string, source_page string")
    with pytest.raises(Exception, match="CAST"):
        tables.typed(df, TABLES["pr_party_blocks"]).collect()
    row = tables.typed(df, TABLES["pr_party_blocks"], strict=False).first()
    assert row.votes is None and row.seats is None and row.source_page == 3 and row.extra == "x"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("e", "東", "a", Decimal("1200.000"), 3, None, None, 7), ("e", "東", "b", Decimal("5.250"), 0, 1, None, 7)],
        TABLES["pr_party_blocks"],
    )
    path = str(tmp_path / "out")
    tables.write_table(df, path)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "1200," in text and "5.250" in text and "1200.000" not in text and "null" not in text
    back = tables.typed(tables.read_text_table(spark, path), TABLES["pr_party_blocks"])
    assert sorted(map(tuple, back.drop("file_ordinal").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError, match="zero rows"):
        tables.write_table(df.where("false"), path + "2")


def test_flags_and_ordinals(spark, tmp_path):
    folder = tmp_path / "e1"
    folder.mkdir()
    (folder / "party_votes_by_block.csv").write_text(
        "election_id,block,rank,party,votes,share_pct,is_total_row,source_page\ne1,東,1,a,10,50.00,false,1\ne1,東,2,b,10,50.00,,1\ne1,東,,計,20,,true,1\n")
    loaded = tables.load_tables(spark, str(tmp_path))
    assert set(loaded) == {"party_votes_by_block"}
    rows = loaded["party_votes_by_block"].orderBy("file_ordinal").collect()
    assert [r.is_total_row for r in rows] == [False, False, True]
    assert [r.party for r in rows] == ["a", "b", "計"]
    assert rows[2].share_pct is None
    with pytest.raises(FileNotFoundError):
        tables.load_tables(spark, str(tmp_path / "nowhere"))


def test_nest_and_flatten(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 1, "c")], "k string, o int, v string")
    nested = documents.nest(df, ["k"], ["o"], ["o", "v"], "items")
    assert [x.v for x in nested.where("k = 'k'").first()["items"]] == ["a", "b"]
    assert sorted(map(tuple, documents.flatten(nested, "items").collect())) == sorted(map(tuple, df.collect()))


def test_nest_in_parts_keeps_everything(spark):
    df = spark.range(25).select(F.lit("k").alias("k"), F.col("id").alias("o"), F.col("id").alias("v"))
    parts = documents.nest_in_parts(df, ["k"], ["o"], ["o", "v"], "items", 10).orderBy("part_no").collect()
    assert [[x.v for x in p["items"]] for p in parts] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]


def test_documents_are_written_only_when_checked(spark, tmp_path):
    doc = spark.createDataFrame([("k", [1])], "k string, items array<int>")
    problems = spark.createDataFrame([("seats",)], "problem string")
    with pytest.raises(ValueError, match="self-check"):
        documents.write_checked(doc, problems, str(tmp_path / "d"))
    assert not (tmp_path / "d").exists()
    documents.write_checked(doc, problems.where("false"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first()["items"] == [1]


def test_manifest_of_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "b.bin").write_bytes(b"two")
    files = manifest.file_contents(spark, str(tmp_path)).withColumn("source", F.substring_index("source", "/", -1))
    registered = spark.createDataFrame(
        [("a.bin", hashlib.sha256(b"one").hexdigest()), ("b.bin", "00"), ("c.bin", "11")], "source string, sha256 string")
    got = {r.source: r.status for r in manifest.verify_manifest(files, registered).collect()}
    assert got == {"a.bin": "ok", "b.bin": "mismatch", "c.bin": "missing"}


def test_geography(spark):
    geo = dimensions.geography(spark)
    assert geo.count() == 47 and geo.select("block").distinct().count() == 11
    assert geo.where("prefecture = '沖縄県'").first()[1:] == (47, "九州")


def test_election_index_newest_first(spark):
    rows = dimensions.election_index(dimensions.elections(spark)).collect()
    assert [r.ordinal for r in rows] == [51, 50, 49, 48, 47]
    assert rows[-1].totalSeats == 475


def test_header_span_grows_until_all_known(spark):
    cells = spark.createDataFrame(
        [(0, 0, "title"), (1, 0, "自由民"), (2, 0, "主党"), (1, 1, ""), (2, 1, "公明党"), (3, 0, "男"), (3, 1, "女")],
        "row int, col int, text string").withColumn("page", F.lit(1))
    known = spark.createDataFrame([("自由民主党",), ("公明党",)], "name string")
    got = grid.header_span(cells, known, ["page"], "row", "col", "text", 2).orderBy("group_no").collect()
    assert [(r.start_row, r.end_row, r.name) for r in got] == [(1, 2, "自由民主党"), (1, 2, "公明党")]
    top = grid.header_span(cells, known, ["page"], "row", "col", "text", 3, max_rows=3, from_bottom=False).collect()
    assert {(r.start_row, r.end_row) for r in top} == {(1, 2)}
    assert grid.header_span(cells, known.limit(1), ["page"], "row", "col", "text", 2).isEmpty()


def test_cells_of_any_size(spark):
    """Long chains of lines, one of them in a cell without a name, against a walk from the top."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", None]), float(rng.randrange(3000)) / 4, rng.randrange(50), rng.choice("xyz")) for _ in range(3000)]
    rows += [("b", None, 1, "n"), ("b", None, 0, "m"), ("b", 5.0, 1, "o"), ("c", 1.0, 0, None)]
    want = {}
    for cell in {r[0] for r in rows}:
        line, first = 0, object()
        lines = {}
        for _, top, x, t in sorted((r for r in rows if r[0] == cell), key=lambda r: (r[1] is not None, r[1] or 0)):
            if line == 0 or (first is None) != (top is None) or top is not None and top > first + 3.0:
                line, first = line + 1, top
            lines.setdefault((line, first), []).append((x, top, t))
        want |= {(cell, *k): "".join(t for *_, t in sorted(v, key=lambda p: (p[0], p[1] or 0, p[2] or "")) if t) for k, v in lines.items()}
    got = grid.cell_lines(spark.createDataFrame(rows, "cell string, top double, x int, t string"), ["cell"], "top", "x", "t", 3.0)
    assert {(r.cell, r.line_no, r.top): r.text for r in got.collect()} == want and len(want) > 300


def test_cell_lines_look_back_to_the_first(spark):
    tokens = spark.createDataFrame(
        [(1, 0.0, 5.0, "b"), (1, 2.0, 1.0, "a"), (1, 3.5, 2.0, "c"), (1, 9.0, 1.0, "d")], "cell int, top double, x double, t string")
    got = grid.cell_lines(tokens, ["cell"], "top", "x", "t", 3.0).orderBy("line_no").collect()
    # 3.5 is within 3 of its neighbour but not of the line's first token.
    assert [(r.top, r.text) for r in got] == [(0.0, "ab"), (3.5, "c"), (9.0, "d")]


def test_cluster_means(spark):
    df = spark.createDataFrame([("p", v) for v in (1.0, 1.5, 1.9, 9.0)], "page string, v double")
    got = grid.cluster_means(df, ["page"], "v", 0.6).orderBy("cluster_no").collect()
    assert [(round(r.center, 4), r["size"]) for r in got] == [(1.4667, 3), (9.0, 1)]


def test_overrides(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, None)], "k int, name string")
    register = spark.createDataFrame([(1, "A")], "k int, name string")
    assert [r.name for r in reshape.with_overrides(df, register, ["k"], ["name"]).orderBy("k").collect()] == ["A", "b", None]
    assert [r.k for r in reshape.unresolved(df, register, ["k"], F.col("name").isNull()).collect()] == [3]


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("s"), F.col("id").alias("k"))
    a = aggregates.seeded_sample(df.repartition(7), ["s"], "k", 4, "seed")
    b = aggregates.seeded_sample(df.coalesce(1), ["s"], "k", 4, "seed")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.count() == 12


def test_files_are_matched_by_column_name(spark, tmp_path):
    for name, lines in (("one", "election_id,a,b\n1,10,20\n"), ("two", "election_id,b,a,c\n2,20,10,\"x \"\"q\"\" y\"\n"), ("three", "election_id,a\n3,\"l1\nl2\"\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.csv").write_text(lines)
    got = tables.read_text_table(spark, f"{tmp_path}/*/t.csv").orderBy("election_id").select("election_id", "a", "b", "c").collect()
    assert [tuple(r) for r in got] == [("1", "10", "20", None), ("2", "10", "20", 'x "q" y'), ("3", "l1\nl2", None, None)]


def test_quotes_survive_a_round_trip(spark, tmp_path):
    rows = [(1, 'x "q" y'), (2, "a,b"), (3, "l1\nl2"), (4, "")]
    tables.write_table(spark.createDataFrame(rows, "k long, v string"), str(tmp_path / "t.csv"))
    got = tables.read_text_table(spark, str(tmp_path / "t.csv")).orderBy("k").select("k", F.coalesce("v", F.lit(""))).collect()
    assert [tuple(r) for r in got] == [(str(k), v) for k, v in rows]
