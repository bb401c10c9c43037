"""The query registry, and a cross-section of it against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
SAMPLE = [
    "apportion_dhondt", "apportion_capacity_vacant", "apportion_tie_flag", "quotient_table", "list_capacity", "majority_lines",
    "check_identity", "check_expected_totals", "check_contiguity", "parse_printed_number", "label_list_header", "gap_cluster", "range_bin", "section_positions", "merge_wrapped_parts", "nested_list_parts", "row_labels", "category_fold",
    "carry_forward", "merge_wrapped", "header_span", "locate_key_column", "nested_lists", "grouped_totals", "mode_first_seen",
    "rejection_layers", "orderings",
]


def test_registry():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert len(names) > 90
    assert {n for n in names - set(entry.oracle_sql()) if not n.startswith("op") and n != "pipeline"} == set()


@pytest.mark.skipif(not DATA.exists(), reason="shared tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    df = entry.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == columns
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())
    assert got


@pytest.mark.skipif(not DATA.exists(), reason="shared tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() == 25
