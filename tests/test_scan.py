"""Split windows equal plain windows, whatever the split width and the hot key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        data.append((key, i, rng.randint(0, 2000), rng.choice([None, "x", "y"]), rng.random() < 0.05))
    return spark.createDataFrame(data, "k string, pos long, v long, label string, clear boolean").cache()


#: Rows a task may sort: all keys, some keys and no key are cut into ranges.
LIMITS = [scan.Limits(9, 40), scan.Limits(100), scan.LIMITS]


def same(a, b, *cols):
    assert sorted(map(str, a.select("pos", *cols).collect())) == sorted(map(str, b.select("pos", *cols).collect()))


@pytest.fixture(scope="module", params=["several", "one", "null"])
def keyed(rows, request):
    """Rows of several keys, of a single one, and of the null key only."""
    key = {"several": F.col("k"), "one": F.lit("x"), "null": F.lit(None).cast("string")}[request.param]
    return rows.withColumn("k", key)


@pytest.mark.parametrize("limits", LIMITS)
def test_rank(keyed, limits):
    w = Window.partitionBy("k").orderBy("pos")
    same(scan.ordered_rank(keyed, ["k"], ["pos"], "out", limits),
         keyed.withColumn("out", F.row_number().over(w).cast("long")), "out")


@pytest.mark.parametrize("limits", LIMITS)
def test_lag(keyed, limits):
    w = Window.partitionBy("k").orderBy("pos")
    same(scan.ordered_lag(keyed, ["k"], ["pos"], "label", "out", limits),
         keyed.withColumn("out", F.lag("label").over(w)), "out")


@pytest.mark.parametrize("limits", LIMITS)
def test_running_sum(keyed, limits):
    w = Window.partitionBy("k").orderBy("pos")
    same(scan.ordered_running_sum(keyed, ["k"], ["pos"], "v", "out", limits),
         keyed.withColumn("out", F.sum("v").over(w)), "out")


@pytest.mark.parametrize("limits", LIMITS)
def test_carry_forward(keyed, limits):
    got = scan.carry_forward(keyed, ["k"], ["pos"], "label", "out", F.col("clear"), limits)
    want, last = {}, {}
    for r in sorted(keyed.collect(), key=lambda r: r.pos):
        if r.clear:
            last[r.k] = None
        elif r.label is not None:
            last[r.k] = r.label
        want[r.pos] = last.get(r.k)
    assert {r.pos: r.out for r in got.collect()} == want


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("tol", [0, 6])
def test_islands(keyed, limits, tol):
    got = scan.islands(keyed, ["k"], ["v", "pos"], "v", tol, "out", limits)
    want, state = {}, {}
    for r in sorted(keyed.collect(), key=lambda r: (r.v, r.pos)):
        prev, no = state.get(r.k, (None, 0))
        no += prev is None or r.v - prev > tol
        state[r.k] = (r.v, no)
        want[r.pos] = no
    assert {r.pos: r.out for r in got.collect()} == want


def test_text_orders_and_equal_places(spark):
    """Any sortable type is an order; rows that are equal in it stay in one range."""
    rows = spark.range(400).select(F.lit(1).alias("k"), F.md5((F.col("id") % 50).cast("string")).alias("o"), "id")
    got = scan.ordered_running_sum(rows, ["k"], ["o", "id"], F.lit(1), "out", scan.Limits(30))
    w = Window.partitionBy("k").orderBy("o", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.withColumn("out", F.row_number().over(w)).collect()))
    tied = scan.ordered_rank(rows, ["k"], ["o"], "out", scan.Limits(30))
    assert sorted(r.out for r in tied.collect()) == list(range(1, 401))
    low = tied.groupBy("o").agg((F.max("out") - F.min("out")).alias("d")).collect()
    assert {r.d for r in low} == {7}


@pytest.mark.parametrize("key", ["x", None])
def test_no_task_sorts_a_large_key(spark, key):
    """A key of many rows, null or not, reaches the windows in pieces of bounded size."""
    rows = spark.range(4000).select(F.lit(key).cast("string").alias("k"), F.col("id").alias("pos"))
    sizes = []

    def carried(cut):
        sizes.extend(r["count"] for r in cut.groupBy("k", "__range").count().collect())
        return cut.select("k", "__range", F.lit(0).alias("__carry")).distinct()

    scan._scan(rows, ["k"], ["pos"], scan.Limits(500), F.lit(0), carried, lambda r, w: r.select("pos", F.row_number().over(w).alias("n")))
    assert sum(sizes) == 4000 and len(sizes) > 8 and max(sizes) <= 500


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, pos long")
    assert scan.ordered_rank(none, ["k"], ["pos"]).collect() == []
    assert scan.islands(none, ["k"], ["pos"], "pos", 1).columns == ["k", "pos", "island_no"]


@pytest.mark.parametrize("salts", [1, 8])
def test_top_by_group(rows, salts):
    got = scan.top_by_group(rows, ["k"], [F.desc("v"), F.col("pos")], 9, ["pos"], "out", salts)
    w = Window.partitionBy("k").orderBy(F.desc("v"), "pos")
    same(got, rows.withColumn("out", F.row_number().over(w)).where("out <= 9"), "out")


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    got = {(r.k, r.a, r.b) for r in scan.join_null_safe(a, b, ["k"]).collect()}
    assert got == {(None, 1, 3), ("x", 2, None)}
