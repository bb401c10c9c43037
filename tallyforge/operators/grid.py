"""Positioned tokens and cell grids: clusters, bins, lines, headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import islands, join_null_safe, ordered_lag


def cluster_means(df: DataFrame, keys: Sequence[str], value: str, tol: float, tie: str | None = None) -> DataFrame:
    """Clusters of near positions with mean, extent and size, numbered from 1 per key."""
    order = [value, tie] if tie else [value]
    return islands(df, keys, order, value, tol, "cluster_no").groupBy(*keys, "cluster_no").agg(
        F.avg(value).alias("center"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.count(F.lit(1)).alias("size"),
    )


def bin_by_bounds(df: DataFrame, bounds: DataFrame, keys: Sequence[str], value: Column, out: str = "bin_no") -> DataFrame:
    """Column of each value: bounds[i] <= value < bounds[i + 1], from 0; outside is null.

    ``bounds``: keys and ``bound``. The bounds of a key (the rules of one page) are
    folded into one sorted array, so a range join becomes an equi-join plus a count
    inside the row.
    """
    arrays = bounds.groupBy(*keys).agg(F.sort_array(F.collect_set("bound")).alias("__b"))
    joined = join_null_safe(df, arrays, keys, "left")
    below = F.size(F.filter("__b", lambda b: b <= value))
    return joined.withColumn(
        out, F.when((below >= 1) & (below < F.size("__b")), below - 1)
    ).drop("__b")


def subdivide(bounds: DataFrame, keys: Sequence[str], n: int, bound: str = "bound") -> DataFrame:
    """Each interval between neighbouring bounds cut into ``n`` equal parts."""
    lagged = ordered_lag(bounds, keys, [bound], bound, "__left")
    step = (F.col(bound) - F.col("__left")) / n
    inner = F.when(
        F.col("__left").isNotNull(), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.col("__left") + step * k)
    ).otherwise(F.array(F.col(bound).cast("double")))
    return lagged.select(*keys, F.explode(inner).alias(bound))


def token_lines(
    tokens: DataFrame, keys: Sequence[str], top: str, x: str, text: str, tol: float, cell: Sequence[str] = ()
) -> DataFrame:
    """Bands of tokens whose ``top`` is within ``tol`` of the last one, text in x order.

    ``cell`` columns (a bin number) keep the columns of a band apart.
    """
    banded = islands(tokens, keys, [top, x], top, tol, "line_no")
    parts = F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(top).alias("y"), F.col(text).alias("t"))))
    return banded.groupBy(*keys, "line_no", *cell).agg(
        F.count(F.lit(1)).alias("tokens"), F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text")
    )


def _line_starts(tops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows ``keys, __idx`` that start a line, of rows with ``__idx`` (from 1) and ``__jump`` (the first one out of reach).

    Pointer jumping: after round r the starts are marked up to the 2 ** r-th, and each row points as many
    lines ahead, so the rounds grow with the log of the longest chain of lines.
    """
    state = cut_lineage(tops.select(*keys, "__idx", "__jump", (F.col("__idx") == 1).alias("__start")))
    while not state.where("__start and __jump is not null").isEmpty():
        ahead = state.select(*keys, F.col("__idx").alias("__jump"), F.col("__jump").alias("__far"))
        met = state.where("__start and __jump is not null").select(*keys, F.col("__jump").alias("__idx"), F.lit(True).alias("__met"))
        # Rows without a jump stay without one.
        further = join_null_safe(state, ahead.where("__far is not null"), [*keys, "__jump"], "left")
        marked = join_null_safe(further, met, [*keys, "__idx"], "left")
        state = cut_lineage(marked.select(
            *keys, "__idx", F.col("__far").alias("__jump"), (F.col("__start") | F.coalesce("__met", F.lit(False))).alias("__start")))
    return state.where("__start").select(*keys, "__idx")


def cell_lines(tokens: DataFrame, keys: Sequence[str], top: str, x: str, text: str, tol: float) -> DataFrame:
    """Lines inside one cell: a token joins the line whose *first* top is at most ``tol`` above its own.

    Every top points to the first one beyond the reach of a line that starts there; the starts are those
    met from the first top on, whatever the size of the cell. Tokens without a top are a line of their
    own, the first. Text is in the order of x, then top, then text.
    """
    keys = list(keys)
    tops = tokens.select(*keys, F.col(top).cast("double").alias("top")).distinct()
    order = Window.partitionBy(*keys).orderBy("top")
    by = ", ".join(f"`{k}`" for k in keys)
    within = F.expr(f"count(1) over (partition by {by} order by top range between unbounded preceding and {float(tol)!r}D following)")
    placed = tops.withColumn("__idx", F.row_number().over(order).cast("long")).withColumn("__next", within + 1)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    placed = cut_lineage(placed.withColumn("__jump", F.when(F.col("__next") <= size, F.col("__next"))).drop("__next"))
    starts = _line_starts(placed, keys).withColumn("__one", F.lit(1))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = join_null_safe(placed, starts, [*keys, "__idx"], "left").select(
        *keys, "top", F.sum(F.coalesce("__one", F.lit(0))).over(upto).cast("int").alias("line_no"))
    parts = join_null_safe(tokens.select(*keys, F.col(top).cast("double").alias("top"), F.col(x).alias("__x"), F.col(text).alias("__t")),
                           lines, [*keys, "top"], "inner")
    item = F.struct(F.col("__x"), F.col("top"), F.col("__t"))
    return parts.groupBy(*keys, "line_no").agg(
        F.min("top").alias("top"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda p: p["__t"]), "").alias("text"))


def locate_column(
    cells: DataFrame, dimension: DataFrame | Sequence[str], keys: Sequence[str], column: str, text: str
) -> DataFrame:
    """The column with most cells found in ``dimension``; lowest number on ties.

    A fixed list of names is a filter of the scan; a table of names is joined.
    """
    if isinstance(dimension, DataFrame):
        hits = cells.join(dimension.select(F.col(dimension.columns[0]).alias(text)).distinct(), text, "left_semi")
    else:
        hits = cells.where(F.col(text).isin(list(dimension)))
    counts = hits.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("hits"))
    best = F.min(F.struct((-F.col("hits")).alias("n"), F.col(column).alias("c")))
    return counts.groupBy(*keys).agg(best.alias("__b")).select(
        *keys, F.col("__b.c").alias(column), (-F.col("__b.n")).alias("hits")
    )


def column_roles(
    header: DataFrame, keys: Sequence[str], column: str, label: str, exact: dict[str, str],
    prefixes: Sequence[tuple[str, str]], required: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """(role assignments, problems). A label names a role exactly or by prefix; a role
    given twice or a required role without a column is a problem."""
    role = F.lit(None).cast("string")
    for prefix, name in reversed(list(prefixes)):
        role = F.when(F.col(label).startswith(prefix), name).otherwise(role)
    for text, name in exact.items():
        role = F.when(F.col(label) == text, name).otherwise(role)
    found = header.withColumn("role", role).where("role IS NOT NULL").select(*keys, "role", column)
    counts = found.groupBy(*keys, "role").agg(F.count(F.lit(1)).alias("n"))
    wanted = header.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(r) for r in required])).alias("role"))
    missing = join_null_safe(wanted, counts, [*keys, "role"], "left_anti").withColumn("problem", F.lit("missing"))
    twice = counts.where("n > 1").select(*keys, "role", F.lit("duplicate").alias("problem"))
    return found, missing.unionByName(twice)


def header_span(
    cells: DataFrame, dictionary: DataFrame, keys: Sequence[str], row: str, column: str, text: str,
    last_row: int, group_size: int = 1, max_rows: int | None = None, from_bottom: bool = True,
) -> DataFrame:
    """The first span of header rows in which every non-empty column is a known name.

    Spans end at ``last_row`` and grow upwards (``from_bottom``), or start at each row
    from the top and take 1..``max_rows`` rows. The text of a span is joined per
    group of ``group_size`` columns. Result: keys, span, column group, name.
    A page has few header rows, so a cell appears in few spans.
    """
    heads = cells.where(F.col(row) <= last_row)
    limit = max_rows or last_row + 1
    if from_bottom:
        spans = F.transform(
            F.sequence(F.lit(0), F.col(row)),
            lambda s: F.struct(s.alias("start"), F.lit(last_row).alias("end"), (F.lit(last_row) - s).alias("try_no")),
        )
        spans = F.filter(spans, lambda s: s["end"] - s["start"] < limit)
    else:
        ends = F.sequence(F.lit(0), F.lit(limit - 1))
        starts = F.sequence(F.greatest(F.col(row) - (limit - 1), F.lit(0)), F.col(row))
        spans = F.flatten(F.transform(starts, lambda s: F.transform(ends, lambda e: F.struct(
            s.alias("start"), (s + e).alias("end"), (s * limit + e).alias("try_no")))))
        spans = F.filter(spans, lambda s: (s["end"] >= F.col(row)) & (s["end"] <= last_row))
    exploded = heads.select(*keys, row, (F.floor(F.col(column) / group_size)).alias("group_no"), column, text, F.explode(spans).alias("s"))
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct(row, column, text))), lambda c: F.coalesce(c[text], F.lit(""))), ""
    )
    names = exploded.groupBy(*keys, "s.try_no", "s.start", "s.end", "group_no").agg(joined.alias("name")).where("name <> ''")
    known = dictionary.select(F.col(dictionary.columns[0]).alias("name"), F.lit(True).alias("__hit")).distinct()
    tested = names.join(known, "name", "left")
    good = tested.groupBy(*keys, "try_no").agg(F.bool_and(F.coalesce("__hit", F.lit(False))).alias("ok")).where("ok")
    first = good.groupBy(*keys).agg(F.min("try_no").alias("try_no"))
    return join_null_safe(names, first, [*keys, "try_no"], "left_semi").select(
        *keys, F.col("start").alias("start_row"), F.col("end").alias("end_row"), F.col("group_no").cast("int").alias("group_no"), "name"
    )
