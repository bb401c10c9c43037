"""Nested documents from flat tables and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import ordered_rank


def nest(df: DataFrame, keys: Sequence[str], order: Sequence[str], items: Sequence[str | Column], out: str) -> DataFrame:
    """One row per key with an ordered array of structs.

    For groups bounded by their meaning (parties of a block, candidates of a
    district). For unbounded groups use ``nest_in_parts``.
    """
    cols = [F.col(i) if isinstance(i, str) else i for i in items]
    ordered = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("__o"), F.struct(*cols).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(ordered, lambda x: x["v"]).alias(out))


def nest_in_parts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], items: Sequence[str], out: str, part_rows: int
) -> DataFrame:
    """Like ``nest``, but a group becomes consecutive parts of ``part_rows`` items.

    Every item is kept; no array, and so no task, ever holds more than one part.
    """
    ranked = ordered_rank(df, keys, order, "__no")
    parts = ranked.withColumn("part_no", F.floor((F.col("__no") - 1) / part_rows) + 1)
    return nest(parts, [*keys, "part_no"], ["__no"], items, out)


def flatten(df: DataFrame, array: str) -> DataFrame:
    """Nested rows back to flat ones; the struct's fields become columns."""
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.explode(array).alias("__x")).select(*rest, "__x.*")


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON, one document per line."""
    df.write.mode(mode).json(path)


def write_checked(df: DataFrame, problems: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Publish only when the self-check found nothing."""
    first = problems.limit(1).collect()
    if first:
        raise ValueError(f"self-check failed, nothing written: {first[0].asDict()}")
    write_documents(df, path, mode)
