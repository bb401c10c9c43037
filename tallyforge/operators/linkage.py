"""Record linkage in passes, each using up what it pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import ordered_rank


@dataclass
class Links:
    """pairs: left id, right id, ``pass_no`` · the ids left over on both sides."""

    pairs: DataFrame
    left_rest: DataFrame
    right_rest: DataFrame


def _pair_in_order(left, right, keys, left_order, right_order) -> DataFrame:
    """The k-th left record of a key with the k-th right one; never all pairs of a key."""
    a = ordered_rank(left, keys, left_order, "__no")
    b = ordered_rank(right, keys, right_order, "__no")
    return a.select(*keys, "__no", left_order[-1]).join(
        b.select(*keys, "__no", right_order[-1]), [*keys, "__no"]
    ).select(left_order[-1], right_order[-1])


def link(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    passes: Sequence[tuple[Sequence[Column], Sequence[Column]]],
    residual: tuple[Sequence[Column], Sequence[Column]] | None = None,
    left_order: Sequence[str] = (),
    right_order: Sequence[str] = (),
) -> Links:
    """Link ``left`` to ``right`` by successive keys, each record used at most once.

    ``passes``: (left key columns, right key columns); a null key part never links.
    ``residual``: keys under which exactly one record remaining on each side is a
    pair. Ids are unique. Records of one key pair in the order of ``left_order`` and
    ``right_order`` (file order, say), then of the id. Each pass writes its pairs (two ids per row), so later passes
    do not repeat earlier ones.
    """
    left_order, right_order = [*left_order, left_id], [*right_order, right_id]
    pairs: DataFrame | None = None

    def rest(df: DataFrame, id_col: str) -> DataFrame:
        return df if pairs is None else df.join(pairs.select(id_col), id_col, "left_anti")

    def keyed(df, order, cols):
        named = [c.alias(f"__k{i}") for i, c in enumerate(cols)]
        return df.select(*order, *named).na.drop(subset=[f"__k{i}" for i in range(len(cols))])

    for no, (lk, rk) in enumerate(passes, 1):
        names = [f"__k{i}" for i in range(len(lk))]
        found = _pair_in_order(
            keyed(rest(left, left_id), left_order, lk), keyed(rest(right, right_id), right_order, rk),
            names, left_order, right_order,
        ).withColumn("pass_no", F.lit(no))
        pairs = cut_lineage(found if pairs is None else pairs.unionByName(found))
    if residual is not None:
        lk, rk = residual
        names = [f"__k{i}" for i in range(len(lk))]

        def single(df, id_col, cols):
            return (
                keyed(rest(df, id_col), [id_col], cols)
                .groupBy(*names)
                .agg(F.count(F.lit(1)).alias("__n"), F.min(id_col).alias(id_col))
                .where("__n = 1")
                .drop("__n")
            )

        found = single(left, left_id, lk).join(single(right, right_id, rk), names).select(
            left_id, right_id, F.lit(len(passes) + 1).alias("pass_no")
        )
        pairs = cut_lineage(found if pairs is None else pairs.unionByName(found))
    return Links(pairs, rest(left, left_id), rest(right, right_id))


def ambiguous_keys(left: DataFrame, first: Sequence[Column], second: Sequence[Column], left_id: str) -> DataFrame:
    """Left records whose second key equals another record's first key.

    Only for these can the order of passes matter; report them rather than guess.
    """
    names = [f"__k{i}" for i in range(len(first))]
    a = left.select(F.col(left_id).alias("__other"), *[c.alias(n) for c, n in zip(first, names)])
    firsts = a.groupBy(*names).agg(F.min("__other").alias("__low"), F.max("__other").alias("__high"))
    b = left.select(left_id, *[c.alias(n) for c, n in zip(second, names)]).na.drop(subset=names)
    return b.join(firsts, names).where(
        (F.col("__low") != F.col(left_id)) | (F.col("__high") != F.col(left_id))
    ).select(left_id)


def disagreements(
    pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, compare: Sequence[tuple[Column, Column, str]]
) -> DataFrame:
    """Linked pairs whose attributes differ: one row per (pair, attribute)."""
    a = left.select(left_id, *[c.alias(f"__a{i}") for i, (c, _, _) in enumerate(compare)])
    b = right.select(right_id, *[c.alias(f"__b{i}") for i, (_, c, _) in enumerate(compare)])
    joined = pairs.join(a, left_id).join(b, right_id)
    tests = F.array(
        *[
            F.struct(
                F.lit(name).alias("attribute"),
                F.col(f"__a{i}").cast("string").alias("left_value"),
                F.col(f"__b{i}").cast("string").alias("right_value"),
                F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}")).alias("same"),
            )
            for i, (_, _, name) in enumerate(compare)
        ]
    )
    return joined.select(left_id, right_id, "pass_no", F.explode(tests).alias("t")).where("NOT t.same").select(
        left_id, right_id, "pass_no", "t.attribute", "t.left_value", "t.right_value"
    )
