"""Similarity join of documents by n-gram Jaccard, as a blocked sparse matrix product.

The matrix has a row per document and a column per word n-gram; its product with its transpose holds the
overlap counts. It is never formed whole. Columns get one global order, rare ones first, and a row's
*leading* columns are those of which at least one must be shared by any similar row. The product over
leading columns comes first and only says which entries can reach the least overlap that the sizes of
both rows ask for; all others are dropped. For the entries that remain, overlap counts are accumulated over
all columns, in blocks of rows, and compared exactly.

A large group of near copies has a quadratic number of similar pairs. Only components are asked for, so
each leading column is first multiplied with one row alone, its *hub*; entries inside a component found
that way need no count, and the full leading product is taken for rows outside their hub's component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, WordHashes, bounded, durable, map_texts, mix, signed, words_of
from .components import components

#: Counters of the column sketch and the tables they travel in; a fixed 4 MB, whatever the input.
CELLS, PARTS = 1 << 22, 256
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: A leading column above this level is dealt to 2 ** (level - 2) tasks.
SALT_LEVEL = 2


def columns_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ascending distinct columns of a row of word hashes; fewer than ``n`` words are one column."""
    if not len(hashes):
        return hashes
    with np.errstate(over="ignore"):
        if len(hashes) < n:
            weighed = hashes * _WEIGHTS[np.arange(len(hashes)) % len(_WEIGHTS)] + np.arange(len(hashes), dtype=np.uint64)
            return mix(weighed.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)))
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for i in range(n):
            total += hashes[i : len(hashes) - n + 1 + i] * _WEIGHTS[i % len(_WEIGHTS)] + np.uint64(i // len(_WEIGHTS))
    return np.unique(mix(total))


def cell_of(columns: np.ndarray) -> np.ndarray:
    """Counter of a column: its leading 22 bits."""
    return (columns >> np.uint64(42)).astype(np.int64)


def lead(size: int, percent: int) -> int:
    """Leading columns of a row: a similar row shares at least one of them."""
    return size - (percent * size + 99) // 100 + 1


def _bound(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of two similar rows of the given sizes."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100 + percent))


def sketch(docs: DataFrame, n: int, text: str = "text") -> np.ndarray:
    """Level of each cell: 0 for cells no fuller than chance makes them, else the log of the excess.

    All columns of all documents are counted, in a table of fixed size that tasks fill and Spark adds up.
    The levels only order the columns: a column that shares its cell with a frequent one costs time, not
    correctness.
    """

    width = CELLS // PARTS
    kinds = {width * np.dtype(k).itemsize: k for k in (np.uint8, np.uint16, np.int64)}
    schema = "part int, cells binary"

    def batch_of(parts: list[int], blocks: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["part", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cells = WordHashes(), np.zeros(CELLS, np.int32)
        for batch in batches:
            for t in batch.column(0):
                w = words_of(t.as_py())
                if w:
                    at = cell_of(columns_of(known.of(w, len(w)), n))
                    cells[at] += 1
                    # Columns are ascending, so those that share a cell are neighbours.
                    np.add.at(cells, at[1:][at[1:] == at[:-1]], 1)
        if cells.any():
            blocks = cells.reshape(PARTS, width)
            yield batch_of(list(range(PARTS)), [
                b.astype(np.uint8 if b.max() < 256 else np.uint16 if b.max() < 65536 else np.int64) for b in blocks])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = np.frombuffer(raw.as_py(), kinds[len(raw.as_py())])
                sums[part] = sums[part] + block if part in sums else block.astype(np.int64)
        if sums:
            yield batch_of(list(sums), list(sums.values()))

    parts = docs.select(F.col(text)).mapInArrow(count, schema).repartition("part").mapInArrow(add, schema)
    cells = np.zeros(CELLS, np.int64)
    for row in parts.collect():  # at most PARTS rows, 32 MB
        cells[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["cells"], np.int64)
    total = cells.sum()
    mean = total / CELLS
    excess = (cells - mean - 6 * np.sqrt(mean)) / 16
    return np.where(excess >= 1, 1 + np.log2(np.maximum(excess, 1)), 0).astype(np.uint8)


def rows_of(docs: DataFrame, n: int, percent: int, levels, text: str = "text") -> DataFrame:
    """``row`` struct of the input columns, ``size``, class key ``cls`` and leading columns ``lead`` with their levels.

    Rows of equal column sets have equal ``cls``; rows without words have none.
    """

    def make() -> Callable[[list], list]:
        known, level = WordHashes(), levels.value

        def work(texts: list) -> list:
            out = []
            for t in texts:
                w = words_of(t)
                if not w:
                    out.append((0, None, None, None))
                    continue
                c = columns_of(known.of(w, len(w)), n)
                lv = level[cell_of(c)]
                first = np.lexsort((c, lv))[: lead(len(c), percent)] if lv.any() else slice(0, lead(len(c), percent))
                out.append((len(c), class_of(c), signed(c[first]), lv[first].astype(np.int16)))
            return out

        return work

    return map_texts(docs.select("doc_id", F.col(text).alias("text")), ["doc_id"], "text",
                     "size int, cls long, lead array<long>, level array<short>", make)


def class_of(columns: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(columns.tobytes())).view(np.int64))


def _complete(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """Exact overlap counts ``a, b, overlap`` of the entries ``(a, b)`` over all columns; those of similar rows stay.

    Only texts that an entry asks for are read; each goes to the tasks of its entries.
    """
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("cls"), "a", "b"), F.struct(F.col("b").alias("cls"), "a", "b"))).alias("s")).select("s.*")
    wanted = durable(sides.select("cls").distinct().join(reps.select("cls", "doc_id"), "cls"))
    texts = docs.join(bounded(wanted), "doc_id").select("cls", "text")
    together = sides.join(texts, "cls").select("a", "b", "cls", "text").repartition("a", "b").sortWithinPartitions("a", "b", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        cache: dict[int, np.ndarray] = {}
        block: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        held = None

        def product() -> pa.RecordBatch:
            """Overlaps of the block's entries: equal columns inside an entry are counted once."""
            owner = np.repeat(np.arange(len(block)), [len(x[2]) + len(x[3]) for x in block])
            flat = np.concatenate([c for x in block for c in x[2:]])
            order = np.lexsort((flat, owner))
            flat, owner = flat[order], owner[order]
            same = (flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])
            overlap = np.bincount(owner[1:][same], minlength=len(block))
            sizes = np.array([len(x[2]) + len(x[3]) for x in block])
            good = np.flatnonzero(100 * overlap >= percent * (sizes - overlap))
            return pa.RecordBatch.from_arrays(
                [pa.array([block[i][c] for i in good], pa.int64()) for c in (0, 1)] + [pa.array(overlap[good], pa.int64())], ["a", "b", "overlap"])

        size = 0
        for batch in batches:
            # Texts leave the batch one at a time: a batch of them is large.
            for a, b, cls, t in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                c = cache.get(cls)
                if c is None:
                    w = words_of(t.as_py())
                    c = columns_of(known.of(w, len(w)), n)
                    if class_of(c) != cls:  # another row with the same doc_id
                        continue
                    if len(cache) > 256:
                        cache.clear()
                    cache[cls] = c
                if held and held[:2] == (a, b):
                    if held[2] != cls:
                        block.append((a, b, held[3], c))
                        size += len(held[3]) + len(c)
                        held = None
                else:
                    held = (a, b, cls, c)
                if size > 1 << 18:
                    yield product()
                    block, size = [], 0
        if block:
            yield product()

    return together.mapInArrow(run, "a long, b long, overlap long")


def _possible(percent: int, a: str, b: str, first: bool = False, both: bool = True) -> Column:
    """The bounds allow similarity of rows whose columns are named by ``a`` and ``b``; the limit of ``b`` counts if ``both``.

    By sizes, by limits, and by what can precede and follow the shared column; with ``first``, nothing
    shared precedes it. Every pair has a first shared column, so that bound may be asked of all.
    """
    size_a, size_b, pos_a, pos_b = (F.col(x.format(c)) for c in ("size", "pos") for x in (a, b))
    limits = [F.col(x.format("limit")) for x in ((a, b) if both else (a,))]
    least = _bound(size_a, size_b, percent)
    before, after = F.lit(0) if first else F.least(pos_a, pos_b), F.least(size_a - pos_a, size_b - pos_b)
    return (F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent) & (
        F.least(*limits, before + after) >= least)


def _prepared(docs: DataFrame, n: int, percent: int, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with size and class; one row per class; the leading columns that two classes or more have.

    The last has ``col, cls, size, pos``, the column's hub with ``hub_size`` and ``hub_pos``, and ``limit``: leading
    columns that no other row has are lost to any overlap, and what is left of a row bounds it. Count and hub
    come from one pass over the rows of a column; frequent columns are dealt out by a salt for it, and their
    parts, few rows, are put together by a second one.
    """
    levels = docs.sparkSession.sparkContext.broadcast(sketch(docs, n))
    rows = tables.durable(rows_of(docs, n, percent, levels))
    reps = tables.durable(
        rows.where("doc_id is not null and cls is not null").groupBy("cls")
        .agg(F.min(F.struct("doc_id", "size", "lead", "level")).alias("r")).select("cls", "r.*"))

    salted = F.col("c.level") > SALT_LEVEL
    dealt = F.call_function("shiftleft", F.lit(1), (F.col("c.level") - SALT_LEVEL).cast("int"))
    each = reps.select("cls", "size", F.posexplode(F.arrays_zip("lead", "level")).alias("pos", "c")).select(
        F.col("c.lead").alias("col"), "cls", "size", "pos", salted.alias("salted"),
        F.when(salted, F.pmod("cls", dealt)).otherwise(F.lit(0)).cast("int").alias("salt"))
    part = Window.partitionBy("col", "salt")
    counted = each.select(
        "col", "cls", "size", "pos", "salted", F.count(F.lit(1)).over(part).alias("n"),
        F.min(F.struct("pos", "cls", "size")).over(part).alias("h"))
    met = tables.durable(counted.where("n > 1 or salted"))
    # Every part of a salted column reports its count on each of its rows, so distinct parts are summed.
    parts = met.where("salted").select("col", "n", "h").distinct()
    whole = tables.durable(parts.groupBy("col").agg(F.sum("n").alias("n"), F.min("h").alias("h")).where("n > 1"))
    plain = met.where("not salted").select("col", "cls", "size", "pos", "h")
    frequent = met.where("salted").select("col", "cls", "size", "pos").join(bounded(whole.select("col", "h")), "col")
    hubs = [F.col(f"h.{c}").alias(name) for c, name in (("cls", "hub"), ("size", "hub_size"), ("pos", "hub_pos"))]
    shared = plain.unionByName(frequent).select("col", "cls", "size", "pos", *hubs)
    kept = F.count(F.lit(1)).over(Window.partitionBy("cls"))
    shared = tables.durable(shared.withColumn("limit", (F.ceil(F.col("size") * percent / 100) - 1 + kept).cast("int")))
    return rows, reps, shared


def _ordered(a: str, b: str, *more: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), *more]


def similar_components(docs: DataFrame, n: int = 4, percent: int = 85, text: str = "text", tables: Tables | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Rows are linked if the Jaccard of their n-gram sets is at least ``percent`` / 100; ``component_id`` is the
    smallest doc_id that links lead to, the row's own included. Null, empty and blank texts have size 0
    and their own id. A null doc_id takes part in no link and has a null component. Rows with the same
    doc_id are linked by their texts alone. Other columns are ignored; an empty table gives no rows.
    The tables that the result reads belong to ``tables`` if given.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    result, used = tables or Tables(), Tables()
    with used:
        rows, reps, shared = _prepared(docs, n, percent, used)
        # Every row of a column against the hub. The hub's own limit is asked of the few entries that are left.
        near = _possible(percent, "{}", "hub_{}", both=False)
        entry = F.struct(F.col("cls").alias("row"), "hub", _bound(F.col("size"), F.col("hub_size"), percent).alias("least"))
        found = shared.where((F.col("cls") != F.col("hub")) & near).select(entry.alias("e")).distinct().select("e.*")
        limits = shared.groupBy("cls").agg(F.first("limit").alias("limit")).withColumnRenamed("cls", "hub")
        first = used.durable(found.join(limits, "hub").where("limit >= least").select(*_ordered("row", "hub")).distinct())
        links = used.durable(_complete(first, docs, reps, n, percent).select("a", "b"))
        group = components(links)
        used.written.append(group)

        # Rows outside their hub's component, against all rows of the column in other components.
        own, top = group.select(F.col("node").alias("cls"), F.col("component").alias("own")), group.select(
            F.col("node").alias("hub"), F.col("component").alias("top"))
        apart = shared.select("cls", "hub").distinct().join(own, "cls", "left").join(top, "hub", "left").select(
            "cls", "hub", F.coalesce("own", "cls").alias("own"), F.coalesce("top", "hub").alias("top")).where("own != top")
        apart = used.durable(apart)
        sides = ("col", "cls", "size", "pos", "limit", "own", "top")
        left = used.durable(shared.join(bounded(apart), ["cls", "hub"]).select(*sides))
        open_ = used.durable(left.select("col").distinct())
        right = shared.join(bounded(open_), "col").join(own, "cls", "left").join(top, "hub", "left").select(
            *sides[:5], F.coalesce("own", "cls").alias("own"), F.coalesce("top", "hub").alias("top"))
        entries = left.select("col", *[F.col(c).alias(f"{c}_a") for c in sides[1:]]).join(
            right.select("col", *[F.col(c).alias(f"{c}_b") for c in sides[1:]]), "col").where(
            (F.col("own_a") != F.col("own_b")) & ((F.col("own_b") == F.col("top_b")) | (F.col("cls_a") < F.col("cls_b")))
            & _possible(percent, "{}_a", "{}_b", first=True))
        second = used.durable(entries.select(*_ordered("cls_a", "cls_b")).distinct().join(first, ["a", "b"], "left_anti"))
        more = used.durable(_complete(second, docs, reps, n, percent).select("a", "b"))

        group = components(links.unionByName(more))
        used.written.append(group)
        classes = used.durable(reps.join(group.withColumnRenamed("node", "cls"), "cls", "left").select(
            "cls", F.col("doc_id").alias("rep"), F.coalesce("component", "cls").alias("component")))
        least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
        # A class on its own is named by its document.
        named = used.durable(classes.join(least, "component").select("cls", "component_id"))
        return result.durable(rows.join(named, "cls", "left").select(
            "doc_id", F.col("size").cast("long").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def similar_pairs(docs: DataFrame, n: int = 4, percent: int = 85, text: str = "text", tables: Tables | None = None) -> tuple[DataFrame, DataFrame]:
    """All links: ``a, b, size_a, size_b, overlap`` of classes, and ``doc_id, cls`` of every row with words.

    A class is the rows with one set of n-grams; copies are not expanded into pairs, and no link between different
    sets is left out, so a group of n near copies that are all similar has n * (n - 1) / 2 rows. The rules for
    texts and ids are those of ``similar_components``; a null doc_id is in no class.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    result, used = tables or Tables(), Tables()
    with used:
        rows, reps, shared = _prepared(docs, n, percent, used)
        sides = ("cls", "size", "pos", "limit")
        left, right = (shared.select("col", *[F.col(c).alias(f"{c}_{x}") for c in sides]) for x in "ab")
        entries = left.join(right, "col").where((F.col("cls_a") < F.col("cls_b")) & _possible(percent, "{}_a", "{}_b", first=True))
        pairs = used.durable(entries.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct())
        links = used.durable(_complete(pairs, docs, reps, n, percent))
        size = reps.select("cls", F.col("size").cast("long").alias("size"))
        for x in "ab":
            links = links.join(size.select(F.col("cls").alias(x), F.col("size").alias(f"size_{x}")), x)
        members = result.durable(rows.where("doc_id is not null and cls is not null").select("doc_id", "cls"))
        return result.durable(links.select("a", "b", "size_a", "size_b", "overlap")), members
