"""Runs of periodically repeated words, found in tiles of every period octave.

Octave ``k`` holds the periods from ``g = 2 ** k`` to ``2 g - 1``. A document is exploded into overlapping tiles
of a length in proportion to ``g``, for each octave; tiles are spread over all tasks, so a long document is
the work of many. In a tile, Z-functions at a few boundaries give for every period at once how far the words
around the boundary repeat at that distance. Tiles report interval fragments, which are shuffled by
document and period and stitched: an interval is a set of positions whose word equals the one a period
later, so fragments that meet are one.

Any stretch that is long enough for a run lies in one tile whole, hence fragments shorter than that are not
reported. A part of a document where no gram of ``g`` words recurs within ``2 g`` words often enough for a run of
the octave gives no tile; that test never loses a run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import durable, mix

#: Words of new text in a tile, in units of the octave's least period; short octaves use that of 8 words.
STEP, SHORTEST = 8, 8
#: Characters that are looked at together.
SLICE = 1 << 22


def word_ids(text: str | None) -> np.ndarray:
    """Number of each word in the order of first use: equal words, equal numbers."""
    found = text.encode("utf-8", "surrogatepass").split() if text else []
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found))


def _least_equal(g: int, least: int, times: int) -> int:
    """Fewest positions that equal the one a period later, over the periods of an octave."""
    q = np.arange(g, 2 * g) if g < least else np.array([g])
    return int((np.maximum(least, times * q) - q).min())


def stretches(ids: np.ndarray, first: np.ndarray, last: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """``g, from, to`` of all parts that may hold a run of the octave of ``g``.

    ``ids`` are the words of one or more documents, ``first`` and ``last`` the bounds of the document of every
    position. Inside a run of period q, grams of g words recur at q, so they stand behind an equal gram at
    less than 2 g for as many positions in sequence as the shortest run has, less the gram. At four periods
    and more, one of them at least starts a gram of 2 g words whose last equal one is at q exactly.
    """
    h = mix((first.astype(np.uint64) << np.uint64(32)) + ids.astype(np.uint64) + np.uint64(1))
    alive = np.arange(len(ids))
    held: list[tuple[int, int]] = []
    g = 1
    while len(alive) or held:
        order = np.argsort(h[alive], kind="stable")
        at, key = alive[order], h[alive][order]
        same = key[1:] == key[:-1]
        later, distance = at[1:][same], (at[1:] - at[:-1])[same]
        exact = np.sort(later[(distance < g) & (2 * distance >= g)])
        for a, b in held:
            i = np.searchsorted(exact, a)
            if times < 4 or i < len(exact) and exact[i] <= b:
                yield g // 2, max(int(first[a]), a - g), min(int(last[a]), b + g // 2)
        near = np.sort(later[distance < 2 * g])
        held = []
        if len(near):
            cut = np.flatnonzero(np.diff(near) != 1)
            begin, end = near[np.append(0, cut + 1)], near[np.append(cut, len(near) - 1)]
            long = end - begin + 1 >= _least_equal(g, least, times) - g + 1
            held = list(zip(begin[long].tolist(), end[long].tolist()))
        # A longer gram recurs only where both of its halves do.
        again = np.zeros(len(ids) + 1, bool)
        again[later] = again[at[:-1][same]] = True
        alive = alive[again[alive]]
        alive = alive[alive + 2 * g <= last[alive]]
        alive = alive[again[alive + g]]
        with np.errstate(over="ignore"):
            h[alive] = mix(h[alive] * np.uint64(0x9E3779B97F4A7C15) + h[alive + g])
        g *= 2


def tiles(begin: int, end: int, g: int, least: int, times: int) -> Iterator[tuple[int, int]]:
    """Overlapping tiles of a stretch; the longest shortest run of the octave fits into the overlap."""
    step = STEP * max(g, SHORTEST)
    reach = step + max(least, (times - 1) * 2 * g) + 2 * g
    while True:
        stop = min(end, begin + reach)
        yield begin, stop
        if stop == end:
            return
        begin += step


def z_function(s: Sequence[int], m: int) -> list[int]:
    """Length of the common prefix of ``s`` and ``s[i:]`` for i below ``m``."""
    n, left, right = len(s), 0, 0
    z = [n] + [0] * (m - 1)
    for i in range(1, m):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def z_match(p: Sequence[int], s: Sequence[int], m: int) -> list[int]:
    """Length of the common prefix of ``p`` and ``s[i:]`` for i below ``m``."""
    if not p:
        return [0] * m
    z = z_function(p, min(m, len(p)))
    out, left, right = [], 0, 0
    for i in range(m):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                out.append(k)
                continue
            k = right - i
        while k < len(p) and i + k < len(s) and p[k] == s[i + k]:
            k += 1
        out.append(k)
        if i + k > right:
            left, right = i, i + k
    return out


def solve(x: Sequence[int], g: int, least: int, times: int) -> set[tuple[int, int, int]]:
    """``period, start, end`` of the maximal stretches of a tile whose smallest period is in the octave of ``g``."""
    found = set()
    for b in range(0, len(x), (times - 1) * g):
        top = min(2 * g - 1, len(x) - b)
        right = z_function(x[b:], min(top + 1, len(x) - b)) + [0]
        left = z_match(x[:b][::-1], x[: b + top][::-1], top)
        smallest: set[tuple[int, int]] = set()
        for q in range(1, top + 1):
            start, end = b - left[top - q], b + q + right[q]
            # A multiple of the smallest period has the same bounds.
            if end - start >= max(least, times * q) and (start, end) not in smallest:
                smallest.add((start, end))
                if q >= g:
                    found.add((q, start, end))
    return found


def _scan(docs: DataFrame, keep: Sequence[str], text: str, least: int, times: int, digest: bool) -> DataFrame:
    """A row per document, then a row per tile; the text goes along only where there are tiles."""
    taken = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*keep).alias("row"), F.col(text).alias("text"))
    fields = taken.sparkSession.createDataFrame([], "n_words long, plain string, full string, octave int, start long, ids array<int>").schema
    schema = StructType(taken.schema.fields[:2] + fields.fields)
    types = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, a = batch.column(2), 0
            sizes = [len(x.as_py() or "") for x in texts]
            while a < batch.num_rows:
                b, total = a, 0
                while b < batch.num_rows and (b == a or total + sizes[b] <= SLICE):
                    total += sizes[b]
                    b += 1
                part = batch.slice(a, b - a)
                yield from piece(part, texts.slice(a, b - a).to_pylist())
                a = b

    def piece(part: pa.RecordBatch, texts: list) -> Iterator[pa.RecordBatch]:
        words = [word_ids(t) for t in texts]
        n = np.array([len(w) for w in words])
        last = np.cumsum(n)
        flat, owner = np.concatenate(words), np.repeat(np.arange(len(n)), n)
        found: list[tuple[int, int, int, int]] = []
        for g, u, v in stretches(flat, (last - n)[owner], last[owner], least, times):
            found += [(int(owner[u]), g, s, e) for s, e in tiles(u, v, g, least, times)]
        special = {f[0] for f in found}
        plain = [None if i in special else collapsed(t, (), digest) for i, t in enumerate(texts)]
        full = [t if i in special else None for i, t in enumerate(texts)]
        yield batch_of(part, range(len(texts)), n, plain, full, *[[None] * len(texts)] * 3)
        for c in range(0, len(found), 1024):
            few = found[c : c + 1024]
            none = [None] * len(few)
            yield batch_of(part, [f[0] for f in few], none, none, none, [f[1].bit_length() - 1 for f in few],
                           [f[2] - int(last[f[0]] - n[f[0]]) for f in few], [flat[f[2] : f[3]] for f in few])

    def batch_of(part: pa.RecordBatch, rows, *columns) -> pa.RecordBatch:
        kept = [part.column(i).take(pa.array(list(rows), pa.int64())) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(kept + [pa.array(c, t.type) for c, t in zip(columns, types)], names=schema.names)

    return taken.mapInArrow(run, schema)


def collapsed(text: str | None, runs: Sequence[dict], digest: bool) -> str:
    """The words but those that a run holds after its first period, joined by one space; or the digest of that."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if runs:
        step = np.zeros(len(words) + 1, np.int64)
        for r in runs:
            step[r["start"] + r["period"]] += 1
            step[r["start"] + r["length"]] -= 1
        dropped = np.cumsum(step[:-1]) > 0
        words = [w for w, gone in zip(words, dropped.tolist()) if not gone]
    out = b" ".join(words)
    return hashlib.sha256(out).hexdigest() if digest else out.decode("utf-8", "surrogatepass")


def _fragments(found: DataFrame, least: int, times: int) -> DataFrame:
    """Solve every tile on its own, spread over all tasks: ``rid, period, a, b`` by positions that equal a later one."""
    spread = found.select("rid", "octave", "start", "ids").repartition("rid", "octave", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, octave, start, ids in zip(*(batch.column(i) for i in range(4))):
                base = start.as_py()
                rows += [(rid.as_py(), q, base + s, base + e - q)
                         for q, s, e in solve(ids.values.to_pylist(), 1 << octave.as_py(), least, times)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [()] * 4)],
                                             ["rid", "period", "a", "b"])

    return spread.mapInArrow(run, "rid long, period long, a long, b long")


def _stitched(fragments: DataFrame) -> DataFrame:
    """``rid, runs`` from fragments, stitched by document and period; runs by start, then period."""
    ordered = Window.partitionBy("rid", "period").orderBy("a", "b")
    reach = F.max("b").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    islands = fragments.withColumn("new", F.coalesce(F.col("a") > reach, F.lit(True)).cast("int")).withColumn(
        "island", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("rid", "period", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    one = F.struct(F.col("a").alias("start"), "period", (F.col("b") - F.col("a") + F.col("period")).alias("length"))
    return runs.groupBy("rid").agg(F.array_sort(F.collect_list(one)).alias("runs"))


def find_runs(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", least: int = 6, times: int = 4, digest: bool = False,
) -> DataFrame:
    """``row`` (struct of the ``keep`` columns), ``n_words``, ``runs`` and ``collapsed`` of every row.

    Words are separated by ASCII white space. A run is a maximal stretch of words with smallest period q and at
    least ``max(least, times * q)`` words (``times`` of 3 or more); ``runs`` has its start (word number), period
    and length, by start, then period. ``collapsed`` is the text without the words a run holds after its first
    period, its words joined by one space; with ``digest``, the SHA-256 of that.

    Null, empty and blank texts have no words, no run and an empty collapsed text. Rows are told apart by
    themselves, so repeated rows, repeated or null ids give a result each. Other columns are ignored; an empty
    table gives no rows. A text is held in one task once; its tiles are spread.
    """
    if times < 3:
        raise ValueError("runs of less than three periods are not looked for")
    found = durable(_scan(docs, keep, text, least, times, digest))
    runs = _stitched(_fragments(found.where("octave is not null"), least, times))
    rows = found.where("octave is null")
    none = F.array().cast(runs.schema["runs"].dataType)
    plain = rows.where("plain is not null").select("row", "n_words", none.alias("runs"), F.col("plain").alias("collapsed"))
    special = rows.where("plain is null").join(runs, "rid", "left").select(
        "row", "n_words", F.coalesce("runs", none).alias("runs"), "full")
    out = StructType([*special.schema.fields[:3], plain.schema["collapsed"]])

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [collapsed(t.as_py(), r.as_py(), digest) for t, r in zip(batch.column(3), batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], names=out.names)

    return plain.unionByName(special.mapInArrow(collapse, out))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first; null without runs."""
    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def listed(runs: Column) -> Column:
    """One line ``start,length,period`` per run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, number of runs, the strongest run and digests of all runs and of the collapsed text, per row."""
    found = find_runs(docs, text=text, digest=True).withColumn("best", strongest(F.col("runs")))
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed(F.col("runs")), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"), "n_words")
