"""Repeated passages across documents by a sparse suffix array.

Of all suffixes (one per word) only those at minimisers are kept: places whose next GRAM words have the
smallest hash among REACH neighbouring places. Content alone selects them, so two copies of a passage of
MIN_WORDS words keep the same ones. The kept suffixes are sorted by their first GRAM words and compared
with their neighbours; what is equal to a neighbour of another document is extended left, to every place
whose window of MIN_WORDS words has its minimiser there, and right to the end of that window. The
extended suffixes are sorted and compared once more, now by all MIN_WORDS words: equal neighbours of
different documents are repeated windows, and overlapping windows join into maximal spans.

Exactly the windows of MIN_WORDS words that occur in two documents are found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, durable, map_texts, mix, signed, words_of

MIN_WORDS = 50
#: GRAM + REACH - 1 words hold REACH grams and so a minimiser: together they must not exceed MIN_WORDS.
GRAM, REACH = 25, 26
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Windows:
    """Hashes of all word windows of a text, from prefix sums of weighted word hashes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, words: np.ndarray, size: int) -> np.ndarray:
        n = len(words)
        if n < size:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            if n > len(self.up):
                self.up = np.cumprod(np.append(np.uint64(1), np.full(n + n // 2, _BASE)), dtype=np.uint64)
                self.down = np.cumprod(np.append(np.uint64(1), np.full(n + n // 2, _INVERSE)), dtype=np.uint64)
            sums = np.append(np.uint64(0), np.cumsum(words * self.up[:n], dtype=np.uint64))
            return mix((sums[size:] - sums[:-size]) * self.down[: n - size + 1])


def minimiser_of(grams: np.ndarray) -> np.ndarray:
    """For each window of REACH grams, the place of its smallest one; the first on ties."""
    view = np.lib.stride_tricks.sliding_window_view(grams, REACH)
    out = np.empty(len(view), np.int64)
    for a in range(0, len(view), 1 << 16):
        out[a : a + (1 << 16)] = view[a : a + (1 << 16)].argmin(axis=1)
    return out + np.arange(len(view))


def _kept(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, key``: the retained suffixes and their first GRAM words."""

    def make() -> Callable[[list], list]:
        known, windows = WordHashes(), Windows()

        def work(texts: list) -> list:
            out = []
            for t in texts:
                w = words_of(t)
                if len(w) < MIN_WORDS:
                    out.append([])
                    continue
                grams = windows.of(known.of(w, len(w)), GRAM)
                at = np.unique(minimiser_of(grams))
                out.append(list(zip(at.tolist(), signed(grams[at]).tolist())))
            return out

        return work

    return map_texts(docs, ["doc_id"], "text", "pos int, key long", make, many=True)


def _repeated(suffixes: DataFrame) -> DataFrame:
    """Rows ``doc_id, pos, key`` whose key another document has too: sorted, then compared with neighbours.

    Ties of a key are sorted by document, so a frequent key spreads over as many partitions as it fills.
    Runs of a key at the edge of a partition are settled afterwards, from two markers per run.
    """
    ordered = suffixes.repartitionByRange("key", "doc_id", "pos").sortWithinPartitions("key", "doc_id", "pos").select("key", "doc_id", "pos")
    schema = "key long, doc_id long, pos int, edge int"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, ...]] = []

        def put(key, doc, pos, edge: int) -> None:
            if len(key):
                rows.append((key, doc, pos, np.full(len(key), edge, np.int32)))

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["key", "doc_id", "pos", "edge"])
                rows.clear()

        held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32))  # rows of the last run, all of one document
        open_key, first_key = None, None  # a last run known to have several documents; the first run's key
        low = high = None  # first and last document of the last run, however many batches it has

        def mark(key, *docs) -> None:
            d = np.array(docs, np.int64)
            put(np.full(len(d), key, np.int64), d, np.zeros(len(d), np.int32), 2)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, pos = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
            if first_key is None:
                first_key = key[0]
                mark(key[0], doc[0])
            if open_key is not None and open_key == first_key != key[0]:
                mark(first_key, high)  # the first run ended with the batch before
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            end = np.append(begin[1:], len(key))
            several = doc[begin] != doc[end - 1]
            if open_key is not None and key[0] == open_key:
                several[0] = True
            if len(begin) > 1 and key[0] == first_key:
                mark(first_key, doc[end[0] - 1])
            dup = np.repeat(several, end - begin)
            put(key[dup], doc[dup], pos[dup], 0)
            # A run of one document is settled at the next key, unless it is the partition's first.
            lone = ~dup
            lone[begin[-1]:] = False
            lone &= key == first_key
            put(key[lone], doc[lone], pos[lone], 1)
            tail = slice(begin[-1], None)
            if open_key is None or key[-1] != open_key:
                low = doc[begin[-1]]
            high = doc[-1]
            if several[-1]:
                open_key, held = key[-1], tuple(x[:0] for x in (key, doc, pos))
            else:
                open_key, held = None, (key[tail], doc[tail], pos[tail])
            last = key[-1]
            yield from flush()
        if first_key is not None:
            put(*held, 1)
            mark(last, low, high)
            yield from flush()

    found = durable(ordered.mapInArrow(compare, schema))
    edges = found.where("edge > 0").groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low != high")
    settled = found.where("edge = 1").join(edges.select("key"), "key", "left_semi")
    return found.where("edge = 0").unionByName(settled).select("doc_id", "pos", "key")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``doc_id, pos`` of every window of MIN_WORDS words that another document has too."""
    shared = _repeated(durable(_kept(docs)))
    places = shared.groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
    texts = docs.join(places, "doc_id")

    def make_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, windows = WordHashes(), Windows()
        for batch in batches:
            for doc, t, places in zip(*(batch.column(i) for i in range(3))):
                w = words_of(t.as_py())
                hashes = known.of(w, len(w))
                full = windows.of(hashes, MIN_WORDS)
                if not len(full):
                    continue
                grams = windows.of(hashes, GRAM)
                # GRAM + REACH - 1 words of each window decide its minimiser.
                chosen = np.zeros(len(grams), bool)
                at = places.values.to_numpy()
                chosen[at[at < len(grams)]] = True
                pos = np.flatnonzero(chosen[minimiser_of(grams)[: len(full)]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pos), doc.as_py(), np.int64)), pa.array(pos.astype(np.int32)), pa.array(signed(full[pos]))],
                    ["doc_id", "pos", "key"])

    extended = texts.select("doc_id", "text", "places").mapInArrow(make_rows, "doc_id long, pos int, key long")
    return _repeated(durable(extended)).select("doc_id", "pos")


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, spans, n_repeated_words`` of the documents with a passage that another document has too.

    Spans are maximal word ranges ``[start, end)`` covered by repeated windows, of MIN_WORDS words at
    least. Words compare without regard to A-Z case. Rows with the same doc_id are one document, so
    what repeats only inside it is no finding; rows without doc_id take no part; null, empty and short
    texts have no window. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = repeated_windows(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    begins = F.filter("at", lambda x, i: (i == 0) | (x > F.get("at", i - 1) + MIN_WORDS))
    ends = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) > x + MIN_WORDS))
    spans = found.select("doc_id", F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b + MIN_WORDS).alias("end"))).alias("spans"))
    return spans.select(
        "doc_id", "spans",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_repeated_words"))
