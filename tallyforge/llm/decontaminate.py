"""Benchmark decontamination with the CGK embedding and bit-sampling LSH.

Edit distance is over words. The CGK random walk reads a word sequence and writes it to a longer one:
at each step it writes the current word and moves on or stays, as a random function of the step and the
word says. Both sequences use the same random functions, so a small edit distance becomes a small Hamming
distance with good probability. Each repetition has its own walk and samples a few positions of what it
writes; an item and a window of its size that agree in all samples of a repetition are candidates. The
number of repetitions follows from the target recall. Candidates are verified by exact edit distance.

A walk of STEPS steps reads about half as many words. Items of STEPS words and more are walked from several
anchors, spread so that these walks read the whole item: wherever its edits lie, the walk of some anchor
meets few of them. All anchors have the same walks, so a text is walked once for all of them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, map_texts, mix, words_of

#: Words that an edit may touch, of a hundred of the item's.
EDIT_PERCENT = 10
#: Chance to find a window at the largest distance allowed, and what one more repetition finds of those that the
#: others miss. Single repetitions find 0.47 to 0.70 of such windows; they miss partly the same ones, hence less.
TARGET_RECALL, PER_REPETITION = 0.99, 0.2
#: Samples of a repetition, and the steps of the walk that they are taken from.
SAMPLES, STEPS = 4, 20
#: Words between anchors at most, and words of the item behind its last anchor: what a walk reads on average, and with some room.
ANCHOR_GAP, ANCHOR_ROOM = STEPS // 2, STEPS // 2 + 2
#: Items in memory at once; a larger benchmark is searched in blocks of so many.
BLOCK_ITEMS = 50_000
HIT = "item_id long, start_word long, end_word long, distance long"


def repetitions(target: float = TARGET_RECALL, each: float = PER_REPETITION) -> int:
    return math.ceil(math.log(1 - target) / math.log(1 - each))


def allowed(size: int) -> int:
    return size * EDIT_PERCENT // 100


def anchors(size: int) -> list[int]:
    """Words of an item at which walks begin: the first one only if the item ends within a walk."""
    if size < STEPS:
        return [0]
    last = size - ANCHOR_ROOM
    parts = -(-last // ANCHOR_GAP)
    return [last * i // parts for i in range(parts + 1)]


def _moves(word: np.ndarray, step: int, seed: int) -> np.ndarray:
    """The random bit of a word at a step of a repetition."""
    with np.errstate(over="ignore"):
        salt = np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xC2B2AE3D27D4EB4F) & (2**64 - 1))
        return (((word ^ salt) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)).astype(np.int64)


class Walk:
    """The walk and the sampled steps of one repetition.

    Steps are sampled from the first STEPS, which read the first words behind an anchor: items of STEPS words
    and more share a walk whatever their size, a shorter item ends within it and is walked by its own size.
    """

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng([min(size, STEPS), seed])
        span = min(STEPS, max(2 * size - 2, 1))
        self.size, self.seed = min(size, STEPS), seed
        self.steps = np.sort(rng.choice(span, min(SAMPLES, span), replace=False))

    def keys(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hash of the sampled words for each window that begins at a start; past its size, a filler."""
        at = np.zeros(len(starts), np.int64)
        key = np.full(len(starts), self.seed + 1, np.uint64)
        wanted = set(self.steps.tolist())
        with np.errstate(over="ignore"):
            for step in range(int(self.steps[-1]) + 1):
                word = flat[starts + at]
                if self.size < STEPS:
                    word = np.where(at < self.size, word, np.uint64(0))
                if step in wanted:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + word)
                at += _moves(word, step, self.seed)
        return key


def nearest(item: np.ndarray, text: np.ndarray, most: int, starts: int) -> tuple[int, int, int]:
    """``(distance, start, end)`` of the span of ``text`` nearest to the item, of those that begin at one of the first ``starts`` places.

    Of several the first, and of these the shortest; the distance is capped at ``most`` + 1.
    """
    at = np.arange(len(text) + 1)
    # Distance and start in one number, so that the least one has the first start.
    row = np.minimum(at, starts - 1) + (np.maximum(at - starts + 1, 0) << 32)
    steps, one = at << 32, 1 << 32
    for word in item:
        new = row + one
        np.minimum(new[1:], row[:-1] + ((text != word).astype(np.int64) << 32), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps  # insertions run along the row
        if row.min() >> 32 > most:
            return most + 1, 0, 0
    end = int(row.argmin())
    return int(row[end]) >> 32, int(row[end]) & (one - 1), end


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """Least edit distance of the item to a prefix of ``text``, and that prefix's length; the distance is capped at ``most`` + 1."""
    d, _, end = nearest(item, text[: len(item) + most], most, 1)
    return d, end


class Index:
    """LSH tables over a block of items: one set for items of STEPS words and more, one for each smaller size."""

    def __init__(self, items: list[tuple[int, str]], repeats: int):
        known = WordHashes()
        self.items = [(i, known.of(w, len(w))) for i, t in items if (w := words_of(t))]
        self.sizes = sorted({len(w) for _, w in self.items})
        self.vocabulary = np.unique(np.concatenate([w for _, w in self.items])) if self.items else np.zeros(0, np.uint64)
        classes: dict[int, list[int]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            classes[min(len(w), STEPS)].append(k)
        self.tables = {}
        for size, members in classes.items():
            filler = np.zeros(STEPS, np.uint64)
            flat = np.concatenate([x for k in members for x in (self.items[k][1], filler)])
            begins = np.cumsum([0, *[len(self.items[k][1]) + STEPS for k in members[:-1]]])
            spread = [anchors(len(self.items[k][1])) for k in members]
            item = np.repeat(np.array(members, np.int32), [len(x) for x in spread])
            offset = np.concatenate(spread).astype(np.int32)
            starts = np.repeat(begins, [len(x) for x in spread]) + offset
            tables = []
            for r in range(repeats):
                walk = Walk(size, r)
                keys = walk.keys(flat, starts)
                order = np.argsort(keys, kind="stable")
                tables.append((walk, keys[order], item[order], offset[order]))
            self.tables[size] = tables
        self.lengths = np.array([len(w) for _, w in self.items], np.int64)

    def _near(self, foreign: np.ndarray, count: int) -> np.ndarray:
        """Places where a window can begin.

        Cut into runs of the smallest item size, a window near an item has a run with few words of no item;
        one that starts close enough behind each place is looked for once for all sizes.
        """
        least, longest = self.sizes[0], self.sizes[-1]
        few = max(allowed(n) // max((n - allowed(n)) // least, 1) for n in self.sizes)
        at = np.arange(count)
        dense = foreign[np.minimum(at + least, count)] - foreign[:-1] <= few
        ahead = np.concatenate([[0], np.cumsum(dense)])
        return np.flatnonzero(ahead[np.minimum(at + longest, count)] > ahead[:-1])

    def _verify(self, pairs: np.ndarray, flat, owner, begins, ends, foreign, hits: dict) -> None:
        """Adds the hits near candidates, given in order as item times text length plus supposed begin.

        Edits before an anchor shift the begin by so many words; begins that are close to each other are verified together.
        """
        item, begin = np.divmod(pairs, len(flat))
        most = self.lengths[item] * EDIT_PERCENT // 100
        doc = owner[begin]
        # Words that every span in question holds.
        inner = np.minimum(begin + most, ends[doc])
        outer = np.maximum(np.minimum(begin + self.lengths[item] - 2 * most, ends[doc]), inner)
        some = foreign[outer] - foreign[inner] <= most
        rows = list(zip(item[some].tolist(), doc[some].tolist(), begin[some].tolist()))
        i = 0
        while i < len(rows):
            k, d, first = rows[i]
            item_id, words = self.items[k]
            edits = allowed(len(words))
            while i < len(rows) and rows[i][:2] == (k, d) and rows[i][2] <= first + 2 * edits:
                last = rows[i][2]
                i += 1
            best = hits.get((d, item_id))
            a, b = max(first - edits, int(begins[d])), min(last + edits + 1, int(ends[d]))
            if best and best[2] == 0 and best[0] <= a:
                continue
            distance, start, end = nearest(words, flat[a : min(b + len(words) + edits, int(ends[d]))], edits, b - a)
            if distance <= edits and (best is None or (distance, a + start) < (best[2], best[0])):
                hits[d, item_id] = (a + start, a + end, distance)

    def find(self, flat: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Verified hits ``(owner, item, start, end, distance)`` in the words of several texts, one behind the other.

        ``owner`` is the text of each word and ``ends`` where each text ends.
        """
        hits: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not len(self.vocabulary) or not len(flat):
            return []
        place = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        foreign = np.concatenate([[0], np.cumsum(self.vocabulary[place] != flat)])
        padded = np.concatenate([flat, np.zeros(STEPS, np.uint64)])
        places = self._near(foreign, len(flat))
        room = ends[owner[places]] - places
        begins = np.concatenate([[0], ends[:-1]])
        # A window near an item holds at most ``allowed`` words of no item and is at most that much shorter.
        fits = {c: np.zeros(len(places), bool) for c in self.tables}
        reach = np.zeros(len(places), np.int64)
        for size in self.sizes:
            upto = places + np.minimum(size, room)
            fit = (room >= size - allowed(size)) & (foreign[upto] - foreign[places] <= allowed(size))
            fits[min(size, STEPS)] |= fit
            if size >= STEPS:
                np.maximum(reach, fit * (anchors(size)[-1] + allowed(size)), out=reach)
        for c, tables in self.tables.items():
            starts = places[fits[c]]
            if c == STEPS and len(starts):
                # Anchors of a window that begins at a place lie behind it.
                last = np.full(len(flat), -1)
                last[starts] = starts + np.minimum(reach, room - 1)[fits[c]]
                starts = np.flatnonzero(np.maximum.accumulate(last) >= np.arange(len(flat)))
            pairs = []
            for walk, keys, members, offsets in tables if len(starts) else ():
                # A short window at the end of a text reads on, as any window with words lost does.
                found = walk.keys(padded, starts)
                lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
                some = np.flatnonzero(hi > lo)
                if len(some):
                    count = (hi - lo)[some]
                    at = np.repeat(lo[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    start = np.repeat(starts[some], count)
                    begin = np.maximum(start - offsets[at], begins[owner[start]])
                    pairs.append(np.unique(members[at].astype(np.int64) * len(flat) + begin))
            if pairs:
                self._verify(np.unique(np.concatenate(pairs)), flat, owner, begins, ends, foreign, hits)
        return [(doc, item, a - int(begins[doc]), b - int(begins[doc]), d) for (doc, item), (a, b, d) in sorted(hits.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document row and item found in it: the ``keep`` columns, ``item_id``, word span and ``distance``.

    A hit is a span of the text within EDIT_PERCENT of the item's words in edit distance; of several the
    nearest and then first is given. Null, empty and blank texts and items give nothing; repeated rows give
    repeated hits; the ids of equal items are all given. Other columns are ignored. The benchmark is a query
    set: it is read in blocks of BLOCK_ITEMS and searched against all documents.
    """
    spark = docs.sparkSession

    def search(found: list[tuple[int, str]]) -> DataFrame:
        return map_texts(docs, keep, text, HIT, _searcher(spark, found), many=True)

    parts = [search(block) for block in _blocks(benchmark)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without any benchmark item in their text, with all their columns."""
    for block in _blocks(benchmark):
        rows = docs.select(F.struct("*").alias("row"), F.col("text"))
        counted = map_texts(rows, ["row"], "text", "hits int", _searcher(docs.sparkSession, block, count=True))
        docs = counted.where("hits = 0").select("row.*")
    return docs


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, BLOCK_ITEMS at a time; one empty block if there are none."""
    block: list[tuple[int, str]] = []
    given = False
    for row in benchmark.select("item_id", "text").where("text is not null and item_id is not null").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        if len(block) == BLOCK_ITEMS:
            yield block
            block, given = [], True
    if block or not given:
        yield block


def _searcher(spark: SparkSession, block: list[tuple[int, str]], count: bool = False) -> Callable:
    shared, repeats = spark.sparkContext.broadcast(block), repetitions()

    def make() -> Callable[[list], list]:
        index, known = Index(shared.value, repeats), WordHashes()

        def work(texts: list) -> list:
            found = [words_of(t) for t in texts]
            sizes = np.array([len(w) for w in found])
            flat = known.of((x for w in found for x in w), int(sizes.sum()))
            out: list[list[tuple]] = [[] for _ in texts]
            for doc, *hit in index.find(flat, np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)):
                out[doc].append(tuple(hit))
            return [(len(x),) for x in out] if count else out

        return work

    return make
