"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is normalised as the model asks (dummy prefix, spaces as U+2581) and cut before every run of
U+2581: no piece of the model continues over such a cut, which is checked when the model is loaded.
All different words of a batch lie in flat symbol arrays. Each round finds the best pair rank of every
word (a segmented minimum), merges all its occurrences from the left at once and compacts the arrays,
until no pair is left. Merging all at once equals merging one by one unless the merged piece could grow
into a better-ranked one while the same pair waits further right; there, only the leftmost is merged.

A long word is first cut where no piece holds the two characters side by side. What is still long has its
minimum taken over a window around every pair instead of the whole word: no piece reaches beyond it, so
the best pair of each window can be merged in the same round, and rounds do not grow with the length.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import map_texts

SPACE = "▁"
#: Parts of more symbols than this take their minima over windows: rounds per word would grow with its length.
LONG = 512
#: Rounds after which a part that still has pairs is finished pair by pair (texts made to need one round per pair).
ROUNDS = 4096
_CACHED_WORDS = 1 << 17
_NONE = np.int64(1 << 40)


def _least(values: np.ndarray, left: int, right: int) -> np.ndarray:
    """Minimum of every value and its neighbours, so many to the left and to the right."""
    out = np.concatenate([np.full(left, _NONE), values, np.full(right, _NONE)])
    have, size = 1, left + right + 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Model:
    """Piece tables of a SentencePiece BPE model with byte fallback, and the codec built on them."""

    def __init__(self, path: str):
        import sentencepiece  # the library only reads the model file here

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        self.byte_ids, self.bytes_of = [0] * 256, [b""] * n
        self.control = np.zeros(n, bool)
        self.is_byte = np.zeros(n, bool)
        ids: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
                self.is_byte[i] = True
            elif sp.is_control(i) or sp.is_unknown(i):
                self.control[i] = sp.is_control(i)
                self.bytes_of[i] = b"" if sp.is_control(i) else b" \xe2\x81\x87 "
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece of this model continues after a space")
                ids[piece] = i
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        # Equal scores are equal ranks; the better score has the smaller rank.
        scores = sorted({-sp.get_score(i) for i in ids.values()})
        place = {s: r for r, s in enumerate(scores)}
        rank = {i: place[-sp.get_score(i)] for i in ids.values()}
        self.pairs: dict[int, tuple[int, int]] = {}
        best_growth: dict[int, int] = {}
        keys, ranks, made = [], [], []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is None or right is None:
                    continue
                keys.append(left * n + right)
                ranks.append(rank[i])
                made.append(i)
                for part in (left, right):
                    best_growth[part] = min(best_growth.get(part, 1 << 40), rank[i])
        order = np.argsort(np.array(keys, np.int64))
        self.n = n
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int64)[order]
        self.made = np.array(made, np.int64)[order]
        self.heap_pairs = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.made)}
        #: Pieces that can grow into a piece of an equal or better rank.
        self.longest = max(map(len, ids), default=1)
        joined = {ord(a) * 0x110000 + ord(b) for piece in ids for a, b in zip(piece, piece[1:])}
        #: Neighbouring characters of any piece.
        self.neighbours = np.array(sorted(joined), np.int64)
        self.grows = np.zeros(n, bool)
        for i, r in rank.items():
            self.grows[i] = best_growth.get(i, 1 << 40) <= r
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        #: Symbol of every character: its piece, or minus its code point outside the vocabulary.
        self.symbol_of = -np.arange(0x110000, dtype=np.int64)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        self.id_text = np.array([str(i) for i in range(n)], object)
        #: Ids of words met so far, as text and as int32 bytes.
        self.names: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}

    # -- encoding -------------------------------------------------------------------------------

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of neighbouring symbols; symbols outside the vocabulary (< 0) never merge."""
        key = left * self.n + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == key) & (key >= 0)
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.made[at], -1)

    def _all_pairs(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of every symbol with the next one of its word."""
        if not len(symbols):
            return symbols, symbols
        return self._look_up(symbols, np.append(np.where(word[1:] == word[:-1], symbols[1:], -1), -1))

    def _merge(self, at, symbols, word, rank, made) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Merge the pairs at ``at``, compact the arrays and look the pairs beside merged symbols up again."""
        symbols[at] = made[at]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, word, rank, made = symbols[stay], word[stay], rank[stay], made[stay]
        at = at - np.arange(len(at))
        at = np.concatenate([at[at > 0] - 1, at])
        there = np.minimum(at + 1, len(word) - 1)
        right = np.where((at + 1 < len(word)) & (word[there] == word[at]), symbols[there], -1)
        rank[at], made[at] = self._look_up(symbols[at], right)
        return symbols, word, rank, made

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair of any word is left; ``word`` is the ascending word number of a symbol."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = self._all_pairs(symbols, word)
        while len(symbols):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            best = np.minimum.reduceat(rank, first)
            open_word = best < _NONE
            if not open_word.all():  # finished words leave the arrays
                stay = np.repeat(open_word, size)
                done.append((symbols[~stay], word[~stay]))
                symbols, word, rank, made, size, best = (
                    symbols[stay], word[stay], rank[stay], made[stay], size[open_word], best[open_word])
                if not len(symbols):
                    break
                first = np.cumsum(size) - size
            hit = rank == np.repeat(best, size)
            at = np.flatnonzero(hit)
            # A hit is dropped if its left neighbour is taken: of touching hits every second one stays.
            run = np.flatnonzero(np.append(True, np.diff(at) != 1))
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]
            owner = word[at]
            leading = np.append(True, owner[1:] != owner[:-1])
            # The growing kind is merged one at a time, unless the word has only that one.
            risky = np.logical_or.reduceat(self.grows[made[at]], np.flatnonzero(leading))
            at = at[leading | ~np.repeat(risky, np.diff(np.append(np.flatnonzero(leading), len(at))))]
            symbols, word, rank, made = self._merge(at, symbols, word, rank, made)
        if not done:
            return symbols, word
        symbols, word = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _windows(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same merges with the minimum over a window of twice the longest piece to both sides.

        A pair that is best in its window is merged before anything that could touch it: whatever comes
        to touch it would be made of pairs of the window, none of which is better. Among equal pairs
        the left one goes first; one that waits, or that grows once merged, holds back those right of it as
        long as they follow within a window of each other.
        """
        reach = 2 * self.longest + 2
        rank, made = self._all_pairs(symbols, word)
        for _ in range(ROUNDS):
            hit = (rank == _least(rank, reach, reach)) & (rank < _NONE)
            at = np.flatnonzero(hit)
            if not len(at):
                return symbols, word
            waits = _least(np.where(hit, _NONE, rank), reach, 0)[at] == rank[at]
            run = np.flatnonzero(np.append(True, np.diff(at) != 1))
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at, waits = at[place % 2 == 0], waits[place % 2 == 0]
            new, r = made[at], rank[at]
            before = np.where((at > 0) & (word[at - 1] == word[at]), symbols[at - 1], -1)
            there = np.minimum(at + 2, len(word) - 1)
            after = np.where((at + 2 < len(word)) & (word[there] == word[at]), symbols[there], -1)
            merged = np.where(np.append(False, np.diff(at) == 2), np.append(-1, new[:-1]), -1)
            grown = (self._look_up(before, new)[0] <= r) | (self._look_up(new, after)[0] <= r) | (self._look_up(merged, new)[0] <= r)
            held = np.cumsum(waits | grown) - (waits | grown)
            group = np.flatnonzero(np.append(True, np.diff(at) > reach))
            held -= np.repeat(held[group], np.diff(np.append(group, len(at))))
            at = at[(held == 0) & ~waits]
            symbols, word, rank, made = self._merge(at, symbols, word, rank, made)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        parts = [np.array(self._heap(p.tolist()), np.int64) for p in np.split(symbols, first[1:])]
        return np.concatenate(parts), np.repeat(word[first], [len(p) for p in parts])

    def _heap(self, symbols: list[int]) -> list[int]:
        """The same merges for one word, pair by pair: best pair first, leftmost on ties."""
        n, pairs = self.n, self.heap_pairs
        after, before = list(range(1, len(symbols))) + [-1], list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and symbols[i] >= 0 and symbols[j] >= 0 and (hit := pairs.get(symbols[i] * n + symbols[j])):
                heap.append((hit[0], i, symbols[i], symbols[j]))

        for i in range(len(symbols)):
            offer(i)
        heapq.heapify(heap)
        gone = bytearray(len(symbols))
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i] = pairs[a * n + b][1]
            gone[j] = 1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0:
                    size = len(heap)
                    offer(k)
                    if len(heap) > size:
                        heapq.heappush(heap, heap.pop())
        return [s for s, dead in zip(symbols, gone) if not dead]

    def encode_words(self, found: list[str]) -> None:
        """Add the ids of words as cut by :func:`cut` to the remembered ones."""
        if not found:
            return
        codes = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, found), np.int64, len(found))
        word = np.repeat(np.arange(len(found)), size)
        starts = np.append(True, word[1:] != word[:-1])
        inside = np.flatnonzero(~starts & (size > LONG)[word])
        starts[inside[~np.isin(codes[inside - 1] * 0x110000 + codes[inside], self.neighbours)]] = True
        part, owner = np.cumsum(starts) - 1, word[starts]
        wide = (np.bincount(part) > LONG)[part]
        symbols = self.symbol_of[codes]
        merged, of = self._rounds(symbols[~wide], part[~wide])
        if wide.any():
            more, of_more = self._windows(symbols[wide], part[wide])
            of = np.concatenate([of, of_more])
            order = np.argsort(of, kind="stable")
            merged, of = np.concatenate([merged, more])[order], of[order]
        self._remember(found, merged, np.searchsorted(owner[of], np.arange(len(found))))

    def _remember(self, found: list[str], symbols: np.ndarray, begins) -> None:
        ends = [*begins[1:], len(symbols)]
        names, raw = self.id_text[np.maximum(symbols, 0)].tolist(), symbols.astype(np.int32).tobytes()
        strange = np.logical_or.reduceat(symbols <= 0, begins).tolist()
        for w, a, b, odd in zip(found, map(int, begins), map(int, ends), strange):
            if odd:  # characters outside the vocabulary become their bytes
                ids = [x for s in symbols[a:b].tolist()
                       for x in ([self.byte_ids[c] for c in chr(-s).encode()] if s <= 0 else [s])]
                self.names[w], self.raw[w] = " ".join(map(str, ids)), np.array(ids, np.int32).tobytes()
            else:
                self.names[w], self.raw[w] = " ".join(names[a:b]), raw[4 * a : 4 * b]

    def encode(self, texts: list[str | None]) -> list[tuple[str, int, np.ndarray]]:
        """Per text: its ids as one string, their number and the ids; null is the empty text; the end id is last."""
        parts = [cut(t) for t in texts]
        present = set(chain.from_iterable(parts))
        if len(self.names) + len(present) > _CACHED_WORDS:
            self.names.clear()
            self.raw.clear()
        self.encode_words(list(present - self.names.keys()))
        end, end_raw = str(self.eos), np.array([self.eos], np.int32).tobytes()
        out = []
        for p in parts:
            ids = np.frombuffer(b"".join(map(self.raw.__getitem__, p)) + end_raw, np.int32)
            out.append((" ".join([*map(self.names.__getitem__, p), end]), len(ids), ids))
        return out

    # -- decoding -------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control ids vanish, one leading space goes, malformed bytes become U+FFFD."""
        ids = ids[~self.control[ids]]
        size = self.lengths[ids]
        total = int(size.sum())
        if not total:
            return ""
        from_ = np.repeat(self.starts[ids] - (np.cumsum(size) - size), size) + np.arange(total)
        data = self.flat[from_].tobytes()
        if data[:1] == b" " and not self.is_byte[ids[0]]:
            data = data[1:]
        return data.decode("utf-8", "replace")


_CUT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def cut(text: str | None) -> list[str]:
    """The normalised text in words; an empty text has none."""
    if not text:
        return []
    return _CUT.findall(SPACE + text.replace(" ", SPACE))


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, model_path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row with ``ids`` array<int>: the text's pieces and the end id.

    A null text is the empty text (the end id alone). Rows are independent, so repeated rows and empty
    tables need no care, and other columns are ignored. The model file must be at ``model_path`` on
    every machine.
    """

    def make():
        model = load(model_path)
        return lambda texts: [(ids,) for _, _, ids in model.encode(texts)]

    return map_texts(docs, keep, text, "ids array<int>", make)


def decode(rows: DataFrame, model_path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row with ``text``; null ids give the empty text."""
    names = [*keep, "ids"]
    taken = rows.select(*keep, F.col(ids).alias("ids"))
    schema = StructType([*taken.schema.fields[:-1], StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            texts = ["" if x is None else model.decode(np.array(x, np.int64)) for x in batch.column(len(names) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return taken.mapInArrow(run, schema)


def digests(docs: DataFrame, model_path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``n_tokens`` of every row, and the digests of its ids and of the text decoded from them."""

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    def make():
        model = load(model_path)
        return lambda texts: [(n, sha(s), sha(model.decode(ids))) for s, n, ids in model.encode(texts)]

    return map_texts(docs, keep, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
