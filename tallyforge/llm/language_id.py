"""Language identification with error-correcting output codes.

Each language has a binary codeword. One linear classifier over hashed character n-grams per bit predicts
that bit of a text's language; the codeword with the smallest loss, summed over bits with each bit's own
weight, names the language. A small distance to the second-best codeword flags a text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Hashed n-gram features; the longest n-gram.
FEATURES, ORDER = 1 << 14, 3
#: Characters handled at once; a longer text hands its last symbols on, so that no n-gram is lost or added.
PIECE = 1 << 20
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # language x bit, +1 or -1
    weights: np.ndarray  # feature x bit
    trust: np.ndarray  # weight of each bit in decoding


def codewords(count: int, bits: int = 31, seed: int = 7) -> np.ndarray:
    """Codes of ``count`` languages: all splits into two sides if they are few, else far random ones."""
    if count < 2:
        return np.ones((count, 1), np.int8)
    if count <= 5:
        splits = [[1 if (k >> i) & 1 else -1 for i in range(count)] for k in range(1, 2 ** (count - 1))]
        return np.array(splits, np.int8).T
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (count, max(bits, 4 * int(np.ceil(np.log2(count))))))
        apart = ((code[:, None, :] != code[None, :, :]).sum(axis=2) + 10**6 * np.eye(count, dtype=int)).min()
        if apart > far and (np.abs(code.sum(axis=0)) < count).all():
            best, far = code, apart
    return best


def features(before: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Hashed n-grams that end in ``symbols``; those ``before`` only start some."""
    both = np.concatenate([before, symbols])
    out = []
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):
            part = both[max(len(before) - n + 1, 0) :]
            h = np.full(max(len(part) - n + 1, 0), n, np.uint64)
            for i in range(n):
                h = (h ^ part[i : len(h) + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append((h >> np.uint64(50)).astype(np.int64))
    return np.concatenate(out)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = True
    return table


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """Features of a text: n-grams of its letters in lower case, all else is one space between words."""
    low, blank = (text or "").lower(), np.full(1, 32, np.uint64)
    seen, after_letter, before = False, False, blank[:0]
    for a in range(0, len(low), PIECE):
        code = np.frombuffer(low[a : a + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        keep = letter | np.append(after_letter, letter[:-1])
        after_letter = letter[-1]
        symbols = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)
        if not seen and letter.any():
            seen, symbols = True, np.concatenate([blank, symbols])
        if seen and a + PIECE >= len(low):
            symbols = np.concatenate([symbols, blank])
        if len(symbols):
            yield features(before, symbols)
            before = np.concatenate([before, symbols])[1 - ORDER :]


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the decimal id, remainder 1 of 3; a null id is not one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on all rows given: one pass adds up n-gram counts per language, the bits are computed from those.

    The counts are at most FEATURES rows per language, whatever the input. A bit's classifier weighs an
    n-gram by the log ratio of its share on the two sides of the bit, each side a mean over its
    languages, so that frequent languages do not outweigh rare ones. A bit is trusted by how far apart
    it holds the languages' mean scores.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1).to_pylist()):
                for f in pieces(t.as_py()):
                    if name not in sums:
                        sums[name] = np.zeros(FEATURES, np.int64)
                    sums[name] += np.bincount(f, minlength=FEATURES)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "feature", "n"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang))
    sums = rows.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(sums["lang"].unique()))
    counts = np.zeros((len(names), FEATURES))
    counts[sums["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(int), sums["feature"].to_numpy(int)] = sums["n"].to_numpy(float)
    codes = codewords(len(names))
    if len(names) < 2:
        return Model(names, codes, np.zeros((FEATURES, codes.shape[1]), np.float32), np.ones(codes.shape[1]))
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    up, down = (codes > 0).astype(float), (codes < 0).astype(float)
    weights = np.log((up.T @ share) / up.sum(axis=0)[:, None]) - np.log((down.T @ share) / down.sum(axis=0)[:, None])
    margin = (share @ weights.T) * codes  # mean score of each language, positive on its own side
    scale = np.maximum(np.abs(margin).mean(axis=0), 1e-9)
    trust = np.clip(margin.min(axis=0) / scale, 0.05, 1.0)
    return Model(names, codes, (weights / scale[:, None]).T.astype(np.float32), trust / trust.sum())


def decode(model: Model, margins: np.ndarray) -> tuple[str, float, float]:
    """Language, score and gap of the mean margins of a text's bits."""
    loss = np.log1p(np.exp(-4.0 * margins[None, :] * model.codes)) @ model.trust
    order = np.argsort(loss, kind="stable")
    near = np.exp(-4.0 * (loss - loss[order[0]]))
    gap = float(loss[order[1]] - loss[order[0]]) if len(order) > 1 else 1.0
    return model.languages[order[0]], float(1 / near.sum()), gap


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ambiguous_below: float = 0.05) -> DataFrame:
    """The ``keep`` columns of every row with ``lang_pred``, ``score`` in 0..1 and ``ambiguous``.

    Only the text is looked at. Null texts, and texts without a letter, are ``und`` with score 0 and
    ambiguous; so is every text if nothing was learned. Long texts are scored whole, piece by piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], list]:
        m = shared.value

        def one(t: str | None) -> tuple[str, float, bool]:
            total, n = np.zeros(m.weights.shape[1]), 0
            for f in pieces(t):
                if len(f):
                    total += np.bincount(f, minlength=FEATURES) @ m.weights if len(f) > 4096 else m.weights[f].sum(axis=0)
                    n += len(f)
            if not n or not m.languages:
                return UNDETERMINED, 0.0, True
            name, score, gap = decode(m, total / n)
            return name, score, gap < ambiguous_below

        return lambda texts: [one(t) for t in texts]

    return map_texts(docs, keep, text, "lang_pred string, score double, ambiguous boolean", make)
