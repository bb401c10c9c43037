"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded once, whole. The character span of every token is joined to the intervals of its
fields and sections; a token that crosses a boundary goes to the interval that holds most of its
characters, the first one on ties. So the counts of the sections of a document add up to its tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Fixed value: how the vocabulary's text is split before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: white space as the pattern sees it. Runs of it from this length on are cut out before the pattern,
#: whose lookahead would go back over a run one character at a time.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1024,}")
#: A field ends with this; it belongs to the section before it. A section of a field is a line with its end.
FIELD_END = "\n"
_SECTION = re.compile(r"[^\n]*\n|[^\n]+")
ROWS = "field string, section int, start_char int, end_char int, n_tokens int, n_crossing int"


@lru_cache(maxsize=2)
def load(path: str):
    """Encoders of a rank file, with the pattern and without, and the byte lengths of its tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    split, whole = (tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
                    for name, pattern in (("ranks", PATTERN), ("whole", "(?s).+")))
    return split, whole, lengths


def encode(text: str, path: str) -> np.ndarray:
    """Token ids. Of a run of white space all but the last character is one part, all of it at the end of the text."""
    split, whole, _ = load(path)
    parts, at = [], 0
    for run in _BLANKS.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        parts += [split.encode_ordinary(text[at : run.start()]), whole.encode_ordinary(text[run.start() : stop])]
        at = stop
    parts.append(split.encode_ordinary(text[at:]))
    return np.concatenate([np.array(p, np.int32) for p in parts])


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last character of every token; a token of part of a character spans all of it."""
    size = load(path)[2][encode(text, path)]
    end = np.cumsum(size)
    begin = end - size
    if text.isascii():
        return begin, end
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[begin], char[end - 1] + 1


def attribute(begin: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and tokens that cross a boundary, per interval; ``bounds`` are the ascending interval starts from 0."""
    first = np.searchsorted(bounds, begin, "right") - 1
    last = np.searchsorted(bounds, end - 1, "right") - 1
    owner = first.copy()
    for i in np.flatnonzero(first != last):
        cuts = np.concatenate([[begin[i]], bounds[first[i] + 1 : last[i] + 1], [end[i]]])
        owner[i] = first[i] + int(np.argmax(np.diff(cuts)))
    n = len(bounds)
    return np.bincount(owner, minlength=n), np.bincount(owner[first != last], minlength=n)


def token_counts(docs: DataFrame, path: str, fields: Sequence[str] = ("text",), keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document row and section: ``field, section, start_char, end_char, n_tokens, n_crossing``.

    The document is the fields in order, each but the last followed by a line break; sections are the lines of
    a field, counted from 0, and the character positions are those in the document. A null or empty field
    has no section; its line break, if any, is a section of its own. ``n_crossing`` counts the tokens of
    a section that reach into another. Documents without characters give no row; repeated rows give
    repeated rows; other columns are ignored.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    sizes = F.array(*[F.length(p) for p in parts])
    whole = F.concat_ws(FIELD_END, *parts)
    # Lengths lead the text, so that one column carries both.
    rows = docs.select(*keep, F.concat(F.array_join(sizes, ","), F.lit(" "), whole).alias("_whole"))
    names = list(fields)

    def make() -> Callable[[list], list]:
        def one(value: str) -> list[tuple]:
            head, _, text = value.partition(" ")
            if not text:
                return []
            lengths = [int(x) for x in head.split(",")]
            bounds, label = [], []
            at = 0
            for k, n in enumerate(lengths):
                stop = min(at + n + (k + 1 < len(lengths)), len(text))
                for j, m in enumerate(_SECTION.finditer(text, at, stop)):
                    bounds.append(m.start())
                    label.append((names[k], j))
                at = stop
            starts = np.array(bounds)
            n, crossing = attribute(*token_spans(text, path), starts)
            ends = np.append(starts[1:], len(text))
            return [(f, j, a, b, x, y) for (f, j), a, b, x, y in zip(label, bounds, ends.tolist(), n.tolist(), crossing.tolist())]

        return lambda values: [one(v) for v in values]

    return map_texts(rows, keep, "_whole", ROWS, make, many=True)
