"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent.

Entities are detected per document. Every different entity of the corpus gets one surrogate, drawn from a
keyed hash of it, so a mention has the same replacement everywhere. A surrogate that equals a real entity
of the corpus or another's surrogate is drawn again until all are distinct. Letters become letters of
the same script and case, digits digits; names keep the gender that their title tells, and a surname
alone gets what it got beside a given name.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, durable, map_texts

#: Titles that come before a name, by gender.
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Monsieur", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа"),
    "n": ("Dr", "Prof"),
}
_GENDER = {t: g for g, titles in TITLES.items() for t in titles} | {"MR": "m", "MRS": "f", "mr": "m", "mrs": "f"}
#: Words in lower case inside a name.
PARTICLES = ("al", "bin", "da", "de", "del", "den", "der", "di", "dos", "du", "el", "la", "le", "ter", "van", "von", "zu")
_TITLE = rf"(?:{'|'.join(_GENDER)})\b\.?"
_UPPER = r"[^\W\d_a-zа-я]"
_NAME = rf"{_UPPER}[^\W\d_]*(?:['’-][^\W\d_]+)*\b"
#: A word of a name or an initial, with the particles before it.
_PART = rf"(?:(?:{'|'.join(PARTICLES)}) )*(?:{_UPPER}\.(?=[ ]?{_UPPER}| (?:{'|'.join(PARTICLES)}) )|{_NAME})"
_WORD = re.compile(rf"{_UPPER}\.|[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ENTITY = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)(?!\w))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?)(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w))"
    rf"|(?P<person>\b{_TITLE}(?: {_TITLE})* (?P<names>{_PART}(?: ?{_PART})*)|\bmrs?\b\.? (?P<low>[^\W\d_]{{2,}}(?:['’-][^\W\d_]+)*))"
)
#: A word, hyphens included, and its parts.
_LETTERS, _LETTER_RUN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*"), re.compile(r"[^\W\d_]+(?:['’][^\W\d_]{2,})*")
#: Digits as Python's \d has them, for Java: its \d is ASCII only, and Java 17 does not know the last three blocks.
_DIGIT = r"[\p{Nd}\x{11F50}-\x{11F59}\x{16AC0}-\x{16AC9}\x{1E4F0}-\x{1E4F9}]"
#: A text without any of these holds no entity.
MAY_HOLD = rf"@|{_DIGIT}{{3}}|{_DIGIT}\.{_DIGIT}|[A-Z]{{2}}{_DIGIT}{{2}}|" + "|".join(
    t for t in _GENDER if not any(t != u and t.startswith(u) for u in _GENDER))
#: After so many attempts, and again after as many more, surrogates become a character longer: short forms may be used up.
PATIENCE = 16
#: Characters that a form without letters and digits gets, as nothing in it can be drawn.
BARE = 8
ENTITY = "start int, end int, kind string, value string, canonical string"


def detect(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """Mentions ``(start, end, kind, value, canonical)``, leftmost first, not overlapping.

    A title, or several, introduces a name: capitalised words, initials and the particles between them, up to the
    last capitalised word; behind ``mr`` and ``mrs`` in lower case, one word. The last word is the surname. Names
    that a title has introduced are also found without it in the same text.
    """
    found: list[tuple[int, int, str, str, str]] = []
    known: dict[str, str] = {}
    if not text:
        return found
    for m in _ENTITY.finditer(text):
        kind = "person" if m["person"] else m.lastgroup
        if kind != "person":
            found.append((m.start(), m.end(), kind, m[0], canonical(kind, m[0])))
            continue
        gender = _GENDER[re.match(r"\w+", m[0])[0]]
        group = "names" if m["names"] else "low"
        parts = [(p.start(), re.sub(r"(?<=..)['’]s\Z", "", p[0])) for p in _WORD.finditer(text, *m.span(group)) if p[0] not in PARTICLES]
        if m["names"]:
            parts = list(takewhile(lambda p: not p[1][0].islower(), parts))
        for k, (at, name) in enumerate(parts):
            if name.endswith("."):
                found.append((at, at + 1, "initial", name[0], canonical("initial", name[0])))
                continue
            kind = "surname" if k == len(parts) - 1 else f"given_{gender}"
            known.setdefault(name, kind)
            found.append((at, at + len(name), known[name], name, canonical(kind, name)))
    if known:
        ends = [(b, a) for a, b, *_ in found]  # ascending, as the spans do not overlap
        for m in _LETTERS.finditer(text):
            # A hyphened word, or its parts; an ending behind an apostrophe is none of the name.
            parts = [m] if m[0] in known else _LETTER_RUN.finditer(text, *m.span())
            for p in parts:
                i = bisect_right(ends, (p.start(), len(text)))
                if p[0] in known and (i == len(ends) or ends[i][1] >= p.end()):
                    found.append((p.start(), p.end(), known[p[0]], p[0], canonical(known[p[0]], p[0])))
    return sorted(found)


def canonical(kind: str, value: str) -> str:
    """The same entity in another spelling has the same canonical form."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "phone", "ssn", "iban"):
        return ascii_digits(re.sub(r"[ ().-]", "", value))
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    return unicodedata.normalize("NFC", value).casefold()


def ascii_digits(value: str) -> str:
    """Digits of all scripts as 0 to 9; the rest as it is."""
    return value if value.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in value)


def digits_like(c: str, digits: str) -> str:
    """The 0 to 9 in ``digits`` in the script of the digit ``c``; as they are if ``c`` is none."""
    if c.isascii() or not c.isdecimal():
        return digits
    zero = ord(c) - unicodedata.decimal(c)
    return "".join(chr(zero + int(x)) if x in "0123456789" else x for x in digits)


class Draw:
    """Numbers from a keyed hash of an entity and the attempt."""

    def __init__(self, key: bytes, kind: str, name: str, attempt: int):
        self.seed, self.block, self.pool = (key, f"{kind}\0{name}\0{attempt}".encode()), 0, b""

    def below(self, n: int) -> int:
        while len(self.pool) < 4:
            self.pool += hmac.new(self.seed[0], self.seed[1] + b"\0%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def like(self, c: str) -> str:
        """A character of the same class: digit or letter of the same script; all else stays."""
        if c.isdecimal():
            return digits_like(c, str(self.below(10)))
        if not c.isalpha():
            return c
        script = unicodedata.name(c, "LATIN").split()[0]
        for name, first, count in (("CYRILLIC", 0x430, 32), ("GREEK", 0x3B1, 17), ("HEBREW", 0x5D0, 27), ("CJK", 0x4E00, 3000),
                                   ("HIRAGANA", 0x3042, 80), ("KATAKANA", 0x30A2, 80), ("HANGUL", 0xAC00, 3000), ("ARABIC", 0x627, 20)):
            if script == name:
                return chr(first + self.below(count))
        return chr(97 + self.below(26))


def surrogate(key: bytes, kind: str, name: str, attempt: int) -> str:
    """Canonical surrogate of a canonical entity.

    It has the entity's form, and more characters where that form leaves no other draw or too few: at the end,
    in an e-mail before the ``@``. So there is always an attempt that gives a free one.
    """
    d = Draw(key, kind, name, attempt)
    made = drawn(d, kind, name)
    drawable = name.rpartition(".")[0] if kind == "email" else name
    more = attempt // PATIENCE + (0 if any(c.isalpha() or c.isdecimal() for c in drawable) else BARE)
    if not more:
        return made
    extra = "".join(d.like("0" if kind in ("ip", "card", "phone", "ssn", "iban") else "a") for _ in range(more))
    local, sign, domain = made.rpartition("@") if kind == "email" else (made, "", "")
    return local + extra + sign + domain


def drawn(d: Draw, kind: str, name: str) -> str:
    """The entity's form with its characters drawn anew."""
    if kind == "email":
        local, _, domain = name.rpartition("@")
        host, _, top = domain.rpartition(".")
        return "".join(map(d.like, local)) + "@" + "".join(map(d.like, host)) + "." + top
    if kind == "ip":
        return ".".join(str(1 + d.below(254)) for _ in range(4))
    if kind == "card":
        digits = [int(name[0])] + [d.below(10) for _ in name[1:]]
        if luhn(name) == 0:
            digits[-1] = 0
            digits[-1] = (10 - luhn("".join(map(str, digits)))) % 10
        return "".join(map(str, digits))
    if kind == "iban":
        return name[:2] + "".join(str(d.below(10)) if c.isdigit() else chr(65 + d.below(26)) for c in name[2:])
    if kind == "phone":
        keep = 2 if name.startswith("+") else 0  # sign and first digit of the country code
        return name[:keep] + "".join(map(d.like, name[keep:]))
    if kind in ("given_m", "given_f", "given_n", "surname"):
        return person_name(d, kind, name)
    if kind == "initial" and name.isascii():
        return chr(97 + (ord(name) - 97 + 1 + d.below(25)) % 26)
    return "".join(map(d.like, name))


def person_name(d: Draw, kind: str, name: str) -> str:
    """A pronounceable name in the script of ``name``; given names end as their gender's often do."""
    script = unicodedata.name(name[0], "LATIN").split()[0]
    if script == "LATIN":
        on, mid, ends = "bcdfghklmnprstvw", "aeiou", {"given_f": ("a", "ia", "ine"), "given_m": ("us", "an", "ert")}
    elif script == "CYRILLIC":
        on, mid, ends = "бвгдклмнпрст", "аеиоу", {"given_f": ("на", "ия"), "given_m": ("ан", "ий")}
    else:
        return "".join(map(d.like, name))
    body = "".join(on[d.below(len(on))] + mid[d.below(len(mid))] for _ in range(2 + d.below(2)))
    tail = ends.get(kind, ("n", "r", "l") if script == "LATIN" else ("в", "н"))
    last = on[d.below(len(on))] if kind != "surname" else ""
    return body + last + tail[d.below(len(tail))]


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


def dress(kind: str, value: str, replacement: str) -> str:
    """The canonical surrogate in the spelling of the mention: its separators, and its case."""
    if kind in ("card", "phone", "ssn", "iban"):
        given = iter(replacement)
        return "".join(c if c in " ().-" else digits_like(c, next(given)) for c in value) + digits_like(value[-1], "".join(given))
    if kind == "ip":
        return digits_like(value[0], replacement)
    if kind == "email" and len(value) == len(replacement):
        return "".join(r.upper() if v.isupper() else r for v, r in zip(value, replacement))
    if kind.startswith(("given", "surname", "initial")):
        return replacement.upper() if value.isupper() else replacement[:1].upper() + replacement[1:]
    return replacement


def surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """``family, kind, canonical, surrogate`` of the different entities, one-to-one and none a real entity of any kind.

    Collisions are counted by keyed aggregation over all kinds. The entity with the fewest attempts, then the
    smallest kind and canonical form, keeps a contested surrogate; the others draw again. Every round writes
    a table, which goes with the next. Initials are letters, not entities: they may meet.
    """
    spark = entities.sparkSession
    schema = "kind string, canonical string, attempt int, surrogate string"

    def draw(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [surrogate(key, k, c, a) for k, c, a in zip(*(b.column(i).to_pylist() for i in range(3)))]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.string())], ["kind", "canonical", "attempt", "surrogate"])

        return rows.select("kind", "canonical", "attempt").mapInArrow(run, schema)

    # A name has one surrogate, be it a given name here and a surname there.
    kinds = entities.select("kind", "canonical").distinct().withColumn("family", family(F.col("kind")))
    names = durable(kinds.groupBy("family", "canonical").agg(F.min("kind").alias("kind")))
    real = durable(names.select(F.col("canonical").alias("surrogate"), F.lit(True).alias("real")).distinct())
    table = durable(draw(names.withColumn("attempt", F.lit(0))))
    while True:
        best = table.where("kind <> 'initial'").groupBy("surrogate").agg(F.min(F.struct("attempt", "kind", "canonical")).alias("first"))
        judged = table.join(best, "surrogate", "left").join(real, "surrogate", "left")
        good = F.col("real").isNull() & (F.col("first.canonical") == F.col("canonical")) & (F.col("first.kind") == F.col("kind"))
        good = (F.col("kind") == "initial") | good
        judged = durable(judged.select("kind", "canonical", "attempt", "surrogate", good.alias("good")))
        drop(table)
        if judged.where("not good").isEmpty():
            drop(names, real)
            return judged.select(family(F.col("kind")).alias("family"), "kind", "canonical", "surrogate")
        again = judged.where("not good").withColumn("attempt", F.col("attempt") + 1)
        table = durable(judged.where("good").drop("good").unionByName(draw(again)))
        drop(judged)


def family(kind: Column) -> Column:
    """The kinds of names are one family."""
    return F.when(kind.startswith("given") | (kind == "surname"), "name").otherwise(kind)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row, ``text`` with surrogates, and ``n_entities``.

    Null texts stay null and empty ones empty, with no entity. Rows are told apart by ``keep`` and text, so
    repeated rows have repeated results. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    rows = rows.withColumn("rid", F.concat_ws("-", F.xxhash64("row", "text"), F.xxhash64("text", "row", F.lit(1))))
    maybe = F.coalesce(F.col("text").rlike(MAY_HOLD), F.lit(False))
    some = durable(rows.where(maybe))
    mentions = durable(map_texts(some, ["rid"], "text", ENTITY, lambda: lambda texts: [detect(t) for t in texts], many=True).distinct())
    chosen = durable(surrogates(mentions, key))
    named = mentions.withColumn("family", family(F.col("kind")))
    spans = named.join(chosen.drop("kind"), ["family", "canonical"]).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind", "value", "surrogate"))).alias("spans"))
    joined = some.join(spans, "rid", "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out, at = [], 0
                for s in spans or ():
                    out += [t[at : s["start"]], dress(s["kind"], s["value"], s["surrogate"])]
                    at = s["end"]
                texts.append("".join([*out, t[at:]]))
                counts.append(len(spans or ()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["row", "text", "n_entities"])

    schema = joined.select("row", "text").schema.add("n_entities", "long")
    done = joined.mapInArrow(run, schema)
    plain = rows.where(~maybe).select("row", "text", F.lit(0).cast("long").alias("n_entities"))
    return done.unionByName(plain).select("row.*", "text", "n_entities")
