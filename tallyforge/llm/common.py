"""Helpers shared by the operators: declared tables, words, hashes and durable intermediate tables."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyforge.session import ensure_checkpoint_dir
from tallyforge.sources.testdata import table

__all__ = ["BLANKS", "Tables", "WordHashes", "blank_free", "bounded", "drop", "durable", "map_texts", "mix", "signed", "table", "words", "words_of"]

#: ASCII white space: the characters that end a word.
BLANKS = "\x20\t\n\x0b\f\r"
_MAX_CACHED = 1 << 18
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the folder of ``spark.checkpoint.dir`` and read it back.

    The files survive the loss of an executor and are read with column pruning.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table_ = spark.read.schema(df.schema).parquet(path)
    _PATHS[table_] = path
    return table_


def drop(*tables: DataFrame) -> None:
    """Delete the files of durable tables; whatever was made of them must be written by now."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Durable tables that go when the block ends."""

    def __init__(self) -> None:
        self.written: list[DataFrame] = []

    def durable(self, df: DataFrame) -> DataFrame:
        self.written.append(durable(df))
        return self.written[-1]

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        drop(*self.written)
        self.written.clear()


def bounded(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """A written table of a few short columns, to be broadcast if it has at most ``rows`` rows; else joined by key."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array (null text: no words)."""
    single = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * 5)
    return F.array_remove(F.split(single, " "), "")


def blank_free(text: Column) -> Column:
    """The text without its ASCII white space."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def words_of(text: str | None) -> list[bytes]:
    """The same words in UTF-8, with A-Z in lower case; ``bytes`` methods look at ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered; the memory of it is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MAX_CACHED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, found: Iterable[bytes], count: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, count)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise sums of weighted hashes so that their order is random."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)




def map_texts(
    docs: DataFrame, keep: Sequence[str], text: str, fields: str, make: Callable[[], Callable[[list], list]],
    many: bool = False, budget: int = 1 << 20,
) -> DataFrame:
    """Columns ``fields`` computed from texts in tasks, beside the ``keep`` columns as they are.

    ``make()`` is called once per task and gives a function from a list of texts to a list of tuples, one
    per text; with ``many``, to one list of tuples per text. Texts come in slices of about ``budget``
    characters, so memory stays bounded for long ones.
    """
    taken = docs.select(*keep, F.col(text).alias("_text"))
    empty = docs.sparkSession.createDataFrame([], fields).schema
    schema = StructType(taken.schema.fields[:-1] + empty.fields)
    types = to_arrow_schema(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            bounds = np.flatnonzero(np.diff(np.cumsum(size) // budget)) + 1
            for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), batch.num_rows]):
                if a == b:
                    continue
                rows = work(texts[a:b].to_pylist())
                kept = [c[a:b] for c in batch.columns[:-1]]
                if many:
                    at = pa.array(np.repeat(np.arange(b - a), [len(r) for r in rows]))
                    kept = [c.take(at) for c in kept]
                    rows = [x for r in rows for x in r]
                made = [pa.array(list(c), f.type) for f, c in zip(types, zip(*rows))] if rows else [pa.array([], f.type) for f in types]
                yield pa.RecordBatch.from_arrays(kept + made, names=schema.names)

    return taken.mapInArrow(run, schema)
