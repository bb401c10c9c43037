"""Reading and writing tables of text cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, IntegralType, StringType, StructField, StructType

from ..functions.numbers import plain_decimal
from .schemas import TABLES


def typed(df: DataFrame, schema: StructType, strict: bool = True) -> DataFrame:
    """Text cells to typed columns: empty is null, a flag is true only for ``true``.

    A bad number stops the job when ``strict``; otherwise it becomes null so that a
    check can count it.
    """
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        cell = F.nullif(F.col(f.name), F.lit(""))
        if isinstance(f.dataType, BooleanType):
            value: Column = F.coalesce(cell == "true", F.lit(False))
        else:
            value = cell.cast(f.dataType) if strict else cell.try_cast(f.dataType)
        out.append(value.alias(f.name))
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    return df.select(*out, *extra)


#: Cells may hold quotes, written twice, and line breaks.
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def read_text_table(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Headed CSVs with every cell as text, matched by column name; a column that a path lacks is null there.

    Each path (a file or a folder of files, patterns allowed) has one header; a file
    of a folder with another one is an error. Spark keeps no input order, so
    ``file_ordinal`` records it: the block's offset in its file (in MiB) above the row's
    position in the task that read it. It orders the rows of one file.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in _resolved(spark, [paths] if isinstance(paths, str) else list(paths)):
        header = tuple(spark.read.options(**CSV).csv(path).columns)
        by_header.setdefault(header, []).append(path)
    parts = []
    for header, found in by_header.items():
        schema = StructType([StructField(c, StringType()) for c in header])
        df = spark.read.options(**CSV).option("enforceSchema", False).schema(schema).csv(found)
        block = F.shiftleft(F.expr("_metadata.file_block_start div 1048576"), 33)
        parts.append(df.withColumn(
            "file_ordinal", block.bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _resolved(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """The paths that patterns stand for, listed without reading the files: one per CSV file or folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(patterns)).select("path")
    one = F.regexp_replace("path", r"(\.csv)/.*$", "$1")
    return sorted(r[0] for r in files.select(one.alias("path")).distinct().collect())


def load_tables(spark: SparkSession, folder: str, names=tuple(TABLES), elections=("*",)) -> dict[str, DataFrame]:
    """Typed tables ``folder/<election>/<name>.csv``, all elections in one DataFrame each.

    Names without any file are left out; no table at all is an error.
    """
    out: dict[str, DataFrame] = {}
    for name in names:
        try:
            cells = read_text_table(spark, [f"{folder}/{e}/{name}.csv" for e in elections])
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out[name] = typed(cells, TABLES[name])
    if not out:
        raise FileNotFoundError(f"no table below {folder}")
    return out


def rendered(df: DataFrame) -> DataFrame:
    """All columns as text: plain decimals, lower-case flags, null as empty."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, DecimalType):
            text = plain_decimal(c)
        elif isinstance(f.dataType, BooleanType):
            text = F.when(c, "true").otherwise(F.when(c.isNotNull(), "false"))
        elif isinstance(f.dataType, IntegralType):
            text = c.cast("string")
        else:
            text = c.cast("string")
        cols.append(F.coalesce(text, F.lit("")).alias(f.name))
    return df.select(*cols)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write as headed CSV, one file per partition; an empty table is refused."""
    if df.isEmpty():
        raise ValueError(f"refusing to write zero rows to {path}")
    rendered(df).write.mode(mode).options(header=True, quote='"', escape='"', emptyValue="").csv(path)
