"""CSV extracts to typed tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_text_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = False, whole: bool = False
) -> DataFrame:
    """Every column as text under its header name; broken lines go to ``_corrupt_record``.

    ``multi_line`` allows line breaks inside quoted cells but makes a file one split.
    ``whole`` reads all cells of a line whichever are asked for, so that every line with the
    wrong number of cells is found.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in [*names, CORRUPT]])
    return (
        reader.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("columnPruning", not whole)
        .csv(path)
    )


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    multi_line: bool = False,
    keep_corrupt: bool = False,
) -> DataFrame:
    """A typed table from CSV; columns are matched to ``schema`` by name.

    Cells that do not parse become NULL. ``keep_corrupt`` keeps the raw text of broken
    lines in a last column.
    """
    raw = read_text_csv(spark, path, multi_line)
    typed = normalize(raw, schema)
    return typed if keep_corrupt else typed.drop(CORRUPT)


def parse_lines(lines: DataFrame, names: Sequence[str], column: str = "value") -> DataFrame:
    """CSV lines without a header, in a column of text, as text columns.

    The same rules as for files: doubled quotes inside quoted cells, and a line with another
    number of cells goes to ``_corrupt_record`` as a whole.
    """
    fields = ", ".join(f"`{n}` STRING" for n in (*names, CORRUPT))
    cells = F.from_csv(F.col(column), F.lit(fields), {
        "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(cells.alias("cells")).select("cells.*")


def read_checked_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, key: str,
    multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """A typed table from CSV and what had to be left out of it (:func:`rejects`)."""
    raw = read_text_csv(spark, path, multi_line, whole=True)
    return normalize(raw, schema).drop(CORRUPT), rejects(raw, schema, key)


def rejects(raw: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """(row, column, cell, reason): every cell of text that is not what ``schema`` says.

    Exactly the cells that are not empty and that :func:`normalize` turns into NULL, with the
    text they held; ``row`` is the text of the row's ``key`` column. A line with the wrong
    number of cells is listed as a whole, its cells are not.
    """
    types = dict(raw.dtypes)
    checked = [f for f in schema.fields if f.name in types
               and types[f.name] != f.dataType.simpleString()]
    broken = F.col(CORRUPT).isNotNull() if CORRUPT in types else F.lit(False)
    found = [F.when(broken, _reject(key, CORRUPT, F.col(CORRUPT), "wrong number of cells"))] \
        if CORRUPT in types else []
    for f in checked:
        cell = F.col(f"`{f.name}`")
        text = empty_to_null(cell.cast("string"))
        bad = ~broken & text.isNotNull() & _typed(cell, types[f.name], f.dataType).isNull()
        found.append(F.when(bad, _reject(key, f.name, text, REASONS.get(
            f.dataType.simpleString(), f"not a {f.dataType.simpleString()}"))))
    if not found:
        return raw.sparkSession.createDataFrame(
            [], "row string, column string, cell string, reason string")
    return raw.select(F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


#: Why a cell is not of a type.
REASONS = {"boolean": "not a flag", "int": "not a whole number", "double": "not a number",
           "timestamp": "not a time", "date": "not a date"}


def _reject(key: str, column: str, cell: Column, reason: str) -> Column:
    return F.struct(F.col(f"`{key}`").cast("string").alias("row"), F.lit(column).alias("column"),
                    cell.alias("cell"), F.lit(reason).alias("reason"))


def normalize(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` in its types; other columns follow unchanged.

    Empty text becomes NULL before anything is tested, flags become booleans, and
    columns absent from ``df`` become NULL.
    """
    types = dict(df.dtypes)
    typed = [
        (_typed(F.col(f.name), types[f.name], f.dataType) if f.name in types
         else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    known = set(schema.fieldNames())
    return df.select(*typed, *[F.col(c) for c in df.columns if c not in known])


def normalize_flags(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df`` with the named flag columns as booleans."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: _typed(F.col(c), types[c], T.BooleanType()) for c in columns if c in types}
    )


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def parse_flag(text: Column) -> Column:
    """Boolean of ``True``, ``false``, ``1``, ``0``, ``t``, ``no`` and the like, else NULL."""
    return text.try_cast("boolean")


def number_flag(number: Column) -> Column:
    """Boolean of 1 and 0; any other number is no flag: NULL."""
    return F.when(number == 1, F.lit(True)).when(number == 0, F.lit(False))


def _typed(column: Column, source: str, target: T.DataType) -> Column:
    if source == target.simpleString():
        return empty_to_null(column) if source == "string" else column
    if isinstance(target, T.BooleanType):
        return parse_flag(empty_to_null(column)) if source == "string" else number_flag(column)
    if source != "string":
        if isinstance(target, T.TimestampType) and source == "timestamp_ntz":
            return column
        return column.cast(target) if isinstance(target, T.StringType) else column.try_cast(target)
    text = empty_to_null(column)
    if isinstance(target, T.IntegerType):
        # Integers with gaps are often written as 3.0; a number with a fraction is none.
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number).try_cast(target)
    return text.try_cast(target)
