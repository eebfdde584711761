"""Readers: labelled CSV, uploaded comments, pasted lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civilspark import fixed_values as fixed
from civilspark.functions.regex import NOT_SPACE
from civilspark.functions.text import strip

LABELLED_SCHEMA = (
    f"{fixed.LABELLED_TEXT_COLUMN} string, {fixed.LABELLED_CLASS_COLUMN} string"
)


def read_labelled_csv(
    spark: SparkSession,
    path: str,
    schema: str | None = LABELLED_SCHEMA,
    multi_line: bool = True,
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """CSV with header; quoted fields may hold line breaks and doubled quotes.

    All columns are read as strings; those of ``schema`` are then chosen by name and
    cast, so their order in the file does not matter and a missing one raises.
    ``schema=None`` returns every column.  Files with headers in different orders are
    read by one call each.  Line breaks in fields keep Spark from splitting a file, so
    each file is one task, whatever its size; where the data has none,
    ``multi_line=False`` lets large files be read in parallel.  ``mode`` says what
    happens to malformed rows: nulls (PERMISSIVE), or an error (FAILFAST).
    """
    rows = spark.read.options(
        header=True, multiLine=multi_line, quote='"', escape='"', mode=mode
    ).csv(path)
    if schema is None:
        return rows
    wanted = StructType.fromDDL(schema)
    return rows.select(
        *[F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) for c in wanted]
    )


def resolve_labelled_columns(
    df: DataFrame, text: str = "text", label: str = "label"
) -> DataFrame:
    """Text and class column by name, else by position 0 and 1."""
    names = df.columns
    text_col = (
        fixed.LABELLED_TEXT_COLUMN
        if fixed.LABELLED_TEXT_COLUMN in names
        else names[0]
    )
    label_col = (
        fixed.LABELLED_CLASS_COLUMN
        if fixed.LABELLED_CLASS_COLUMN in names
        else names[1]
    )
    return df.select(
        F.col(f"`{text_col}`").alias(text), F.col(f"`{label_col}`").alias(label)
    )


def detect_text_column(columns: Sequence[str]) -> str:
    """First known comment column, else the first column."""
    for name in fixed.COMMENT_COLUMN_CANDIDATES:
        if name in columns:
            return name
    return columns[0]


def comments_from_table(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` plus ``comment`` from the detected column; missing rows dropped."""
    column = F.col(f"`{detect_text_column(df.columns)}`")
    return df.where(column.isNotNull()).select(
        *keep, column.cast("string").alias("comment")
    )


def lines_to_rows(df: DataFrame, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` plus ``line_no`` and ``comment``: one row per non-blank line.

    ``line_no`` counts all lines of the text from 0, blank ones included.
    """
    lines = df.select(
        *keep, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "_line")
    )
    return lines.where(F.col("_line").rlike(NOT_SPACE)).select(
        *keep, "line_no", strip(F.col("_line")).alias("comment")
    )
