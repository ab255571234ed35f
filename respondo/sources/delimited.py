"""Delimited-text ingest: separator sniffing, one-column repair and
numeric coercion.

Only one line (the header) ever reaches the driver: it decides the
separator and the column names. Parsing is Spark's CSV reader with an
all-string schema (no ``inferSchema`` pass over the data), and typing is a
projection of ``coerce_numeric`` expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from respondo.functions.scalar import coerce_numeric

# Separator preference of the reader (tab, then ';', then ',').
SEPARATORS = ("\t", ";", ",")


def first_line(spark: SparkSession, path: str) -> str | None:
    row = spark.read.text(path).limit(1).first()
    return row[0] if row else None


def sniff_separator(line: str | None, candidates=SEPARATORS) -> str | None:
    """First candidate present in the header line; None = single column."""
    if not line:
        return None
    for sep in candidates:
        if sep in line:
            return sep
    return None


def clean_name(name: str) -> str:
    """``emp.var.rate`` -> ``emp_var_rate`` (dots would need back-ticks)."""
    return name.strip().strip('"').replace(".", "_")


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Header + rows as strings; separator sniffed from the header when not
    given (the reference's tab -> ';' fallback chain, decided from one line
    instead of re-reading the whole file per attempt). A row with more or
    fewer fields than the header is an error, never cut."""
    header = first_line(spark, path)
    if header is None:
        return spark.createDataFrame([], StructType([]))
    sep = sep or sniff_separator(header)
    if sep is None:
        names = [clean_name(header)]
        sep = "\u0001"  # a separator that never occurs: one column
    else:
        names = [clean_name(h) for h in header.split(sep)]
    schema = StructType([StructField(n, StringType(), True) for n in names])
    return spark.read.csv(path, sep=sep, header=True, schema=schema, mode="FAILFAST",
                          enforceSchema=True)


def split_single_column(df: DataFrame, column: str | None = None,
                        sep: str | None = None) -> DataFrame:
    """Repair a table that arrived as one text column ``"a;b;c"``.

    The separator comes from the sample (first) row (``;`` preferred over
    ``,``), the first row's fields become the column names, and every
    row equal to that header line is dropped (each written part file may
    start with it).
    """
    column = column or df.columns[0]
    head = df.select(column).limit(1).first()
    if head is None:
        return df
    line = head[0]
    sep = sep or sniff_separator(line, (";", ","))
    if sep is None:
        raise ValueError("could not determine the delimiter of the single column")
    names = [clean_name(h) for h in line.split(sep)]
    split = F.split(F.col(column), re.escape(sep), -1)
    parts = F.when(F.size(split) == len(names), split).otherwise(F.raise_error(
        F.concat(F.lit(f"expected {len(names)} fields: "), F.col(column))))
    body = df.where(F.col(column) != F.lit(line))
    return body.select(*[parts.getItem(i).alias(n) for i, n in enumerate(names)])


def coerce_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Decimal comma -> point and text -> DOUBLE (bad values -> NULL) for
    the named columns; other columns pass through."""
    wanted = set(columns)
    return df.select(*[coerce_numeric(c).alias(c) if c in wanted else F.col(c)
                       for c in df.columns])


# Numeric columns of the raw contact table (names after
# clean_name), the rest stay strings ("unknown" is a category).
RAW_NUMERIC = ["age", "duration", "campaign", "pdays", "previous", "emp_var_rate",
               "cons_price_idx", "cons_conf_idx", "euribor3m", "nr_employed"]


def read_raw_contacts(spark: SparkSession, path: str) -> DataFrame:
    """The raw contact table (delimited text, e.g. a TSV named ``.xls``):
    sniffed separator, one-column repair when needed, numeric coercion.
    Damaged numbers (spreadsheet dates such as ``1.Oca``) become NULL."""
    df = read_delimited(spark, path)
    if len(df.columns) == 1:
        df = split_single_column(spark.read.text(path), "value")
    nums = [c for c in RAW_NUMERIC if c in df.columns]
    return coerce_columns(df, nums)
