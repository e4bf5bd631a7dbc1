"""Delimited, JSON and Parquet files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sets import bind_rows

# zone-free timestamps keep their microseconds in text files
NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_delimited(
    spark: SparkSession, path, schema: T.StructType | str | None = None, delimiter: str = ",", null_text: str = "",
    empty_text: str | None = None, multi_line: bool = False, line_end: str | None = None,
) -> DataFrame:
    """Header row; give a schema for large inputs, inference costs a full extra read.

    ``multi_line`` reads quoted values with line breaks; such a file is one task's work, so write many.
    Line ends are found by the reader, in Windows files too; ``line_end`` fixes them ("\\n" for files that
    :func:`write_delimited` wrote, so that other line ends inside values stay as they are).
    A value equal to ``null_text`` is missing, one equal to ``empty_text`` is the empty text.  With a
    schema, a row that does not fit it is an error, never a row of nulls.
    """
    reader = spark.read.option("header", True).option("sep", delimiter).option("nullValue", null_text)
    reader = reader.option("escape", '"').option("timestampNTZFormat", NTZ_FORMAT).option("multiLine", multi_line)
    if empty_text is not None:
        reader = reader.option("emptyValue", empty_text)
    if line_end is not None:
        reader = reader.option("lineSep", line_end)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.option("mode", "FAILFAST").schema(schema).csv(path)


def write_delimited(
    df: DataFrame, path: str, delimiter: str = ",", mode: str = "errorifexists", null_text: str = "", empty_text: str = '""'
) -> str:
    """Header row; white space at the ends of a value is kept, missing and empty text are told apart."""
    writer = df.write.mode(mode).option("header", True).option("sep", delimiter).option("escape", '"').option("timestampNTZFormat", NTZ_FORMAT)
    writer = writer.option("nullValue", null_text).option("emptyValue", empty_text)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Replace struct columns by their fields, at any depth, names joined by ``separator``."""
    def leaves(fields, prefix, names):
        for f in fields:
            path, label = prefix + [f.name], names + [f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, path, label)
            else:
                quoted = ".".join(f"`{p}`" for p in path)
                yield F.col(quoted).alias(separator.join(label))

    return df.select(*leaves(df.schema.fields, [], []))


def read_json(
    spark: SparkSession, path, schema: T.StructType | str | None = None, multi_line: bool = True, separator: str = "_"
) -> DataFrame:
    """All JSON files of a folder as one flat table.

    ``multi_line`` reads files that hold one JSON array each; record-per-line files should
    use ``multi_line=False`` so that large files split.
    """
    reader = spark.read.option("multiLine", multi_line).option("timestampNTZFormat", NTZ_FORMAT)
    return flatten((reader.schema(schema) if schema is not None else reader).json(path), separator)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("timestampNTZFormat", NTZ_FORMAT).json(path)
    return path


def write_by_year(df: DataFrame, path: str, year: str = "year", mode: str = "errorifexists") -> str:
    """Parquet with one folder per year, so a season filter skips whole folders."""
    df.write.mode(mode).partitionBy(year).parquet(path)
    return path


def read_seasons(spark: SparkSession, path: str, first: int, last: int, year: str = "year") -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path).where(F.col(year).between(first, last))


def read_many(spark: SparkSession, paths: Sequence[str], schema=None) -> DataFrame:
    """Several delimited extracts bound by column name."""
    return bind_rows(*[read_delimited(spark, p, schema) for p in paths])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
